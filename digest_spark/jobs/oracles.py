"""SQL for the registered queries, over the test tables."""

from __future__ import annotations

from digest_spark.functions.text import EXCLUDED_TITLE_WORDS, NEGATIVE_WORDS
from digest_spark.jobs.views import AS_OF, DICTIONARY, LANGUAGES, TOPICS
from digest_spark.operators.triage import TRIAGE_PROMPT


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rows(data: tuple[tuple[str, ...], ...]) -> str:
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in data)


def alternation(words: tuple[str, ...]) -> str:
    return quoted("|".join(words))


NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

RESPONSES = """
all_responses AS (
    SELECT o_orderkey AS response_seq,
           CASE WHEN o_orderkey % 97 <> 0 THEN 'user' || o_custkey || '@example.com' END AS email,
           CAST(o_orderdate AS TIMESTAMP) AS modified,
           CASE WHEN o_orderkey % 11 = 0 THEN CAST([] AS VARCHAR[])
                WHEN o_orderkey % 3 = 0 THEN [o_orderpriority] WHEN o_orderkey % 3 = 1 THEN [o_orderpriority, o_orderstatus] ELSE [o_orderstatus, 'Other'] END AS categories,
           CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 4 = 0 THEN CAST([] AS VARCHAR[])
                WHEN o_orderkey % 4 = 1 THEN ['English'] WHEN o_orderkey % 4 = 2 THEN ['English', 'Deutsch'] ELSE ['Deutsch', 'Klingon'] END AS languages
    FROM orders
), people AS (
    SELECT response_seq, email, modified, categories, CASE WHEN len(languages) = 0 THEN ['English'] ELSE languages END AS languages
    FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY modified DESC, response_seq) AS r FROM all_responses WHERE email IS NOT NULL) WHERE r = 1
)"""
PROFILES = f"""{RESPONSES}, lang_map AS (SELECT * FROM (VALUES {rows(LANGUAGES)}) t(lang_name, lang_code)
), dict AS (SELECT * FROM (VALUES {rows(DICTIONARY)}) t(lang_code, category, value)
), langs AS (
    SELECT email, lang_pos, lang_code, categories
    FROM (SELECT email, categories, unnest(languages) AS lang_name, CAST(generate_subscripts(languages, 1) - 1 AS INTEGER) AS lang_pos FROM people) JOIN lang_map USING (lang_name)
), cats AS (
    SELECT email, lang_pos, lang_code, unnest(categories) AS category, CAST(generate_subscripts(categories, 1) - 1 AS INTEGER) AS cat_pos FROM langs
), terms AS (
    SELECT email, lang_pos, cat_pos, lang_code, coalesce(nullif(value, ''), category) AS term FROM cats LEFT JOIN dict USING (lang_code, category)
), searches AS (
    SELECT email, lang_pos, lang_code, string_agg('"' || term || '"', ' OR ' ORDER BY cat_pos) AS query_string FROM terms GROUP BY ALL
)"""
ARTICLES = """
articles AS (
    SELECT doc_id AS article_pos, substring(flat, 1, 80) AS title, substring(flat, 81) AS description,
           'https://' || source || '.example.com/' || doc_id AS url, source AS publisher, lang,
           TIMESTAMP '2023-12-31 06:00:00' + to_minutes(CAST((doc_id * 7919) % 4320 AS BIGINT)) AS published_ts, source || '|' || lang AS topic_key
    FROM (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM documents)
), dated AS (
    SELECT *, strftime(published_ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS published_raw, strftime(published_ts - INTERVAL 3 HOUR, '%d/%m/%Y %H:%M') AS local_time FROM articles
), listed AS (
    SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY article_pos) - 1 AS pos FROM dated
)"""
BATCHED = f"""{ARTICLES}, batched AS (
    SELECT *, CAST(r // 30 AS BIGINT) AS batch_no, CAST(r % 30 AS BIGINT) AS idx
    FROM (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY topic_key ORDER BY article_pos) - 1 AS r
          FROM listed WHERE NOT regexp_matches(lower(title), {alternation(NEGATIVE_WORDS)}))
), lists AS (
    SELECT topic_key, batch_no, count(*) AS n, string_agg('ID ' || idx || ': ' || replace(title, chr(10), ' ') || chr(10), '' ORDER BY idx) AS lines FROM batched GROUP BY ALL
), replies AS (
    SELECT topic_key, batch_no, CASE (length(topic_key) + batch_no) % 4 WHEN 0 THEN '0, 2, 2, 99' WHEN 1 THEN 'NULL' WHEN 2 THEN 'Relevant: 1, 3, 5 and 29.' END AS reply FROM lists
), ids AS (
    SELECT topic_key, batch_no, CASE WHEN contains(lower(reply), 'null') THEN CAST([] AS INTEGER[]) ELSE CAST(regexp_extract_all(reply, '\\b\\d+\\b') AS INTEGER[]) END AS ids FROM replies
), named AS (
    SELECT topic_key, batch_no, CAST(unnest(ids) AS BIGINT) AS idx, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS reply_pos FROM ids
), approved AS (
    SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY batch_no, reply_pos) - 1 AS pos FROM batched JOIN named USING (topic_key, batch_no, idx)
)"""
REPLY_CASE = """CASE (length(topic_key) * 5 + ascii(substring(topic_key, 4, 1)) + ascii(substring(topic_key, length(topic_key), 1))) % 6
    WHEN 0 THEN '```json' || chr(10) || '[[0, 2], [1]]' || chr(10) || '```' WHEN 1 THEN 'So: [[0, "1", 2.5], [9999], [3, 4]] done' WHEN 2 THEN '[]'
    WHEN 3 THEN 'broken [[0, ' WHEN 4 THEN '[[1, 0], [0, 3]]' ELSE '[0, 1]' END"""
GROUPS = f"""{BATCHED}, keys AS (
    SELECT DISTINCT topic_key FROM listed
), said AS (
    SELECT topic_key, {REPLY_CASE} AS reply FROM keys
), bare AS (
    SELECT topic_key, trim(replace(replace(reply, '```json', ''), '```', ''), ' ' || chr(10)) AS b FROM said
), cut AS (
    SELECT topic_key, coalesce(nullif(regexp_extract(b, '(?s)\\[\\[.*\\]\\]', 0), ''), b) AS j FROM bare
), parsed AS (
    SELECT topic_key, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS v FROM cut
), outer_items AS (
    SELECT topic_key, unnest(CAST(v AS JSON[])) AS g, CAST(generate_subscripts(CAST(v AS JSON[]), 1) - 1 AS BIGINT) AS group_pos FROM parsed WHERE json_type(v) = 'ARRAY'
), state AS (
    SELECT topic_key, coalesce(json_type(v) IN ('ARRAY', 'OBJECT', 'VARCHAR'), FALSE)
           AND topic_key NOT IN (SELECT topic_key FROM outer_items WHERE json_type(g) NOT IN ('ARRAY', 'OBJECT', 'VARCHAR')) AS usable FROM parsed
), members AS (
    SELECT topic_key, group_pos, member_pos, CAST(m AS BIGINT) AS id
    FROM (SELECT topic_key, group_pos, unnest(CAST(g AS JSON[])) AS m, CAST(generate_subscripts(CAST(g AS JSON[]), 1) - 1 AS BIGINT) AS member_pos FROM outer_items WHERE json_type(g) = 'ARRAY')
    WHERE json_type(m) IN ('UBIGINT', 'BIGINT')
), groups AS (
    SELECT topic_key, group_pos, member_pos, CASE WHEN usable THEN id END AS id, usable FROM state LEFT JOIN members USING (topic_key)
), ranked AS (
    SELECT topic_key, group_pos, g.id AS pos, row_number() OVER (PARTITION BY topic_key, group_pos ORDER BY length(title) DESC, member_pos) - 1 AS member_pos
    FROM groups g JOIN listed l USING (topic_key) WHERE usable AND g.id = l.pos
), alone AS (
    SELECT topic_key, pos FROM listed JOIN state USING (topic_key) WHERE usable AND (topic_key, pos) NOT IN (SELECT (topic_key, pos) FROM ranked)
), heads AS (
    SELECT topic_key, late, spot, row_number() OVER (PARTITION BY topic_key ORDER BY late, spot) - 1 AS cluster_pos
    FROM (SELECT DISTINCT topic_key, 0 AS late, group_pos AS spot FROM ranked UNION ALL SELECT topic_key, 1, pos FROM alone)
), clusters AS (
    SELECT ranked.topic_key, cluster_pos, member_pos, pos FROM ranked JOIN heads ON heads.topic_key = ranked.topic_key AND late = 0 AND spot = group_pos
    UNION ALL SELECT alone.topic_key, cluster_pos, 0, pos FROM alone JOIN heads ON heads.topic_key = alone.topic_key AND late = 1 AND spot = pos
)"""
EVENTS = f"""{PROFILES}, {ARTICLES.strip()}, ledger AS (
    SELECT url AS link FROM articles WHERE article_pos % 7 = 0
), events AS (
    SELECT article_pos AS event_id, topic_key, article_pos AS cluster_pos, title, url AS link, split_part(description, '.', 1) AS summary, local_time, publisher FROM listed
), quoted AS (
    SELECT email, lang_pos, lang_code AS lang, regexp_extract_all(query_string, '"(.*?)"', 1) AS t FROM searches
), profile_terms AS (
    SELECT email, lang_pos, lang, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS term_pos FROM quoted
), fresh AS (
    SELECT * FROM events WHERE link NOT IN (SELECT link FROM ledger)
), sighted AS (
    SELECT email, link, event_id, lang_pos, term_pos, cluster_pos, {{'l': lang_pos, 't': term_pos, 'c': cluster_pos}} AS ord FROM profile_terms p JOIN fresh e ON e.topic_key = p.term || '|' || p.lang
), chosen AS (
    SELECT email, link, min(ord) AS ord, arg_max(event_id, ord) AS event_id FROM sighted GROUP BY ALL
), items AS (
    SELECT event_id, '<section><h2><a href="' || link || '">' || title || '</a></h2><p>' || coalesce(summary, '') || '</p><p>Publicado em: ' || local_time || ' por <b>' || publisher || '</b></p></section>' AS item FROM events
)"""
TOPIC_ROWS = f"""topics AS (SELECT * FROM (VALUES {rows(TOPICS)}) t(term, lang)
), sought AS (
    SELECT article_pos, lang, ' ' || {NORM.format("title || ' ' || description")} || ' ' AS words FROM articles
)"""
ANY = f"""{ARTICLES}, {TOPIC_ROWS}, wanted AS (
    SELECT term, lang, {NORM.format("p")} AS phrase FROM (SELECT term, lang, unnest(string_split(term, ' OR ')) AS p FROM topics)
), hits AS (
    SELECT DISTINCT term, lang, article_pos FROM sought JOIN wanted USING (lang) WHERE contains(words, ' ' || phrase || ' ')
)"""
PAGES = """pp AS (
    SELECT page_id, url, html, CASE page_id % 10 WHEN 3 THEN 'application/pdf' WHEN 7 THEN 'image/PNG' ELSE 'text/html; charset=utf-8' END AS content_type,
           CASE WHEN page_id % 4 = 0 THEN 'https://news.google.com/rss/' || page_id ELSE url END AS raw FROM pages
)"""
#: What one reply of views.same_initial to a topic's whole list says.
JUDGED = f"""{ARTICLES}, sized AS (
    SELECT *, lower(substring(title, 1, 1)) AS event, count(*) OVER e AS n, min(pos) OVER e AS first FROM listed WINDOW e AS (PARTITION BY topic_key, lower(substring(title, 1, 1)))
), judged AS (
    SELECT topic_key, dense_rank() OVER (PARTITION BY topic_key ORDER BY n = 1, first) - 1 AS cluster_pos, row_number() OVER (PARTITION BY topic_key, event ORDER BY length(title) DESC, pos) - 1 AS member_pos, pos FROM sized
)"""
TITLE_SUFFIX = "CASE WHEN article_pos % 2 = 0 THEN title || ' - ' || publisher ELSE '  ' || title || ' | ' || description END"
#: A run over clustered events: every second headline is relevant, a summary is the text's first twelve words, the same initial is the same event.
RUN = f"""{PROFILES}, {BATCHED.strip()}, listed2 AS (
    SELECT topic_key, title, url AS link, publisher, local_time, trim(array_to_string(list_filter(string_split_regex(description, '\\s+'), lambda x: x <> '')[1:12], ' '), '"') AS summary,
           row_number() OVER (PARTITION BY topic_key ORDER BY batch_no, idx) - 1 AS pos
    FROM batched WHERE idx % 2 = 0 AND length(description) > 80
), sized AS (
    SELECT *, lower(substring(title, 1, 1)) AS event, count(*) OVER e AS n, min(pos) OVER e AS first FROM listed2 WINDOW e AS (PARTITION BY topic_key, lower(substring(title, 1, 1)))
), judged AS (
    SELECT *, dense_rank() OVER (PARTITION BY topic_key ORDER BY n = 1, first) - 1 AS cluster_pos, row_number() OVER (PARTITION BY topic_key, event ORDER BY length(title) DESC, pos) - 1 AS member_pos FROM sized
), also AS (
    SELECT topic_key, cluster_pos, string_agg('<a href="' || link || '">' || publisher || '</a>', ', ' ORDER BY member_pos) AS also FROM judged WHERE member_pos > 0 GROUP BY ALL
), events AS (
    SELECT j.topic_key || '#' || j.cluster_pos AS event_id, j.topic_key, j.cluster_pos, link, '<section><h2><a href="' || link || '">' || title || '</a></h2><p>' || summary || '</p><p>Publicado em: ' || local_time || ' por <b>' || publisher || '</b></p>'
           || coalesce('<p>Também visto em: ' || also || '</p>', '') || '</section>' AS item
    FROM judged j LEFT JOIN also a ON a.topic_key = j.topic_key AND a.cluster_pos = j.cluster_pos WHERE member_pos = 0
), fresh AS (
    SELECT * FROM events WHERE link NOT IN (SELECT url FROM articles WHERE article_pos % 7 = 0)
), quoted AS (
    SELECT email, lang_pos, lang_code AS lang, regexp_extract_all(query_string, '"(.*?)"', 1) AS t FROM searches
), profile_terms AS (
    SELECT email, lang_pos, lang, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS term_pos FROM quoted
), chosen AS (
    SELECT email, link, min({{'l': lang_pos, 't': term_pos, 'c': cluster_pos}}) AS ord, arg_max(event_id, {{'l': lang_pos, 't': term_pos, 'c': cluster_pos}}) AS event_id
    FROM profile_terms p JOIN fresh e ON e.topic_key = p.term || '|' || p.lang GROUP BY ALL
), d AS (
    SELECT c.email, count(*) AS n, string_agg(item, '' ORDER BY ord) AS body, string_agg(c.link, ' ' ORDER BY ord) AS links FROM chosen c JOIN fresh f ON f.event_id = c.event_id GROUP BY c.email
)"""

ORACLES = {
    "valid_responses": f"WITH {RESPONSES} SELECT response_seq, email, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified FROM all_responses WHERE email IS NOT NULL",
    "choices": f"WITH {RESPONSES} SELECT response_seq, array_to_string(categories, ',') AS categories, CAST(len(categories) AS INTEGER) AS n FROM all_responses",
    "default_languages": f"WITH {RESPONSES} SELECT response_seq, CASE WHEN len(languages) = 0 THEN 'English' ELSE array_to_string(languages, ',') END AS languages FROM all_responses",
    "latest_by_email": f"WITH {RESPONSES} SELECT email, response_seq, strftime(modified, '%Y-%m-%d') AS modified FROM people",
    "map_languages": f"WITH {PROFILES} SELECT email, lang_pos, lang_code FROM langs",
    "map_categories": f"WITH {PROFILES} SELECT email, lang_pos, cat_pos, lang_code, term FROM terms",
    "build_queries": f"WITH {PROFILES} SELECT email, lang_pos, lang_code, query_string FROM searches",
    "build_profiles": f"""WITH {PROFILES}, s AS (SELECT email, string_agg(lang_code || '=' || query_string, ';' ORDER BY lang_pos) AS s FROM searches GROUP BY email)
        SELECT email, array_to_string(categories, ',') AS keywords, coalesce(s, '') AS searches FROM people LEFT JOIN s USING (email)""",
    "extract_terms": f"WITH {EVENTS} SELECT email, lang_pos, term_pos, term, lang FROM profile_terms",
    "search_plan": f"WITH {EVENTS} SELECT DISTINCT term, lang, term || '|' || lang AS topic_key FROM profile_terms",
    "recent": f"WITH {ARTICLES} SELECT article_pos, strftime(published_ts, '%Y-%m-%d %H:%M') AS published FROM articles WHERE published_ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND published_ts <= TIMESTAMP '{AS_OF}'",
    "match_topics_phrase": f"WITH {ARTICLES}, {TOPIC_ROWS} SELECT DISTINCT term, lang, article_pos FROM sought JOIN topics USING (lang) WHERE contains(words, ' ' || {NORM.format('term')} || ' ')",
    "match_topics_any": f"WITH {ANY} SELECT * FROM hits",
    "match_topics_ngrams": f"WITH {ANY} SELECT * FROM hits",
    "group_by_topic": f"""WITH {ANY}, placed AS (SELECT term || '|' || lang AS topic_key, article_pos, (row_number() OVER (PARTITION BY term, lang ORDER BY article_pos) - 1) // 1000 AS page FROM hits),
        grouped AS (SELECT topic_key, page, count(*) AS n, string_agg(article_pos, ',' ORDER BY article_pos) AS articles FROM placed GROUP BY ALL)
        SELECT t.term || '|' || t.lang AS topic_key, CAST(coalesce(page, 0) AS BIGINT) AS page, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(articles, '') AS articles FROM topics t LEFT JOIN grouped g ON g.topic_key = t.term || '|' || t.lang""",
    "split_topic_key": f"WITH {ARTICLES} SELECT article_pos, publisher AS term, CASE WHEN article_pos % 5 = 0 THEN 'pt' ELSE lang END AS lang FROM articles",
    "drop_negative": f"WITH {ARTICLES} SELECT article_pos, title FROM articles WHERE NOT regexp_matches(lower(title), {alternation(NEGATIVE_WORDS)})",
    "drop_excluded": f"WITH {ARTICLES} SELECT article_pos, title FROM articles WHERE NOT regexp_matches(lower(title), {alternation(('heed', *EXCLUDED_TITLE_WORDS))})",
    "assign_batches": f"WITH {BATCHED} SELECT topic_key, article_pos, batch_no, idx FROM batched",
    "batch_headlines": f"WITH {BATCHED} SELECT * FROM lists",
    "with_prompt": f"WITH {BATCHED} SELECT topic_key, batch_no, printf({quoted(TRIAGE_PROMPT)}, string_split(topic_key, '|')[1], lines) AS prompt FROM lists",
    "text_or_description": f"""WITH {ARTICLES} SELECT * FROM (SELECT article_pos, CASE WHEN article_pos % 3 = 0 THEN 'page ' || title WHEN length(description) > 80 THEN description END AS text FROM articles) WHERE text IS NOT NULL""",
    "normalize_title": f"""WITH {ARTICLES}, p AS (SELECT article_pos, trim(regexp_replace({TITLE_SUFFIX}, '\\s+', ' ', 'g')) AS t FROM articles), q AS (SELECT article_pos, t, string_split_regex(t, ' [-|] ') AS x FROM p)
        SELECT article_pos, trim(lower(CASE WHEN len(x) > 1 AND length(x[len(x)]) <= 40 THEN array_to_string(x[1 : len(x) - 1], ' ') ELSE t END)) AS norm FROM q""",
    "clean_title": f"WITH {ARTICLES} SELECT article_pos, title FROM articles",
    "format_published": f"""WITH {ARTICLES} SELECT article_pos, CASE article_pos % 10 WHEN 4 THEN 'Data não disponível' WHEN 5 THEN published_raw || '+1' ELSE local_time END AS published FROM listed""",
    "summary_language": f"WITH {ARTICLES} SELECT article_pos, CASE lang WHEN 'en' THEN 'Inglês' WHEN 'de' THEN 'Alemão' ELSE 'Português' END AS language FROM articles",
    "cluster_headlines": f"""WITH {ARTICLES} SELECT topic_key, CAST(pos // 200 AS BIGINT) AS part, count(*) AS n,
        string_agg('[' || pos || '] ' || replace(title, chr(10), ' ') || ' || ' || substring(description, 1, 60) || '...' || chr(10), '' ORDER BY pos) AS lines FROM listed GROUP BY ALL""",
    "parse_relevant_ids": f"WITH {BATCHED} SELECT topic_key, batch_no, array_to_string(ids, ',') AS ids FROM ids",
    "select_approved": f"WITH {BATCHED} SELECT topic_key, pos, article_pos, batch_no, reply_pos FROM approved",
    "clean_summary": f"""WITH {ARTICLES} SELECT article_pos, trim(trim(' "' || description || '"" ' || chr(10), ' ' || chr(10)), '"') AS summary FROM articles""",
    "parse_groups": f"WITH {GROUPS} SELECT topic_key, group_pos, member_pos, id, usable FROM groups",
    "rank_members": f"""WITH {GROUPS} SELECT topic_key, group_pos, pos, row_number() OVER (PARTITION BY topic_key, group_pos ORDER BY length(t) DESC, member_pos) - 1 AS rank
        FROM (SELECT g.topic_key, group_pos, g.id AS pos, g.member_pos, substring(title, 1, CAST(80 - article_pos % 3 * 5 AS INTEGER)) AS t FROM groups g JOIN listed l ON l.topic_key = g.topic_key AND l.pos = g.id WHERE usable)""",
    "cluster_from_groups": f"WITH {GROUPS} SELECT * FROM clusters",
    "cluster_judged": f"WITH {JUDGED} SELECT * FROM judged",
    "judge_groups": f"""WITH {ARTICLES}, e AS (SELECT topic_key, CAST(pos // 200 AS BIGINT) AS part, lower(substring(title, 1, 1)) AS event, count(*) AS n, min(pos) AS first, string_agg(pos, ', ' ORDER BY pos) AS ids FROM listed GROUP BY ALL)
        SELECT topic_key, part, '[' || coalesce(string_agg('[' || ids || ']', ', ' ORDER BY first) FILTER (WHERE n > 1), '') || ']' AS reply FROM e GROUP BY topic_key, part HAVING sum(n) > 1""",
    "score_batches": f"WITH {BATCHED} SELECT topic_key, batch_no, array_to_string(generate_series(0, n - 1, 2), ', ') AS reply FROM lists",
    "summarize": f"""WITH {ARTICLES} SELECT article_pos, trim(array_to_string(list_filter(string_split_regex(description, '\\s+'), lambda x: x <> '')[1:12], ' '), '"') AS summary FROM articles""",
    "enriched_articles": f"""WITH {BATCHED} SELECT topic_key, article_pos, title, url AS link, trim(trim(description), '"') AS summary, published_raw, publisher FROM approved""",
    "is_final_url": f"WITH {PAGES} SELECT page_id, NOT contains(raw, 'google.com') AS final FROM pp",
    "is_text_content": f"WITH {PAGES} SELECT page_id, NOT (contains(lower(content_type), 'application/pdf') OR contains(lower(content_type), 'image')) AS is_text FROM pp",
    "resolve_urls": f"WITH {PAGES} SELECT page_id, url AS link FROM pp WHERE page_id % 4 <> 0 OR page_id % 8 = 0",
    "gate_text": f"WITH {PAGES} SELECT page_id, CASE WHEN length(html) > 300 THEN substring(html, 1, 2500) END AS text FROM pp",
    "fan_out": f"WITH {EVENTS} SELECT email, link, event_id, lang_pos, term_pos, cluster_pos FROM profile_terms p JOIN events e ON e.topic_key = p.term || '|' || p.lang",
    "fan_out_shares": f"WITH {EVENTS} SELECT email, link, event_id, lang_pos, term_pos, cluster_pos FROM profile_terms p JOIN events e ON e.topic_key = p.term || '|' || p.lang",
    "topic_map": f"WITH {ARTICLES} SELECT topic_key, CAST(pos AS INTEGER) AS pos, title, url FROM listed",
    "new_events": f"WITH {EVENTS} SELECT event_id, topic_key, link FROM fresh",
    "dedupe_events": f"WITH {EVENTS} SELECT email, link, ord.l AS lang_pos, ord.t AS term_pos, ord.c AS cluster_pos, event_id FROM chosen",
    "also_seen": f"""WITH {GROUPS}, m AS (SELECT c.*, CASE WHEN article_pos % 9 <> 0 THEN url END AS link, CASE WHEN article_pos % 8 <> 0 THEN publisher END AS publisher FROM clusters c JOIN listed l ON l.topic_key = c.topic_key AND l.pos = c.pos)
        SELECT topic_key, cluster_pos, coalesce(string_agg('<a href="' || coalesce(link, '#') || '">' || coalesce(publisher, 'Fonte') || '</a>', ', ' ORDER BY member_pos) FILTER (WHERE member_pos > 0), '') AS also FROM m GROUP BY ALL""",
    "render_items": f"WITH {EVENTS} SELECT event_id, item FROM items",
    "digest_run": f"""WITH {RUN} SELECT email, 'AUTOMÁTICO | Boletim (02/01/2024)' AS subject, '<html><body><h1>Boletim: últimas 24h</h1><p>Suas preferências: ' || array_to_string(categories, ', ') || '</p>' || body || '<p>Termos filtrados: {", ".join(EXCLUDED_TITLE_WORDS)}.</p></body></html>' AS html,
               CAST(n AS INTEGER) AS n_events, links FROM d JOIN people USING (email)""",
    "assemble_digest": f"""WITH {EVENTS}, d AS (SELECT email, count(*) AS n, string_agg(item, '' ORDER BY ord) AS body, string_agg(link, ' ' ORDER BY ord) AS links FROM chosen JOIN items USING (event_id) GROUP BY email)
        SELECT email, 'AUTOMÁTICO | Boletim (02/01/2024)' AS subject, '<html><body><h1>Boletim: últimas 24h</h1><p>Suas preferências: ' || array_to_string(categories, ', ') || '</p>' || body || '<p>Termos filtrados: {", ".join(EXCLUDED_TITLE_WORDS)}.</p></body></html>' AS html,
               CAST(n AS INTEGER) AS n_events, links FROM d JOIN people USING (email)""",
    "ledger_append": f"WITH {EVENTS} SELECT DISTINCT link FROM (SELECT link FROM chosen UNION ALL SELECT url FROM articles) WHERE link NOT IN (SELECT link FROM ledger)",
    "topic_funnel": f"""WITH {GROUPS}, t AS (
            SELECT topic_key, 1 AS a, 0 AS b, 0 AS c, 0 AS d FROM listed UNION ALL SELECT topic_key, 0, 1, 0, 0 FROM batched
            UNION ALL SELECT topic_key, 0, 0, 1, 0 FROM approved UNION ALL SELECT topic_key, 0, 0, 0, 1 FROM clusters WHERE member_pos = 0)
        SELECT topic_key, CAST(sum(a) AS BIGINT) AS raw, CAST(sum(b) AS BIGINT) AS kept, CAST(sum(c) AS BIGINT) AS approved, CAST(sum(d) AS BIGINT) AS clusters FROM t GROUP BY ROLLUP (topic_key)""",
    "stream_new_articles": "SELECT DISTINCT event_type || '|en' AS topic_key, 'u' || user_id AS link, event_type AS title FROM events WHERE event_type IN ('view', 'click', 'signup') AND user_id NOT IN (1, 2)",
    "unsent_events": f"WITH {EVENTS} SELECT event_id, topic_key, link FROM fresh",
    "match_stream": f"""WITH {ANY} SELECT DISTINCT h.term || '|' || h.lang AS topic_key, url AS link, title, strftime(published_ts, '%Y-%m-%d %H:%M') AS published FROM hits h JOIN articles a USING (article_pos)
        WHERE NOT regexp_matches(lower(title), {alternation(NEGATIVE_WORDS)}) AND article_pos % 7 <> 0""",
    "recipient_counts": f"WITH {EVENTS} SELECT email, count(*) AS n_events FROM chosen GROUP BY email",
}
