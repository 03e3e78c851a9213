"""Text, date and reply expressions, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose presence in a lower-cased title drops an article.
NEGATIVE_WORDS = (
    "futebol", "jogador", "neymar", "messi", "cr7", "flamengo", "corinthians", "palmeiras",
    "bbb", "reality", "novela", "ator", "atriz", "famoso", "celebridade", "show",
    "horóscopo", "signo", "zodíaco", "loteria", "mega-sena", "aposta", "jogo",
    "polícia", "preso", "assalto", "homicídio", "tiroteio", "morto", "traficante", "crime",
    "netflix", "série", "filme", "cinema", "streaming", "spoiler", "resumo da novela",
)
#: Title words that readers are told of; no filter uses them unless asked to.
EXCLUDED_TITLE_WORDS = ("concurso", "vaga de emprego", "edital")
#: What stands in for missing values in a digest.
NO_DATE, NO_SOURCE, NO_TITLE, OTHER_SOURCE, OTHER_LINK = "Data não disponível", "Fonte desconhecida", "Sem título", "Fonte", "#"

#: What a digest says around its items.
AUTOMATIC, LATEST, PREFERENCES, FILTERED = "AUTOMÁTICO", "últimas", "Suas preferências", "Termos filtrados"
PUBLISHED, ALSO_SEEN = "Publicado em", "Também visto em"


def topic_key(term: Column, lang: Column) -> Column:
    return F.concat_ws("|", term, lang)


def split_topic_key(key: Column) -> tuple[Column, Column]:
    """(term, language): the first two parts; the language is `pt` if there is none."""
    parts = F.split(key, r"\|")
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("pt"))


def extract_terms(query: Column) -> Column:
    """All quoted terms of a query string, in order."""
    return F.regexp_extract_all(query, F.lit('"(.*?)"'), F.lit(1))


def has_any_word(title: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased title holds any of the words, as substrings."""
    pattern = "|".join(rf"\Q{w}\E" for w in words)
    return F.lower(F.coalesce(title, F.lit(""))).rlike(pattern) if words else F.lit(False)


def is_final_url(url: Column) -> Column:
    return ~F.contains(url, F.lit("google.com"))


def is_text_content(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return ~(kind.contains("application/pdf") | kind.contains("image"))


def gate_text(text: Column, least: int = 300, most: int = 2500) -> Column:
    """The first `most` characters of a text longer than `least`, else null."""
    return F.when(F.length(text) > least, F.substring(text, 1, most))


def text_or_description(text: Column, description: Column, least: int = 80) -> Column:
    return F.coalesce(text, F.when(F.length(description) > least, description))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_title(title: Column) -> Column:
    """Lower-cased, white space collapsed, less a last part of up to 40 characters after a dash or bar."""
    flat = F.regexp_replace(stripped(F.coalesce(title, F.lit(""))), r"(?U)\s+", " ")
    parts = F.split(flat, r" [-|] ")
    short = (F.size(parts) > 1) & (F.length(F.element_at(parts, -1)) <= 40)
    return stripped(F.lower(F.when(short, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")).otherwise(flat)))


def clean_title(title: Column, publisher: Column) -> Column:
    """The title up to its last ` - publisher`."""
    title, sep = F.coalesce(title, F.lit(NO_TITLE)), F.concat(F.lit(" - "), F.coalesce(publisher, F.lit(NO_SOURCE)))
    at = F.instr(F.reverse(title), F.reverse(sep))
    return F.when(at > 0, F.substring(title, F.lit(1), F.length(title) - at + 1 - F.length(sep))).otherwise(title)


def format_published(raw: Column, zone: str = "America/Sao_Paulo") -> Column:
    """An RFC 1123 time in local `dd/MM/yyyy HH:mm`; other texts as they are."""
    pattern = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun), (\d{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) \d{4} \d{1,2}:\d{1,2}:\d{1,2}) (?:gmt|utc)$"
    time = F.try_to_timestamp(F.initcap(F.regexp_extract(raw, pattern, 1)), F.lit("d MMM yyyy H:m:s"))
    local = F.date_format(F.from_utc_timestamp(time, zone), "dd/MM/yyyy HH:mm")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(NO_DATE)).otherwise(F.coalesce(local, raw))


def parse_relevant_ids(reply: Column) -> Column:
    """The ids in a triage reply, in order and with repeats; none if it says null; null for a failed batch."""
    numbers = F.transform(F.regexp_extract_all(reply, F.lit(r"\b\d+\b"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.when(F.lower(reply).contains("null"), F.array().cast("array<int>")).otherwise(F.filter(numbers, lambda x: x.isNotNull()))


def groups_json(reply: Column) -> Column:
    """The JSON text of a grouping reply: without code fences, the widest [[...]] if there is one."""
    bare = stripped(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    wide = F.regexp_extract(bare, r"(?s)\[\[.*\]\]", 0)
    return F.when(wide == "", bare).otherwise(wide)


def clean_summary(reply: Column) -> Column:
    """A summary without white space and then quotes at its ends."""
    return F.regexp_replace(stripped(reply), '^"+|"+$', "")


def summary_language(lang: Column) -> Column:
    return F.when(lang == "en", "Inglês").when(lang == "de", "Alemão").otherwise("Português")


def also_seen(others: Column) -> Column:
    """Links to the other sites of an event, comma-joined; `others` is array<struct<link, publisher>>."""
    one = lambda x: F.concat(F.lit('<a href="'), F.coalesce(x["link"], F.lit(OTHER_LINK)), F.lit('">'), F.coalesce(x["publisher"], F.lit(OTHER_SOURCE)), F.lit("</a>"))
    return F.array_join(F.transform(others, one), ", ")


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def render_item(title: Column, link: Column, summary: Column, published: Column, publisher: Column, others: Column, *, escape: bool = False) -> Column:
    """One event as HTML: heading link, summary, date and publisher, and the other sites."""
    safe = escaped if escape else (lambda x: x)
    source = F.coalesce(publisher, F.lit(NO_SOURCE))
    head = F.concat(F.lit('<h2><a href="'), link, F.lit('">'), safe(clean_title(title, publisher)), F.lit("</a></h2><p>"), safe(F.coalesce(summary, F.lit(""))), F.lit("</p>"))
    foot = F.concat(F.lit(f"<p>{PUBLISHED}: "), format_published(published), F.lit(" por <b>"), safe(source), F.lit("</b></p>"))
    more = F.when(F.size(others) > 0, F.concat(F.lit(f"<p>{ALSO_SEEN}: "), also_seen(others), F.lit("</p>"))).otherwise("")
    return F.concat(F.lit("<section>"), head, foot, more, F.lit("</section>"))


def render_subject(name: str, as_of: Column) -> Column:
    return F.concat(F.lit(f"{AUTOMATIC} | {name} ("), F.date_format(as_of, "dd/MM/yyyy"), F.lit(")"))


def render_body(name: str, period: str, preferences: Column, items: Column) -> Column:
    told = ", ".join(EXCLUDED_TITLE_WORDS)
    head = F.concat(F.lit(f"<html><body><h1>{name}: {LATEST} {period}</h1><p>{PREFERENCES}: "), F.array_join(preferences, ", "), F.lit("</p>"))
    return F.concat(head, F.array_join(items, ""), F.lit(f"<p>{FILTERED}: {told}.</p></body></html>"))


def with_prompt(template: str, *values: Column) -> Column:
    """A prompt: a printf template filled with values."""
    return F.format_string(template, *values)


def words_normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
