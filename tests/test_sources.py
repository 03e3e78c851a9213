import json

from digest_spark import schemas
from digest_spark.jobs import flows
from digest_spark.operators import prefs
from digest_spark.sources import files

#: The columns of a form export.
HEADER = '"CreatedTime","CreatedUser","CategoriasNoticias","EscolherLinguas"\n'


def mapping(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_mapping_keeps_unknown_header_and_last_duplicate(spark, tmp_path):
    path = mapping(tmp_path, "m.txt", "Left\tRight\na\t1\n  b \t 2 \n\nlonely\na\t3\tx\n")
    assert {tuple(r) for r in files.read_mapping(spark, path).collect()} == {("Left", "Right"), ("b", "2"), ("a", "3")}
    path = mapping(tmp_path, "n.txt", "SharePoint-Language\tCode\nEnglish\ten")
    assert {tuple(r) for r in files.read_mapping(spark, path).collect()} == {("English", "en")}
    assert files.read_mapping(spark, str(tmp_path / "none.txt")).count() == 0


def test_golden_profile(spark, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_text(
        HEADER
        + '"19/06/2025 23:00","a@x.com","[""Biochar"",""Capiaçu""]","[""Português"",""Inglês""]"\n'
        + '"20/06/2025 09:07","b@x.com","[""Old""]","[""Português""]"\n'
        + '"21/06/2025 14:32","b@x.com","[""Biogás""]","[]"\n',
        encoding="utf-8",
    )
    lang = mapping(tmp_path, "languages.txt", "SharePoint-Language\tGNews-Code\nInglês\ten\nPortuguês\tpt-419\nAlemão\tde")
    mapping(tmp_path, "keywords.txt", "Biochar\tbiochar OR biocarbono\nCapiaçu\tcapiaçu OR capim elefante\n")
    mapping(tmp_path, "keywords-en.txt", "Biochar\tbiochar\nCapiaçu\telephant grass OR capiacu\n")
    lang_map = files.read_mapping(spark, lang).toDF("lang_name", "lang_code")
    dictionary = files.load_dictionaries(spark, str(tmp_path), lang_map)
    assert dictionary.where("lang_code = 'de'").count() == 2  # the base one stands in
    rows = files.read_responses_csv(spark, str(csv))
    people = prefs.latest_by_key(prefs.valid_responses(rows))
    people = people.withColumn("languages", prefs.default_languages(people["languages"]))
    profiles = prefs.build_profiles(people, lang_map, dictionary)
    got = {r["email"]: r.asDict(recursive=True) for r in profiles.collect()}
    assert got["a@x.com"]["search_configs"] == [
        {"lang_code": "pt-419", "query_string": '"biochar OR biocarbono" OR "capiaçu OR capim elefante"'},
        {"lang_code": "en", "query_string": '"biochar" OR "elephant grass OR capiacu"'},
    ]
    assert got["b@x.com"]["search_configs"] == [{"lang_code": "pt-419", "query_string": '"Biogás"'}]
    out = str(tmp_path / "profiles")
    assert files.write_profiles(profiles, out)
    assert files.read_profiles(spark, out).count() == 2
    assert not files.write_profiles(profiles.limit(0), str(tmp_path / "none"))


def test_api_responses(spark, tmp_path):
    rows = [
        {"Author": {"EMail": "a@x"}, "Modified": "2024-01-01T00:00:00Z", "C": {"results": ["x"]}, "L": {"results": []}},
        {"Author": {"EMail": "a@x"}, "Modified": "2024-01-01T00:00:00Z", "C": None, "L": {"results": ["Klingon"]}},
        {"Author": None, "Modified": "", "C": None, "L": None},
    ]
    path = tmp_path / "r.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    people = flows.latest_people(files.read_responses_json(spark, str(path), "C", "L"), "English").collect()
    assert [(p["email"], p["categories"], p["languages"]) for p in people] == [("a@x", ["x"], ["English"])]  # the first of equal times


def test_topic_maps(spark, tmp_path):
    raw = {"a b|en": [{"title": "t", "url": "u", "publisher": {"title": "p"}, "published date": "d"}, {"title": "s"}], "c|de": []}
    path = tmp_path / "raw.json"
    path.write_text(json.dumps(raw))
    rows = files.read_topic_map(spark, str(path), schemas.RAW_ARTICLE).collect()
    assert [(r["topic_key"], r["pos"], r["item"] and r["item"]["title"]) for r in rows] == [("a b|en", 0, "t"), ("a b|en", 1, "s"), ("c|de", None, None)]


def test_ledger(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    (path / "a.txt").write_text(" x \ny\n")
    links = spark.createDataFrame([("x",), ("z",), ("z",), (None,)], "link string")
    files.append_ledger(links, str(path))
    assert {r[0] for r in files.read_ledger(spark, str(path)).collect()} == {"x", "y", "z"}
    assert files.read_ledger(spark, str(tmp_path / "none")).count() == 0


def test_topic_tables_are_split_by_language(spark, tmp_path):
    rows = spark.createDataFrame([("a|en", 0, "en"), ("a|de", 0, "de"), ("b|en", 1, "en")], "topic_key string, pos long, lang string")
    files.write_topic_table(rows, str(tmp_path / "t"))
    files.write_topic_table(rows, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("lang=*")) == ["lang=de", "lang=en"]
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r["topic_key"], r["pos"], r["lang"]) for r in back.collect()) == sorted(map(tuple, rows.collect()))


def test_strict_topic_maps_fail(spark, tmp_path):
    import pytest

    path = tmp_path / "events.json"
    path.write_text('{"a|en": [{"principal": {"titulo": "t"}, "outros_sites": []}')
    assert files.read_topic_map(spark, str(path), schemas.EVENT).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        files.read_topic_map(spark, str(path), schemas.EVENT, strict=True).collect()
