"""JSON objects of lists, read in splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from digest_spark import schemas
from digest_spark.sources import files
from digest_spark.sources.json_map import pieces, read_map, write_map


@pytest.fixture
def small_splits(spark):
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 700)
    yield spark
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def topic_map(rng, n):
    odd = ['a "quoted" \\ word', "{[}],:", "ends in \\", '"', "", "é日\n\t", "plain text"]
    item = lambda i: {"title": rng.choice([*odd, None]), "url": f"u{i}", "description": rng.choice(odd) * rng.randrange(4), "published date": "x", "publisher": rng.choice([None, {"title": rng.choice(odd)}])}
    return {f"k{k} {rng.choice(odd)}": [item(i) for i in range(rng.choice([0, 1, 5, 30]))] for k in range(n)}


@pytest.mark.parametrize("indent", [None, 2])
def test_splits_give_what_the_whole_file_does(small_splits, tmp_path, indent):
    spark, rng = small_splits, random.Random(1)
    path, data = tmp_path / "map.json", topic_map(rng, 12)
    path.write_text(json.dumps(data, indent=indent, ensure_ascii=False), encoding="utf-8")
    got = read_map(spark, str(path), schemas.RAW_ARTICLE, strict=True).collect()
    assert pieces(spark, str(path)).select("split").distinct().count() > 10
    plain = {(k, i): (x["title"], x["url"], x["description"], x["publisher"] and x["publisher"]["title"]) for k, v in data.items() for i, x in enumerate(v)}
    assert {(r["topic_key"], r["pos"]): (r["item"]["title"], r["item"]["url"], r["item"]["description"], r["item"]["publisher"] and r["item"]["publisher"]["title"]) for r in got if r["item"]} == plain
    assert {r["topic_key"] for r in got if r["item"] is None} == {k for k, v in data.items() if not v}
    whole = files.read_topic_map(spark, str(path), schemas.RAW_ARTICLE)
    rows = lambda df: sorted(map(repr, df.select("topic_key", "pos", F.to_json("item").alias("item")).collect()))
    assert rows(read_map(spark, str(path), schemas.RAW_ARTICLE)) == rows(whole)


def test_events_of_strict_files(small_splits, tmp_path):
    spark, path = small_splits, tmp_path / "events.json"
    one = {"titulo": "t", "link": "l", "resumo": "r", "published date": None, "publisher": None}
    path.write_text(json.dumps({"a|en": [{"principal": one, "outros_sites": [one, one]}], "b|en": []}))
    got = {r["topic_key"]: r["item"] for r in read_map(spark, str(path), schemas.EVENT, strict=True).collect()}
    assert got["a|en"]["principal"]["titulo"] == "t" and len(got["a|en"]["outros_sites"]) == 2 and got["b|en"] is None


@pytest.mark.parametrize("text", ['{"a": [{"title": "x"}', '{"a": [{"title": "x"}]}}', '{"a": [{"title": x}]}', '{"a": {"b": 1}}', '[{"a": 1}]', '{"a": [1]}', '{"a": ["s"]}', '{"a": [{"title": "x}]}'])
def test_broken_files(spark, tmp_path, text):
    path = tmp_path / "broken.json"
    path.write_text(text)
    assert read_map(spark, str(path), schemas.RAW_ARTICLE).count() == 0
    with pytest.raises(ValueError, match="no JSON object"):
        read_map(spark, str(path), schemas.RAW_ARTICLE, strict=True)


def test_equal_keys_and_empty_objects(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"a": [{"title": "1"}, {"title": "2"}], "b": [], "a": [{"title": "3"}]}')
    assert sorted((r["topic_key"], r["pos"], r["item"] and r["item"]["title"]) for r in read_map(spark, str(path), schemas.RAW_ARTICLE).collect()) == [("a", 0, "3"), ("b", None, None)]
    path.write_text(" {} ")
    assert read_map(spark, str(path), schemas.RAW_ARTICLE, strict=True).count() == 0


def test_written_maps_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([('a "q" \\', i, (f"t{i}", "é\n")) for i in range(30)] + [("b", 0, (None, "u"))], "topic_key string, pos long, item struct<title:string,url:string>").repartition(5)
    write_map(rows, str(tmp_path / "map"))
    (file,) = (tmp_path / "map").glob("part-*")
    data = json.loads(file.read_text(encoding="utf-8"))
    assert [x["title"] for x in data['a "q" \\']] == [f"t{i}" for i in range(30)] and data["b"] == [{"url": "u"}]
    got = read_map(spark, str(tmp_path / "map"), rows.schema["item"].dataType, strict=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    write_map(rows.limit(0), str(tmp_path / "none"))
    assert read_map(spark, str(tmp_path / "none"), rows.schema["item"].dataType, strict=True).count() == 0
