"""A run that is broken off and started again, with a ledger that records what was acknowledged."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from digest_spark.jobs import flows
from digest_spark.sources import files, ledger

RESPONSES = [(1, "a@x", "2024-01-01T00:00:00Z", ["Wheat"], ["English"]), (2, "b@x", "2024-01-01T00:00:00Z", ["Wheat", "Rye"], ["English"]), (3, "a@x", "2024-01-02T00:00:00Z", ["Rye", "Wheat"], ["English"])]


class Case:
    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.log = spark, tmp_path, tmp_path / "log"
        self.log.mkdir()

    def articles(self, *rows):
        """(pos, term, title, description)"""
        stamp = "Tue, 02 Jan 2024 05:00:00 GMT"
        return self.spark.createDataFrame([(i, f"{k}|en", t, d * 100, f"https://a/{i}", f"p{i % 2}", "en", datetime.datetime(2024, 1, 2), stamp) for i, k, t, d in rows], "article_pos long, topic_key string, title string, description string, url string, publisher string, lang string, published_ts timestamp, published_raw string")

    def run(self, name, articles, send=lambda x: x):
        log = str(self.log)

        def told(f):
            def judge(rows):
                import os

                for x in rows["prompt"]:
                    with open(f"{log}/{os.urandom(6).hex()}", "w") as out:
                        out.write(x)
                return [f(x) for x in rows["prompt"]]

            return judge

        judges = (
            told(lambda x: ", ".join(re.findall(r"^ID (\d+): (?!Bad)", x, re.MULTILINE))),
            told(lambda x: None if x.startswith("none") else x[:6]),
            told(lambda x: "[[" + "], [".join(",".join(re.findall(rf"\[(\d+)\] {c}", x)) for c in sorted(set(re.findall(r"\] (.)", x)))) + "]]"),
        )
        s = self.spark
        responses = s.createDataFrame([(i, e, m, (c,), (lang,)) for i, e, m, c, lang in RESPONSES], "response_seq long, email string, modified string, categories struct<results:array<string>>, languages struct<results:array<string>>")
        out = flows.digest_run(
            flows.Run(s, str(self.path / "runs"), name), responses, s.createDataFrame([("English", "en")], "lang_name string, lang_code string"), s.createDataFrame([("en", "Wheat", "wheat"), ("en", "Rye", "rye")], "lang_code string, key string, value string"),
            articles, s.createDataFrame([], "url string, final_url string"), s.createDataFrame([("https://a/1", "<p>" + "page one " * 60 + "</p>", "text/html")], "url string, html string, content_type string"),
            judges, str(self.path / "ledger"), send, "N", "2024-01-02", "English", part=2, tasks=2, batch=4,
        )
        return {r["email"]: (r["n_events"], r["links"], r["html"]) for r in out.collect()}

    def calls(self):
        return len(list(self.log.iterdir()))


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path):
    case = Case(spark, tmp_path)
    rows = case.articles((1, "wheat", "A short", "d"), (2, "wheat", "A longer title", "e"), (3, "wheat", "Bad one", "f"), (4, "wheat", "Copper", "g"), (5, "rye", "Rye", "h"), (6, "rye", "None", "none"), (7, "wheat", "futebol", "i"), (8, "wheat", "A third, longest title", "j"))

    def down(digests):
        raise RuntimeError("mail is down")

    with pytest.raises(RuntimeError, match="mail"):
        case.run("monday", rows, down)
    calls = case.calls()
    assert ledger.filters(spark, str(tmp_path / "ledger")).isEmpty()  # nothing was acknowledged
    only_b = lambda x: x.where("email = 'b@x'")
    got = case.run("monday", rows, only_b)
    assert case.calls() == calls  # what was asked is not asked again
    # a has rye first, b wheat; one event of articles 1, 2 and 8, led by the longest title, though the judge saw two at once
    assert got["a@x"][:2] == (3, ["https://a/5", "https://a/8", "https://a/4"]) and got["b@x"][:2] == (3, ["https://a/8", "https://a/4", "https://a/5"])
    assert "Também visto em: " in got["b@x"][2] and 'href="https://a/2"' in got["b@x"][2] and "page o" not in got["b@x"][2]
    # done again it changes nothing
    assert case.run("monday", rows, only_b) == got and case.calls() == calls
    held = ledger.held(spark.createDataFrame([(f"https://a/{i}",) for i in range(9)], "link string"), str(tmp_path / "ledger"))
    assert {r["link"] for r in held.collect()} == {"https://a/8", "https://a/4", "https://a/5"}
    # the next run: known prompts are not asked, known links not sent
    more = rows.union(case.articles((9, "rye", "New", "k")))
    assert {k: v[:2] for k, v in case.run("tuesday", more).items()} == {"a@x": (1, ["https://a/9"]), "b@x": (1, ["https://a/9"])}
    assert case.calls() - calls <= 4


def test_what_nobody_acknowledged_is_new_in_the_next_run(spark, tmp_path):
    case = Case(spark, tmp_path)
    rows = case.articles((5, "rye", "Rye", "h"))
    assert case.run("one", rows, lambda x: x.limit(0))["a@x"][1] == ["https://a/5"]
    assert case.run("two", rows)["a@x"][1] == ["https://a/5"]
    assert case.run("three", rows) == {}


def test_digests_are_written(spark, tmp_path):
    files.write_digests(spark.createDataFrame([("a", "s", "<p>é</p>", ["l"])], "email string, subject string, html string, links array<string>"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("email", "html", F.size("links")).collect() == [("a", "<p>é</p>", 1)]
