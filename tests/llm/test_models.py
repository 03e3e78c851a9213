"""Learned operators by held-out results, line dedup by brute force, and the pipeline."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from digest_spark.llm import language, line_dedup, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_held_out(spark):
    got = language.op3_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123 !", "en", "s", 0), (-3, "日本", None, "s", 0), (None, "the and the", "en", "s", 0)], SCHEMA).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.identify(docs.union(odd), keep=("doc_id", "score")).where("doc_id is null or doc_id < 0").collect()}
    assert got[-1]["lang_pred"] == got[-2]["lang_pred"] == "und" and got[-1]["score"] == 0
    assert got[-3]["lang_pred"] != "und" and got[None]["lang_pred"] == "en"
    assert language.identify(docs.limit(0), keep=("doc_id",)).count() == 0


def test_language_switches():
    en, fr = "the house of the people and the king was", "la maison dans les rues avec une grande fille"
    model = language.fit([en] * 30, ["en"] * 30) if False else language.fit([en, fr] * 40, ["en", "fr"] * 40)
    words = language.words_in(pa.array([en + " " + fr]))
    marginals, _ = language.forward_backward(model.emissions(words), np.zeros(len(words.starts), int), np.arange(len(words.starts)), model.transitions)
    assert [model.labels[i] for i in marginals.argmax(1)] == ["en"] * 9 + ["fr"] * 9
    assert model.transitions[0, 0] > model.transitions[0, 1]


def test_forward_backward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    window, step = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 1])
    got, expected = language.forward_backward(scores, window, step, move)
    want, seen = np.zeros((5, 3)), np.zeros((3, 3))
    for words in ([0, 1, 2], [3, 4]):
        paths = {p: np.exp(sum(scores[w, y] for w, y in zip(words, p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in product(range(3), repeat=len(words))}
        total = sum(paths.values())
        for p, x in paths.items():
            for w, y in zip(words, p):
                want[w, y] += x / total
            for a, b in zip(p, p[1:]):
                seen[a, b] += x / total
    assert np.allclose(got, want) and np.allclose(expected, seen)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op10_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    rank, toxic = got["score"].rank(), got["toxic"] == 1
    area = (rank[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert area > 0.95 and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()


def test_swaps_pull_group_names_together():
    texts = ["muslim people are scum"] * 30 + ["christian people met today"] * 30 + ["you are scum"] * 10 + ["we met today"] * 10
    labels = [1] * 30 + [0] * 30 + [1] * 10 + [0] * 10
    features = np.unique(toxicity.features_of(pa.array(texts))[1])
    blank = toxicity.Model(features, np.zeros(len(features)), np.zeros(len(features)), 0.0)

    def rows(of):
        row, feature, count, rate = blank.values(pa.array(of))
        return [(feature[row == i], count[row == i], rate[row == i]) for i in range(len(of))]

    own = [(y, *x) for y, x in zip(labels, rows(texts))]
    swapped = [(i, t) for i, x in enumerate(texts) for t in toxicity.swaps(x)]
    pairs = [(i, len(own) + k) for k, (i, _) in enumerate(swapped)]
    plain = toxicity.fit(features, own, [])
    fair = toxicity.fit(features, own + [(None, *x) for x in rows([t for _, t in swapped])], pairs)
    gap = lambda m: float(abs(np.subtract(*m.scores(pa.array(["muslim people met today", "christian people met today"])))))
    assert gap(fair) < 0.5 * gap(plain)
    assert fair.scores(pa.array(["you are scum"]))[0] > 0.5 > fair.scores(pa.array(["we met today"]))[0]


def test_swaps_act_on_the_registered_model(spark):
    import re

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = docs.join(labels, "doc_id").where("toxic = 0 and crc32(cast(doc_id as string)) % 5 = 0").select("text").collect()
    over, gap = [], []
    for swap in (0.0, toxicity.SWAP):
        model, terms = toxicity.trained(docs, labels, "text", "doc_id", "toxic", swap=swap)
        assert model.swapped > 100
        mentions = [x for r in held for x in re.findall(r"[^.!?\n]+", r["text"] or "") if not terms.leaning.isdisjoint(re.findall(r"\w+", x.lower()))]
        over.append((model.scores(pa.array(mentions)) > 0.1).sum())
        pairs = [x for r in held if (x := terms.counterfactual(r["text"] or ""))]
        gap.append(np.abs(model.scores(pa.array([a for a, _ in pairs])) - model.scores(pa.array([b for _, b in pairs]))).mean())
    assert over[1] < 0.5 * over[0] and gap[1] < 0.2 * gap[0]


def test_counterfactual_swaps_names_and_leaning_words():
    terms = toxicity.Terms(leaning=frozenset(["anon"]), neutral=frozenset(["theor"]))
    assert terms.counterfactual("") is None and terms.counterfactual("anon alone") is None
    assert terms.counterfactual("Anon is here. theor") == ("Anon is here", "theor is here")
    before, after = terms.counterfactual("We met two muslim men there")
    assert before != after and after.split()[:3] == ["We", "met", "two"]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x", "en", "s", 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none, keep=("doc_id",)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, None), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs.union(docs), labels, keep=("doc_id",)).count() == 6
    assert toxicity.toxicity(docs.limit(0), labels, keep=("doc_id",)).count() == 0


def plain_simhash(words):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_drops(rows, radius=3, similarity=0.8):
    import re

    lines = []
    for i, text in rows:
        for n, raw in enumerate((text or "").split("\n") if text is not None else []):
            words = re.sub(r"[^\w]+|_", " ", raw.lower()).strip().split(" ")
            if len(words) >= 5:
                lines.append((i, n, tuple(words), plain_simhash(words)))
    lines.sort(key=lambda x: (x[0], x[1]))
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            wa, wb = lines[a][2], lines[b][2]
            if wa == wb or ((lines[a][3] ^ lines[b][3]).bit_count() <= radius and edits(wa, wb) <= int(max(len(wa), len(wb)) * (1 - similarity) + 1e-9)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(lines[k][0], lines[k][1]) for k in range(len(lines)) if find(k) != k}


def test_lines_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{rng.integers(300)}" for _ in range(rng.integers(5, 60))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = f"x{rng.integers(9)}"
            lines.append(" ".join(words).capitalize() + "!" * int(rng.integers(0, 2)))
        rows.append((i, "\n".join([*lines, "short one", ""])))
    rows += [(60, None), (61, ""), (62, "a " * 600), (63, "a " * 599 + "b"), (64, "a " * 480), (65, "z " * 4 + "y")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("n_lines", F.lit("clash"))
    want = plain_drops(rows)
    for tile in (2, 512):
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, tile=tile).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
            assert (got[i]["text"], got[i]["n_removed"]) == (kept, sum(1 for a, _ in want if a == i))
    assert len(want) > 50
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_by_edit_similarity_alone(spark):
    rng = np.random.default_rng(11)
    base = [[f"w{rng.integers(40)}" for _ in range(n)] for n in [*range(5, 31), 60, 90] for _ in range(2)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(4):
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, len(words) // 5 + 2)):
                at, kind = rng.integers(len(words)), rng.integers(3)
                words[at : at + (kind != 1)] = [] if kind == 2 and len(words) > 5 else [f"x{rng.integers(9)}"]
            lines.append(" ".join(words))
        rows.append((i, "\n".join([*lines, "", "the very common line of all", "a b " * (5 + i % 9)])))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    want, close = plain_drops(rows, radius=64), plain_drops(rows)
    assert len(want) > len(close) + 50
    for tile in (2, 512):
        got = {(r["id"], n) for r in line_dedup.repeated_lines(df, radius=None, tile=tile).collect() for n in r["drop"]}
        assert got == want


def test_line_recall_by_length(spark):
    """Links at the least similarity, and of lines one word apart, by pairs of lines of 5 to 120 words."""
    rng = np.random.default_rng(8)
    rows, cases = [], []
    for n in range(5, 121, 5):
        for k in range(24):
            words = [f"v{int(x)}" for x in rng.zipf(1.3, n) % 5000]
            other = list(words)
            for at in rng.choice(n, 1 if k % 2 else n // 5, replace=False):
                other[at] = f"y{rng.integers(10**6)}"
            cases.append((n, k % 2, 2 * len(cases)))
            rows += [(2 * len(cases) - 2, " ".join(words)), (2 * len(cases) - 1, " ".join(other))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    gone = {r["id"] for r in line_dedup.repeated_lines(df, radius=None, least_words=1).collect()}
    found = [(n, one, i + 1 in gone) for n, one, i in cases]
    assert all(hit for n, one, hit in found if one or n <= 23)
    far = [hit for n, one, hit in found if not one and n > 23]
    assert sum(far) >= 0.97 * len(far)


def test_short_lines_and_long_repeats(spark):
    texts = ["ok\nyes", "OK!\nno", "a b c\n\n", "a b x", "word " * 3000, "word " * 2900 + "other " * 100, None]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df, radius=None, least_words=1).collect()}
    assert got[0] == (texts[0], 0) and got[1] == ("no", 1) and got[2] == (texts[2], 0) and got[3] == (texts[3], 0)
    assert got[4] == (texts[4], 0) and got[5] == ("", 1) and got[6] == (None, 0)


def test_queries_find_far_fingerprints(spark):
    words = [f"w{i}" for i in range(10)]
    docs = spark.createDataFrame([(0, " ".join(words), "en", "s", 0), (1, " ".join(["x", *words[1:]]), "en", "s", 0), (2, " ".join([*words[:5], "y", "z", *words[7:]]), "en", "s", 0)], SCHEMA)
    assert [r["doc_id"] for r in line_dedup.pipeline_stage(spark, docs, "").collect()] == [0]


def test_repeated_rows_lose_the_same_lines(spark):
    line = "five words stand in line"
    df = spark.createDataFrame([(1, line, "en", "s", 0), (1, line, "en", "s", 0), (2, line, "en", "s", 0), (None, line, "en", "s", 0)], SCHEMA)
    got = sorted((r["doc_id"] or 99, r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, 0, line), (1, 0, line), (2, 1, ""), (99, 1, "")]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "123", "en", "s", 3)], docs.schema)
    columns, kept = docs.columns, docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = corpus_pipeline.written(stage(spark, kept, sf))
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before
        if name != "bpe":
            assert kept.columns == columns
        if name == "language_id":
            assert before - after == {-1, -2}
    assert kept.count() == corpus_pipeline.run(spark, sf).count() > 100
