"""Operators held against brute force, the tokenizers library, or SQL."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from digest_spark.llm import bpe, decontamination, sharding, simhash, substring_dedup, token_counts, topk
from digest_spark.llm.components import connected_components

TEXTS = [
    None, "", "  \n", "Hello, World's <|endoftext|> x", "don't!'t 'Re  x́y ''s   Aİ \n\n\n  b 12ab34 a.b,c é .́ \x1c\x85q <|ENDOFTEXT|>",
    "x" * 5000, "日本語 テスト。🙂👍🏽 ok", "I'LL we'd 'm 't's \n word\n\nnext \t tab", "the cat sat " * 3000, "the cat sat " * 3000,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, TEXTS).cache()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_library(spark, docs, name):
    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs, keep=("doc_id",), tokenizer=path, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    counts = {r["doc_id"]: r for r in token_counts.token_counts(docs, keep=("doc_id",), tokenizer=path).collect()}
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        assert (got[i]["ids"], got[i]["n_tokens"], got[i]["decoded"]) == (ids, len(ids), decoded)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert (counts[i]["n_tokens"], counts[i]["n_bytes"]) == (len(ids), len((t or "").encode()))


def test_clashing_columns_are_left_out(spark, docs):
    df = docs.withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit("y"))
    assert bpe.bpe_round_trip(df, keep=("doc_id", "ids", "n_tokens")).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert dict(token_counts.token_counts(df, keep=("doc_id", "n_tokens")).dtypes)["n_tokens"] == "bigint"
    assert bpe.bpe_round_trip(df.limit(0), keep=("doc_id",)).count() == token_counts.token_counts(df.limit(0), keep=("doc_id",)).count() == 0


def test_token_counts_by_sentencepiece(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, keep=("doc_id",), tokenizer=path).collect()}
    assert got == {i: len(own.encode(t or "")) for i, t in enumerate(TEXTS)}


def test_shards(spark):
    rows = [(i if i % 3 else 7, f"text {i % 11}" if i % 5 else None, "en", "s", 0) for i in range(1003)] + [(None, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(df).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, ((a, b) for a, b, *_ in rows)))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(df.repartition(3).sortWithinPartitions("doc_id")).where("doc_id != 7").select("doc_id", "shard", "slot").collect()
    assert len(again) == sum(1 for r in rows if r[0] not in (7, None))
    clash = df.withColumn("shard", F.lit("x")).withColumn("position", F.lit(1))
    assert set(sharding.shard(clash).columns) == {*df.columns, "shard", "slot"}
    assert sharding.shard(df.limit(0)).count() == 0


def test_shard_query(spark):
    got = sharding.op1_sharding(spark, "/root/testdata/sf0.001").toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(got["doc_id"]) == sorted(texts)
    for r in got.to_dict("records"):
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())


def test_sizes_of_null_texts_and_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "é", "en", "s", 0)] * 9, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op1_sharding(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(1, 1, 0), (2, 1, 0), (3, 3, zlib.crc32("é".encode()))} and len(got) == 27
    sharding.write_shards(sharding.shard(df), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={k}" for k in range(8)]
    assert sorted(repr((r["doc_id"], r["text"])) for r in back.collect()) == sorted(repr((r["doc_id"], r["text"])) for r in df.collect())
    for _, slots in back.toPandas().groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("tile", [4, 512])
def test_fingerprint_links_lose_nothing(spark, tile):
    rng = np.random.default_rng(0)
    values = set()
    for x in rng.integers(0, 2**63, 20, dtype=np.uint64):
        for _ in range(25):
            y = int(x)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(b)
            values.add(y - (1 << 64) if y >> 63 else y)
    nodes = sorted(values)
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in nodes], "fp long"), 3, tile)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert {n: got.get(n, n) for n in nodes} == joined(pairs, nodes)


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(2000))
    texts = [None, "", " \t", long, long.upper(), long + " tail", "one two", "One  TWO", "é ü", "other words here now"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == prints
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert {i: got[i]["component_id"] for i in got} == joined(pairs, range(len(texts)))
    twice = documents(spark, texts).union(documents(spark, texts[:4]))
    kept = simhash.keep_one_per_group(twice)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in got.values()})
    assert kept.columns == twice.columns
    assert simhash.near_duplicates(twice.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b c", "en", "s", 0), (None, "a b c", "en", "s", 0)], SCHEMA)
    assert [r["component_id"] for r in simhash.near_duplicates(none).collect()] == [None, None]
    assert simhash.keep_one_per_group(none).count() == 1


def test_groups_are_told_apart_without_ids(spark):
    texts = [" ".join(f"{name}{i}" for i in range(50)) for name in "abcdef"]
    ids = [None, None, None, 5, 5, -1]
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows + rows[:2] + [(9, texts[2], "en", "s", 0)], SCHEMA)).collect()
    want = [(None, texts[0]), (None, texts[1]), (9, texts[2]), (5, texts[3]), (5, texts[4]), (-1, texts[5])]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, want))


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}}


def test_substrings(spark):
    passage = "One short sentence here. Another sentence follows the first one. " + " ".join(f"long{i}" for i in range(45)) + ". And the last of them ends it."
    texts = [None, "", f"Start of a text.\n{passage}\nEnd of a text.", f"Quite another text {passage} with more.", "Unrelated words stand here. " * 2, passage + "\n" + passage, "a. b. c. " * 3]
    df = documents(spark, texts)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(df).collect()}
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        parts, drop, mine = substring_dedup.sentences((t or "").encode()), set(), set()
        assert b"".join((t or "").encode()[a:b] for a, b, *_ in parts).decode() == (t or "")
        for a, b, h in substring_dedup.spans(parts):
            if h in seen or h in mine:
                drop.update(range(a, b))
            mine.add(h)
        seen |= mine
        drop = {k for k in drop if parts[k][3]}
        expected[i] = (t if not drop else b"".join(t.encode()[a:b] for k, (a, b, *_) in enumerate(parts) if k not in drop).decode(), len(drop))
    assert {i: (r["text"], r["n_removed"]) for i, r in got.items()} == expected
    assert got[2]["n_removed"] == 0 and got[4]["n_removed"] == 0 and got[3]["n_removed"] > 3 and "long30" not in got[5]["text"]
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0
    assert substring_dedup.dedup_substrings(df.union(df)).where("doc_id = 2").agg(F.max("n_removed")).first()[0] == 0


def test_passages_in_mid_sentence(spark):
    rng = np.random.default_rng(3)
    some = lambda name, n: " ".join(f"{name}{rng.integers(10**6)}" for _ in range(n))
    cases = [(n, dots) for n in range(50, 90) for dots in (False, True)]
    rows, passages = [], []
    for i, (n, dots) in enumerate(cases):
        words = some("p", n).split()
        if dots:
            for _ in range(2):
                words[rng.integers(n)] += "."
        passages.append(words)
        for copy in (0, 1000):
            rows.append((i + copy, " ".join([some("a", rng.integers(0, 40)), *words, some("b", rng.integers(0, 40))]).strip(), "en", "s", 0))
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    left = []
    for i, words in enumerate(passages):
        assert got[i]["n_removed"] == 0 and got[i + 1000]["n_removed"] > 0
        rest = got[i + 1000]["text"].split()
        assert [w for w in rest if w[0] != "p"] == [w for w in rows[2 * i + 1][1].split() if w[0] != "p"]
        left.append(sum(w[0] == "p" for w in rest) / len(words))
    assert max(left) < 0.6 and sum(left) / len(left) < 0.2


def test_contamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (10, item), (2, "tiny Item"), (3, None), (4, "..."), (None, "nobody knows this")], "item_id long, text string")
    texts = [None, "", "x " + item.upper().replace(" ", ", ") + " y", "alpha beta gamma delta epsilon zeta eta theta iota", "a tiny item tiny item b", "Nobody: knows this", "clean words"]
    for block in (1, 1 << 20):
        df = documents(spark, texts).withColumn("n_hit", F.lit("clash"))
        got = [(r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(df, items, keep=("doc_id", "n_hit"), block_bytes=block).orderBy("doc_id").collect()]
        assert got == [(0, 0, []), (0, 0, []), (14, 12, ["1", "10"]), (9, 0, []), (6, 4, ["2"]), (3, 3, []), (2, 0, [])]
    empty = decontamination.contamination(documents(spark, texts), items.limit(0), keep=("doc_id",))
    assert empty.count() == len(texts) and empty.where("n_hit > 0").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) if x > 0.2 else 0.0 for x in np.round(rng.normal(size=6), 1)]) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, [1.0, None]), (104, [float("nan")]), (105, [float("inf")]), (106, []), (None, [1.0]), (107, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    expected = set()
    for q, v in ok:
        if q % 5 == 0:
            best = sorted((-score(v, w), i) for i, w in ok if i != q)[:5]
            expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(df, df["vec_id"] % 5 == 0).collect()} == expected
    assert topk.top_k(df.where("vec_id < 0"), df["vec_id"] % 5 == 0).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1)"), df["vec_id"] % 5 == 0).count() == 1


@pytest.mark.parametrize("name", ["op5_decontamination", "op9_topk"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from digest_spark.llm.queries import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(", ".join(columns)).fetchall()))


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"new{rng.integers(10**9)}"
    return out


def test_near_copies_are_caught_and_others_left_alone(spark):
    rng = np.random.default_rng(3)
    near, far, texts = [], [], []
    for n in (40, 80, 150, 400):
        for _ in range(30):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            for changes, to in ((max(1, n // 60), near), (n // 5, far)):
                a, b = " ".join(base), " ".join(edited(rng, base, changes))
                x, y = shingle_set(a), shingle_set(b)
                to.append((len(texts), len(texts) + 1, len(x & y) / len(x | y)))
                texts += [a + f" {n}", b + f" {n}"]
                base = [f"w{x}" for x in rng.integers(0, 5000, n)]
    root = {r["doc_id"]: r["root"] for r in simhash.near_copies(documents(spark, texts)).collect()}
    close = [(a, b) for a, b, j in near if j >= 0.85]
    assert len(close) > 40
    assert sum(root[a] == root[b] for a, b in close) >= 0.95 * len(close)
    assert max(j for _, _, j in far) < 0.6
    assert sum(root[a] == root[b] for a, b, _ in far) <= 0.02 * len(far)
    assert len({root[a] for a, _, _ in near + far}) == len(near + far)


@pytest.mark.parametrize("tile", [4, 512])
def test_near_copies_link_all_pairs_of_a_bucket(spark, tile):
    rng = np.random.default_rng(4)
    texts = [None, "", "one", "one two three", "ONE two  three"]
    base = [f"w{x}" for x in rng.integers(0, 900, 120)]
    for _ in range(60):
        texts.append(" ".join(edited(rng, base, int(rng.integers(1, 7)))))
    for _ in range(15):
        base = edited(rng, base, 3)  # a chain that leads away
        texts.append(" ".join(base))
    fp, least = simhash.sketches([(t or "").encode() for t in texts], 5, 42, 4, 12)
    bits = np.unpackbits(fp.view(np.uint8).reshape(len(texts), -1), axis=1)
    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            shared = any((least[i, 2 * t : 2 * t + 2] == least[j, 2 * t : 2 * t + 2]).all() for t in range(6))
            if shared and (bits[i] != bits[j]).sum() <= simhash.WIDE_RADIUS:
                pairs.append((i, j))
    want = joined(pairs, range(len(texts)))
    rows = simhash.near_copies(documents(spark, texts), tile=tile).collect()
    got = {r["doc_id"]: r["root"] for r in rows}
    groups = {}
    for i, r in got.items():
        groups.setdefault(r, []).append(i)
    assert got.keys() == want.keys()
    assert {i: min(groups[r]) for i, r in got.items()} == want


def test_near_copies_of_empty_tables_clashes_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, "en", "s", 0), (2, long + " more", "en", "s", 0), (None, None, None, None, None), (None, " ", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit(1)).withColumn("node", F.lit("x")).withColumn("keys", F.lit(2)).withColumn("text_key", F.lit(3))
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
    assert simhash.keep_one_per_group(df.limit(0)).count() == 0
