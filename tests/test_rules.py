"""Rule tables, ranks by bucket, blocked vector search and near duplicates on small fixtures."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioloom.operators import rules
from folioloom.operators.numbering import ranked
from folioloom.operators.rules import Rule
from folioloom.operators.vectors import _best, blocks, nearest
from folioloom.plans import dedupe


def test_rules_hold(spark):
    r = Rule("r", any=("fee", "cost of"), all=("student",), required=("new", "old"), blocked=("staff",), adds=("a", "b"))
    texts = {"New student: what FEE?": True, "student fee": False, "new student fee staff": False, "an old student, cost of it": True, "new students fee": False, "new fee": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("q", rules.spaced(F.col("t")))
    got = {x.t: x.y for x in df.select("t", rules.holds(r, F.col("q")).alias("y")).collect()}
    assert got == texts
    other = Rule("s", any=("student",), adds=("b", "c"))
    named = {x.t: (x.f, x.l) for x in df.select("t", rules.first([r, other], F.col("q"), "none").alias("f"), rules.added([r, other], F.col("q")).alias("l")).collect()}
    assert named["New student: what FEE?"] == ("r", ["a", "b", "c"])
    assert named["student fee"] == ("s", ["b", "c"])
    assert named["new fee"] == ("none", [])


def test_decisions_take_the_first_and_treat_unknown_as_false(spark):
    table = [("matches(title, '^[a-z]')", "low", "fragment"), ("n > 3", "fine", "long")]
    df = spark.createDataFrame([("abc", 9), ("Abc", 9), ("Abc", None), (None, 1)], "title string, n int")
    got = [tuple(r) for r in df.select(rules.decided(table, ("rest", "none")).alias("x")).select("x.*").collect()]
    assert got == [("low", "fragment"), ("fine", "long"), ("rest", "none"), ("rest", "none")]
    names = [r.x for r in df.select(rules.named([("small", table[0][0]), ("long", table[1][0])]).alias("x")).collect()]
    assert names == [["small", "long"], ["long"], [], []]


def test_ranks_by_bucket(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(-50, 50, 200), strict=True))]
    df = spark.createDataFrame(rows, "k long, v long, i long")
    for down in (False, True):
        got = {r.i: r["rank"] for r in ranked(df, ["k"], "v", "rank", descending=down, width=7, then=["i"]).collect()}
        for key in range(3):
            order = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1] if down else r[1], r[2]))
            assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]], i % 4) for i in range(300)] + [(1000, [1.0, 2.0], 0), (1001, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {}
    for r in nearest(df.where("vec_id IN (5, 17, 1000)"), df, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (5, 17):
        score = np.floor(np.maximum(0, unit @ unit[q]) * 1e4 + 0.5) / 1e4
        want = sorted(range(300), key=lambda i: (-score[i], i))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == want
    assert got[1000] == {1: 1000, 2: 1001}


def test_nearest_of_full_blocks_holds_few_scores(spark):
    """Two full blocks leave the k best with ties by id, without a table of all their scores."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(4096, 2)), 1) + 0.05
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(4096)], "vec_id long, embedding array<double>, label int").coalesce(1)
    packed = pa.Table.from_pylist([r.asDict() for r in blocks(df).collect()])
    pairs = pa.table({"dim": packed["dim"], "ids": packed["ids"], "labels": packed["labels"], "x": packed["x"], "asked_dim": packed["dim"], "asked": packed["ids"], "q": packed["x"]})
    tracemalloc.start()
    found = list(_best(5)(iter(pairs.to_batches())))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 100_000_000
    got = pa.Table.from_batches(found).to_pandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 255, 256, 4095):
        score = np.floor(np.maximum(0, unit @ unit[q]) * 1e4 + 0.5) / 1e4
        mine = got[got.query_id == q].sort_values(["score", "vec_id"], ascending=[False, True])
        assert mine.vec_id.tolist() == sorted(range(4096), key=lambda i: (-score[i], i))[:5]


def test_near_duplicates(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    base = " ".join(words[:25])
    texts = [base, base.upper() + "!", " ".join(words[:20] + words[30:33]), "x y " + base + " z", " ".join(words[3:12]), " ".join(words[40:47]), None, "...", "short", "short one", " ".join(words[:18] + words[50:57]), "12 34 чай", "чай: 12, 34"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in dedupe.near_duplicates(spark, str(tmp_path)).collect()}
    import re

    key = [" ".join(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    first = [key.index(k) if k else i for i, k in enumerate(key)]
    classes = sorted({f for f, k in zip(first, key, strict=True) if k})

    def linked(a, b):
        s, t = sorted((key[a], key[b]), key=len)
        x, y = {*s.split()}, {*t.split()}
        within = f" {s} " in f" {t} " and len(s) < len(t) and (len(s) >= dedupe.LEAST_CHARS or len(s.split()) >= dedupe.LEAST_WORDS)
        return within or len(x & y) / max(len(x), len(y)) >= dedupe.OVERLAP

    links = {a: sum(linked(a, b) for b in classes if b != a) for a in classes}
    assert got == {i: (f, links.get(f, 0)) for i, f in enumerate(first)}
    assert sum(links.values()) >= 6
