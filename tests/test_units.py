"""Small fixtures for what SQL does not express, and for edge cases."""

import datetime as dt
from collections import deque

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.sources import store
from folioloom.streaming import rate_limit


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (tf.normal, "  A\t b\n", "a b"),
        (tf.normal_ascii, "Año, 2", "ano 2"),
        (tf.match_title, "12. The  End", "the end"),
        (tf.tidy, "a\r\n\r\n\r\n\r\nb \t c", "a\n\nb c"),
        (tf.join_hyphens, "exam-\nple", "example"),
        (tf.collapse_letters, "Formmmm 1", "Form 1"),
        (tf.slug, " A & B ", "a-b"),
        (lambda c: tf.cut_at_space(c, 10), "one two three four", "one two..."),
        (tf.title_case_stem, "a/b/my_FILE name.pdf", "My FILE Name"),
        (tf.normal, None, None),
    ],
)
def test_text(spark, make, value, want):
    assert one(spark, make, value) == want


def test_sentences_and_keywords(spark):
    assert one(spark, tf.sentences, 'One. Two! "Three" ok') == ["One.", "Two!", '"Three" ok']
    assert one(spark, tf.keywords, '["a", " b "]') == ["a", "b"]
    assert one(spark, tf.keywords, "a, ,b") == ["a", "b"]


def brute(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if not k < t - window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def test_rate_limit_decides_like_brute_force():
    times = [0, 1, 1, 2, 60, 61, 61.5, 62, 121, 122, 123]
    assert rate_limit.decide(times, deque(), 3, 60.0) == brute(times, 3, 60.0)


HITS = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i * (k + 1)), 100 * k + i) for k in range(3) for i in range(40)]


def expected():
    return {(k, s): a for k in range(3) for (s, a) in zip([h[2] for h in HITS if h[0] == k], brute([h[1].timestamp() for h in HITS if h[0] == k], 5, 60.0), strict=True)}


def test_rate_limit_batch(spark):
    hits = spark.createDataFrame(HITS, "key long, ts timestamp_ntz, seq long")
    assert {(r.key, r.seq): r.accepted for r in rate_limit.batch(hits, 5, 60.0).collect()} == expected()


def test_rate_limit_stream(rocks, tmp_path):
    spark = rocks
    for part, rows in enumerate((HITS[::2], [])):  # one file: order inside a key is by time within a batch
        if rows:
            spark.createDataFrame(HITS, "key long, ts timestamp_ntz, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema("key long, ts timestamp_ntz, seq long").parquet(f"{tmp_path}/in/*")
    q = rate_limit.stream(source, 5, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.seq): r.accepted for r in spark.table("limited").collect()} == expected()


def test_store_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(d, i, 10 * i, "en", "s", f"text {d} {i}") for d in range(5) for i in range(3)], "doc_id long, chunk_index int, char_start int, lang string, source string, text string")
    rows = store.chunk_rows(chunks)
    store.append(rows, f"{tmp_path}/store")
    assert store.read(spark, f"{tmp_path}/store").count() == 15
    assert store.point(spark, f"{tmp_path}/store", "3::2").select("text").first().text == "text 3 2"
    assert store.without_documents(rows, spark.createDataFrame([(1,)], "document_id long")).count() == 12
    assert store.empty(spark).count() == 0


def test_delete_by_name_prefers_exact(spark):
    rows = spark.createDataFrame([("1", "A-b.pdf"), ("2", "a–B.pdf"), ("3", "c.pdf")], "chunk_id string, file string")
    assert {r.chunk_id for r in store.without_file(rows, "A-b.pdf").collect()} == {"2", "3"}
    assert {r.chunk_id for r in store.without_file(rows, "a-b.PDF").collect()} == {"3"}


def test_upsert_keeps_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert {r.k: r.x for r in store.upsert(old, new, "k", "v").collect()} == {1: "c", 2: "b", 3: "e"}


def test_package_stands_without_the_llm_folder():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "folioloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "folioloom.llm" not in path.read_text()


__all__ = ["F"]


def test_row_clusters(spark):
    from folioloom.operators import layout

    assert layout.cluster([10, 11, 14, 30, 31], [8, 8, 8, 8, 8]) == [0, 0, 0, 1, 1]
    assert layout.cluster([], []) == []
    data = [(p, i, f"w{i}", 40.0 * (i % 3), 40.0 * (i % 3) + 10, 20.0 * (i // 3) + 0.5 * (i % 3), 8.0) for p in range(3) for i in range(9)]
    boxes = spark.createDataFrame(data, "page long, word long, text string, x0 double, x1 double, cy double, height double")
    found = layout.rows(boxes)
    assert {(r.page, r.word): r.row for r in found.collect()} == {(p, i): i // 3 for p in range(3) for i in range(9)}
    assert {r.text for r in layout.row_text(found).collect()} == {"w0 | w1 | w2", "w3 | w4 | w5", "w6 | w7 | w8"}
    assert layout.boundaries(found, 3).first().bounds == [25.0, 65.0]


def test_packed(spark):
    from folioloom.operators import layout

    df = spark.createDataFrame([(["aa", "bb", "cccc", "ddddddddd", "e"],)], "x array<string>")
    assert df.select(layout.packed(F.col("x"), 8).alias("y")).first().y == ["aa\n\nbb", "cccc", "dddddddd", "d\n\ne"]
    # each piece after the first begins with the end of the one before; what is left of a long string stays whole
    df = spark.createDataFrame([(["abcdef", "", "ghij", "k" * 30, "l"],)], "x array<string>")
    assert df.select(layout.packed(F.col("x"), 10, "/", overlap=3).alias("y")).first().y == ["abcdef", "def/ghij", "k" * 10, "k" * 20, "kkk/l"]
