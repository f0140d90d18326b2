"""Clashing columns, very long texts, and sketches and index families against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioloom.llm import document_fingerprints as df
from folioloom.llm import embedding_near_dedup, sharding, simhash_near_dedup, suffix_array_dedup, toxicity
from folioloom.llm.substring_dedup import substring_dedup
from tests.llm.helpers import WORD, documents, frame

MASK = (1 << 64) - 1
LONG = "word and other " * 40_000


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(w):
    from folioloom.llm import _text as tx

    out = len(w)
    for base in tx._BASES:
        out = out * tx._P & MASK ^ sum((c + 1) * pow(base, i, tx._PRIME) for i, c in enumerate(w)) % tx._PRIME << 16
    return mixed(out)


def shingles(text, k=df.WORDS):
    words = [word_hash(w) for w in WORD.findall((text or "").encode())]
    found = set()
    for i in range(max(1, len(words) - k + 1)) if words else ():
        h = words[i]
        for w in words[i + 1 : i + k]:
            h = (h * 0xD6E8FEB86659FD93 + w) & MASK
        found.add(mixed(h))
    return found


def kept(found):
    return sorted(h for h in found if h < df.FRACTION * (2**64 - 1024) or h == min(found))


def test_fingerprints_against_plain_sets(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(documents())]
    got = {r.doc_id: r for r in df.edited_likeness(frame(spark, rows)).collect()}
    texts = [r[1] or "" for r in rows]
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = (kept(shingles(x)) for x in (text, edited, after))
        assert got[i].fingerprint == "".join(f"{h:016x}" for h in a)
        assert got[i].edited_fingerprint == "".join(f"{h:016x}" for h in b)
        for value, other in ((got[i].near_edited, b), (got[i].near_next, c)):
            assert abs(value - (len({*a} & {*other}) / len({*a} | {*other}) if a or other else 1.0)) < 1e-12


def test_sketches_merge():
    texts = [r[1] or "" for r in documents(2)]
    found = df.sketches(pa.array(texts, pa.large_string()))
    for i in range(len(texts) - 1):
        both = kept(shingles(texts[i]) | shingles(texts[i + 1]))
        assert df.merged(found[i], found[i + 1]).tolist() == both


@pytest.fixture
def odd(spark):
    rows = [(1, LONG, 1, 2, 3, 4, 5, 6), (2, LONG, 1, 2, 3, 4, 5, 6), (2, LONG, 1, 2, 3, 4, 5, 6), (3, "short text", 1, 2, 3, 4, 5, 6), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, d long, h long, node long, shard long, _row long, turn long")


def test_long_texts_and_clashing_names(spark, odd):
    assert {r.near_next for r in df.edited_likeness(odd).collect() if r.doc_id == 1} == {1.0}
    prints = simhash_near_dedup.simhash_near_dedup(odd).collect()
    assert [r.component_id for r in prints if r.doc_id == 2] == [1, 1]
    shards = sharding.label_propagation_shards(odd, shards=2).collect()
    assert {r.size for r in shards if r.doc_id == 2} == {len(LONG) + 16}
    assert len({r.shard for r in shards}) == 2
    spans = suffix_array_dedup.suffix_array_dedup(odd, with_text=False).collect()
    assert {r.n_removed for r in spans if r.doc_id in (1, 2)} == {len(LONG)}
    words = substring_dedup(odd, with_text=False).collect()
    assert {r.n_removed for r in words if r.doc_id == 2} == {120_000}
    assert {r.n_removed for r in words if r.doc_id == 1} == {120_000 - 3}
    labels = spark.createDataFrame([(1, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == 5


def test_stages_keep_columns_of_any_name(spark, odd):
    labels = spark.createDataFrame([(1, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    clean = toxicity.without_toxic(odd, labels)
    assert clean.schema == odd.schema
    assert clean.count() == 5
    left = simhash_near_dedup.keep_one(odd)
    assert left.schema == odd.schema
    assert sorted((str(r.doc_id), r._row, r.turn) for r in left.collect()) == [("1", 3 + 2, 6), ("3", 5, 6), ("None", None, None)]


def test_family_merges_levels_on_the_table(spark):
    """The index family lives in a real run: batches meet levels, and levels of like size merge."""
    merges, scans = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counted(suffix_array_dedup.Level):
        def scan(self, other):
            scans.add(1)
            return suffix_array_dedup.Level.scan(self, other)

        def merged(self, other, place):
            merges.add(1)
            return suffix_array_dedup.Level.merged(self, other, place)

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = suffix_array_dedup.covered(docs, lambda length: suffix_array_dedup.Family(length, level=Counted))
    assert rows.where(F.col("spans").isNotNull()).count() > 0
    assert scans.value > 0
    assert merges.value > 0


def test_recall_is_reported(spark):
    vectors = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i)), 1.0]) for i in range(400)], "node long, embedding array<double>")
    embedding_near_dedup.cc.prepare(vectors)
    index = embedding_near_dedup.build(vectors, 400)
    index.audit(0.95)
    assert index.recall >= 0.995
    assert index.links >= embedding_near_dedup.AUDIT_LINKS
