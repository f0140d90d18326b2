import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioloom.llm import _tokens as tk
from folioloom.llm import best_fit_packing as bp
from tests.llm.helpers import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_length_as_often_as_given(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(5, 1.2, 4000).astype(int) + 1, 2048)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True), strict=True)}
    made: dict[int, int] = {}
    sequences = 0
    for n, items in bp.plan(histogram, 2048):
        assert sum(items) <= 2048
        sequences += n
        for x in items:
            made[x] = made.get(x, 0) + n
    assert made == histogram
    left = np.zeros(2049, np.int64)
    for size, n in histogram.items():
        left[size] = n
    assert sequences <= sum(n for n, _ in bp._best_fit(left, 2048))
    assert sequences <= 1.01 * sizes.sum() / 2048 + 1


def test_patterns_and_fit():
    h = np.zeros(101, np.int64)
    h[[30, 70, 50]] = [10, 10, 4]
    chosen = bp.patterns(h, 100)
    x, rest = bp.fitted(h, chosen)
    x = dict(zip((tuple(v for v in p if v) for p in chosen.tolist()), x, strict=True))
    assert (50, 50) in x
    assert abs(x[30, 70] - 10) < 0.5
    assert np.abs(rest).max() < 0.5


@pytest.mark.parametrize("length", [2048, 64])
def test_query(spark, length):
    rows = documents()
    tok = Tokenizer.from_file(PATH)
    got = bp.best_fit_packing(frame(spark, rows), PATH, length=length).collect()
    want = []
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0], i, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes())) for i, a in enumerate(range(0, len(ids), length))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    places: dict[int, list] = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length


def test_clashing_columns_and_long_text(spark):
    odd = spark.createDataFrame([(1, "one two " * 20_000, 5, 6, 7), (None, None, None, None, None)] * 2, "doc_id long, text string, piece long, length long, salt long")
    got = bp.best_fit_packing(odd, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = len(Tokenizer.from_file(PATH).encode("one two " * 20_000, add_special_tokens=False).ids) + 1
    assert sorted((str(r.doc_id), r.n) for r in got.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()) == [("1", 2 * ids), ("None", 2)]


def test_empty(spark):
    assert bp.best_fit_packing(frame(spark, []), PATH).count() == 0


def test_words_are_encoded_in_parts():
    """Words that differ in case and in what stands beside them share their parts; ids stay those of the library, beside odd characters too."""
    memory = tk._MEMORY[PATH] = tk.Memory(PATH)
    tk.encode(pa.array(["The the, (the) THE. the-12 21"]), PATH)
    assert set(memory.place) == {b"the", b",", b"(", b")", b".", b"-", b"1", b"2"}
    rng = random.Random(2)
    odd = [*"abJTKsdmlé''',.<|>-_01  \n\t\x1c\x7f\x85\xa0", "'s", "'RE", "́", "̌", "̸", "«", "İ", "Σ", "漢", "٣", "😀", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    ids, first = tk.encode(pa.array(texts), PATH)
    want = Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)
    for i, x in enumerate(want):
        assert ids[first[i] : first[i + 1]].tolist() == x.ids, texts[i]
