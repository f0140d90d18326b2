import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece

from folioloom.llm import sentencepiece_codec as sc
from tests.llm.helpers import documents, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_and_texts_are_the_library_s(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    odd = ["a  b", "\n x", " lead", "two  ", "é́ 漢字 \U0001f600", "\x00\x7f", "▁mark ▁", "x" * 300, "don't (stop) 123,456"]
    rows = documents() + [(9000 + i, t, "", "", 0) for i, t in enumerate(odd)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = sc.sentencepiece_encode(frame(spark, rows), PATH)
    texts = {r.doc_id: r.text for r in sc.sentencepiece_decode(got, PATH).collect()}
    by = {r.doc_id: r for r in got.collect()}
    for i, t, *_ in rows:
        want = sp.encode(t or "")
        assert list(by[i].ids) == want, t
        assert texts[i] == sp.decode(want)
        assert by[i].round_trip == (texts[i] == (t or ""))


def test_whole_table_and_long_unbroken_text():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    c = sc.codec(PATH)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    rng = random.Random(6)
    texts += ["".join(rng.choice("abcdetaoin shrdlué漢.,") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += ["a" * n for n in range(1, 100)] + [" " * n for n in range(1, 40)] + ["ab" * n for n in range(1, 40)]
    texts.append("".join(rng.choice("abcdetaoinshrdlu") for _ in range(100_000)))
    for text, ids in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(text)


def test_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "one two", 5, "x"), (1, "one two", 5, "x"), (None, None, None, None)], "doc_id long, text string, ids long, n_ids string")
    got = sc.sentencepiece_encode(odd, PATH)
    assert got.columns == ["doc_id", "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip"]
    assert sorted(r.n_ids for r in got.collect())[0] == 0


def test_viterbi_finds_the_best_segmentation():
    pieces = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab"]
    scores = [-2.0, -3.1, -3.2, -3.3, -4.0, -3.9, -7.5, -3.5, -4.1, -6.0]
    c = sc.Codec(pieces, scores, {}, set(), 0, bpe=False)
    value = dict(zip(pieces, scores, strict=True))
    for text in ("▁abcab", "▁cabcab", "▁aabbcc", "▁abcabc"):
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, now = [], text[0]
            for ch, cut in zip(text[1:], cuts, strict=True):
                parts, now = ([*parts, now], ch) if cut else (parts, now + ch)
            parts.append(now)
            if all(p in value for p in parts):
                best = max(best, sum(value[p] for p in parts))
        ids = c.encode_units([text])[0]
        assert "".join(pieces[i] for i in ids) == text
        assert abs(sum(scores[i] for i in ids) - best) < 1e-9


def test_empty(spark):
    assert sc.sentencepiece_encode(frame(spark, []), PATH).count() == 0


def test_words_of_like_length_advance_together():
    """Few calls serve words of many lengths, and each keeps its own ids beside longer ones."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    c = sc.Codec.load(PATH)
    calls = []
    own = c.viterbi
    c.viterbi = lambda *a: calls.append(1) or own(*a)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdetaoinshrdlué漢.") for _ in range(n)) for n in range(1, 200) for _ in range(3)]
    units = [sc.MARK + w for w in words]
    for word, ids in zip(words, c.encode_units(units), strict=True):
        assert ids.tolist() == sp.encode(word)
    assert len(calls) <= 20
