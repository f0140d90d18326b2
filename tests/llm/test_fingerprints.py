import hashlib

import numpy as np
import pyarrow as pa

from folioloom.llm import document_fingerprints as fp
from tests.llm.helpers import documents, frame


def test_whole_fraction_is_exact_likeness():
    a, b = "a b c d e f g h", "a b c d e f x y"
    x, y = fp.sketches(pa.array([a, b], pa.large_string()), fraction=1)
    assert len(x) == 4
    assert fp.likeness(x, y) == 2 / 6
    assert fp.containment(x, y) == 2 / 4


def test_sketch_of_union_is_merged_sketch():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 500, 900)]
    left, right = " ".join(words[:500]), " ".join(words[496:])
    a, b, both = fp.sketches(pa.array([left, right, " ".join(words)], pa.large_string()))
    assert set(a) | set(b) == set(both)


def test_query(spark):
    rows = [r for r in documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in fp.edited_likeness(frame(spark, rows)).collect()}
    order = sorted(rows)
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= g.near_edited <= 1
        own, changed, after = fp.sketches(pa.array([t, e, nxt], pa.large_string()))
        assert (g.fingerprint, g.edited_fingerprint) == (fp.text_of(own), fp.text_of(changed))
        assert g.near_next == fp.likeness(own, after)
    assert len(got) == len(order)


def test_edges(spark):
    assert fp.edited_likeness(frame(spark, [])).count() == 0
    assert fp.edited_likeness(frame(spark, documents())).count() == len(documents())
    alone = fp.edited_likeness(frame(spark, [(1, "a b", "", "", 0)])).first()
    assert (alone.near_edited, alone.near_next) == (0.0, 1.0) or alone.near_next == 1.0
    nulls = fp.document_fingerprints(frame(spark, [(None, None, None, None, None)])).first()
    assert (nulls.doc_id, nulls.fingerprint) == (None, "")
