import random
import zlib
from collections import Counter, defaultdict

from folioloom.llm import sharding
from tests.llm.helpers import documents, frame


def checked(rows, got, shards):
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    sizes, slots = Counter(r.shard for r in got), defaultdict(list)
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == shards else 0) <= 1
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small(spark):
    rows = documents()
    checked(rows, sharding.label_propagation_shards(frame(spark, rows)).collect(), 40)


def test_copies_come_together_and_a_hot_group_is_split(spark):
    rows = [(i, f"text {i}", "", "", 0) for i in range(200)]
    rows += [(1000 + 10 * g + i, f"copy {g}", "", "", 0) for g in range(20) for i in range(3)]
    rows += [(5000 + i, "hot", "", "", 0) for i in range(130)]
    got = sharding.label_propagation_shards(frame(spark, rows), shards=10).collect()
    checked(rows, got, 10)
    by = {r.doc_id: r.shard for r in got}
    whole = sum(len({by[1000 + 10 * g + i] for i in range(3)}) == 1 for g in range(20))
    assert whole >= 18
    hot = Counter(by[5000 + i] for i in range(130))
    assert sum(sorted(hot.values())[-4:]) >= 100


def test_empty(spark):
    assert sharding.label_propagation_shards(frame(spark, [])).count() == 0


def test_linked_rows_trade_places_where_every_text_has_a_copy(spark):
    rows = [(2 * g + i, f"pair {g}", "", "", 0) for g in range(300) for i in range(2)]
    got = sharding.label_propagation_shards(frame(spark, rows), shards=10).collect()
    checked(rows, got, 10)
    by = {r.doc_id: r.shard for r in got}
    assert sum(by[2 * g] == by[2 * g + 1] for g in range(300)) >= 280


def test_quotas():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(2, 12)
        wish = {(a, b): rng.randint(0, 9) for a in range(n) for b in range(n) if a != b}
        free = {a: rng.randint(0, 6) for a in range(n) if rng.random() < 0.5}
        got = sharding.quotas(wish, free)
        gain = Counter()
        for (a, b), x in got.items():
            assert 0 < x <= wish[a, b]
            gain[a] -= x
            gain[b] += x
        assert all(gain[a] <= free.get(a, 0) for a in range(n))
    assert sharding.quotas({(0, 1): 5, (1, 2): 5, (2, 0): 5}, {}) == {(0, 1): 5, (1, 2): 5, (2, 0): 5}
    assert sharding.quotas({(0, 1): 5}, {1: 3}) == {(0, 1): 3}
