"""Aliases, header closeness, matches with context and assignment against plain versions."""

import difflib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators import aliases, assignment, matching

HEADERS = ["Bureau or Branch", "Matter", "Kind of Request", "Who May Ask", "Client Steps", "Agency Actions", "Fees to be Paid"]


def spoiled(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 6)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "E", "S", " "])
    return "".join(out)


def test_ratio_is_difflibs():
    rng = random.Random(1)
    for _ in range(3000):
        k = rng.choice([2, 4, 26])
        a, b = ("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:k]) for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert abs(matching.ratio(a, b) - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-12


def test_closest_headers_of_cells(spark):
    rng = random.Random(2)
    known = {h.upper(): h for h in HEADERS}
    texts = [spoiled(rng, rng.choice(HEADERS)) for _ in range(400)] + ["", None, "12", "SERVICES", "Our services", "one two three four five six", "matter", "Unknown"] * 2
    got = {r["i"]: r["header"] for r in matching.closest_headers(spark.createDataFrame(list(enumerate(texts)), "i int, cell string"), "cell", HEADERS).collect()}
    for i, t in enumerate(texts):
        c = " ".join(re.sub("[^A-Za-z ]", " ", t or "").split()).upper()
        alone = {h.split()[0].upper() for h in HEADERS}
        ok = c and len(c.split()) <= 5 and not c.endswith("SERVICES") and (" " in c or c in alone)
        best = difflib.get_close_matches(c, list(known), n=1, cutoff=0.72) if ok else []
        assert got.get(i) == (known[best[0]] if best else None)


def test_aliases_between_borders(spark):
    rng = random.Random(3)
    names = ["help desk", "desk", "records", "a.b", "office of records", "é", "x1"]
    texts = ["".join(rng.choice([*names, " ", ",", "z", "9", "é"]) for _ in range(rng.randint(0, 8))) for _ in range(400)] + ["", None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(names)], "alias_no long, alias string")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {i: [k for k, a in enumerate(names) if re.search(rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])", t or "")] for i, t in enumerate(texts)}
    assert {r["i"]: sorted(r["alias_no"]) for r in aliases.with_hits(df, rows).collect()} == want
    apart = {}
    for r in aliases.with_hits(df, rows, room=8).collect():  # several tries
        apart.setdefault(r["i"], []).extend(r["alias_no"])
    assert {i: sorted(x) for i, x in apart.items()} == want
    assert all(r["alias_no"] == [] for r in aliases.with_hits(df, rows.where("false")).collect())


def test_time_does_not_grow_with_the_aliases():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40_000))
    took = []
    for n in (100, 20_000):
        trie = aliases.Trie([(i, "".join(rng.choice("abcdefgh") for _ in range(9))) for i in range(n)])
        began = time.perf_counter()
        trie.hits(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def test_sure_offices_lead_the_next(spark):
    rows = spark.createDataFrame([(1, "Records", 1.5), (2, "Help  Desk", 1.5), (3, "records", 1.4), (1, "records", 1.0), (4, "registry", 0.1)], "office_id long, alias string, weight double")
    texts = spark.createDataFrame([(1, "records?"), (2, "HELP DESK"), (3, "help desk records"), (4, "the registry"), (5, None)], "i int, text string")
    got = {r["i"]: (r["office_id"], r["alias"]) for r in aliases.offices_of(texts, ["i"], "text", rows).collect()}
    assert got == {2: (2, "help desk")}  # records are two offices'; the registry's alias is weak


def test_matches_around(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the ", "THE\n", "cat ", "é", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tf.matches_around("t", "(?i)the", 7, F.lit("x")).alias("m")).collect()
    for r in got:
        t = texts[r["i"]] or ""
        want = [("x", n, m[0], m.start(), t[max(0, m.start() - 7) : m.end() + 7]) for n, m in enumerate(re.finditer("(?i)the", t))]
        assert [tuple(x) for x in r["m"] or []] == want


def test_assignment_equals_taking_turns(spark):
    rng = random.Random(6)
    for askers, items in ((12, 5), (30, 200), (1, 1)):
        rows = [(o, rng.randint(0, 3), rng.randrange(items)) for o in range(1, askers + 1) for _ in range(rng.randint(0, 40))]
        rows = list({(o, i): (o, k, i) for o, k, i in rows}.values())
        taken, want = set(), {}
        for o in range(1, askers + 1):
            free = sorted((k, i) for x, k, i in rows if x == o and i not in taken)
            if free:
                want[o] = free[0][1]
                taken.add(want[o])
        df = spark.createDataFrame(rows, "ord long, rank long, item long")
        assert {r["ord"]: r["item"] for r in assignment.first_free(df, askers).collect()} == want


@pytest.mark.parametrize("room", [aliases.ROOM, 60])
def test_a_text_leaves_its_task_with_two_offices_at_most(spark, room):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    known = {(o, " ".join(rng.choices(words, k=rng.randint(1, 3)))): rng.choice([0.7, 0.9, 1.1]) for o in range(6) for _ in range(8)}
    texts = [(i, " ".join(rng.choices(words, k=30))) for i in range(40)] + [(40, ""), (41, None), (42, "nothing")]
    df, rows = spark.createDataFrame(texts, "i long, t string").coalesce(1), spark.createDataFrame([(o, a, w) for (o, a), w in known.items()], "office_id long, alias string, weight double")
    got = aliases.leading(df, rows, room).collect()
    best = {}
    for r in got:
        best[r["i"], r["office_id"]] = max(best.get((r["i"], r["office_id"]), (0.0, 0, "")), (r["s"], r["n"], r["alias"]))
    for i, t in texts:
        score = {}
        for (o, a), w in known.items():
            if f" {a} " in f" {t} ":
                score[o] = max(score.get(o, (0.0, 0, "")), (w * (0.65 + 0.35 * min(1.0, len(a) / max(12, min(len(t), 80)))), len(a), a))
        first = sorted(score, key=lambda o: (-score[o][0], o))[:2]
        found = sorted((o for j, o in best if j == i), key=lambda o: (-best[i, o][0], o))[:2]
        assert [(o, score[o]) for o in first[:1]] == [(o, best[i, o]) for o in found[:1]]
        assert [score[o][0] for o in first] == [best[i, o][0] for o in found]
    if room == aliases.ROOM:
        assert len(got) == len(best) <= 2 * len(texts)
