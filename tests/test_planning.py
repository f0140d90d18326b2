"""Merging of parts and blueprints against plain loops over small random tables."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators import merging

MISSING = merging.MISSING
OFFICES = ["Registrar", "Registrar North", "North", "registrar  ", None, "", MISSING, "Library", "needs REVIEW", "Lib/rary"]


def words(x):
    return re.sub(r"\s+", " ", x or "").strip()


def office(x):
    x = words(x).lower()
    return "" if x == MISSING.lower() else words(re.sub(r"[^\w\s]+", " ", x))


def one_by_one(parts):
    """Parts in order; each meets the group that the first part of its key has opened."""
    groups, first = [], {}
    for p in sorted(parts, key=lambda p: p["ord"]):
        if not p["key"]:
            continue
        g, o = first.get(p["key"]), office(p["office"])
        held = office(g["office"]) if g else ""
        if g is None or (held and o and held not in o and o not in held):
            new = {"key": p["key"], "head": p["ord"], "parts": 0, "office": None, "fee": None, "steps": []}
            groups.append(new)
            if g is None:
                first[p["key"]] = new
            g = new
        g["parts"] += 1
        if g["office"] is None and o:
            g["office"] = words(p["office"])
        if g["fee"] is None and words(p["fee"]) and p["fee"] != MISSING:
            g["fee"] = words(p["fee"])
        for s in map(words, p["steps"] or []):
            if s and s != MISSING and s.lower() not in {t.lower() for t in g["steps"]}:
                g["steps"].append(s)
    return sorted((g["key"], g["head"], g["parts"], g["office"], g["fee"], tuple(g["steps"])) for g in groups)


def merged(spark, parts):
    df = spark.createDataFrame([tuple(p.values()) for p in parts], "key string, ord long, office string, fee string, steps array<string>")
    out = merging.merge_parts(df, "key", "ord", "office", ["fee"], ["steps"]).collect()
    return sorted((r.key, r.head, r.parts, r.office, r.fee, tuple(r.steps)) for r in out)


def test_parts_as_one_by_one(spark):
    rnd = random.Random(3)
    steps = ["File it", "file  IT", "Pay", "", MISSING, None, "Wait"]
    parts = [{"key": rnd.choice(["a", "b", "c d", "", None]), "ord": i, "office": rnd.choice(OFFICES), "fee": rnd.choice([None, "", MISSING, " 5 ", "7"]), "steps": rnd.choice([None, [], rnd.choices(steps, k=4)])} for i in range(400)]
    assert merged(spark, parts) == one_by_one(parts)


def test_belonging_is_not_transitive(spark):
    part = lambda i, o: {"key": "k", "ord": i, "office": o, "fee": None, "steps": [str(i)]}
    parts = [part(0, None), part(1, "North"), part(2, "Registrar North"), part(3, "Registrar"), part(4, "Registrar"), part(5, MISSING)]
    got = merged(spark, parts)
    assert got == one_by_one(parts)
    assert [(g[1], g[2], g[5]) for g in got] == [(0, 4, ("0", "1", "2", "5")), (3, 1, ("3",)), (4, 1, ("4",))]


def test_no_parts(spark):
    assert merged(spark, [{"key": None, "ord": 1, "office": None, "fee": None, "steps": None}]) == []


def test_titles(spark):
    titles = ["Issue of Cards - Part 2", "issue of  cards (PART 3)", "Issue of Cards: part 10", "Issue, of cards!", "Part 2", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(merging.merge_key("t").alias("k"))
    assert [r.k for r in df.collect()] == ["issue of cards"] * 4 + ["part 2", None]


def key(x):
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip(" ")


def says_nothing(x):
    return len(key(x)) <= 2 or not re.sub("[0-9 ]", "", key(x))


def scoped(scope, topic):
    return topic if topic.lower().startswith(scope.lower()) else f"{scope} {topic}"


def coherent(units):
    kinds = {u["type"] for u in units} - {None}
    return len({key(u["topic"]) for u in units} - {""}) <= 4 and len(kinds) <= 2 and len({u["root"] for u in units} - {None}) <= 3


def planned(units):
    """Blueprints by nested loops over all units."""
    by_parent, out = defaultdict(list), []
    for u in sorted(units, key=lambda u: u["ord"]):
        u = u | {"parent": words(u["parent"]) or merging.NO_PARENT, "topic": words(u["topic"]) or merging.NO_TOPIC}
        by_parent[u["parent"]].append(u)
    add = lambda parent, topic, us, whole, fits: out.append({"parent": parent, "topic": topic, "units": len(us), "lead": us[0]["ord"], "scope": min((u["root"] for u in us if u["root"] is not None), default=None), "whole": whole, "fits": fits})
    for parent, us in by_parent.items():
        topics = defaultdict(list)
        for u in us:
            topics[key(u["topic"])].append(u)
        if len(topics) >= 3 and len(us) >= 3 and len({u["root"] for u in us} - {None}) <= 1 and coherent(us) and not says_nothing(parent):
            add(parent, parent, us, True, True)
            continue
        for ts in topics.values():
            roots = defaultdict(list)
            for u in ts:
                roots[parent if u["root"] is None else u["root"]].append(u)
            for root, rs in roots.items() if len(roots) > 1 else [(None, ts)]:
                topic = parent if len(rs) >= 3 and len({u["topic"] for u in rs}) > 1 else rs[0]["topic"]
                topic = topic if root is None else scoped(root, topic)
                if not says_nothing(topic):
                    grown = len(rs) >= 3 and not says_nothing(parent)
                    add(parent, topic, rs, grown and coherent(rs), not grown or coherent(rs))
    kept = {}
    for b in sorted(out, key=lambda b: (-b["units"], b["lead"])):
        kept.setdefault((b["parent"].lower(), b["topic"].lower()), b)
    times = defaultdict(int)
    for b in kept.values():
        times[key(b["topic"])] += 1
    for b in kept.values():
        if times[key(b["topic"])] > 1 and b["scope"] is not None:
            title = scoped(b["scope"], b["topic"])
            if key(b["parent"]) == key(b["topic"]) and title != b["topic"]:
                b["parent"] = title
            b["topic"] = title
    return sorted((b["parent"], b["topic"], b["units"], b["lead"], b["whole"], b["fits"]) for b in kept.values())


def test_blueprints_as_loops(spark):
    rnd = random.Random(11)
    for size in (12, 60, 500):
        units = [{"parent": rnd.choice(["Leave", "leave", "Fees ", "12", "of", None, "North Fees", "Cards", "Loans"]), "topic": rnd.choice(["Refund", "refund!", "When", "Where", "42", "", None, "Leave", "north fees", "Who"]), "root": None, "type": rnd.choice([None, None, "form", "policy", "step"]), "ord": i} for i in range(size)]
        for u in units:
            u["root"] = rnd.choice(["North", "South", None]) if u["parent"] in ("Leave", "Fees ", "12") else "North"
            if u["parent"] in ("Cards", "Loans"):
                u["topic"], u["type"] = rnd.choice(["When", "Where", "Who", "who?"]), rnd.choice([None, "form"])
        df = spark.createDataFrame([tuple(u.values()) for u in units], "parent string, topic string, root string, type string, ord long")
        got = merging.blueprints(df, lambda k: F.length(k) <= 2)
        assert sorted(tuple(r) for r in got.drop("id").collect()) == planned(units)
        assert got.select("id").distinct().count() == got.where(F.col("id") == tf.stable_id("parent", "topic")).select("id").distinct().count()


def test_no_units(spark):
    none = spark.createDataFrame([], "parent string, topic string, root string, type string, ord long")
    assert merging.blueprints(none, lambda k: F.length(k) <= 2).count() == 0
