"""Merging of rows that belong together where belonging is not transitive, and grouping of units into articles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.sources.shared import written

#: Says that a field was looked for and not found; as good as null.
MISSING = "Needs review"
#: Groups of units become one article of their parent within these limits.
LEAST_UNITS, MOST_TOPICS, MOST_TYPES, MOST_ROOTS = 3, 4, 2, 3
NO_PARENT, NO_TOPIC = "General", "General Information"


def without_part(title: Column | str) -> Column:
    """A title without `- Part 2` or `(part 2)` at its end."""
    x = tf.collapse(title)
    for suffix in (r"(?i)\s*[-–—:]\s*part\s*\d+\s*$", r"(?i)\s*\(\s*part\s*\d+\s*\)\s*$"):
        x = F.regexp_replace(x, suffix, "")
    return F.regexp_replace(x, "^[ :–—-]+|[ :–—-]+$", "")


def merge_key(title: Column | str) -> Column:
    return tf.collapse(F.regexp_replace(F.lower(without_part(title)), r"[^\p{L}\p{N}_\s/]+", " "))


def office_key(office: Column | str) -> Column:
    """An office's name for comparison; null and MISSING are empty."""
    x = F.coalesce(tf.collapse(office), F.lit(""))
    return F.when(F.lower(x) == MISSING.lower(), "").otherwise(tf.collapse(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]+", " ")))


def _filled(x: Column) -> Column:
    return (tf.collapse(x) != "") & (x != MISSING)


def merge_parts(parts: DataFrame, key: str, order: str, office: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row for each service, from its parts.

    parts: `key` (string), `order` (unique, not null), `office`, string columns `scalars`
    and array<string> columns `lists`. A key's first part opens its group. The group's
    office is the first one filled, and a part joins it if its own is empty or either name
    contains the other; any other part stays by itself, so that `a b` and `b` may both
    belong to `b`'s group while `a` does not meet `c`. Returns `key`, `head` (the least
    order of the group), `parts`, `office`, the first filled value of each scalar (null: none) and each
    list's items in order, once in any case, the first spelling kept; blank ones and
    MISSING go. Parts with a null or empty key are dropped.

    The office that decides is an aggregate of its key, so no part waits for another: a
    key with a third of all rows is combined before the shuffle, split by the adaptive
    skew join, and combined again. Lists do not travel by key: they meet their group by `order`.
    Items are the same if the MD5 of their lower case is.
    """
    parts = parts.where(F.col(key) != "")
    x = parts.select(F.col(key).alias("_key"), F.col(order).alias("_ord"), F.col(office).alias("_office"), office_key(office).alias("_o"), *scalars)
    anchors = x.groupBy("_key").agg(F.min("_ord").alias("_head"), F.min_by("_o", F.when(F.col("_o") != "", F.col("_ord"))).alias("_a"))
    inside = F.col("_a").isNull() | (F.col("_o") == "") | F.contains("_a", "_o") | F.contains("_o", "_a")
    member = x.join(anchors, "_key").withColumn("head", F.when(inside, F.col("_head")).otherwise(F.col("_ord")))
    first = lambda c, by: F.min_by(tf.collapse(c), F.when(by, F.col("_ord")))
    fields = member.groupBy(F.col("_key").alias(key), "head").agg(F.count("*").alias("parts"), first("_office", F.col("_o") != "").alias(office), *(first(c, _filled(F.col(c))).alias(c) for c in scalars))
    heads = member.select("_ord", "head")
    return reduce(lambda out, c: out.join(_united(parts.select(F.col(order).alias("_ord"), c).join(heads, "_ord"), c), "head", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>"))), lists, fields)


def _united(member: DataFrame, name: str) -> DataFrame:
    """The items of one list of each group, in order, once."""
    item = member.select("head", "_ord", F.posexplode(name).alias("_at", "_item")).withColumn("_item", tf.collapse("_item")).where(_filled(F.col("_item")))
    once = item.groupBy("head", F.unhex(F.md5(F.lower("_item"))).alias("_k")).agg(F.min(F.struct("_ord", "_at", "_item")).alias("_first"))
    return once.groupBy("head").agg(F.transform(F.sort_array(F.collect_list("_first")), lambda s: s["_item"]).alias(name))


def blueprints(units: DataFrame, generic: Callable[[Column], Column]) -> DataFrame:
    """Articles to be written from units.

    units: parent, topic, root (null: none), type (null: plain), ord (unique, not null).
    `generic` tells of a title key (lower case, letters and digits) whether it says nothing.
    Null or blank parents and topics are General and General Information. Topics of a
    parent that have one title key are one topic, named as its least ord is. A parent with at
    least 3 topics and 3 units that come from one root at most, and that is coherent (at
    most 4 topics, 2 types, 3 roots), becomes one article, unless its own title is
    generic. Else each topic is an article, or one article for each of its roots, with the
    root before its title; a topic of 3 units or more in several spellings takes its parent's title. Articles
    with generic or numeric titles are dropped, and of those with one id the larger stays.
    Titles that still repeat get their root in front.

    Returns id, parent, topic, units, lead (least ord), consolidated, coherent. Units are counted once by
    their distinct fields, before any shuffle; all later steps read these counts.
    """
    blank = lambda c, name: F.when(F.coalesce(tf.collapse(c), F.lit("")) == "", name).otherwise(tf.collapse(c)).alias(c)
    clean = units.select(blank("parent", NO_PARENT), blank("topic", NO_TOPIC), "root", "type", "ord")
    kinds = written(clean.groupBy("parent", "topic", "root", "type").agg(F.count("*").alias("n"), F.min("ord").alias("lead")).withColumn("k", tf.title_key("topic")))

    of_parent = kinds.groupBy("parent").agg(
        F.sum("n").alias("units"), F.min("lead").alias("lead"), F.count_distinct("k").alias("keys"), F.count_distinct(F.nullif("k", F.lit(""))).alias("topics"), F.count_distinct("type").alias("types"), F.count_distinct("root").alias("roots"), F.min("root").alias("scope"),
    )
    coherent = (F.col("topics") <= MOST_TOPICS) & (F.col("types") <= MOST_TYPES) & (F.col("roots") <= MOST_ROOTS)
    whole = (F.col("keys") >= LEAST_UNITS) & (F.col("units") >= LEAST_UNITS) & (F.col("roots") <= 1) & coherent & ~_says_nothing("parent", generic)
    of_parent = of_parent.withColumn("whole", whole)
    consolidated = of_parent.where("whole").select("parent", F.col("parent").alias("topic"), "scope", "units", "lead", F.lit(True).alias("consolidated"), F.lit(True).alias("coherent"))

    split = kinds.groupBy("parent", "k").agg(F.count_distinct(F.coalesce("root", "parent")).alias("split"))
    rest = kinds.join(of_parent.where("NOT whole").select("parent"), "parent").join(split, ["parent", "k"]).withColumn("part", F.when(F.col("split") > 1, F.coalesce("root", "parent")))
    group = rest.groupBy("parent", "k", "part").agg(
        F.sum("n").alias("units"), F.min("lead").alias("lead"), F.min_by("topic", "lead").alias("topic"), F.count_distinct("topic").alias("spellings"), F.count_distinct(F.nullif("k", F.lit(""))).alias("topics"), F.count_distinct("type").alias("types"), F.count_distinct("root").alias("roots"), F.min("root").alias("scope"),
    )
    named = group.withColumn("topic", F.when((F.col("units") >= LEAST_UNITS) & (F.col("spellings") > 1), F.col("parent")).otherwise(F.col("topic")))
    named = named.withColumn("topic", F.when(F.col("part").isNull(), F.col("topic")).otherwise(_scoped("part", "topic"))).where(~_says_nothing("topic", generic))
    grown = (F.col("units") >= LEAST_UNITS) & ~_says_nothing("parent", generic)
    single = named.select("parent", "topic", "scope", "units", "lead", (grown & coherent).alias("consolidated"), (~grown | coherent).alias("coherent"))

    found = consolidated.unionByName(single).withColumn("id", tf.stable_id("parent", "topic"))
    row = F.struct("parent", "topic", "scope", "units", "lead", "consolidated", "coherent")
    kept = written(found.groupBy("id").agg(F.max_by(row, F.struct("units", -F.col("lead"))).alias("x")).select("x.*").withColumn("k", tf.title_key("topic")))
    again = kept.groupBy("k").agg((F.count("*") > 1).alias("again"))
    title = F.when(F.col("again") & F.col("scope").isNotNull(), _scoped("scope", "topic")).otherwise(F.col("topic"))
    same = tf.title_key("parent") == F.col("k")
    out = kept.join(again, "k").withColumn("title", title).withColumn("parent", F.when(same & (F.col("title") != F.col("topic")), F.col("title")).otherwise(F.col("parent")))
    return out.select(tf.stable_id("parent", "title").alias("id"), "parent", F.col("title").alias("topic"), "units", "lead", "consolidated", "coherent")


def _scoped(scope: str, topic: str) -> Column:
    return F.when(F.startswith(F.lower(topic), F.lower(scope)), F.col(topic)).otherwise(F.concat_ws(" ", scope, topic))


def _says_nothing(title: str, generic: Callable[[Column], Column]) -> Column:
    key = tf.title_key(title)
    return generic(key) | key.rlike("^[0-9 ]*$")
