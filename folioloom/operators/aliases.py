"""Many aliases looked for in many texts, in one pass a text.

The aliases become a trie with failure links, which a task builds once and then runs
over each of its texts: time does not grow with the number of aliases. The trie is
told to the tasks, so its size is checked: beyond ROOM bytes of aliases they are dealt
into shards, each of which is another pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.sources.shared import written

ROOM = 8 << 20  # bytes of aliases in one trie; a trie takes some 30 times that
LEAST, MARGIN = 0.72, 0.12  # confidence that a match needs, and its lead over the next office
FULL = 1.35  # score of confidence 1
HELD = 100_000  # scores of texts that are rated together


def _border(c: str) -> bool:
    return not (c.isascii() and c.isalnum())


class Trie:
    """Which of the aliases stand in a text between borders (no ASCII letter or digit beside them)."""

    def __init__(self, aliases: list[tuple[int, str]]):
        self.found = ahocorasick.Automaton()
        for number, alias in aliases:
            self.found.add_word(alias, (number, len(alias)))
        if aliases:
            self.found.make_automaton()

    def hits(self, text: str) -> list[int]:
        if not len(self.found):
            return []
        hits = set()
        for end, (number, size) in self.found.iter(text):
            if (end + 1 == len(text) or _border(text[end + 1])) and (end + 1 == size or _border(text[end - size])):
                hits.add(number)
        return sorted(hits)


def _searched(aliases: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(aliases)
        for batch in batches:
            hits = [trie.hits(t or "") for t in batch.column("t").to_pylist()]
            yield batch.append_column("alias_no", pa.array(hits, pa.list_(pa.int64())))

    return run


def with_hits(texts: DataFrame, aliases: DataFrame, room: int = ROOM) -> DataFrame:
    """texts: any columns and t, normalised. aliases: alias_no (long) and alias, normalised, no two alike. Adds alias_no, the numbers of the aliases in t.

    Null and empty texts and aliases hold nothing. With more than `room` bytes of
    aliases there are several rows a text, one a shard of aliases.
    """
    aliases = aliases.where("alias <> ''").select("alias_no", "alias")
    shards = 1 + (aliases.agg(F.sum(F.octet_length("alias").cast("long"))).first()[0] or 0) // room
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", alias_no array<bigint>"
    out = None
    for shard in range(shards):
        own = aliases.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == shard) if shards > 1 else aliases
        found = texts.mapInArrow(_searched([(r["alias_no"], r["alias"]) for r in own.collect()]), schema)  # below `room` bytes, about
        out = found if out is None else out.unionByName(found)
    return out


def score(weight: Column, alias: Column, text: Column) -> Column:
    """Longer aliases, relative to the text, are stronger evidence."""
    return F.greatest(F.lit(0.1), weight) * (0.65 + 0.35 * F.least(F.lit(1.0), F.length(alias) / F.greatest(F.lit(12), F.least(F.length(text), F.lit(80)))))


def _leading(known: list[tuple[int | None, str, float | None]]):
    """The two offices with the best scores of each text, one row each; what else a text holds never leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted({a for _, a, _ in known}, key=str.encode)
        places = sorted({o for o, _, _ in known}, key=lambda o: (o is not None, o or 0))
        number, place = {a: i for i, a in enumerate(names)}, {o: i for i, o in enumerate(places)}
        trie, size = Trie(list(enumerate(names))), np.array([len(a) for a in names], np.int64)
        rows = sorted((number[a], place[o], 0.1 if w is None else max(0.1, w)) for o, a, w in known)
        alias, office, weight = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        begin = np.searchsorted(alias, np.arange(len(names) + 1))
        many = np.diff(begin)

        def best(texts: list[tuple[int, int]], hits: list[list[int]]) -> tuple[np.ndarray, ...]:
            flat = np.concatenate([np.array(h, np.int64) for h in hits])
            of = np.repeat(np.arange(len(texts)), [len(h) for h in hits])
            each = np.repeat(np.arange(len(flat)), many[flat])
            row = np.arange(len(each)) - np.repeat(np.cumsum(many[flat]) - many[flat], many[flat]) + begin[flat[each]]
            text, length = np.array(texts, np.int64)[of[each]].T
            s = weight[row] * (0.65 + 0.35 * np.minimum(1.0, size[alias[row]] / np.maximum(12, np.minimum(length, 80))))
            by = np.lexsort((alias[row], size[alias[row]], s, office[row], text))  # the last of an office is its best
            last = by[np.flatnonzero(np.r_[(text[by][1:] != text[by][:-1]) | (office[row][by][1:] != office[row][by][:-1]), True])]
            by = last[np.lexsort((office[row][last], -s[last], text[last]))]
            first = np.flatnonzero(np.r_[True, text[by][1:] != text[by][:-1]])
            at = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
            by = by[at < 2]
            return text[by], office[row][by], s[by], alias[row][by]

        for batch in batches:
            texts, hits, held = [], [], 0
            for at, t in enumerate([*batch.column("t").to_pylist(), None]):
                if hit := trie.hits(t or ""):
                    texts.append((at, len(t)))
                    hits.append(hit)
                    held += int(many[hit].sum())
                if hits and (held > HELD or at == batch.num_rows):
                    text, o, s, a = best(texts, hits)
                    keys = batch.drop_columns("t").take(pa.array(text))
                    out = {"office_id": pa.array([places[i] for i in o], pa.int64()), "s": pa.array(s), "n": pa.array(size[a], pa.int32()), "alias": pa.array([names[i] for i in a], pa.string())}
                    yield pa.RecordBatch.from_arrays([*keys.columns, *out.values()], [*keys.schema.names, *out])
                    texts, hits, held = [], [], 0

    return run


def leading(texts: DataFrame, known: DataFrame, room: int = ROOM) -> DataFrame:
    """texts: keys and t, normalised. known: office_id, alias, weight, one row an office and alias. The columns besides t, office_id, s, n and alias.

    Two rows a text at most, and as many again for each further `room` bytes of aliases:
    an office that is best or second over all shards is so in the shard of its best alias.
    """
    size = F.octet_length("alias") + 16
    shards = 1 + (known.agg(F.sum(size.cast("long"))).first()[0] or 0) // room
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "t") + ", office_id long, s double, n int, alias string"
    out = None
    for shard in range(shards):
        own = known.where(F.pmod(F.xxhash64("alias", "office_id"), F.lit(shards)) == shard) if shards > 1 else known
        found = texts.mapInArrow(_leading([tuple(r) for r in own.select("office_id", "alias", "weight").collect()]), schema)  # below `room` bytes, about
        out = found if out is None else out.unionByName(found)
    return out


def offices_of(texts: DataFrame, keys: list[str], text: str, aliases: DataFrame, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """keys, office_id, alias and confidence of each text with one office that is sure and leads the next one.

    aliases: office_id, alias, weight. Of two rows with the same alias and office the
    heavier counts. Ties of scores: no office leads, unless both aliases are one's.
    """
    rows = aliases.select(F.col("office_id").cast("long").alias("office_id"), tf.normal("alias").alias("alias"), F.col("weight").cast("double").alias("weight")).groupBy("office_id", "alias").agg(F.max("weight").alias("weight")).where("alias <> ''")
    each = leading(texts.select(*keys, tf.normal(text).alias("t")), written(rows))
    best = each.groupBy(*keys, "office_id").agg(F.max(F.struct("s", "n", "alias")).alias("m"))
    w = Window.partitionBy(*keys).orderBy(F.desc("m.s"), "office_id")
    sure = lambda x: F.least(F.lit(1.0), x / FULL)
    led = best.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("m.s").over(w)).where("k = 1")
    confidence = sure(F.col("m.s"))
    return led.where((confidence >= least) & (F.col("next").isNull() | (confidence - sure(F.col("next")) >= margin))).select(*keys, "office_id", F.col("m.alias").alias("alias"), confidence.alias("confidence"))
