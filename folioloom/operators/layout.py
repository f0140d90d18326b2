"""Word boxes into rows, cells and columns; greedy packing.

Rows depend on what came before in a way windows can't say (a running mean), so pages stream through a task sorted by key, one page's
state at a time. What follows from rows is window work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster(cy: list[float], height: list[float], least: float = 3.0, share: float = 0.65) -> list[int]:
    """Row number of each box (sorted by cy): a new row starts further from the running mean of the row than the tolerance."""
    middle = sorted(height)[len(height) // 2] if height else 0.0
    far = max(least, share * middle)
    out, row, mean, n = [], -1, 0.0, 0
    for y in cy:
        if row < 0 or abs(y - mean) > far:
            row, mean, n = row + 1, y, 1
        else:
            n += 1
            mean += (y - mean) / n
        out.append(row)
    return out


def rows(boxes: DataFrame, least: float = 3.0, share: float = 0.65) -> DataFrame:
    """boxes: page (long), word (long), text, x0, x1, cy, height. Adds row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows so far of the last page, which later frames may go on with
        for pdf in frames:
            last = pdf["page"].iloc[-1] if len(pdf) else None
            if not len(pdf) or held and held[0]["page"].iloc[0] == last:
                held.append(pdf)
                continue
            goes_on = pdf["page"] == last
            yield _numbered(pd.concat([*held, pdf[~goes_on]]), least, share)
            held = [pdf[goes_on]]
        if held:
            yield _numbered(pd.concat(held), least, share)

    order = ["page", "cy", "x0", "word"]
    return boxes.repartition("page").sortWithinPartitions(*order).mapInPandas(run, boxes.schema.simpleString()[7:-1].replace(":", " ") + ", row int")


def _numbered(pdf: pd.DataFrame, least: float, share: float) -> pd.DataFrame:
    page = pdf["page"].to_numpy()
    edges = [0, *(i + 1 for i in range(len(page) - 1) if page[i] != page[i + 1]), len(page)]
    cy, height = pdf["cy"].tolist(), pdf["height"].tolist()
    return pdf.assign(row=[r for a, b in zip(edges, edges[1:], strict=False) for r in cluster(cy[a:b], height[a:b], least, share)])


def row_text(boxes: DataFrame) -> DataFrame:
    """Text of each row with a bar where the gap between words is wide."""
    w = Window.partitionBy("page", "row").orderBy("x0", "word")
    wide = (F.col("x0") - F.lag("x1").over(w)) > F.greatest(2 * F.col("height"), F.lit(18.0))
    piece = F.concat(F.when(wide, "| ").otherwise(""), "text")
    marked = boxes.withColumn("piece", piece)
    item = F.struct("x0", "word", "piece")
    return marked.groupBy("page", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["piece"]), " ").alias("text"))


def boundaries(boxes: DataFrame, columns: int, least: float = 0.0) -> DataFrame:
    """Midpoints of each row's columns - 1 widest gaps, ascending."""
    w = Window.partitionBy("page", "row").orderBy("x0", "word")
    gaps = boxes.withColumn("next", F.lead("x0").over(w)).withColumn("gap", F.col("next") - F.col("x1")).where(F.col("gap") >= least)
    top = gaps.withColumn("k", F.row_number().over(Window.partitionBy("page", "row").orderBy(F.desc("gap"), "x0", "word"))).where(F.col("k") < columns)
    return top.groupBy("page", "row").agg(F.sort_array(F.collect_list((F.col("x1") + F.col("next")) / 2)).alias("bounds"))


def column_of(x0: Column, bounds: Column) -> Column:
    """How many boundaries lie at or left of x0."""
    return F.size(F.filter(bounds, lambda b: x0 >= b))


def packed(parts: Column, limit: int, glue: str = "\n\n", overlap: int = 0) -> Column:
    """Greedy packing of strings into pieces of at most `limit` characters, as one fold.

    A piece that is full is followed by one that begins with its last `overlap`
    characters. A string longer than the limit is cut: its first `limit` characters
    are a piece, and what is left begins the next one, whole however long it is.
    Empty strings add nothing.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("now"))

    def step(acc: Column, x: Column) -> Column:
        now, done = acc["now"], acc["done"]
        fits = (now == "") | (F.length(now) + len(glue) + F.length(x) <= limit)
        more = F.when(now == "", x).otherwise(F.concat(now, F.lit(glue), x))
        tail = F.when(F.length(now) > overlap, F.substr(now, F.length(now) - overlap + 1, F.lit(overlap))).otherwise(now) if overlap else F.lit("")
        again = F.when(tail == "", x).otherwise(F.concat(tail, F.lit(glue), x)) if overlap else x
        long = F.length(x) > limit
        full = F.when(now == "", done).otherwise(F.concat(done, F.array(now)))
        kept = F.struct(F.concat(full, F.array(F.substr(x, F.lit(1), F.lit(limit)))).alias("done"), F.substr(x, F.lit(limit + 1), F.length(x)).alias("now"))
        put = F.when(fits, F.struct(done.alias("done"), more.alias("now"))).otherwise(F.struct(F.concat(done, F.array(now)).alias("done"), again.alias("now")))
        return F.when(x == "", acc).when(long, kept).otherwise(put)

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def voted_bounds(boxes: DataFrame, columns: int, least: float = 8.0) -> DataFrame:
    """Boundaries of a page's columns, for which all its rows vote: where words begin, sorted, the widest gaps between neighbours.

    Words begin anywhere inside a column but nowhere between columns, so the columns - 1
    widest gaps of at least `least` part them. One row a place and page is compared,
    however many words begin there. Equal gaps: the left one.
    """
    w = Window.partitionBy("page").orderBy("x0")
    places = boxes.select("page", "x0").distinct().withColumn("next", F.lead("x0").over(w)).withColumn("gap", F.col("next") - F.col("x0")).where(F.col("gap") >= least)
    top = places.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("gap"), "x0"))).where(F.col("k") < columns)
    return top.groupBy("page").agg(F.sort_array(F.collect_list((F.col("x0") + F.col("next")) / 2)).alias("bounds"))


def column_cells(rows: DataFrame, columns: int, least: float = 8.0) -> DataFrame:
    """rows: boxes with their row. One row for each page and row, with its `columns` cells of text; a page without boundaries has one cell a row."""
    bounds = voted_bounds(rows, columns, least)
    placed = rows.join(bounds, "page", "left").withColumn("col", column_of(F.col("x0"), F.coalesce("bounds", F.array().cast("array<double>"))))
    words = placed.groupBy("page", "row").agg(F.sort_array(F.collect_list(F.struct("x0", "word", "col", "text"))).alias("words"))
    cell = lambda c: F.array_join(F.transform(F.filter("words", lambda w: w["col"] == c), lambda w: w["text"]), " ")
    return words.select("page", "row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), cell).alias("cells"))


def page_cells(batches: Iterator[pa.RecordBatch], columns: int, least: float = 3.0, share: float = 0.65, gap: float = 8.0) -> Iterator[tuple[list, list, list]]:
    """What `rows` and `column_cells` make of boxes, inside a task: page, number in the page (from 1) and cells of each row.

    batches: page, at (1 begins a page), word, text, x0, cy, height; a page's boxes follow
    each other, sorted by cy, x0 and word. Pages that a batch holds whole are read at
    once; the last one waits for the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("at").to_numpy() == 1)
        if not len(begins):
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
        held = [batch.slice(begins[-1])]
        if whole.num_rows:
            yield _cells(whole, columns, least, share, gap)
    if held and (whole := pa.Table.from_batches(held)).num_rows:
        yield _cells(whole, columns, least, share, gap)


def unbundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes as `page_cells` reads them, from rows that hold some of a page's boxes each (page, at, y, height, and lists text, x0, dy); a page's rows follow each other. Boxes at one place keep their order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("at").to_numpy() == 1)
        if not len(begins):
            held.append(batch)
            continue
        yield from _opened([*held, batch.slice(0, begins[-1])])
        held = [batch.slice(begins[-1])]
    yield from _opened(held)


def _opened(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not held or not (whole := pa.Table.from_batches(held)).num_rows:
        return
    text, x0, dy = (whole.column(c).combine_chunks() for c in ("text", "x0", "dy"))
    row = np.repeat(np.arange(len(text)), pc.list_value_length(text).to_numpy())
    text, x0, cy = text.flatten(), x0.flatten().to_numpy(), dy.flatten().to_numpy() + whole.column("y").to_numpy()[row]
    some = np.flatnonzero(pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False))
    if len(some) < len(row):
        text, x0, cy, row = text.take(pa.array(some)), x0[some], cy[some], row[some]
    page = (np.cumsum(whole.column("at").to_numpy() == 1) - 1)[row]
    less, same = page[1:] < page[:-1], page[1:] == page[:-1]
    if (less | same & ((cy[1:] < cy[:-1]) | (cy[1:] == cy[:-1]) & (x0[1:] < x0[:-1]))).any():
        order = np.lexsort((x0, cy, page))
        text, x0, cy, row, page = text.take(pa.array(order)), x0[order], cy[order], row[order], page[order]
    at = np.where(np.diff(page, prepend=-1) != 0, 1, 2)
    given = {c: pa.array(whole.column(c).to_numpy()[row]) for c in ("page", "height")}
    if len(row):
        yield pa.RecordBatch.from_pydict({"page": given["page"], "at": pa.array(at), "word": pa.array(np.arange(len(row))), "text": text, "x0": pa.array(x0), "cy": pa.array(cy), "height": given["height"]})


def _cells(boxes: pa.Table, columns: int, least: float, share: float, gap: float) -> tuple[list, list, list]:
    x0, cy, height, word = (boxes.column(c).to_numpy() for c in ("x0", "cy", "height", "word"))
    first = boxes.column("at").to_numpy() == 1
    begin = np.flatnonzero(first)
    page, size = np.cumsum(first) - 1, np.diff(np.r_[begin, len(first)])
    far = np.maximum(least, share * height[np.lexsort((height, page))][begin + size // 2])
    # boxes at one height go to a row together: the first of them decides, and the mean only comes nearer
    line = np.flatnonzero(first | np.r_[True, cy[1:] != cy[:-1]])
    many, rows, new = np.diff(np.r_[line, len(first)]), [], []
    row, mean, n = -1, 0.0, 0
    for opens, y, k, limit in zip(first[line].tolist(), cy[line].tolist(), many.tolist(), far[page[line]].tolist(), strict=True):
        if opens or abs(y - mean) > limit:
            row, mean, n = row + 1, y, k
            new.append(opens)
        else:
            if y == mean:
                n += k
            else:
                for _ in range(k):
                    n += 1
                    mean += (y - mean) / n
        rows.append(row)
    of = np.repeat(rows, many)
    by = np.lexsort((x0, page))
    by = by[np.r_[True, (page[by][1:] != page[by][:-1]) | (x0[by][1:] != x0[by][:-1])]]
    wide = np.flatnonzero((page[by][1:] == page[by][:-1]) & (x0[by][1:] - x0[by][:-1] >= gap))
    owner, left, right = page[by][wide], x0[by][wide], x0[by][wide + 1]
    best = np.lexsort((left, left - right, owner))
    at = np.arange(len(best)) - np.searchsorted(owner[best], owner[best])
    best, at = best[at < columns - 1], at[at < columns - 1]
    bounds = np.full((len(begin), columns - 1), np.inf)
    bounds[owner[best], at] = (left[best] + right[best]) / 2
    col = (x0[:, None] >= bounds[page]).sum(axis=1)
    by = np.lexsort((word, x0, of))
    by = by[boxes.column("text").is_valid().to_numpy()[by]]
    cell = (of * columns + col)[by]
    edges = np.flatnonzero(np.diff(cell, prepend=-1))
    texts = pa.ListArray.from_arrays(pa.array(np.r_[edges, len(by)], pa.int32()), boxes.column("text").take(pa.array(by)).combine_chunks())
    told = np.full((row + 1) * columns, "", object)
    told[cell[edges]] = pc.binary_join(texts, " ").to_numpy(zero_copy_only=False)
    cells = told.reshape(-1, columns).tolist()
    begins = np.flatnonzero(new)
    number = np.arange(1, row + 2) - np.repeat(begins, np.diff(np.r_[begins, row + 1]))
    pages = np.repeat(np.arange(len(begin)), np.diff(np.r_[begins, row + 1]))
    return boxes.column("page").take(pa.array(begin[pages])).to_pylist(), number.tolist(), cells
