"""SimHash near-dedup with pigeonring filtering.

The 64 bits form a ring of `radius + 1` segments. If two fingerprints differ in
at most `radius` bits, some segment starts a chain along the ring in which every
prefix of l segments differs in at most l * radius / (radius + 1) bits: none in
the first segment, at most one in the first two, and so on. The first two
prefixes make the search key (the second segment with one bit left out, once for
each bit: 64 keys a fingerprint); the longer prefixes prune the candidates of a
key before the full Hamming check. Inside a key only a spanning forest of the
links is kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _components as cc
from . import _text as tx
from ._repeats import NO_ID, parts

ALL = (1 << 64) - 1
FEW = 32
BLOCK = 1024
DENSE = 500_000  # links that lie together
PARITY = 512  # bits beside each key of the prefix filter; more of them part longer sets
_NAME = 0x5851F42D4C957F2D  # any number serves


def bit_majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of hashes the 64-bit word of the bits set in over half of them; 0 for an empty group."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    full = np.flatnonzero(n)
    # sums of at most 255 rows fit in a byte; these are then added up
    runs = -(-n[full] // 255)
    begin = np.repeat(first[full] - 255 * (np.cumsum(runs) - runs), runs) + 255 * np.arange(runs.sum())
    small = np.add.reduceat(bits, begin, axis=0, dtype=np.uint8)
    sums = np.add.reduceat(small.astype(np.int64), np.cumsum(runs) - runs, axis=0)
    major = np.packbits(2 * sums > n[full][:, None], axis=1)
    out[full] = np.ascontiguousarray(major).view(">u8").ravel().astype(np.uint64)
    return out


def shingle_hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every k-word shingle of the lower-cased texts, and where each text's begin."""
    data, off = tx.buffers(column)
    data, start, end, doc = tx.joined(tx.lower(data), off)
    first = np.searchsorted(doc, np.arange(len(off)))
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    lo = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    hi = lo + np.repeat(np.minimum(n, k), count) - 1
    raw, f = data.tobytes(), xxhash.xxh64_intdigest
    h = np.array([f(raw[a:b], 42) for a, b in zip(start[lo].tolist(), end[hi].tolist(), strict=True)], np.uint64)
    return h, at


def fingerprints(column: pa.Array, k: int) -> np.ndarray:
    return bit_majority(*shingle_hashes(column, k))


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(fingerprints(batch.column("text"), k).view(np.int64))], ["d", "print"])

    return run


class Ring:
    """Segments of the ring for a radius, and the masks of its keys and chains."""

    def __init__(self, radius: int):
        self.radius, m = radius, radius + 1
        edge = [round(64 * i / m) for i in range(m + 1)]
        self.segments = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(m)]
        self.keys: list[tuple[int, int]] = []  # chain start, mask
        for i in range(m):
            after = self.segments[(i + 1) % m] if m > 1 else 0
            bits = [b for b in range(64) if after >> b & 1] if radius else []
            self.keys += [(i, self.segments[i] | (after & ~(1 << b))) for b in bits] or [(i, ALL)]
        self.chains = [[(sum(self.segments[(i + j) % m] for j in range(size)), size * radius // m) for size in range(2, m + 1)] for i in range(m)]

    def links(self, x: np.ndarray, chain: int) -> np.ndarray:
        """Which differences keep within every budget of the chain; the last prefix is the full Hamming check."""
        ok = np.ones(x.shape, bool)
        for mask, budget in self.chains[chain]:
            ok &= np.bitwise_count(x & np.uint64(mask)) <= budget
        return ok if self.chains[chain] else x == 0


def _keys(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(radius)
        masks = np.array([m for _, m in ring.keys], np.uint64)
        salts = tx.mix(np.arange(1, len(masks) + 1, dtype=np.uint64))
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                value = np.asarray(batch.column("print")).view(np.uint64)
                block = np.asarray(batch.column("block")).view(np.uint64)
                key = tx.mix((value[:, None] & masks) ^ salts) ^ tx.mix(block)[:, None]
                key = (key & np.uint64(ALL - 127)) | np.arange(len(masks), dtype=np.uint64)  # the low bits tell the mask
                take = np.repeat(np.arange(len(batch)), len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *(batch.column(x).take(pa.array(take)) for x in ("node", "print", "more"))], ["key", "node", "print", "more"])

    return run


def _pairs(radius: int, apart: int):
    """Links inside groups of equal keys, from rows sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(radius)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            key = np.asarray(batch.column("key"))
            cut = int(np.searchsorted(key, key[-1]))
            if cut == 0 and (len(held) == 1 or held[0].column("key")[0].as_py() == key[-1]):
                continue  # one key so far
            tail = batch.slice(cut)
            held[-1] = batch.slice(0, cut)
            yield from _linked(ring, apart, held)
            held = [tail]
        yield from _linked(ring, apart, held)

    return run


def _linked(ring: Ring, apart: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [x for x in held if len(x)]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    key, node, value = (table.column(x).to_numpy() for x in ("key", "node", "print"))
    value = value.view(np.uint64)
    more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint64).reshape(len(key), -1)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def check(i: np.ndarray, j: np.ndarray, chain: int | np.ndarray) -> np.ndarray:
        x = value[i] ^ value[j]
        if isinstance(chain, int):
            ok = ring.links(x, chain)
        else:
            ok = np.zeros(len(x), bool)
            for c in np.unique(chain):
                ok[chain == c] = ring.links(x[chain == c], int(c))
        if more.shape[1]:
            ok &= np.bitwise_count(more[i] ^ more[j]).sum(axis=-1) <= apart
        return ok

    which = np.array([c for c, _ in ring.keys])
    for g in range(2, FEW + 1):  # all pairs of the many small groups at once
        a, b = np.triu_indices(g, 1)
        every = begin[size == g]
        step = max(1, (1 << 20) // len(a))
        for at in (every[x : x + step] for x in range(0, len(every), step)):
            i, j = (at[:, None] + a).ravel(), (at[:, None] + b).ravel()
            ok = check(i, j, np.repeat(which[key[at] & 127], len(a)))
            out.append((node[i[ok]], node[j[ok]]))
    for at, g in zip(begin[size > FEW], size[size > FEW], strict=True):
        # least label over all links of the group, block by block, until nothing changes
        own = np.arange(at, at + g)
        label = np.argsort(np.argsort(node[own], kind="stable"), kind="stable")
        rank = label.copy()
        chain = int(which[key[at] & 127])
        while True:
            before = label.copy()
            for lo in range(0, g, BLOCK):
                mine = own[lo : lo + BLOCK]
                for hi in range(0, g, BLOCK):
                    ok = check(mine[:, None], own[hi : hi + BLOCK][None, :], chain)
                    label[lo : lo + BLOCK] = np.minimum(label[lo : lo + BLOCK], np.where(ok, label[hi : hi + BLOCK][None, :], g).min(axis=1))
            if (label == before).all():
                break
        back = np.empty(g, np.int64)
        back[rank] = node[own]
        out.append((node[own], back[label]))
    if out:
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        a, b = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) & (a != b) if len(a) else np.zeros(0, bool)
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def candidates(nodes: DataFrame, radius: int, apart: int = 0) -> DataFrame:
    """Pairs a > b that span the components of `near`; inside a large key b may be linked to a over others."""
    keyed = nodes.mapInArrow(_keys(radius), "key long, node long, print long, more binary")
    return keyed.repartition(parts(nodes), "key").sortWithinPartitions("key").mapInArrow(_pairs(radius, apart), "a long, b long")


def near(nodes: DataFrame, radius: int, apart: int = 0) -> DataFrame:
    """Components of nodes (node, print, more binary, block long) whose prints differ in at most `radius` bits.

    Nodes must have the same `block` and, where `more` is not empty, `more` may
    differ in at most `apart` bits. Returns node, root for nodes with a link.
    """
    return cc.components(candidates(nodes, radius, apart))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and kept of every row.

    Texts whose fingerprints differ in at most `radius` bits are linked, and
    component_id is the least id reachable. Null and empty texts have fingerprint
    0 and link like any other; a null id comes before all others and is then the
    component's id; rows may repeat (of equal ids all are kept or none).
    Other columns are ignored.
    """
    cc.prepare(docs)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = rows.mapInArrow(_prints(k), "d long, print long").checkpoint()
    classes = prints.groupBy("print").agg(F.min("d").alias("node"), F.count("*").alias("members"))
    # an id may stand in several classes if it repeats: then the node is the class's own number and ids follow later
    links = near(classes.select(F.col("print").alias("node"), "print", F.lit(b"").alias("more"), F.lit(0).cast("long").alias("block")), radius)
    named = classes.join(links.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lead = named.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    total = prints.count()
    of = cc.join_counted(named, lead, ["root"], "size", total).select("print", "members", "component").checkpoint()
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return cc.join_counted(prints, of, ["print"], "members", total).select(null("d").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), null("component").alias("component_id"), (F.col("d") == F.col("component")).alias("kept"))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased texts' distinct words, where each text's begin, and likewise of their k-word shingles."""
    data, off = tx.buffers(column)
    data = tx.lower(data)
    start, end, doc = tx.words(data, off)
    word = tx.ranges(tx.prefix(data), start, end)
    texts = np.arange(len(off))
    grams = tx.grams(word, k)
    owner = doc[: len(grams)]
    inside = owner == doc[k - 1 :][: len(grams)]
    g, o = [grams[inside]], [owner[inside]]
    n = np.bincount(doc, minlength=len(column))
    for size in range(1, k):  # shorter texts are one shingle
        few = np.flatnonzero(n == size)
        if len(few):
            g.append(tx.grams(word, size)[np.searchsorted(doc, few)])
            o.append(few)

    def each(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
        return h[new], np.searchsorted(d[new], texts)

    return *each(word, doc), *each(np.concatenate(g), np.concatenate(o))


def set_names(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set of hashes, the same for equal sets."""
    sums = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(tx.mix(g ^ np.uint64(_NAME)), out=sums[1:])
    return tx.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _twofold(k: int):
    """Prints of a text's distinct words, and two of its distinct k-word shingles; the name and size of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                w, at, g, first = shingle_sets(batch.column("text"), k)
                more = np.stack([bit_majority(tx.mix(g + np.uint64(i)), first) for i in (1, 2)], axis=1)
                columns = [pa.array(bit_majority(w, at).view(np.int64)), pa.array([x.tobytes() for x in more], pa.binary()), pa.array(set_names(g, first)), pa.array(np.diff(first))]
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), *columns], ["d", "h", "print", "more", "node", "n"])

    return run


def _grams(k: int):
    """The shingles of each set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in tx.pieces(whole):
                _, _, g, first = shingle_sets(batch.column("text"), k)
                node = set_names(g, first)
                new = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    new[i] = x not in seen
                    seen.add(x)
                take = np.repeat(new, np.diff(first))
                owner = np.repeat(node, np.diff(first))[take]
                g = (g[take] >> np.uint64(16)).view(np.int64)
                for at in range(0, len(g), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(owner[at : at + (1 << 16)]), pa.array(g[at : at + (1 << 16)])], ["node", "g"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by `name`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = np.asarray(batch.column(name))
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or held[-1].column(name)[0].as_py() != key[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of more than one set and in how many they are, from rows sorted by shingle and set."""
    for table in _runs(batches, "g"):
        g, node = table.column("g").to_numpy(), table.column("node").to_numpy()
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (node[1:] != node[:-1])])
        g, node = g[new], node[new]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(begin, len(g)))
        df = np.repeat(size, size)
        g, node, df = g[df > 1], node[df > 1], df[df > 1]
        for at in range(0, len(g), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (node, g, df)], ["node", "g", "df"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of each set that may have a partner, rarest first, and how many of them are keys.

    From rows sorted by set and df; the first row of a set holds its size n as df = -n.
    A partner has at least four fifths of the set, so it has one of the rarest n - ceil(4n/5) + 1.
    Shingles of no other set are the rarest and need no key.
    """
    for table in _runs(batches, "node"):
        node, g, df = (table.column(x).to_numpy() for x in ("node", "g", "df"))
        begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        end = np.append(begin[1:], len(node))
        n = -df[begin]
        keys = n - (4 * n + 4) // 5 + 1 - (n - (end - begin - 1))
        some = np.flatnonzero((keys > 0) & (end - begin > 1))
        for at in range(0, len(some), 1000):
            x = some[at : at + 1000]
            rest = [g[begin[i] + 1 : end[i]].tobytes() for i in x]
            yield pa.RecordBatch.from_arrays([pa.array(node[begin[x]]), pa.array(n[x]), pa.array(keys[x]), pa.array(rest, pa.binary())], ["node", "n", "keys", "rest"])


_PREFIX_KEYS = "key long, node long, root long, n long, left long, own long, bits binary"


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """PARITY bits of each set: whether an odd number of its hashes falls on the bit. Two sets differ in at least as many elements as bits."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = owner * PARITY + (np.concatenate(sets) & (PARITY - 1))
    return np.packbits((np.bincount(at, minlength=len(sets) * PARITY) & 1).astype(np.uint8).reshape(-1, PARITY), axis=1)


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a key: the shingle, its set, the set's root and size, how much of the set follows from there, how much is in no other set, and the parities of what others have too."""
    for whole in batches:
        for at in range(0, len(whole), 500):
            batch = whole.slice(at, 500)
            node, root, n, keys = (np.asarray(batch.column(x)) for x in ("node", "root", "n", "keys"))
            sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("rest")]
            if not sets:
                continue
            size = np.array([len(x) for x in sets])
            bits = pa.array([x.tobytes() for x in parities(sets)], pa.binary())
            keys = np.minimum(keys, size)
            key = np.concatenate([x[:c] for x, c in zip(sets, keys, strict=True)])
            left = np.concatenate([len(x) - np.arange(c) for x, c in zip(sets, keys, strict=True)])
            own = np.repeat(np.arange(len(sets)), keys)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(x[own]) for x in (node, root, n)), pa.array(left), pa.array((n - size)[own]), bits.take(pa.array(own))], ["key", "node", "root", "n", "left", "own", "bits"])


def _firsts(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least j of each i."""
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    new = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    return i[new], j[new]


def _key_pairs(first: bool):
    """Pairs of sets with a common key that are not linked yet and may be similar, from rows sorted by key and node: for each set the first only, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "key"):
            key, node, root, n, left, alone = (table.column(x).to_numpy() for x in ("key", "node", "root", "n", "left", "own"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            done: list[tuple[np.ndarray, np.ndarray]] = []

            def admitted(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                # what may still be common from this key on has to be enough, else an earlier key decides
                ok = (root[i] != root[j]) & (9 * np.minimum(left[i], left[j]) >= 4 * (n[i] + n[j]))
                i, j = i[ok], j[ok]
                ok = np.zeros(len(i), bool)
                for at in range(0, len(i), 1 << 17):  # similar sets differ in at most a ninth of both sizes
                    x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                    ok[at : at + (1 << 17)] = 9 * (alone[x] + alone[y] + apart) <= n[x] + n[y]
                return i[ok], j[ok]

            for g in np.unique(size[size > 1]):
                every = begin[size == g]
                if g <= FEW:
                    a, b = np.triu_indices(g, 1)
                    step = max(1, (1 << 20) // len(a))
                    for at in (every[x : x + step] for x in range(0, len(every), step)):
                        found = admitted((at[:, None] + b).ravel(), (at[:, None] + a).ravel())
                        done.append(_firsts(*found) if first else found)
                    continue
                for at in every:
                    own = np.arange(at, at + g)
                    if (root[own] == root[at]).all():
                        continue
                    open_ = np.ones(g, bool)
                    for hi in range(0, g, BLOCK):
                        for lo in range(hi, g, BLOCK):
                            i, j = (x.ravel() for x in np.meshgrid(own[lo : lo + BLOCK][open_[lo : lo + BLOCK]], own[hi : hi + BLOCK], indexing="ij"))
                            found = admitted(i[i > j], j[i > j])
                            if first:
                                found = _firsts(*found)
                                open_[found[0] - at] = False
                            done.append(found)
                    yield from _batches(node, done)
                    done.clear()
            yield from _batches(node, done)

    return run


def _batches(node: np.ndarray, done: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if not done:
        return
    a, b = (node[np.concatenate(x)] for x in zip(*done, strict=True))
    a, b = np.maximum(a, b), np.minimum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = (np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)) & (a != b)
    a, b = a[new], b[new]
    for at in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with Jaccard similarity of at least four fifths."""
    for batch in batches:
        n = np.asarray(batch.column("n")) + np.asarray(batch.column("m"))
        both = (np.intersect1d(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), assume_unique=True).size for x, y in zip(batch.column("x"), batch.column("y"), strict=True))
        ok = 9 * np.fromiter(both, np.int64, len(batch)) >= 4 * n
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets are similar."""
    one = sets.select(F.col("node").alias("a"), "n", F.col("rest").alias("x")).hint("merge")
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("rest").alias("y")).hint("merge")
    return pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_similar, "a long, b long")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b with the roots ra and rb of both, which are the nodes themselves where they have none."""
    one, two = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return pairs.join(one, "a", "left").join(two, "b", "left").withColumns({f"r{x}": F.coalesce(f"r{x}", x) for x in "ab"})


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after further links, which join whole groups: only one edge for two groups goes into the search for components."""
    above = cc.components(_rooted(links, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct().checkpoint(), DENSE)
    up = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(above.join(roots.select("node"), "node", "left_anti"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, radius: int = 7, apart: int = 26) -> DataFrame:
    """docs, with all their columns, less all but one row of each group of near copies.

    Texts link if the Jaccard similarity of their sets of k-word shingles is at least
    0.8, computed from the sets. Shingles of more than one set are counted; a set
    nearly all of whose rare shingles are in no other can have no partner. For the
    others candidates come first from the pigeonring over fingerprints of distinct
    words (at most `radius` bits apart, 128 bits of shingle fingerprints at most
    `apart`) and from the keys of the prefix filter: each set is compared with the
    least candidate, which links most of a group, then with the first ones that are
    in other groups; then every pair with a common key that is not linked yet is
    compared, so no link between groups is missed. Parity bits beside each key bound
    from below how many shingles two sets differ in, so sets that share nearly four
    fifths leave their task only if the bound allows four fifths. The row with the least id stays;
    of equal rows one stays. Null texts count as empty. Columns may have any names.
    """
    cc.prepare(docs)
    n = parts(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    prints = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(_twofold(k), "d long, h long, print long, more binary, node long, n long").distinct().checkpoint()

    grams = docs.select(text.alias("text")).mapInArrow(_grams(k), "node long, g long")
    shared = grams.repartition(n, "g").sortWithinPartitions("g", "node").mapInArrow(_shared, "node long, g long, df long")
    sizes = prints.select("node", F.lit(0).cast("long").alias("g"), (-F.col("n")).alias("df")).distinct()
    sets = shared.unionByName(sizes).repartition(n, "node").sortWithinPartitions("node", "df", "g").mapInArrow(_prefixes, "node long, n long, keys long, rest binary").checkpoint()

    def pairs(roots: DataFrame | None, first: bool) -> DataFrame:
        rooted = sets.withColumn("root", F.col("node")) if roots is None else sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        keys = rooted.mapInArrow(_prefix_keys, _PREFIX_KEYS)
        return keys.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_key_pairs(first), "a long, b long")

    classes = prints.join(sets.select("node"), "node", "left_semi").select("node", "print", "more").distinct().withColumn("block", F.lit(0).cast("long"))
    ring, sharing = (x.groupBy("a").agg(F.min("b").alias("b")) for x in (candidates(classes, radius, apart), pairs(None, True)))
    nearest = ring.unionByName(sharing)
    roots = cc.components(_checked(nearest, sets).checkpoint(), DENSE)
    roots = _merged(roots, _checked(pairs(roots, True), sets).checkpoint()).checkpoint()
    links = _merged(roots, _checked(pairs(roots, False), sets).checkpoint())
    rooted = prints.select("d", "h", "node").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("d", "h")).alias("x")).select("x.d", "x.h")
    left = keyed.repartition(n, "d", "h").join(kept.hint("merge"), ["d", "h"], "left_semi")
    first = left.withColumn("turn", F.row_number().over(Window.partitionBy("d", "h").orderBy("d"))).where("turn = 1")
    return first.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4).drop("kept")


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
SQL: dict[str, str] = {}
