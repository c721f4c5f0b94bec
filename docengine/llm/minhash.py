"""Operator 6, MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star edges.

A document's set is its distinct shingles of five words. Documents with equal sets are one class, known by its smallest
doc_id; only classes take part from there on. A class has buckets of ROWS densified bins each, so many (25 at similarity
0.85, 37 at 0.80) that a pair at the threshold misses all of them with probability MISS at most. In each bucket every class is tied to one centre, the class that shares
buckets with most others (an original among its edited copies), so edges grow with a bucket's size, not its square.

Two similar classes that share a bucket share its centre, so the classes around each centre are compared on their full
sets, in blocks of bounded size. The centre is in each of its blocks: first all classes are compared with it, which takes
one pass, and those linked to it need no comparison with each other. The Jaccard distance is a metric, so a class farther
from the centre than twice the allowed distance can't be linked to one that is linked to the centre; only nearer ones meet
the blocks of those, and the classes not linked to the centre meet each other. Tasks emit a spanning forest of the links
and never their pairs. Links then meet in connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .components import components
from .shared import BLOCK_BYTES, block_count, saved, text_of

WORDS, PERCENT, ROWS, MISS = 5, 85, 5, 4.5e-7
_BYTES = 1 << 21  # text hashed at a time
_ROWS_AT_ONCE = 2048  # whose bins are filled at a time
_GROUP = 512  # classes in a block around one centre
_GROUP_SHINGLES = 1 << 20
_BROADCAST_ROWS = 100_000  # of at most five numbers each
FAR, NEAR = 1, 2


def bands_for(percent: int) -> int:
    """Buckets of a class."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1


def _shingles(data: np.ndarray, spans, width: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle: windows first, then the rows of fewer words, each as one."""
    starts, ends, first = spans
    hashes = T.word_hashes(data, starts, ends, True, family)
    at, counts = T.window_starts(first, width)
    full = T.rolling(hashes, width, family)[at] if len(at) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    lengths = np.diff(first)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    whole = np.zeros(len(short), np.uint64)
    for j in range(width - 1):  # salted by the length
        have = lengths[short] > j
        whole[have] = T.mix(whole[have] * np.uint64(0xD1342543DE82EF95) + hashes[first[short][have] + j])
    return np.concatenate([full, T.mix(whole + lengths[short].astype(np.uint64))]), np.concatenate([row, short])


def shingle_sets(column, width: int = WORDS, digests: bool = False):
    """Distinct shingle hashes of each row, sorted within the row, and the first of each row (one more than rows).

    digests: also two 64-bit sums over each row's set, of hashes of either family, which tell sets apart.
    """
    data, offsets = T.flat(column)
    spans = T.spans(data, offsets)
    full, row = _shingles(data, spans, width, 0)
    order = np.lexsort((full, row))
    full, row = full[order], row[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (row[1:] != row[:-1])
    full, row = full[new], row[new]
    first = np.searchsorted(row, np.arange(len(offsets)))
    if not digests:
        return full, first
    other = _shingles(data, spans, width, 1)[0][order][new]
    sums = np.zeros((2, len(full) + 1), np.uint64)
    np.cumsum(full, out=sums[0, 1:])
    np.cumsum(other, out=sums[1, 1:])
    return full, first, [T.mix(s[first[1:]] - s[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64) for s in sums]


def densified(full: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of each non-empty set: the least hash in each bin, empty bins filled.

    Optimal densification: an empty bin tries bins given by a hash of (bin, attempt), alike for all sets, until it meets
    a filled one, and takes its value.
    """
    rows = len(first) - 1
    out = np.full(rows * bins, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(first))
    mixed = T.mix(full ^ np.uint64(0x2545F4914F6CDD1D))
    place = row * bins + (mixed >> np.uint64(32)).astype(np.int64) % bins
    order = np.argsort(place, kind="stable")
    begin = np.flatnonzero(np.diff(place[order], prepend=-1))
    if len(begin):
        out[place[order][begin]] = np.minimum.reduceat(mixed[order], begin)
    out = out.reshape(rows, bins)
    filled = np.zeros((rows, bins), bool)
    filled.reshape(-1)[place] = True
    source = np.tile(np.arange(bins), (rows, 1))
    r, b = np.nonzero(~filled & filled.any(1, keepdims=True))
    attempt = 0
    while len(r):
        attempt += 1
        pick = (T.mix((b * 1_000_003 + attempt).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        hit = filled[r, pick]
        source[r[hit], b[hit]] = pick[hit]
        r, b = r[~hit], b[~hit]
    return np.take_along_axis(out, source, 1)


def _signatures(batches, bands: int):
    """Of each row: size and digests of its set and a key for each of its buckets; the key tells the band too."""
    for batch in batches:
        for part in T.slices(batch, _BYTES):
            full, first, digests = shingle_sets(part.column("text"), digests=True)
            keys = []
            for i in range(0, part.num_rows, _ROWS_AT_ONCE):
                j = min(i + _ROWS_AT_ONCE, part.num_rows)
                bins = densified(full[first[i] : first[j]], first[i : j + 1] - first[i], bands * ROWS).reshape(-1, bands, ROWS)
                key = np.tile(np.arange(bands, dtype=np.uint64), (j - i, 1))
                for k in range(ROWS):
                    key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + bins[:, :, k])
                keys.append(key.view(np.int64).reshape(-1))
            ends = pa.array(np.arange(part.num_rows + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_shingles": pa.array(np.diff(first), pa.int64()), "set_a": pa.array(digests[0]), "set_b": pa.array(digests[1]),
                "keys": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))),
            })


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Elements that few sets have are counted by pairs, the others by matrix products."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    owner, elements = owner[order], elements[order]
    begin = np.flatnonzero(np.append(True, elements[1:] != elements[:-1]))
    size = np.diff(np.append(begin, len(elements)))
    out = np.zeros(m * m, np.int64)
    for d in range(1, 5):  # each of the elements that d sets have: d * d cells
        at = begin[size == d]
        for i in range(d):
            for j in range(d):
                out += np.bincount(owner[at + i] * m + owner[at + j], minlength=m * m)
    out = out.reshape(m, m)
    wide = np.flatnonzero(size > 4)
    for i in range(0, len(wide), 2048):
        part = wide[i : i + 2048]
        dense = np.zeros((m, len(part)), np.float32)
        lengths = size[part]
        spots = np.repeat(begin[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        dense[owner[spots], np.repeat(np.arange(len(part)), lengths)] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A star for each connected component of a symmetric matrix of links: (smallest id, other id)."""
    m = len(ids)
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    reach = linked | np.eye(m, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], m).min(1)
        if (new == label).all():
            break
        label = new
    by_rank = np.sort(ids)
    return [(int(by_rank[k]), int(i)) for k, i in zip(label, ids) if by_rank[k] != i]


def _groups(table: pa.Table, *columns: str) -> list[np.ndarray]:
    """Rows of each value of these columns."""
    values = [table[c].to_numpy() for c in columns]
    order = np.lexsort((table["doc_id"].to_numpy(), *reversed(values)))
    begin = np.flatnonzero(np.append(True, np.any([np.diff(x[order]) != 0 for x in values], 0)))
    return np.split(order, begin[1:])


def _around(table: pa.Table, percent: int) -> pa.Table:
    """Links inside each (centre, block), and the classes that aren't linked to the centre.

    kind 0: a link a, b. Else a class of a centre with several blocks: NEAR if it may be linked to one that is linked to
    the centre, FAR if it can't be.
    """
    out: list[tuple] = []
    if table.num_rows:
        full, first = shingle_sets(table["text"])
        n, ids, cuts, blocks = np.diff(first), table["doc_id"].to_numpy(), table["cuts"].to_numpy(), table["centre"].to_numpy()
        for at in _groups(table, "centre", "own"):
            centre, sets = int(blocks[at[0]]), [full[first[i] : first[i + 1]] for i in at]
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(at)), n[at])
            linked, near = np.zeros(len(at), bool), np.zeros(len(at), bool)
            for k in np.flatnonzero(ids[at] == centre):  # one, but where rows repeat a doc_id
                both = np.bincount(owner, np.isin(flat, sets[k]), len(at)).astype(np.int64)
                union = n[at] + n[at[k]] - both
                linked |= 100 * both >= percent * union
                near |= 100 * both >= (2 * percent - 100) * union
            linked |= ids[at] == centre
            out += [(min(centre, int(i)), max(centre, int(i)), 0, 0) for i in ids[at[linked]] if i != centre]
            rest = ~linked
            if cuts[at[0]] > 1:
                out += [(int(i), 0, centre, NEAR if k else FAR) for i, k in zip(ids[at[rest]], near[rest])]
            some = np.flatnonzero(rest | linked if (near & rest).any() else rest)
            if rest.any() and len(some) > 1:
                out += [(x, y, 0, 0) for x, y in _links([sets[k] for k in some], ids[at[some]], percent)]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("a", "b", "centre", "kind"), columns)})


def _links(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    n, both = np.array([len(x) for x in sets]), overlaps(sets)
    return forest(ids, 100 * both >= percent * (n[:, None] + n[None, :] - both))


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links inside each (centre, side, pair of blocks) among the rows of this group."""
    out: list[tuple] = []
    if table.num_rows:
        full, first = shingle_sets(table["text"])
        ids = table["doc_id"].to_numpy()
        for at in _groups(table, "centre", "side", "one", "two"):
            if len(at) > 1:
                out += _links([full[first[i] : first[i + 1]] for i in at], ids[at], percent)
    columns = list(zip(*out)) or [[]] * 2
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("a", "b"), columns)})


def _cuts(m, s):
    """Blocks for m classes of s shingles in all."""
    return F.greatest(F.ceil(m / _GROUP), F.ceil(s / _GROUP_SHINGLES)).cast("int")


def _with_sizes(rows: DataFrame, sizes: DataFrame, how: str) -> DataFrame:
    """Joins sizes (a row for each centre with several blocks) to rows; where they are few, rows of one centre stay spread."""
    sizes = saved(sizes, "sizes")
    return rows.join(F.broadcast(sizes) if sizes.count() <= _BROADCAST_ROWS else sizes, "centre", how)


def _meetings(members: DataFrame, rest: DataFrame) -> DataFrame:
    """(centre, doc_id, side, one, two): the comparisons left around centres with several blocks.

    Side 1: blocks of classes linked to the centre with blocks of NEAR ones. Side 2: blocks of those not linked to it with
    each other. members: centre, rep, n; rest: centre, rep, kind of those not linked.
    """
    roles = members.join(rest, ["centre", "rep"], "left").withColumn("kind", F.coalesce("kind", F.lit(0)))
    of = lambda c: (F.coalesce(F.sum(c.cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)))
    kind = F.col("kind")
    sizes = roles.groupBy("centre").agg(_cuts(*of(kind == 0)).alias("n_linked"), _cuts(*of(kind == NEAR)).alias("n_near"), _cuts(*of(kind > 0)).alias("n_rest"))
    roles = _with_sizes(roles, sizes.where("n_rest > 0"), "inner")
    own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["centre", F.col("rep").alias("doc_id")]
    first = roles.where("kind = 0 AND n_near > 0").select(*key, F.lit(1).alias("side"), own("n_linked").alias("one"), each("n_near").alias("two"))
    second = roles.where(kind == NEAR).select(*key, F.lit(1).alias("side"), own("n_near").alias("two"), each("n_linked").alias("one"))
    third = roles.where("kind > 0").withColumn("own", own("n_rest")).withColumn("other", each("n_rest"))
    third = third.select(*key, F.lit(2).alias("side"), F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    return first.unionByName(second).unionByName(third)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. A text of fewer than five
    words has one shingle, all of it; a text without words (null, empty, blank) has none and is linked with nothing.
    Repeated rows of one doc_id are each returned and share its component. A row without doc_id names no
    component: its component_id is that of rows with its set, or null. An empty table gives an empty result.
    """
    texts = text_of(docs)
    one = saved(texts.mapInArrow(lambda b: _signatures(b, bands_for(percent)), "doc_id long, n_shingles long, set_a long, set_b long, keys array<bigint>"), "signatures", False)
    filled = one.where("n_shingles > 0")
    classes = saved(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")), "classes")
    # Of the keys, most occur once: those that don't are counted alone, before any row that carries more meets them.
    keys = classes.select(F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    spots = saved(classes.select("rep", F.explode("keys").alias("key")).join(shared, "key"), "spots")
    known = spots.groupBy("rep").agg(F.sum("size").alias("known"))
    ranked = spots.join(known.join(classes.select("rep", "n").hint("merge"), "rep"), "rep")
    centres = ranked.groupBy("key").agg(F.max(F.struct("known", (-F.col("rep")).alias("least"))).alias("top"))
    edges = ranked.join(centres.select("key", (-F.col("top.least")).alias("centre")), "key").select("centre", "rep", "n").distinct()
    edges = saved(edges, "stars")
    sizes = edges.groupBy("centre").agg(_cuts(F.count("*"), F.sum("n")).alias("cuts")).where("cuts > 1")
    parts = 4 * block_count(docs, BLOCK_BYTES)
    task = lambda *by: F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    # A class is in one block of each of its centres, the centre in every block of its own.
    dealt = _with_sizes(edges, sizes, "left").fillna(1, ["cuts"]).withColumn("own", F.pmod(F.xxhash64("rep"), "cuts").cast("int"))
    every = F.when(F.col("rep") == F.col("centre"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("own"))
    around = dealt.select("centre", F.col("rep").alias("doc_id"), "cuts", F.explode(every).alias("own"))
    around = (
        around.join(texts.hint("merge"), "doc_id")  # links grow with the input, so neither side is broadcast
        .withColumn("task", task("centre", "own"))
        .groupBy("task").applyInArrow(lambda t: _around(t, percent), "a long, b long, centre long, kind long")
    )
    around = saved(around, "around")
    rest = around.where("kind > 0").groupBy("centre", F.col("a").alias("rep")).agg(F.max("kind").alias("kind"))
    members = dealt.where("cuts > 1").select("centre", "rep", "n")
    meetings = saved(_meetings(members, rest), "meetings")
    few = meetings.count() <= _BROADCAST_ROWS
    more = (
        (texts.join(F.broadcast(meetings), "doc_id") if few else meetings.join(texts.hint("merge"), "doc_id"))
        .withColumn("task", task("centre", "side", "one", "two"))
        .groupBy("task").applyInArrow(lambda t: _linked(t, percent), "a long, b long")
    )
    found = components(around.where("kind = 0").select("a", "b").unionByName(more), "near")
    by_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = filled.join(by_class, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(one.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
