"""Operator 8, document fingerprints: prefix polynomial hashes.

A modular prefix array P, with P[i] the sum of c[j] * r**j over j < i, gives the hash of any span by one subtraction and
one product, so equality of two spans of any two texts is one comparison and their longest common extension a binary
search. Two primes near 2**31 are used together. A fingerprint keeps samples of a text's array at multiples of a power
of two from either end, so that the likeness of two texts is found from their fingerprints alone. For texts with edits
in several places it also keeps samples chosen by content: all spans of WINDOW code points fall by their hash into
SKETCH groups, and the least hash of each group is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import block_count, stored_bytes, text_of

PRIMES = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_664_525_001))  # with the base of each
SAMPLES = 32
WINDOW, SKETCH = 16, 64
_SEGMENT = 1 << 18
_BLOCK_BYTES = 8 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < _SEGMENT, by doubling."""
    if which not in _tables:
        p, base = PRIMES[which]
        out = []
        for b in (base, pow(base, -1, p)):
            t = np.ones(1, np.uint64)
            while len(t) < _SEGMENT:
                t = np.concatenate([t, t * np.uint64(pow(b, len(t), p)) % np.uint64(p)])
            out.append(t)
        _tables[which] = tuple(out)
    return _tables[which]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_at(codes: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
    """P[i] for each i in at (sorted), holding one segment of the array at a time."""
    p, base = PRIMES[which]
    table, out, total = _power_tables(which)[0], np.empty(len(at), np.uint64), 0
    for begin in range(0, max(len(codes), 1), _SEGMENT):
        part = codes[begin : begin + _SEGMENT].astype(np.uint64) + np.uint64(1)
        local = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * table[: len(part)] % np.uint64(p), out=local[1:])
        local %= np.uint64(p)
        step = pow(base, begin, p)
        lo, hi = np.searchsorted(at, (begin, begin + _SEGMENT))
        hi = len(at) if begin + _SEGMENT >= len(codes) else hi
        out[lo:hi] = (np.uint64(total) + local[at[lo:hi] - begin] * np.uint64(step) % np.uint64(p)) % np.uint64(p)
        total = (total + int(local[-1]) * step) % p
    return out


def _inverse(at: np.ndarray, which: int) -> np.ndarray:
    p, base = PRIMES[which]
    far = {int(k): pow(pow(base, -1, p), int(k) * _SEGMENT, p) for k in np.unique(at // _SEGMENT)}
    high = np.array([far[int(k)] for k in at // _SEGMENT], np.uint64) if len(far) > 1 else np.full(len(at), far.get(int(at[0] // _SEGMENT), 1) if len(at) else 1, np.uint64)
    return _power_tables(which)[1][at % _SEGMENT] * high % np.uint64(p)


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [begin, end): both primes' values side by side in 64 bits."""
    at, place = np.unique(np.concatenate([begin, end]), return_inverse=True)
    out = np.zeros(len(begin), np.uint64)
    for which, (p, _) in enumerate(PRIMES):
        value = prefix_at(codes, at, which)[place]
        a, b = value[: len(begin)], value[len(begin) :]
        out = out << np.uint64(32) | (b + np.uint64(p) - a) % np.uint64(p) * _inverse(begin, which) % np.uint64(p)
    return out


def sketches(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each of the texts that codes holds one after another, 32 bits of the least span hash of each group; 0: no span."""
    none = np.uint64(np.iinfo(np.uint64).max)
    least = np.full(len(lengths) * SKETCH, none)
    ends = np.cumsum(lengths)
    for begin in range(0, len(codes) - WINDOW + 1, _SEGMENT - WINDOW):
        part = codes[begin : begin + _SEGMENT - 1]
        n = len(part) - WINDOW + 1
        hashes = np.zeros(n, np.uint64)
        for which, (p, _) in enumerate(PRIMES):
            sums = prefix_at(part, np.arange(len(part) + 1), which)
            hashes = hashes << np.uint64(32) | (sums[WINDOW:] + np.uint64(p) - sums[:-WINDOW]) % np.uint64(p) * _power_tables(which)[1][:n] % np.uint64(p)
        at = begin + np.arange(n)
        row = np.searchsorted(ends, at, "right")
        inside = at + WINDOW <= ends[row]
        mixed = T.mix(hashes[inside])
        np.minimum.at(least, row[inside] * SKETCH + (mixed % np.uint64(SKETCH)).astype(np.int64), mixed)
    kept = (T.mix(least) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.where(least == none, np.uint64(0), kept).astype(">u4").reshape(len(lengths), SKETCH)


class Prefixes:
    """The whole prefix arrays of one text: span equality and longest common extensions."""

    def __init__(self, text: str):
        self.codes = code_points(text)
        self.n = len(self.codes)
        every = np.arange(self.n + 1)
        self.arrays = [prefix_at(self.codes, every, k) for k in range(len(PRIMES))]

    def span(self, begin: int, end: int) -> tuple[int, ...]:
        return tuple((int(a[end]) - int(a[begin])) * pow(pow(r, -1, p), begin, p) % p for a, (p, r) in zip(self.arrays, PRIMES))

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of self[i:] and other[j:]."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.span(i, i + mid) == other.span(j, j + mid) else (low, mid - 1)
        return low


def step_of(n: int) -> int:
    """The smallest power of two that cuts n into at most SAMPLES steps."""
    step = 1
    while n // step > SAMPLES:
        step *= 2
    return step


def fingerprints(texts: list[str]) -> list[str]:
    """length:hash of all:hashes of the first 1, 2, .. steps:hashes of the last 1, 2, .. steps:sketch (all hexadecimal)."""
    out: list[str] = []
    i = 0
    while i < len(texts):  # about a segment at a time; one long text makes one of its own
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _SEGMENT):
            size += len(texts[j])
            j += 1
        part = texts[i:j]
        codes = code_points("".join(part))
        lengths = np.array([len(t) for t in part], np.int64)
        offsets = np.cumsum(lengths) - lengths
        steps = np.array([step_of(int(n)) for n in lengths], np.int64)
        counts = lengths // steps
        total = int(counts.sum())
        size = (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + 1) * np.repeat(steps, counts)
        first, last = np.repeat(offsets, counts), np.repeat(offsets + lengths, counts)
        spans = span_hashes(codes, np.concatenate([first, last - size, offsets]), np.concatenate([first + size, last, offsets + lengths]))
        small = ((spans >> np.uint64(32)) * np.uint64(0x9E3779B1) ^ spans) & np.uint64(0xFFFFFFFF)
        head, tail, whole = small[:total].astype(">u4"), small[total : 2 * total].astype(">u4"), spans[2 * total :]
        ends, content = np.cumsum(counts), sketches(codes, lengths)
        for k, (n, e, c) in enumerate(zip(lengths.tolist(), ends.tolist(), counts.tolist())):
            out.append(f"{n:x}:{int(whole[k]):016x}:{head[e - c : e].tobytes().hex()}:{tail[e - c : e].tobytes().hex()}:{content[k].tobytes().hex()}")
        i = j
    return out


def likeness(one: str, two: str) -> float:
    """Share of the longer text that the two have in common.

    The larger of what their beginnings and ends have in common, to the steps sampled, and what their sketches let expect
    of all spans (an estimate; the standard error of their Jaccard share is 0.0625 at most).
    """
    a, b = one.split(":"), two.split(":")
    if a[:2] == b[:2]:
        return 1.0
    m, n = int(a[0], 16), int(b[0], 16)
    if not m or not n:
        return 0.0
    s, t = step_of(m), step_of(n)
    step = max(s, t)

    def common(x: str, y: str) -> int:
        low, high = 0, min(m, n) // step
        while low < high:  # samples that agree come first, so a binary search finds the last
            mid = (low + high + 1) // 2
            i, j = 8 * (mid * step // s - 1), 8 * (mid * step // t - 1)
            low, high = (mid, high) if x[i : i + 8] == y[j : j + 8] else (low, mid - 1)
        return low * step

    x, y = (np.frombuffer(bytes.fromhex(k[4]), ">u4") for k in (a, b))
    either = int(((x > 0) | (y > 0)).sum())
    alike = int(((x == y) & (x > 0)).sum()) / either if either else 0.0  # of the spans of both
    return min(max(common(a[2], b[2]) + common(a[3], b[3]), alike / (1 + alike) * (m + n)), min(m, n)) / max(m, n)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _fingerprinted(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["guest"].to_pylist(), table["unnamed"].to_pylist()), key=lambda r: (-r[0], r[1]))
    own, guests = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    texts = [r[1] for r in own]
    own_prints = fingerprints([*texts, *(g[1] for g in guests[:1])])
    following = [*texts[1:], *(g[1] for g in guests[:1])]
    changed = [edited(t, f) for t, f in zip(texts, following)]
    changed_prints = fingerprints(changed)
    n = len(own)
    return pa.table({
        "doc_id": pa.array([None if r[3] else r[0] for r in own], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(own_prints[:n], pa.string()), "edited_fingerprint": pa.array(changed_prints, pa.string()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own_prints, changed_prints)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(own_prints, own_prints[1:])], pa.float64()),
    })


def compared(docs: DataFrame, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness, and that to the next document.

    The next document is the one before in order of doc_id (of rows with one doc_id, the lesser text comes first), after
    the last the first. Ranges of doc_id are blocks; the largest id of each range also goes, as a guest, to the range
    above, so no range waits for another. A sole document is its own next. Null texts are empty, null ids come last; an empty table gives an
    empty result.
    """
    texts = text_of(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text", F.col("doc_id").isNull().alias("unnamed"))
    blocks = block_count(docs, block_bytes)
    ids = texts.select("doc_id")
    bounds = ids.approxQuantile("doc_id", [k / blocks for k in range(1, blocks)], 0.2 / blocks) if stored_bytes(docs) else []
    bounds = sorted({int(x) for x in bounds})
    edges = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))  # eight bytes a block

    def place(batches):  # the number of bounds below the id, by binary search
        for batch in batches:
            yield batch.append_column("blk", pa.array(np.searchsorted(edges.value, batch.column("doc_id").to_numpy()), pa.int32()))

    placed = texts.mapInArrow(place, "doc_id long, text string, unnamed boolean, blk int")
    tops = ids.mapInArrow(place, "doc_id long, blk int").groupBy("blk").agg(F.max("doc_id").alias("doc_id")).orderBy("blk").collect()  # a row a block
    sends = [(t["doc_id"], tops[(k + 1) % len(tops)]["blk"]) for k, t in enumerate(tops)]
    spark = docs.sparkSession
    guests = spark.createDataFrame(sends, "doc_id long, to int")
    guests = F.broadcast(guests) if len(sends) < 100_000 else guests
    rows = placed.join(guests, "doc_id", "left").select(
        "doc_id", "text", "unnamed",
        F.explode(F.filter(F.array(F.struct(F.col("blk"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("blk"), F.lit(True).alias("guest"))), lambda x: x["blk"].isNotNull())).alias("at"),
    ).select("doc_id", "text", "unnamed", "at.blk", "at.guest")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.groupBy("blk").applyInArrow(_fingerprinted, out)


def op8(spark, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
