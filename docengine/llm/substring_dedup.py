"""Operator 9, substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Each block of documents hashes all its windows. A first exchange counts 48-bit keys of the windows by key range: a
block sends each key once, as sorted differences of about four bytes, and gets back one bit for each, set if any other
block has the key too. Only windows whose bit is set (or that repeat inside the block) go into the second exchange,
with their full 64-bit hash, 32 bits of a hash of another family (of words and of windows) and their smallest doc_id, and
come back with the smallest doc_id of all, so that windows count as equal by 96 bits. Windows that start in a smaller
document cover words; covered words merge into maximal intervals, which are removed.

A window that a third of all documents share costs one key a block in either exchange, so no key is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import block_count, in_blocks, opened, text_of

WIDTH = 13
DEDUP_BLOCK_BYTES = 9 << 20  # a block also holds its windows
_SHIFT = np.uint64(16)  # full hash to 48-bit key


class _Windows:
    """The words of a block and the full hash, first word and row of each window."""

    def __init__(self, docs: pa.Table, width: int):
        self.blk, self.width = docs["blk"][0].as_py(), width
        ids, self.null, _, self.data, offsets = opened(docs)
        self.ids = np.where(self.null, np.iinfo(np.int64).max, ids)  # a null doc_id stands after all others
        self.starts, self.ends, self.first = T.spans(self.data, offsets)
        hashes = T.word_hashes(self.data, self.starts, self.ends, False)
        self.at, counts = T.window_starts(self.first, width)
        self.full = T.rolling(hashes, width)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(counts)), counts)

    def covered(self, some: np.ndarray) -> np.ndarray:
        """A flag for each word: whether one of these windows covers it."""
        n = len(self.starts)
        begins = np.bincount(self.at[some], minlength=n + self.width)
        begins[self.width :] -= begins[:n].copy()
        return np.cumsum(begins)[:n] > 0

    def second(self, some: np.ndarray) -> np.ndarray:
        """32 bits of the other family's hash of some windows; only the words that these cover are hashed."""
        if not len(some):
            return np.zeros(0, np.uint64)
        words = np.flatnonzero(self.covered(some))
        hashes = np.zeros(len(self.starts), np.uint64)
        hashes[words] = T.word_hashes(self.data, self.starts[words], self.ends[words], False, 1)
        return T.rolling(hashes, self.width, 1)[self.at[some]] >> np.uint64(32)


def _both(full: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for both hashes, to sort and search by."""
    return T.mix(full * np.uint64(0x9E3779B97F4A7C15) + second)


def _packed_ids(ids: np.ndarray) -> bytes:
    low = ids.min() if len(ids) else np.int64(0)
    return int(low).to_bytes(8, "little", signed=True) + T.pack_ints(ids.view(np.uint64) - low.view(np.uint64))


def _unpacked_ids(raw: bytes) -> np.ndarray:
    low = np.frombuffer(raw[:8], np.uint64)[0]
    return (T.unpack_ints(raw[8:]).view(np.uint64) + low).view(np.int64)


def _edges(ranges: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64)


def _cut(values: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each range of sorted values begins; one more than ranges."""
    return np.concatenate([[0], np.searchsorted(values, _edges(ranges, bits)), [len(values)]]).astype(np.int64)


def _keys(ranges: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        w = _Windows(table, width)
        keys = np.unique(w.full >> _SHIFT)
        cut = _cut(keys, ranges, 48)
        full = np.flatnonzero(np.diff(cut))
        return pa.table({
            "rng": pa.array(full, pa.int32()),
            "blk": pa.array(np.full(len(full), w.blk), pa.int32()),
            "keys": pa.array([T.pack(keys[cut[k] : cut[k + 1]]) for k in full], pa.binary()),
        })

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one range: for each block a bit for each of its keys, set if another block has it."""
    parts = [T.unpack(x.as_py()) for x in table["keys"]]
    lengths = np.array([len(x) for x in parts])
    together = np.concatenate(parts)
    order = np.argsort(together, kind="stable")
    ranked = together[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flags = np.empty(len(ranked), bool)
    flags[order] = twice
    ends = np.cumsum(lengths)
    return pa.table({
        "rng": table["rng"],
        "blk": table["blk"],
        "bits": pa.array([np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends, lengths)], pa.binary()),
    })


def _suspects(ranges: int, width: int):
    """Of a block and the bits for it: the windows that occur elsewhere or twice here, with their smallest doc_id."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        names = ("rng", "blk", "hashes", "second", "low", "top")
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        if not len(docs):
            return pa.table({c: pa.array([], t) for c, t in zip(names, types)})
        w = _Windows(docs, width)
        keys, _, at = T.distinct(w.full >> _SHIFT)
        flagged = np.bincount(at, minlength=len(keys)) > 1
        cut = _cut(keys, ranges, 48)
        for rng, raw in zip(bits["rng"].to_pylist(), bits["bits"].to_pylist()):
            n = cut[rng + 1] - cut[rng]
            flagged[cut[rng] : cut[rng + 1]] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        take = np.flatnonzero(flagged[at])
        full, second, owner = w.full[take], w.second(take), w.ids[w.row[take]]
        order = np.lexsort((owner, second, full))
        full, second, owner = full[order], second[order], owner[order]
        new = np.ones(len(full), bool)
        new[1:] = (full[1:] != full[:-1]) | (second[1:] != second[:-1])
        last = np.append(new[1:], True)[: len(full)]
        top = owner[last]  # the largest doc_id here: only if it is above the smallest of all has this block to act
        full, second, owner = full[new], second[new], owner[new]
        cut = _cut(full, ranges, 64)
        rows = []
        for k in np.flatnonzero(np.diff(cut)):
            p = slice(cut[k], cut[k + 1])
            rows.append((int(k), w.blk, full[p].tobytes(), second[p].astype(np.uint32).tobytes(), _packed_ids(owner[p]), T.pack_ints(top[p].view(np.uint64) - owner[p].view(np.uint64))))
        return pa.table({c: pa.array(x, t) for c, x, t in zip(names, list(zip(*rows)) or [[]] * 6, types)})

    return run


def _lowest(table: pa.Table) -> pa.Table:
    """Of one range: for each block the windows whose smallest doc_id of all lies below one of its own."""
    full = [np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]
    second = [np.frombuffer(x.as_py(), np.uint32) for x in table["second"]]
    low = np.concatenate([_unpacked_ids(x.as_py()) for x in table["low"]])
    top = (low.view(np.uint64) + np.concatenate([T.unpack_ints(x.as_py()) for x in table["top"]]).view(np.uint64)).view(np.int64)
    ends = np.cumsum([len(x) for x in full])
    a, b = np.concatenate(full), np.concatenate(second)
    order = np.lexsort((b, a))
    begins = np.flatnonzero(np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    least = np.empty(len(a), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], begins), np.diff(np.append(begins, len(a))))
    act = least < top
    out = [(x[m], y[m], least[e - len(x) : e][m]) for e, x, y in zip(ends, full, second) for m in (act[e - len(x) : e],)]
    return pa.table({
        "blk": table["blk"],
        "hashes": pa.array([x.tobytes() for x, _, _ in out], pa.binary()),
        "second": pa.array([y.tobytes() for _, y, _ in out], pa.binary()),
        "low": pa.array([_packed_ids(v) for _, _, v in out], pa.binary()),
    })


def removed_words(w: _Windows, full: np.ndarray, second: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A flag for each word of a block: covered by a window that also starts in a smaller document.

    full, second, low: hashes and smallest doc_id of windows that other documents have.
    """
    if not len(full):
        return np.zeros(len(w.starts), bool)
    known = np.unique(full)
    some = np.flatnonzero(known[np.minimum(np.searchsorted(known, w.full), len(known) - 1)] == w.full)
    own, other = w.second(some), _both(full, second)
    order = np.argsort(other)
    full, second, low = full[order], second[order], low[order]
    place = np.minimum(np.searchsorted(other[order], _both(w.full[some], own)), len(full) - 1)
    hit = (full[place] == w.full[some]) & (second[place] == own) & (low[place] < w.ids[w.row[some]])
    return w.covered(some[hit])


def _kept(width: int, with_text: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        w = _Windows(docs, width)
        every = lambda name, of, none: np.concatenate([of(x) for x in found[name].to_pylist()] or [none])
        none = np.zeros(0, np.uint64)
        full, second = every("hashes", lambda x: np.frombuffer(x, np.uint64), none), every("second", lambda x: np.frombuffer(x, np.uint32), none).astype(np.uint64)
        gone = removed_words(w, full, second, every("low", _unpacked_ids, none.view(np.int64)))
        data, starts, ends, first, ids = w.data, w.starts, w.ends, w.first, w.ids
        total = np.concatenate([[0], np.cumsum(gone)])
        raw, shas, texts = data.tobytes(), [], []
        for i in range(len(ids)):
            a, b = first[i], first[i + 1]
            if total[b] == total[a]:
                kept = b" ".join(raw[starts[a] : ends[b - 1]].split()) if b > a else b""
            else:
                stay = np.flatnonzero(~gone[a:b]) + a
                kept = b" ".join(raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist()))
            shas.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        out = {
            "doc_id": pa.array(ids, mask=w.null),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
            "kept_sha256": pa.array(shas, pa.string()),
        }
        return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = False, block_bytes: int = DEDUP_BLOCK_BYTES) -> DataFrame:
    """Removes each word covered by a window of `width` words that also starts in a document with a smaller doc_id.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text on request). Null and empty
    texts have no words and the digest of nothing. Texts with fewer than `width` words stay whole. Rows with equal
    doc_id don't remove each other's words; a null doc_id counts as the largest. An empty table gives an empty result; further
    columns are not looked at; a very long text makes a block of its own.
    """
    blocks = block_count(docs, block_bytes)
    dealt = in_blocks(text_of(docs), blocks)
    bits = (
        dealt.groupBy("blk").applyInArrow(_keys(blocks, width), "rng int, blk int, keys binary")
        .groupBy("rng").applyInArrow(_repeated, "rng int, blk int, bits binary")
    )
    lows = (
        dealt.groupBy("blk").cogroup(bits.groupBy("blk"))
        .applyInArrow(_suspects(blocks, width), "rng int, blk int, hashes binary, second binary, low binary, top binary")
        .groupBy("rng").applyInArrow(_lowest, "blk int, hashes binary, second binary, low binary")
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("blk").cogroup(lows.groupBy("blk")).applyInArrow(_kept(width, with_text), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Word positions joined by window; the words of a window are compared as such, no hash is used.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - {WIDTH - 2})) AS i, w FROM d WHERE len(w) >= {WIDTH}),
k AS (SELECT doc_id, i, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS s FROM g),
m AS (SELECT s, min(doc_id) AS low FROM k GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS i FROM k JOIN m USING (s) WHERE low < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
