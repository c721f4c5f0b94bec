"""Operator 10, packing: best-fit decreasing with a segment tree over remaining capacities.

Texts are tokenised where they are read; an overlong document is cut into full windows and a rest. Only the sizes of the
pieces are exchanged (and their ids on request). Each share of the pieces is packed by best-fit decreasing: a tree over
the capacities 0..window says how many open windows have each capacity left and finds the tightest that holds a piece in
log(window) steps.

Ids are those of the given vocabulary file of `tokenizers`. The merges are run by tiktoken over the same vocabulary, which
gives the same ids (tested) in a fifth of the time; texts that it can't split go to tokenizers itself.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored_bytes, text_of

WINDOW, END_ID = 2048, 1
_SHARE_BYTES = 256 << 20  # input whose pieces are packed together
_loaded: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes a byte as itself if it is printable, else as the next free character from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """ids(text) by the vocabulary file at path, without special tokens added."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.plain = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.special = [*special]
        self.fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def slow(self, text: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return self.plain.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow(text)
        try:
            return self.fast.encode_ordinary(text)
        except ValueError:  # its pattern engine gave up on a very long run
            return self.slow(text)


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _pieces(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*enc.ids(text), end_id], "<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                        if with_ids:
                            kept.append(piece)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                if with_ids:
                    names, arrays = [*names, "ids"], [*arrays, pa.array(kept, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


class CapacityTree:
    """How many open windows have each remaining capacity; tightest(n): the least capacity of at least n that one has."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, least: int) -> int:
        """-1 if no open window holds it."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:  # up to the first right sibling with windows, then down to its leftmost
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths must be sorted descending."""
    tree, having = CapacityTree(window), [[] for _ in range(window + 1)]
    where, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, n in enumerate(lengths.tolist()):
        left = tree.tightest(n)
        if left < 0:
            left, at = window, opened
            opened += 1
        else:
            at = having[left].pop()
            tree.add(left, -1)
        where[k], offset[k] = at, window - left
        if left > n:
            having[left - n].append(at)
            tree.add(left - n, 1)
    return where, offset


def _packed(window: int):
    def run(table: pa.Table) -> pa.Table:
        length, doc, start, crc = (table[c].to_numpy() for c in ("length", "doc_id", "start", "ids_crc32"))
        order = np.lexsort((crc, start, doc, -length))
        where, offset = best_fit(length[order], window)
        table = table.take(pa.array(order))
        base = table["share"][0].as_py() << 40 if len(order) else 0
        return table.drop_columns(["share"]).append_column("sequence_id", pa.array(where + base, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs all texts into sequences of at most `window` tokens.

    A document is its ids and then end_id, cut at multiples of `window`. Returns a row per piece: doc_id, start, length,
    ids_crc32, doc_tokens (and ids on request), sequence_id and offset in it. Null and empty texts are one piece, the end
    id. A repeated row is packed each time it occurs. An empty table gives no pieces. sequence_id is unique in the result;
    ids of different shares of the input differ in their upper bits.
    """
    path = path or vocabulary_path()
    shares = max(1, -(-stored_bytes(docs) // _SHARE_BYTES))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = text_of(docs).mapInArrow(_pieces(path, window, end_id, with_ids), kind)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)))
    return dealt.groupBy("share").applyInArrow(_packed(window), kind + ", sequence_id long, offset long")


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
