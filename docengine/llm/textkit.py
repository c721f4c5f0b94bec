"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on Arrow string buffers: a column of texts is one byte array plus offsets, and words,
word hashes and window hashes are numpy arrays over that buffer. No Python object is made per word.
Nulls count as empty texts. Peak memory is about ten times the text bytes of one batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xDA942042E4DD58B5)  # odd multipliers of the two families of hashes
_WINDOW_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LONG = 64  # bytes of a word from which on its hash is blake2b's


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (uint8) and offsets (int64, one more than rows) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch, size: int):
    """Parts of a batch with column text of at most about `size` bytes of text, a row at least."""
    ends = np.cumsum(np.diff(flat(batch.column("text"))[1])) if batch.num_rows else np.zeros(0, np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends[at:], before + size, "right")))
        yield batch.slice(at, n)
        at += n


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (bytes, end exclusive), and the first word of each row (one more than rows)."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    inside[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word. lower: A-Z count as a-z. family 0 and 1 are independent of each other.

    Eight bytes at a time are mixed into the state, so words of up to eight bytes never share a hash with others of their
    length; words of over _LONG bytes get 64 bits of their blake2b digest.
    """
    data = _LOWER[data] if lower else data
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    chunks = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))  # at each byte, it and the seven that follow
    size = ends - starts
    out = mix(chunks[starts] & _FIRST_BYTES[np.minimum(size, 8)] ^ (size.astype(U64) * U64(_WINDOW_BASES[family])))
    at, done = np.flatnonzero(size > 8), 8
    while len(at) and done < _LONG:
        more = chunks[starts[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)]
        out[at] = mix(out[at] * U64(_BASES[family]) + more)
        done += 8
        at = at[size[at] > done]
    for i in at.tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(digest[8 * family : 8 * family + 8], "little")
    return out


def words(column, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the first word of each row (one more than rows)."""
    data, offsets = flat(column)
    starts, ends, first = spans(data, offsets)
    return word_hashes(data, starts, ends, lower), first


def rolling(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of width consecutive entries; entry i stands for i .. i+width-1 (rows aren't looked at)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= U64(_WINDOW_BASES[family])
        out += hashes[j : j + n]
    return mix(out)


def order_of(keys: np.ndarray) -> np.ndarray:
    """argsort of 64-bit integers. Sorting numbers is several times faster than sorting their places, so where a key and
    its place fit into 63 bits, or the upper bits of a hash tell all apart, they are sorted together."""
    n = len(keys)
    bits = n.bit_length()
    place = np.arange(n, dtype=keys.dtype)
    mask = keys.dtype.type((1 << bits) - 1)
    if keys.dtype == U64:
        perm = (np.sort(keys & ~mask | place) & mask).astype(np.int64)
        ranked = keys[perm]
        return perm if (ranked[1:] >= ranked[:-1]).all() else np.argsort(keys)
    if n and keys.dtype == np.int64 and int(keys.min()) >= 0 and int(keys.max()).bit_length() + bits <= 63:
        return np.sort(keys << bits | place) & mask
    return np.argsort(keys)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one of each, and which of them each entry is."""
    perm = order_of(keys)
    ranked = keys[perm]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(keys), np.int32)
    which[perm] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], perm[new], which


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words at which a window of its row starts, and how many each row has."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    skip = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + skip, counts


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as differences, in 4 bytes each if they fit and in 8 otherwise."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(U64), prepend=U64(0))
    return b"\4" + steps.astype(np.uint32).tobytes() if int(steps.max()) < 1 << 32 else b"\10" + steps.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U64)
    return np.cumsum(np.frombuffer(raw, np.uint32 if raw[0] == 4 else U64, offset=1), dtype=U64)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them all, one plane of bytes after another.

    The planes of high bytes are mostly zeros, which any compressor of an exchange takes out.
    """
    top = int(values.max()) if len(values) else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    size = np.dtype(kind).itemsize
    return bytes([size]) + values.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()


def unpack_ints(raw: bytes) -> np.ndarray:
    size = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"u{size}").reshape(-1).astype(np.int64)
