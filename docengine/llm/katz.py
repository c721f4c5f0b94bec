"""Operator 2, LM scoring: Katz backoff up to trigrams, counted over all training documents.

Counts up to K are discounted by Good-Turing, with counts of counts smoothed by a straight line in the logarithms (Simple
Good-Turing), so that every discount lies between 0 and 1. What a context frees goes, by a backoff weight that makes it sum
to one exactly, to the words never seen after it, in proportion to their probability one order lower. The lowest order
gives its freed mass to one class of unknown words. The first token of a text has the start as its only context.

Counts are held in tables by order and bucket: order 1 by word, the others by context. A block of documents sends each of
its distinct n-grams once, with its own count, and gets the totals back in the order it sent them, so that a very common
n-gram costs one entry a block; of a context it also gets what its weight needs (its total, how many of its words have
count r, and the same of the order below). A context with over _SPLIT occurrences is dealt over several buckets by word,
and the block adds up what these tell. A context that only one block has isn't sent at all. Messages
exist only where there are n-grams, so their number never exceeds that of the n-grams. With the answers each block
evaluates the recursion for each of its tokens. The tables are written beside the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import block_count, held_out, in_blocks, new_folder, opened, text_of

KATZ_BLOCK_BYTES = 7 << 20  # a block holds n-grams beside words, so it is smaller than others
ORDER = 3
K = 5  # counts above it are not discounted
FITTED = 16  # counts of counts that the line is fitted to
_SPLIT = 1 << 20  # occurrences of a context in one bucket
_END = np.uint64(0x5BD1E9955BD1E995)  # stands for the end token; no word gets it but by a 64-bit collision
_FEW = range(1, K + 1)
_STATS = 2 + FITTED  # occurrences, distinct n-grams and counts of counts
_STAT_ROWS = 16  # rows of blk below 0 that gather them
_LOCAL = 1 << 20  # buckets from here on hold contexts that lie in one block


def discounts(n) -> np.ndarray:
    """d[r] for r = 0..K from counts of counts n[1..FITTED] (n[0] isn't looked at): Katz's form of Good-Turing.

    log Z(r) = a + b log r is fitted to the counts of counts, each spread over the distance to its neighbours, as Simple
    Good-Turing does. The smoothed r* / r is ((r + 1) / r) ** (b + 1), below 1 as long as b < -1: a flatter line, which
    only a handful of words can give, is taken as -1.05, and fewer than two points as -2, the slope of Zipf's law.
    """
    n = np.asarray(n, float)
    r = np.flatnonzero(n[1:] > 0) + 1
    if len(r) < 2:
        slope = -2.0
    else:
        before, after = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
        slope = np.polyfit(np.log(r), np.log(2 * n[r] / (after - before)), 1)[0]
    e = min(slope, -1.05) + 1
    d, top = np.ones(K + 1), (K + 1.0) ** e
    for k in _FEW:
        d[k] = (((k + 1) / k) ** e - top) / (1 - top)
    return d


def freed(d: np.ndarray, few: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of a context's mass that is free, and the factor for its seen words; few: words with count 1..K, last axis.

    A context all of whose counts are above K frees one part in total + 1.
    """
    share = (few * (np.arange(1, K + 1) * (1 - d[1:]))).sum(-1) / np.maximum(total, 1)
    none = share <= 0
    return np.where(none, 1 / (total + 1.0), share), np.where(none, total / (total + 1.0), 1.0)


def discounted(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.where(counts > K, 0, counts)] * counts


def first_order(counts: np.ndarray, total: int, d: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Probability of each word by its count; 0 is the unknown class."""
    if not total:
        return np.ones(len(counts))
    share, factor = freed(d, np.asarray(few, float), np.float64(total))
    return np.where(counts > 0, factor * discounted(d, counts) / total, share)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers as planes of bytes, compressed together."""
    parts = [T.pack_ints(a) for a in arrays]
    raw = b"".join(len(p).to_bytes(4, "little") + p for p in parts)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal keys."""
    return np.diff(np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))) if len(keys) else np.zeros(0, np.int64)


def _stored(keys: list[np.ndarray], words: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of n-grams sorted by their keys: the first key as differences, what follows as such within its runs."""
    rest = [*keys[1:], words]
    return _squeezed(np.diff(keys[0], prepend=0), _rises(_runs(keys[0]), rest[0]), *rest[1:], counts)


def _arrays(squeezed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(squeezed[4:], int.from_bytes(squeezed[:4], "little"), "zstd", asbytes=True)
    out, i = [], 0
    while i < len(raw):
        n = int.from_bytes(raw[i : i + 4], "little")
        out.append(T.unpack_ints(raw[i + 4 : i + 4 + n]))
        i += 4 + n
    return out


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers, in the order of the pairs; dense where the plain product is too large."""
    base = int(b.max()) + 1 if len(b) else 1
    if not len(a) or (int(a.max()) + 1) * base < 1 << 62:
        return a * base + b
    order = np.lexsort((b, a))
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.append(False, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    return out


def _by_bucket(bucket: np.ndarray, ranges: int) -> np.ndarray:
    """Order by bucket that leaves the entries of a bucket as they are; short integers are sorted by radix."""
    return np.argsort(bucket.astype(np.uint16) if ranges <= 1 << 16 else bucket, kind="stable")


def _rises(sizes: np.ndarray, values: np.ndarray, back: bool = False) -> np.ndarray:
    """Values that rise within each run of these sizes, as differences from the one before (back: from them)."""
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    if back:
        sums = np.cumsum(values)
        return sums - np.repeat(sums[begin] - values[begin], sizes[sizes > 0])
    out = np.diff(values, prepend=0)
    out[begin] = values[begin]
    return out


def _stats(total: np.ndarray) -> list[int]:
    return [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, FITTED + 1), minlength=FITTED + 2)[1 : FITTED + 1].tolist()]


class _Block:
    """The tokens of a block: words are numbered in order of their hash, the end token is one of them."""

    def __init__(self, docs: pa.Table, order: int):
        self.blk, self.order = docs["blk"][0].as_py(), order
        self.ids, self.null, self.held, data, offsets = opened(docs)
        starts, ends, first = T.spans(data, offsets)
        hashes = T.word_hashes(data, starts, ends, True)
        del data, starts, ends
        n = len(self.ids)
        self.lengths = np.diff(first) + 1
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        tokens = np.full(len(hashes) + n, _END, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.offsets[1:] - 1] = False
        tokens[inner] = hashes
        del hashes, inner
        self.vocab, _, self.word = T.distinct(tokens)
        self.train = np.repeat(~self.held, self.lengths)
        self.own = np.bincount(self.word[self.train], minlength=len(self.vocab))

    def known(self, found: pa.Table) -> None:
        """Takes the answers to the words."""
        rows = _answers(found, 1)
        parts = [_arrays(x) for _, x in rows]
        totals, number, alone = (np.concatenate([p[k] for p in parts]) for k in range(3))
        self.totals_of_texts = totals[np.searchsorted(self.vocab, _END)]
        order = np.argsort(number)  # from here on words are numbered in this order, which all blocks share
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.word, self.totals, self.number, self.alone = rank[self.word], totals[order], number[order], alone[order] > 0

    def level(self, order: int, lower: _Level | None) -> _Level:
        if order == 2:
            at = np.arange(len(self.word))
            context = np.empty(len(self.word), np.int64)
            context[1:] = self.word[:-1] + 1
            context[self.offsets[:-1]] = 0  # the start, which has an occurrence in each text
            first = lambda x, y: np.concatenate([[x], y])
            return _Level(self, order, at, context, [first(0, self.number + 1)], first(self.totals_of_texts, self.totals), first(False, self.alone), self.totals)
        at = np.ones(len(self.word), bool)
        at[self.offsets[:-1]] = False
        at = np.flatnonzero(at)
        keys = [lower.keys[0][lower.context], self.number[lower.word] + 1]
        return _Level(self, order, at, lower.which[at - 1].astype(np.int64), keys, lower.totals, lower.alone, lower.totals, lower.which)


class _Level:
    """The n-grams of a block of one order: pairs of a context and a word, sorted; which of them each token is.

    at: tokens that have a context of this order, context: of each of them, keys: one or two numbers of each context, in
    order, total: occurrences of each context in all, alone: whether no other block has it, below: totals of the order
    below by word or by pair, and of tokens its index there.
    """

    def __init__(self, block: _Block, order: int, at, context, keys, total, alone, below, below_of=None):
        self.order, self.keys, self.total, self.local = order, keys, total, alone
        v = len(block.vocab)
        pairs, first, which = T.distinct(context * v + block.word[at])
        self.context, self.word = (pairs // v).astype(np.int32), (pairs % v).astype(np.int32)
        del pairs
        self.which = np.full(len(block.word), -1, np.int32)
        self.which[at] = which
        self.counts = np.bincount(which[block.train[at]], minlength=len(self.context))
        self.lower_index = self.word if below_of is None else below_of[at[first]]
        self.lower = below[self.lower_index]
        self.totals, self.alone = self.counts, np.ones(len(self.context), bool)
        self.need = np.zeros(len(self.local), bool)  # contexts with a pair that may be unseen: only these need a weight
        self.need[self.context[self.counts == 0]] = True

    def slots(self, ranges: int, number: np.ndarray):
        """Bucket and context of each slot (a context in a bucket), and the pairs sent, in order; pairs of each slot."""
        used = np.flatnonzero(np.bincount(self.context, minlength=len(self.local)).astype(bool) & ~self.local)
        seed = T.mix(sum(k[used].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * i) for i, k in enumerate(self.keys)))
        base = (seed % np.uint64(ranges)).astype(np.int64)
        split = np.minimum(np.maximum(1, -(-self.total[used] // _SPLIT)), ranges)
        nth = np.arange(int(split.sum())) - np.repeat(np.cumsum(split) - split, split)
        bucket, own = (np.repeat(base, split) + nth) % ranges, np.repeat(used, split)
        order = _by_bucket(bucket, ranges)
        bucket, own = bucket[order], own[order]
        of = np.zeros(len(self.local), np.int64)
        parts = np.zeros(len(self.local), np.int64)
        of[used], parts[used] = base, split
        sent = np.flatnonzero(~self.local[self.context])
        context = self.context[sent]
        home = of[context]
        many = np.flatnonzero(parts[context] > 1)
        if len(many):
            nth = (T.mix(number[self.word[sent[many]]].astype(np.uint64)) % parts[context[many]].astype(np.uint64)).astype(np.int64)
            home[many] = (home[many] + nth) % ranges
        order = _by_bucket(home, ranges)
        sent, home = sent[order], home[order]
        n = len(self.local)
        sizes = np.zeros(len(own), np.int64)
        begin = np.flatnonzero(np.append(True, (np.diff(self.context[sent]) != 0) | (np.diff(home) != 0))) if len(sent) else np.zeros(0, np.int64)
        sizes[np.searchsorted(bucket * n + own, home[begin] * n + self.context[sent[begin]])] = np.diff(np.append(begin, len(sent)))
        return bucket, own, sent, sizes

    def messages(self, block: _Block, ranges: int):
        """(bucket, payload) of each bucket that has contexts of this block."""
        bucket, own, pairs, sizes = self.slots(ranges, block.number)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket)) if len(bucket) else [0]
        for i, j in zip(cut[:-1], cut[1:]):
            p = pairs[ends[i] : ends[j]]
            first = self.keys[0][own[i:j]]
            more = [_rises(_runs(first), k[own[i:j]]) for k in self.keys[1:]]
            yield int(bucket[i]), _squeezed(sizes[i:j], _rises(sizes[i:j], block.number[self.word[p]]), self.counts[p], self.lower[p], self.need[own[i:j]].astype(np.uint8), np.diff(first, prepend=0), *more)

    def answered(self, block: _Block, found: pa.Table, ranges: int) -> None:
        """Takes the answers: totals of pairs; of each context its total and whether it has words of few occurrences.

        Of contexts that need a weight also what that takes: words with count r, and with count r in the order below.
        """
        n = len(self.local)
        few = np.bincount(self.context[(self.counts > 0) & (self.counts <= K)], minlength=n) > 0
        total = np.bincount(self.context, self.counts, n).astype(np.int64)
        few[~self.local], total[~self.local] = False, 0
        self.needy = np.flatnonzero(self.need)
        index = np.full(n, -1, np.int32)
        index[self.needy] = np.arange(len(self.needy), dtype=np.int32)
        here = np.flatnonzero(self.need[self.context] & self.local[self.context] & (self.counts > 0))
        weights = np.stack(_weights(index[self.context[here]], self.counts[here], self.lower[here], len(self.needy)), -1)
        rows = _answers(found, self.order)
        if rows:
            own, pairs = self.slots(ranges, block.number)[1:3]
            self.totals, i, j = self.counts.copy(), 0, 0
            for _, payload in rows:
                a = _arrays(payload)
                p, c = pairs[i : i + len(a[0])], own[j : j + len(a[2])]
                i, j = i + len(p), j + len(c)
                self.totals[p], self.alone[p] = a[0], a[1] > 0
                total[c] += a[2]
                few[c] |= a[3] > 0
                asked = index[c[self.need[c]]]
                for k in range(weights.shape[1]):
                    weights[asked, k] += a[4 + k]
        self.context_total, self.factor, self.weights, self.index = total, np.where(few, 1.0, total / (total + 1.0)), weights, index

    def local_stats(self) -> list[int]:
        return _stats(self.counts[self.local[self.context]])

    def local_table(self, block: _Block) -> bytes:
        """The n-grams of contexts that lie in this block, as _tables() has those of a bucket."""
        at = np.flatnonzero(self.local[self.context] & (self.counts > 0))
        return _stored([k[self.context[at]] for k in self.keys], block.number[self.word[at]], self.counts[at])


def _weights(owner: np.ndarray, total: np.ndarray, lower: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each of n contexts: seen words by count 1..K, by count 1..K one order lower, and the sum of larger ones there."""
    large = lower > K
    return [np.bincount(owner[of == r], minlength=n) for of in (total, lower) for r in _FEW] + [np.bincount(owner[large], lower[large], n).astype(np.int64)]


def _answers(found: pa.Table, order: int) -> list[tuple[int, bytes]]:
    rows = [(r["bucket"], r["payload"]) for r in found.select(["ord", "bucket", "payload"]).to_pylist() if r["ord"] == order]
    return sorted(rows, key=lambda r: r[0])


_ASKED = "bucket int, blk int, payload binary, stats array<bigint>"
_ANSWER = "blk int, ord int, bucket int, payload binary, stats array<bigint>"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_WRITTEN = f"{_SCORE}, bucket int, payload binary, ord int"


def _asked(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("bucket", "blk", "payload", "stats"), columns, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))})


def _ask_words(ranges: int):
    def run(docs: pa.Table) -> pa.Table:
        b = _Block(docs, 1)
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
        cut = np.concatenate([[0], np.searchsorted(b.vocab, edges), [len(b.vocab)]])
        steps = lambda x: np.diff(x, prepend=np.uint64(0))
        return _asked([(k, b.blk, _squeezed(steps(b.vocab[i:j]), b.own[i:j]), None) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i])

    return run


def _gathered_words(table: pa.Table):
    asked = [_arrays(x) for x in table["payload"].to_pylist()]
    parts = [np.cumsum(a[0].view(np.uint64), dtype=np.uint64) for a in asked]
    words, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, np.concatenate([a[1] for a in asked]), len(words)).astype(np.int64)
    return parts, words, at, total


def _numbers(total: np.ndarray, bucket: int, ranges: int) -> np.ndarray:
    """A number of its own for each word, small for common ones."""
    ranked = np.empty(len(total), np.int64)
    ranked[np.argsort(-total, kind="stable")] = np.arange(len(total))
    return ranked * ranges + bucket


def _count_words(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        parts, _, at, total = _gathered_words(table)
        bucket = table["bucket"][0].as_py()
        number, ends = _numbers(total, bucket, ranges), np.cumsum([len(x) for x in parts])
        alone = np.bincount(at, minlength=len(total)) == 1
        rows = [(blk, _squeezed(total[x], number[x], alone[x].astype(np.uint8))) for blk, x in zip(table["blk"].to_pylist(), (at[e - len(x) : e] for e, x in zip(ends, parts)))]
        return _answered(rows, 1, bucket, _stats(total))

    return run


def _answered(rows: list[tuple[int, bytes]], order: int, bucket: int, stats: list[int]) -> pa.Table:
    rows = [(blk, order, bucket, payload, None) for blk, payload in rows] + [(-1 - bucket % _STAT_ROWS, order, bucket, None, stats)]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("blk", "ord", "bucket", "payload", "stats"), zip(*rows), types)})


def _blocks(docs: pa.Table, found: pa.Table, order: int, ranges: int) -> tuple[_Block, list[_Level]]:
    """A block with the levels from 2 to order; all but the last have their answers."""
    b = _Block(docs, order)
    b.known(found)
    levels: list[_Level] = []
    for k in range(2, order + 1):
        if levels:
            levels[-1].answered(b, found, ranges)
        levels.append(b.level(k, levels[-1] if levels else None))
    return b, levels


def _ask(order: int, ranges: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not len(docs):
            return _asked([])
        b, levels = _blocks(docs, found, order, ranges)
        rows = [(k, b.blk, x, None) for k, x in levels[-1].messages(b, ranges)]
        return _asked([*rows, (b.blk % ranges, b.blk, None, levels[-1].local_stats())])

    return run


def _gathered(table: pa.Table, order: int):
    """What blocks sent to one bucket: messages, contexts with the index of each slot's, pairs with the index of each entry's."""
    sent = table.filter(pc.is_valid(table["payload"]))
    asked = [_arrays(x) for x in sent["payload"].to_pylist()]
    for a in asked:
        a[1], a[5] = _rises(a[0], a[1], True), np.cumsum(a[5])
        if order == 3:
            a[6] = _rises(_runs(a[5]), a[6], True)
    every = lambda k: np.concatenate([a[k] for a in asked]) if asked else np.zeros(0, np.int64)
    keys = [every(5)] if order == 2 else [every(5), every(6)]
    contexts, first, slot = T.distinct(keys[0] if order == 2 else _joint(*keys))
    context, words = np.repeat(slot, every(0)), every(1)
    pairs, sample, pair = T.distinct(_joint(context.astype(np.int64), words))
    total = np.bincount(pair, every(2), len(pairs)).astype(np.int64)
    return sent, asked, slot, pair, total, context[sample], words[sample], every(3)[sample], [k[first] for k in keys]


def _count(order: int):
    def run(table: pa.Table) -> pa.Table:
        sent, asked, slot, pair, total, owner, _, lower, keys = _gathered(table, order)
        n, seen = len(keys[0]), total > 0
        sums = np.bincount(owner, total, n).astype(np.int64)
        few = (np.bincount(owner[seen & (total <= K)], minlength=n) > 0).astype(np.uint8)
        need = np.zeros(n, bool)
        need[slot[np.concatenate([a[4] for a in asked]) > 0] if asked else []] = True
        seen &= need[owner]
        weights = _weights(owner[seen], total[seen], lower[seen], n)
        alone, rows, i, j = (np.bincount(pair, minlength=len(total)) == 1).astype(np.uint8), [], 0, 0
        for blk, a in zip(sent["blk"].to_pylist(), asked):
            mine, own = pair[i : i + len(a[1])], slot[j : j + len(a[0])]
            i, j = i + len(mine), j + len(own)
            wanted = own[a[4] > 0]
            rows.append((blk, _squeezed(total[mine], alone[mine], sums[own], few[own], *(x[wanted] for x in weights))))
        stats = np.sum([_stats(total), *(x for x in table["stats"].to_pylist() if x)], 0).tolist()
        return _answered(rows, order, table["bucket"][0].as_py(), stats)

    return run


def _written(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Rows of the tables (order, bucket, payload), without the columns of scores."""
    columns = list(zip(*rows)) or [[]] * 3
    out = {name: pa.nulls(len(rows), kind) for name, kind in zip((c.split()[0] for c in _SCORE.split(", ")), _SCORE_TYPES)}
    return pa.table(out | {"bucket": pa.array(columns[1], pa.int32()), "payload": pa.array(columns[2], pa.binary()), "ord": pa.array(columns[0], pa.int32())})


_SCORE_TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def _tables(order: int, ranges: int):
    """The counts of one bucket: of order 1 hash, number and count of each word, of others context, word and count."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if order == 1:
            _, words, _, total = _gathered_words(table)
            return _written([(1, bucket, _squeezed(np.diff(words, prepend=np.uint64(0)), _numbers(total, bucket, ranges), total))])
        total, owner, words, _, keys = _gathered(table, order)[4:]
        seen = np.flatnonzero(total)
        return _written([(order, bucket, _stored([k[owner[seen]] for k in keys], words[seen], total[seen]))])

    return run


def _summed(table: pa.Table) -> pa.Table:
    rows = [r for r in table.select(["ord", "stats"]).to_pylist() if r["stats"]]
    by = {k: np.sum([r["stats"] for r in rows if r["ord"] == k], 0).tolist() for k in {r["ord"] for r in rows}}
    return pa.table({"of": pa.array(list(by), pa.int32()), "sums": pa.array(list(by.values()), pa.list_(pa.int64()))})


def _score(order: int, ranges: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not len(docs):
            return _written([])
        b, levels = _blocks(docs, found, order, ranges)
        if levels:
            levels[-1].answered(b, found, ranges)
        flat = next(x for x in found["sums"].to_pylist() if x)
        stats = [flat[k * _STATS : (k + 1) * _STATS] for k in range(order)]
        total, distinct, few = int(stats[0][0]), int(stats[0][1]), stats[0][2 : 2 + K]
        d = [None, *(discounts([0, *s[2:]]) for s in stats)]
        p = first_order(b.totals, total, d[1], few)  # of each word, then of each pair of the order reached
        below, factors = np.array([total]), np.array([freed(d[1], np.asarray(few, float), np.float64(total))[1] if total else 1.0])
        owner, logs = np.zeros(len(p), np.int32), np.log10(p)[b.word]
        for level in levels:
            at, c, needy, m = level.lower_index, level.context, level.needy, level.weights
            # What the order below gives to the words seen here; they have one lower context, that of any of them.
            under = np.zeros(len(level.local), np.int32)
            under[c] = owner[at]
            under = under[needy]
            lower = (m[:, K : 2 * K] * np.arange(1, K + 1) * d[level.order - 1][1:]).sum(-1) + m[:, -1]
            lower = factors[under] * lower / np.maximum(below[under], 1)
            weight = freed(d[level.order], m[:, :K], level.context_total[needy])[0] / np.maximum(1 - lower, 1e-300)
            total_of = level.context_total[c]
            seen = level.factor[c] * discounted(d[level.order], level.totals) / np.maximum(total_of, 1)
            back = np.flatnonzero((level.totals == 0) & (total_of > 0))
            before, p = p, np.where(total_of == 0, p[at], seen)
            p[back] = weight[level.index[c[back]]] * before[at[back]]
            below, factors, owner = level.context_total, level.factor, c
            has = level.which >= 0
            logs[has] = np.log10(p)[level.which[has]]
        base = np.log10((b.totals + 1) / (total + distinct + 1))[b.word]
        per_doc = lambda x: np.add.reduceat(x, b.offsets[:-1])
        n = len(b.ids)
        columns = [
            pa.array(b.ids, mask=b.null), pa.array(b.held), pa.array(b.lengths, pa.int64()), pa.array(per_doc((b.totals > 0)[b.word].astype(np.int64)), pa.int64()),
            pa.array(np.full(n, total), pa.int64()), pa.array(per_doc(base), pa.float64()), pa.array(per_doc(logs), pa.float64()),
            pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(np.zeros(n, np.int32)),
        ]
        local = _written([(level.order, _LOCAL + b.blk, level.local_table(b)) for level in levels])
        return pa.concat_tables([pa.Table.from_arrays(columns, local.schema.names), local])

    return run


def katz_scores(docs: DataFrame, held=None, order: int = ORDER, block_bytes: int = KATZ_BLOCK_BYTES, path: str | None = None) -> DataFrame:
    """Scores every text by a Katz model of this order (1 to 3) learnt from the rows that aren't held out.

    held: a boolean column of documents left out of the counts; by default crc32(doc_id as text) mod 7 is 2.
    Returns a row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score, both log10 of the whole text's probability. Null and empty texts are one end token. Words unknown to the
    training rows share one class. If every row is held out, each word has probability one in the model. Repeated rows
    count as often as they occur; a row without doc_id is not held out; an empty table gives an empty result; a very long
    text makes a block of its own. Two words are told apart by 64-bit hashes. Ties don't arise; further columns aren't
    looked at.

    Scores and tables are written to a folder (path, else one in the shared folder) partitioned by ord: 0 has the scores,
    1 to order the counts by bucket, which counts_of() reads.
    """
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    held = held_out(F.col("doc_id"), 7, 2) if held is None else held
    blocks = block_count(docs, block_bytes)
    dealt = in_blocks(text_of(docs.withColumn("flag", F.coalesce(held, F.lit(False))), "flag"), blocks)
    asked = dealt.groupBy("blk").applyInArrow(_ask_words(blocks), _ASKED)
    # Answers are exchanged once an order and read whole by all that use them: a filter or a projection on one of these
    # would be moved below its exchange and make another of it.
    found = asked.groupBy("bucket").applyInArrow(_count_words(blocks), _ANSWER).repartition("blk")
    tables = [asked.groupBy("bucket").applyInArrow(_tables(1, blocks), _WRITTEN)]
    for k in range(2, order + 1):
        asked = dealt.groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(_ask(k, blocks), _ASKED)
        tables.append(asked.groupBy("bucket").applyInArrow(_tables(k, blocks), _WRITTEN))
        found = found.unionByName(asked.groupBy("bucket").applyInArrow(_count(k), _ANSWER).repartition("blk"))
    # Counts of counts of all orders: one row, which joins the answers to the words.
    sums = found.groupBy("blk").applyInArrow(_summed, "of int, sums array<bigint>")
    cells = [(k, i) for k in range(1, order + 1) for i in range(_STATS)]
    each = [F.coalesce(F.sum(F.when(F.col("of") == k, F.col("sums")[i])), F.lit(0)).alias(f"s{k}_{i}") for k, i in cells]
    one = sums.agg(F.min("of").alias("of"), *each).select("of", F.array(*[f"s{k}_{i}" for k, i in cells]).alias("sums"))
    found = found.join(F.broadcast(one), F.col("ord") == F.col("of"), "left")
    scores = dealt.groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(_score(order, blocks), _WRITTEN)
    for t in tables:
        scores = scores.unionByName(t)
    path = path or new_folder(spark, "katz")
    scores.write.partitionBy("ord").parquet(path)
    names = [c.split()[0] for c in _SCORE.split(", ")]
    return spark.read.schema(f"{_SCORE}, bucket int, payload binary, ord int").parquet(path).where("ord = 0").select(*names)


def counts_of(spark, path: str, order: int) -> DataFrame:
    """The stored counts of one order: (hash, number, count) of words, or (context, [word before], word, count) by number."""

    def run(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                a = _arrays(payload)
                a[0] = np.cumsum(a[0].view(np.uint64), dtype=np.uint64).view(np.int64)
                if order > 1:
                    a[1] = _rises(_runs(a[0]), a[1], True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in a], names)

    names = {1: ["hash", "number", "count"], 2: ["context", "word", "count"], 3: ["context", "before", "word", "count"]}[order]
    stored = spark.read.schema("bucket int, payload binary, ord int").parquet(path).where(F.col("ord") == order).select("payload")
    return stored.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def op2(spark, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
