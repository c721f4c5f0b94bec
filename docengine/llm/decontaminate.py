"""Operator 5, benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

The index covers the benchmark, which is small beside the corpus; where it isn't (over SHARD_ITEMS items) it is built and
broadcast shard by shard. Every passage of every document, as overlapping windows long enough to hold any item whole, is
a query. An item's score is divided by the score of the item itself, so a threshold means the same for all items.

The bounds of blocks are first summed for all passages of a batch at once, with each distinct term of a passage counted
once: a passage none of whose blocks reaches the threshold can have no result and is done. The others are searched by
WAND over posting lists, with the pivot checked against block maxima. What is retrieved is verified: enough of the
question's word 5-grams and of the answer's must be in the passage. One altered word takes up to five of them, all that
a short part has, and a word glued to its neighbours is an altered one. So a part of under SHORT words also counts as
held if enough of its bytes are, in order and at its place in the passage.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import text_of

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, NGRAM = 0.6, 0.8, 5
SHORT = 29  # words from which on a part keeps OVERLAP of its n-grams when one word is altered
CONTEXT = 8  # words beside a short part that tell its place
_ALIGNED_BYTES = 1 << 12  # of a part and its context; of longer ones words are compared whole
BLOCK = 8  # items
SHARD_ITEMS = 4000  # an index of as many items of 100 words takes about 100 MB
_SENTENCE = re.compile(rb"[.?!][\x20\x09-\x0D]+")
_BATCH = 1 << 21  # bytes of text bounded at a time


def parts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the question and the answer: the last sentence answers, of a sole sentence the last third."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    cuts = [m.end() for m in _SENTENCE.finditer(raw) if raw[m.end() :].strip()]
    words, _ = T.words(pa.array([raw], pa.binary()).cast(pa.string()), True)
    at = len(raw[: cuts[-1]].split()) if cuts else len(words) - len(words) // 3
    return words[:at], words[at:]


def grams(words: np.ndarray) -> np.ndarray:
    """Distinct n-grams; of fewer words, the whole sequence as one."""
    return np.unique(T.rolling(words, min(NGRAM, len(words)))) if len(words) else np.zeros(0, np.uint64)


def aligned(pattern: bytes, begin: int, end: int, window: bytes) -> float:
    """Share of the bytes begin .. end of the pattern that the window holds, where the whole pattern fits it best.

    The best fit has the least edit distance to any part of the window; bytes that it leaves as they are count.
    """
    p, w = np.frombuffer(pattern, np.uint8), np.frombuffer(window, np.uint8)
    steps, cost = np.arange(len(w) + 1), np.zeros((len(p) + 1, len(w) + 1), np.int32)
    for i in range(len(p)):
        cost[i + 1, 0] = i + 1
        np.minimum(cost[i, 1:] + 1, cost[i, :-1] + (w != p[i]), out=cost[i + 1, 1:])
        cost[i + 1] = np.minimum.accumulate(cost[i + 1] - steps) + steps
    i, j, held = len(p), int(cost[-1].argmin()), 0
    while i and j:
        same = pattern[i - 1] == window[j - 1]
        if cost[i, j] == cost[i - 1, j - 1] + (not same):
            held += same and begin <= i - 1 < end
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return held / (end - begin)


def in_place(item: list[bytes], hashes: np.ndarray, a: int, b: int, have: np.ndarray, text) -> float:
    """Share of the bytes of words a .. b of an item that a passage holds at their place, which these words and CONTEXT
    words on either side tell. hashes: of the item's words, have: of the passage's, text(i, j): the passage's words i .. j."""
    low, high = max(0, a - CONTEXT), min(len(item), b + CONTEXT)
    at, word = np.nonzero(have[:, None] == hashes[None, low:high])
    shifts, votes = np.unique(at - word, return_counts=True)
    best = 0.0
    for shift in shifts[np.argsort(-votes, kind="stable")][:3].tolist():
        size = sum(map(len, item[low:high]))
        if size > _ALIGNED_BYTES:
            same = [len(item[k]) for k in range(a, b) if 0 <= shift + k - low < len(have) and have[shift + k - low] == hashes[k]]
            best = max(best, sum(same) / sum(map(len, item[a:b])))
            continue
        near = text(max(0, shift - CONTEXT // 2), min(len(have), shift + high - low + CONTEXT // 2))
        near = [w if len(w) <= 2 * size else w[:size] + b" " + w[-size:] for w in near]
        before = sum(len(w) + 1 for w in item[low:a])
        part = b" ".join(item[a:b])
        best = max(best, aligned(b" ".join(item[low:high]), before, before + len(part), b" ".join(near)))
    return best


class Index:
    """BM25 weights of items in posting lists ordered by item, as shares of each item's own score, with block maxima."""

    def __init__(self, items: list[tuple[int, str]]):
        items = sorted(((i, t or "") for i, t in items), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        split = [parts(t) for _, t in items]
        docs = [np.concatenate(p) for p in split]
        keep = [k for k, d in enumerate(docs) if len(d)]
        self.ids = [items[k][0] for k in keep]
        docs, split = [docs[k] for k in keep], [split[k] for k in keep]
        self.questions, self.answers = [grams(q) for q, _ in split], [grams(a) for _, a in split]
        self.answer_width = [min(NGRAM, len(a)) for _, a in split]
        self.question_width = [min(NGRAM, len(q)) for q, _ in split]
        self.words = [(items[k][1].encode("utf-8", "surrogatepass").lower().split(), len(q), d) for k, (q, _), d in zip(keep, split, docs)]
        self.longest = max(map(len, docs), default=0)
        n, mean = len(docs), (sum(map(len, docs)) / len(docs) if docs else 1)
        terms = [np.unique(d, return_counts=True) for d in docs]
        self.terms, df = np.unique(np.concatenate([t for t, _ in terms]), return_counts=True) if docs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.blocks = -(-n // BLOCK)
        self.maxima = np.zeros((len(self.terms) + 1, self.blocks), np.float32)  # a last row of zeros for other words
        for k, (own, tf) in enumerate(terms):
            at = np.searchsorted(self.terms, own)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(docs[k]) / mean))
            weight = weight / weight.sum()
            for t, w in zip(at.tolist(), weight.tolist()):
                self.postings[t].append((k, w))
            self.maxima[at, k // BLOCK] = np.maximum(self.maxima[at, k // BLOCK], weight.astype(np.float32))
        self.top = [max((w for _, w in p), default=0.0) for p in self.postings]

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item, share of its own score) of all items at or above the threshold, by block-max WAND."""
        lists = [[self.postings[t], 0, self.top[t], t] for t in terms]  # postings, cursor, bound, term
        found, least = [], threshold - 1e-6  # block maxima are of single precision
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[2]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.maxima[x[3], block]) for x in lists[: pivot + 1]) < least:
                # No item up to the end of this block, or up to the next list's item, can reach the threshold.
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0][lists[pivot + 1][1]][0])
                to = max(to, item + 1)
                move = lists[: pivot + 1]
            elif lists[0][0][lists[0][1]][0] == item:
                score = sum(x[0][x[1]][1] for x in lists[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                to, move = item + 1, lists[: pivot + 1]
            else:
                to, move = item, [x for x in lists[:pivot] if x[0][x[1]][0] < item]
            for x in move:
                p, i = x[0], x[1]
                while i < len(p) and p[i][0] < to:
                    i += 1
                x[1] = i
            lists = [x for x in lists if x[1] < len(x[0])]
        return found


def passages(first: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of each half window of each row with words."""
    counts = -(-np.diff(first) // half)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * half


def candidates(index: Index, term: np.ndarray, first: np.ndarray, half: int, threshold: float) -> list[tuple[int, int, int]]:
    """(row, begin, end) of the passages whose block bounds reach the threshold; term: of each word, or one past all."""
    row, begin = passages(first, half)
    if not len(row):
        return []
    end = np.minimum(begin + half, first[row + 1])
    known = np.flatnonzero(term < len(index.terms))
    if not len(known):
        return []
    slot = np.searchsorted(begin, known, "right") - 1  # half window of each known word
    order = np.lexsort((known, term[known], row[slot]))
    before = np.full(len(known), -1, np.int64)
    same = (term[known][order][1:] == term[known][order][:-1]) & (row[slot][order][1:] == row[slot][order][:-1])
    before[order[1:][same]] = known[order[:-1][same]]
    own = np.zeros((len(row), index.blocks), np.float32)  # distinct within its half
    new = np.zeros((len(row), index.blocks), np.float32)  # and not in the half before
    previous = np.where(slot > 0, begin[slot - 1], 0)
    for out, take in ((own, before < begin[slot]), (new, before < previous)):
        at, rows = slot[take], index.maxima[term[known[take]]]
        if len(at):
            cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[at[cut]] = np.add.reduceat(rows, cut, axis=0)
    follows = np.append(row[1:] == row[:-1], False)
    bound = own.copy()
    bound[:-1][follows[:-1]] += new[1:][follows[:-1]]
    alone = ~follows & np.append(False, row[1:] == row[:-1])  # a last half is within the passage before
    stop = np.where(follows, np.append(end[1:], 0), end)
    hit = np.flatnonzero((bound.max(1) >= threshold - 1e-4) & ~alone)
    return [(int(row[k]), int(begin[k]), int(stop[k])) for k in hit]


def leaks(index: Index, column, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(row, item position, score, question overlap, answer overlap) of verified items, the best passage of each."""
    if not len(index.ids):
        return []
    data, offsets = T.flat(column)
    starts, ends, first = T.spans(data, offsets)
    hashes = T.word_hashes(data, starts, ends, True)
    term = np.searchsorted(index.terms, hashes)
    term[(term == len(index.terms)) | (index.terms[np.minimum(term, len(index.terms) - 1)] != hashes)] = len(index.terms)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for row, begin, end in candidates(index, term, first, max(64, index.longest), threshold):
        own = np.unique(term[begin:end])
        for item, score in index.search(own[own < len(index.terms)].tolist(), threshold):
            shares = []
            for want, width in ((index.questions[item], index.question_width[item]), (index.answers[item], index.answer_width[item])):
                have = T.rolling(hashes[begin:end], width) if len(want) else np.zeros(0, np.uint64)
                shares.append(float(np.isin(want, have).mean()) if len(want) else 1.0)
            item_words, cut, own_hashes = index.words[item]
            places = ((0, cut), (cut, len(item_words)))
            if all(share >= overlap or b - a < SHORT for share, (a, b) in zip(shares, places)):
                text = lambda i, j, begin=begin: [data[starts[k] : ends[k]].tobytes().lower() for k in range(begin + i, begin + j)]
                for k, (a, b) in enumerate(places):
                    if shares[k] < overlap <= min(shares[:k], default=1.0):
                        shares[k] = max(shares[k], in_place(item_words, own_hashes, a, b, hashes[begin:end], text))
            if min(shares) >= overlap:
                best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (score, *shares))
    return [(r, i, *v) for (r, i), v in sorted(best.items())]


def _found(index):
    def run(batches):
        for batch in batches:
            for part in T.slices(batch, _BATCH):
                rows = leaks(index.value, part.column("text"))
                ids = part.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()), "item_id": pa.array([index.value.ids[r[1]] for r in rows], pa.int64()),
                    "score": pa.array([round(r[2], 6) for r in rows], pa.float64()), "question_overlap": pa.array([r[3] for r in rows], pa.float64()), "answer_overlap": pa.array([r[4] for r in rows], pa.float64()),
                })

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each benchmark item that a document holds.

    The overlaps are shares of 5-grams or, of parts of under SHORT words, of bytes in place, if that is more.
    Null and empty texts hold nothing and null or empty items are held by nothing. Repeated documents and items are each
    reported, null ids as null. The benchmark is collected in shards of at most `shard_items` items, each broadcast for one pass.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    shards = max(1, -(-items.count() // shard_items))
    texts, out = text_of(docs), None
    for k in range(shards):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect()]
        index = spark.sparkContext.broadcast(Index(part))
        found = texts.mapInArrow(_found(index), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Items verbatim (case apart, words separated alike) in a document: what the synthetic tables hold.
VERBATIM = """
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+'), ' ') || ' ' AS w FROM documents),
b AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'), ' ') || ' ' AS w FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d.w, b.w)
"""
