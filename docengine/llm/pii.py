"""Operator 1, PII: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Base spans are those of four patterns. The network is trained on lines of a bounded sample of the corpus into which spans
of the four kinds, in the patterns' forms and in others (numbers without a plus, "name at host dot tld"), are written, with
look-alikes (keys, versions, dates, sums) as negatives; it adds the spans that patterns miss and takes none away.

Every character of every text is read in overlapping windows. A window is decoded exactly (Viterbi over the CRF); where
at each of its characters "outside" leads by more than any transitions can make up for, the best path is known to be all
outside and isn't computed. Windows are then reconciled over the whole text: a character takes its label from the window
in which it lies farthest from an edge.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 300  # documents whose lines serve as surroundings in training, those with the smallest hash of their id
SAMPLE_CHARS = 1 << 15  # of each of them that are looked at in training; all of every text is searched
WINDOW, OVERLAP = 160, 32
_H, _E, _L = 8, 7, len(KINDS) + 1
_CHUNK = 2048  # windows run at a time
_CHARS = 1 << 21  # text read at a time

_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each "@" outwards, in time linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# Characters fall into classes: each ASCII one its own, letters beyond by parity of the code point, the rest one.
_CLASSES = 131


def classes(codes: np.ndarray) -> np.ndarray:
    out = np.minimum(codes, 128).astype(np.int16)
    far = codes >= 128
    out[far] = 128 + (codes[far] >= 0xC0) + (codes[far] > 0x24F)
    return out


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"emb": f(_CLASSES + 1, _E, by=0.5), "out": f(_L, 2 * _H + 1, by=0.2), "trans": np.zeros((_L, _L), np.float32)}
        for d in "fb":
            w = f(4 * _H, _E + _H + 1, by=0.3)
            w[:, -1] = 0
            w[_H : 2 * _H, -1] = 1  # forget gates start open
            self.p["w" + d] = w
        self.p["trans"] -= 1 - np.eye(_L, dtype=np.float32)

    def emissions(self, x: np.ndarray, mask: np.ndarray | None = None, keep: bool = False):
        """(time, labels, windows) scores of x (time, windows) character classes; _CLASSES stands for none.

        State doesn't change where there is no character, so each direction begins at its first one.
        """
        steps, n = x.shape
        emb = np.ascontiguousarray(self.p["emb"].T)
        states = np.empty((steps, 2 * _H + 1, n), np.float32)
        states[:, -1] = 1
        cache: dict = {}
        scale = np.full((4 * _H, 1), 0.5, np.float32)
        scale[3 * _H :] = 1  # i, f, o by tanh(x / 2), g by tanh(x)
        inside = None if mask is None or mask.all() else mask
        s = np.empty((_E + _H + 1, n), np.float32)
        g = np.empty((4 * _H, n), np.float32)
        for d, times, own in (("f", range(steps), slice(0, _H)), ("b", range(steps - 1, -1, -1), slice(_H, 2 * _H))):
            w = self.p["w" + d] * scale
            h, c = np.zeros((_H, n), np.float32), np.zeros((_H, n), np.float32)
            s[-1] = 1
            for t in times:
                if keep:
                    s, g = np.empty_like(s), np.empty_like(g)
                    s[-1] = 1
                np.take(emb, x[t], axis=1, out=s[:_E], mode="clip")
                s[_E:-1] = h
                np.matmul(w, s, out=g)
                np.tanh(g, out=g)
                g[: 3 * _H] *= 0.5
                g[: 3 * _H] += 0.5
                new = g[_H : 2 * _H] * c
                new += g[:_H] * g[3 * _H :]
                th = np.tanh(new)
                out = g[2 * _H : 3 * _H] * th
                if inside is not None:
                    m = inside[t]
                    new, out = np.where(m, new, c), np.where(m, out, h)
                if keep:
                    cache[d, t] = (s, g, c, th)
                h, c = out, new
                states[t, own] = h
        e = np.matmul(self.p["out"], states)
        return (e, states, cache) if keep else e

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Of the mean negative log-likelihood of label paths y (time, windows) under the CRF."""
        steps, n = x.shape
        e, states, cache = self.emissions(x, mask, True)
        e, trans = e.astype(np.float64), self.p["trans"].astype(np.float64)
        alpha = np.empty((steps, _L, n))
        alpha[0] = e[0]
        for t in range(1, steps):
            z = alpha[t - 1][:, None] + trans[:, :, None]
            top = z.max(0)
            alpha[t] = np.where(mask[t], top + np.log(np.exp(z - top).sum(0)) + e[t], alpha[t - 1])
        top = alpha[-1].max(0)
        total = top + np.log(np.exp(alpha[-1] - top).sum(0))
        beta, de, dtrans = np.zeros((_L, n)), np.empty((steps, _L, n)), np.zeros((_L, _L))
        index = np.arange(n)
        score = np.zeros(n)
        for t in range(steps - 1, -1, -1):
            m = mask[t]
            de[t] = np.exp(alpha[t] + beta - total) * m
            de[t][y[t], index] -= m
            score += e[t][y[t], index] * m
            if t:
                pair = np.exp(alpha[t - 1][:, None] + trans[:, :, None] + (e[t] + beta)[None] - total) * m
                dtrans += pair.sum(2)
                np.add.at(dtrans, (y[t - 1][m], y[t][m]), -1)
                score += trans[y[t - 1], y[t]] * m
                z = trans[:, :, None] + (e[t] + beta)[None]
                top = z.max(1)
                beta = np.where(m, top + np.log(np.exp(z - top[:, None]).sum(1)), beta)
        de = (de / n).astype(np.float32)
        g = {"trans": (dtrans / n).astype(np.float32), "out": np.einsum("tln,tkn->lk", de, states), "emb": np.zeros_like(self.p["emb"])}
        ds = np.einsum("lk,tln->tkn", self.p["out"], de)
        for d, times, own in (("f", range(steps - 1, -1, -1), slice(0, _H)), ("b", range(steps), slice(_H, 2 * _H))):
            w, dw = self.p["w" + d], np.zeros_like(self.p["w" + d])
            dh, dc = np.zeros((_H, n), np.float32), np.zeros((_H, n), np.float32)
            for t in times:
                s, gate, c, th = cache[d, t]
                i, f, o, u = (gate[k * _H : (k + 1) * _H] for k in range(4))
                dh = dh + ds[t, own]
                m = mask[t]
                h_in, c_in = dh * m, dc * m
                dn = c_in + h_in * o * (1 - th**2)
                da = np.concatenate([dn * u * i * (1 - i), dn * c * f * (1 - f), h_in * th * o * (1 - o), dn * i * (1 - u**2)])
                dw += da @ s.T
                back = w.T @ da
                for k in range(_E):
                    g["emb"][:, k] += np.bincount(x[t], back[k], _CLASSES + 1)[: _CLASSES + 1]
                dh, dc = back[_E:-1] + dh * ~m, dn * f + dc * ~m
            g["w" + d] = dw
        return float((total - score).mean()), g

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, windows) labels of the best paths."""
        e, trans = self.emissions(x, mask), self.p["trans"]
        out = np.zeros(x.shape, np.int8)
        # A stretch off "outside" gains at most the best transition over staying, once in and once out, at each character.
        need = 2 * float(max(0.0, (trans - trans[0, 0]).max())) + 1e-3
        lead = e[:, 0] - e[:, 1:].max(1)
        some = np.flatnonzero(((lead < need) & mask).any(0))
        if len(some):
            out[:, some] = _viterbi(np.ascontiguousarray(e[:, :, some]), trans, mask[:, some])
        return out


def _viterbi(e: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> np.ndarray:
    steps, _, n = e.shape
    score, back = e[0].copy(), np.empty((steps, _L, n), np.int8)
    for t in range(1, steps):
        z = score[:, None] + trans[:, :, None]
        back[t] = np.where(mask[t], z.argmax(0), np.arange(_L)[:, None])
        score = np.where(mask[t], z.max(0) + e[t], score)
    out = np.empty((steps, n), np.int8)
    out[-1] = score.argmax(0)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][out[t], np.arange(n)]
    return out


def cut(lengths: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP):
    """Row, begin (in the row) and size of the windows of rows of these lengths; each but a row's last is full."""
    step = window - overlap
    counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - overlap) // step)), 0)
    row = np.repeat(np.arange(len(lengths)), counts)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return row, begin, np.minimum(window, lengths[row] - begin)


def label_texts(net: Network, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans the network finds in each text: maximal runs of one label after the windows are reconciled."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = classes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    offset = np.cumsum(lengths) - lengths
    row, begin, size = cut(lengths)
    first = offset[row] + begin
    found: dict[int, dict[int, np.ndarray]] = {}
    order = np.argsort(size, kind="stable")  # windows of like size together
    for i in range(0, len(order), _CHUNK):
        at = order[i : i + _CHUNK]
        t = np.arange(int(size[at].max()))[:, None]
        mask = t < size[at]
        x = np.where(mask, codes[np.where(mask, first[at] + t, 0)], _CLASSES)
        labels = net.decode(x, mask)
        for k in np.flatnonzero(labels.any(0)):
            w = at[k]
            found.setdefault(int(row[w]), {})[int(begin[w])] = labels[: size[w], k]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    step, half = WINDOW - OVERLAP, OVERLAP // 2
    for r, windows in found.items():
        n, whole = int(lengths[r]), {}
        for b, labels in windows.items():  # each window's own part: up to the middle of what it shares with a neighbour
            lo = b + half if b else 0
            hi = min(n, b + step + half) if b + len(labels) < n else n
            for k in np.flatnonzero(labels[lo - b : hi - b]):
                whole[lo + int(k)] = int(labels[lo - b + k])
        run: list[int] = []
        for i in [*sorted(whole), None]:
            if run and (i is None or i != run[-1] + 1 or whole[i] != whole[run[0]]):
                out[r].append((KINDS[whole[run[0]] - 1], run[0], run[-1] + 1))
                run = []
            if i is not None:
                run.append(i)
    return out


def plausible(kind: str, span: str) -> bool:
    """What any span of a kind must have; keeps stray labels out."""
    digits = len(_DIGIT.findall(span))
    if kind == "email":
        return len(span) >= 6 and ("@" in span or re.search(r"[\[( ]at[\]) ]", span) is not None)
    if kind == "ip":
        return len(re.findall("[0-9]+", span)) == 4 and all(int(x) <= 255 for x in re.findall("[0-9]{1,9}", span))
    return 13 <= digits <= 19 and luhn("".join(_DIGIT.findall(span))) if kind == "card" else 9 <= digits <= 15 and not re.search("[A-Za-z]", span)


def all_spans(text: str, added: list[tuple[str, int, int]]) -> tuple[list, list]:
    """(base spans, all spans): those added are trimmed, must be plausible and mustn't touch a base span."""
    base = base_spans(text)
    more = []
    for kind, a, b in added:
        while a < b and text[a] in " \t\n\r.,;:":
            a += 1
        while a < b and text[b - 1] in " \t\n\r.,;:":
            b -= 1
        if plausible(kind, text[a:b]) and not any(a < y and x < b for _, x, y in base):
            more.append((kind, a, b))
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1]))


# Labelled spans for training


def _number(r, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _word(r, low: int = 3, high: int = 9) -> str:
    return "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(low, high)))


def _card(r) -> str:
    digits = str(r.integers(3, 7)) + _number(r, 14)
    digits += next(c for c in "0123456789" if luhn(digits + c))
    sep = r.choice(["", "", " ", "-"])
    return sep.join(digits[i : i + 4] for i in range(0, 16, 4))


def _span(r) -> tuple[str, str]:
    kind = KINDS[r.integers(0, 4)]
    if kind == "email":
        name, host, top = _word(r) + r.choice(["", ".", "_"]) + str(r.choice([_word(r), _number(r, 2)])), _word(r) + r.choice(["", _number(r, 1)]), r.choice(["com", "org", "net", "de", "example.com"])
        return kind, str(r.choice([f"{name}@{host}.{top}", f"{name}@{host}.{top}", f"{name} at {host} dot {top}", f"{name} [at] {host} [dot] {top}", f"{name} (at) {host}.{top}"]))
    if kind == "ip":
        return kind, ".".join(str(x) for x in r.integers(1, 256, 4))
    if kind == "card":
        return kind, _card(r)
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    return kind, str(r.choice([f"+1 ({a}) {b}-{c}", f"+{r.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{r.integers(1, 99)} {a} {b}{c}"]))


def _lookalike(r) -> str:
    hexes = "".join("0123456789abcdef"[k] for k in r.integers(0, 16, 40))
    kinds = [f'token = "{hexes}"', f"password={hexes[:18]}", "AKIA" + _word(r, 8, 16).upper() + _number(r, 3), f"{r.integers(1, 20)}.{r.integers(0, 30)}.{r.integers(0, 9)}",
             f"{r.integers(1900, 2100)}-{r.integers(10, 13)}-{r.integers(10, 29)}", _number(r, int(r.integers(1, 9))), f"{_number(r, 2)}.{_number(r, 2)}", f"{_word(r)}-{_word(r)} at {_word(r)}", f"({_word(r)}) {_number(r, 4)}"]
    return kinds[r.integers(0, len(kinds))]


def training_windows(lines: list[str], n: int, seed: int = 5, width: int = WINDOW // 2):
    """(classes, mask, labels), each (time, n): corpus text with spans and look-alikes written into it."""
    r = np.random.default_rng(seed)
    x, mask, y = np.full((width, n), _CLASSES, np.int64), np.zeros((width, n), bool), np.zeros((width, n), np.int64)
    for k in range(n):
        line = lines[r.integers(0, len(lines))] if lines else _word(r)
        begin = int(r.integers(0, max(1, len(line) - width // 2)))
        line = line[begin : begin + int(r.integers(width // 3, width))]
        text, label = [], []
        for part in re.split(r"( )", line):
            text += part
            label += [0] * len(part)
            if part == " " and r.random() < (0.12 if k % 3 else 0.0):
                kind, span = _span(r) if r.random() < 0.6 else ("", _lookalike(r))
                text += span + " "
                label += [KINDS.index(kind) + 1 if kind else 0] * len(span) + [0]
        shift = int(r.integers(0, max(1, len(text) - width + 1)))
        text, label = text[shift : shift + width], label[shift : shift + width]
        x[: len(text), k] = classes(np.array([ord(c) for c in text], np.uint32)) if text else []
        mask[: len(text), k], y[: len(label), k] = True, label
    return x, mask, y


def fit(lines: list[str], windows: int = 10_000, epochs: int = 6, batch: int = 128, seed: int = 3) -> Network:
    net, r = Network(seed), np.random.default_rng(seed)
    x, mask, y = training_windows(lines, windows)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-windows // batch)
    for _ in range(epochs):
        order = r.permutation(windows)
        for i in range(0, windows, batch):
            at = order[i : i + batch]
            g = net.gradient(x[:, at], mask[:, at], y[:, at])[1]
            norm = float(np.sqrt(sum((a.astype(np.float64) ** 2).sum() for a in g.values())))
            step += 1
            rate = 0.015 * (1 - 0.9 * step / total) * min(1.0, 5 / max(norm, 1e-9))
            for k, a in g.items():
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def trained(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Network:
    """A network trained on lines of the `sample` documents whose ids have the smallest hashes, `chars` of each at most."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    picked = docs.sparkSession.createDataFrame([tuple(r) for r in ids.collect()], "doc_id long")
    rows = text_of(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.substring("text", 1, chars)).alias("text")).collect()
    lines = [x for r in sorted((r["doc_id"], r["text"]) for r in rows) for x in r[1].split("\n") if x.strip() and not base_spans(x)]
    return fit(lines)


def _batches(batch, chars: int = _CHARS):
    """(doc_ids, texts) of bounded size."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        ids.append(doc)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(net):
    def run(batches):
        for batch in batches:
            for ids, texts in _batches(batch):
                rows = [all_spans(t, a) for t, a in zip(texts, label_texts(net.value, texts))]
                cols = {"doc_id": pa.array(ids, pa.int64())}
                cols |= {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS}
                cols["base_sha256"] = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
                cols["spans"] = pa.array([_joined(spans) for _, spans in rows], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def find_pii(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans) and spans (all) for each row.

    Null and empty texts have no spans. Repeated rows are each read. Spans are in code points, ends exclusive.
    """
    net = docs.sparkSession.sparkContext.broadcast(net or trained(docs))
    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return text_of(docs).mapInArrow(_found(net), out)


def redacted(text: str, spans) -> str:
    """Spans replaced by <KIND>, from the end; of spans that overlap the first is named, all are covered."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in reversed(merged):
        text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
    return text


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The columns of documents with personal data in text replaced by <KIND>; n_chars follows the new text.

    A null text stays null.
    """
    net = docs.sparkSession.sparkContext.broadcast(net or trained(docs))
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [x or "" for x in part.column("text").to_pylist()]
                done: list = []
                at = 0
                while at < len(texts):
                    j, size = at, 0
                    while j < len(texts) and (j == at or size < _CHARS):
                        size += len(texts[j])
                        j += 1
                    done += [redacted(t, all_spans(t, a)[1]) for t, a in zip(texts[at:j], label_texts(net.value, texts[at:j]))]
                    at = j
                done = [None if x is None else d for x, d in zip(part.column("text").to_pylist(), done)]
                columns = {c: pa.array(done, pa.string()) if c == "text" else part.column(c) for c in part.schema.names}
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(*kept, F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, rows.schema)
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
