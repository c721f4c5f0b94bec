"""The pipeline against a plain version of its decisions, and rows without ids in every operator."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from docengine.llm import decontaminate, fingerprints, katz, minhash, packing, pii, substring_dedup, toxicity, warc


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    vocab = [a + b for a in "ba be bi bo da de di do ka ke ki mo mu no".split() for b in "lo la ru ra ti to mo".split()]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, prose(25) + ". " + prose(10)) for k in range(6)]
    docs = [(k, prose(r.randint(5, 120))) for k in range(240)]
    docs = [(k, " ".join(f"zorg{w}" if k % 4 == 0 and j % 5 == 0 else w for j, w in enumerate(t.split()))) for k, t in docs]
    docs += [(300 + k, docs[k][1].upper()) for k in range(1, 30)]  # copies of a smaller id
    docs += [(400 + k, f"{prose(40)} {items[k][1]} {prose(9)}") for k in range(6)]
    docs += [(500, f"{prose(20)} mail jo.doe@mail.example.com or +1 (212) 555-0173 {prose(8)}"), (501, None), (502, ""), (503, prose(6000)), (None, prose(30)), (None, prose(31))]
    tables = {
        "documents": spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in tables}
    toxic = {x["doc_id"] for x in toxicity.toxicity(read["documents"], read["labels"]).where("predicted = 1").collect()}
    assert len(toxic & set(range(0, 240, 4))) > 45 and len(toxic - set(range(0, 240, 4))) < 12
    left = [(i, t) for i, t in docs if i is None or i not in toxic]
    sets = {i: shingles(t) for i, t in left if i is not None}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    left = [(i, t) for i, t in left if i is None or label[i] == i]
    want = [(i, t) for i, t in left if not any(x.lower() in (t or "").lower() for _, x in items)]
    assert len(links) > 15 and len(left) - len(want) == 6 - len(toxic & set(range(400, 406)))

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    starts = [x for x in out if x["start"] == 0]
    assert sorted((x["doc_id"] or -1) for x in starts) == sorted((i or -1) for i, _ in want)
    plain = Tokenizer.from_file(packing.vocabulary_path())
    for i, t in want:
        if i not in (None, 500):
            ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            pieces = {x["start"]: x for x in out if x["doc_id"] == i}
            assert {k: x["ids_crc32"] for k, x in pieces.items()} == {k: zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)}
    if 500 not in toxic:
        whole = len(plain.encode(dict(docs)[500], add_special_tokens=False).ids) + 1
        assert next(x for x in starts if x["doc_id"] == 500)["doc_tokens"] < whole  # its data are replaced


def test_near_copies_from_080(spark):
    r = random.Random(2)
    docs = []
    for k in range(40):
        w = [f"n{k}x{j}" for j in range(104)]  # 100 shingles
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[: 104 - k // 2], *(f"e{k}x{r.random()}" for _ in range(k // 2))]))]
    sets = {i: shingles(t) for i, t in docs}
    share = lambda k, percent: 100 * len(sets[2 * k] & sets[2 * k + 1]) >= percent * len(sets[2 * k] | sets[2 * k + 1])
    frame = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    left = {x["doc_id"] for x in corpus_pipeline.near_duplicate(spark, frame, "").collect()}
    assert left == {i for i in sets if not (i % 2 and share(i // 2, 80))}
    for percent in (80, 85):
        kept = {x["doc_id"] for x in minhash.near_duplicates(frame, percent).where("kept").collect()}
        assert kept == {i for i in sets if not (i % 2 and share(i // 2, percent))}
    assert sum(share(k, 80) and not share(k, 85) for k in range(40)) > 3


def test_rows_without_ids(spark):
    base = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, base), (2, base + " x"), (None, base), (None, "q r s"), (None, None), (5, "other text here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, base), (None, "alpha beta. gamma"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    net = pii.Network()
    outs = [pii.find_pii(docs, net), pii.redact(docs, net), katz.katz_scores(docs), toxicity.toxicity(docs, labels), fingerprints.compared(docs), packing.pack(docs)]
    for out in outs:
        assert sorted(x["doc_id"] or 0 for x in out.collect()) == [0, 0, 0, 1, 2, 5]
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, items).collect()} == {(1, 1), (2, 1), (None, 1)}
    assert {(x["doc_id"], x["n_words"]): x["n_removed"] for x in substring_dedup.substring_dedup(docs).collect()} == {(1, 30): 0, (2, 31): 30, (None, 30): 30, (None, 3): 0, (None, 0): 0, (5, 3): 0}
    near = {(x["doc_id"], x["n_shingles"]): (x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs).collect()}
    assert near == {(1, 26): (1, True), (2, 27): (1, False), (None, 26): (1, False), (None, 1): (None, True), (None, 0): (None, True), (5, 1): (5, True)}
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200), (None, "http://b", "x" * 200), (None, None, None)], "page_id long, url string, html string")
    records = warc.with_payloads(warc.deduplicated(pages)).collect()
    assert {(x["page_id"], x["record_type"], x["refers_to"], x["html"]) for x in records} == {(1, "response", None, "x" * 200), (None, "revisit", 1, "x" * 200), (None, "response", None, "")}
