import json
import shutil

import pytest

from docengine.engine import Engine
from docengine.operators import hybrid, incremental
from docengine.sources import store
from docengine.streaming import follow

A = "Disks\n=====\n\nA disk holds objects of any size.\n\n.. code-block:: bash\n\n   rados disk add mine 3\n"
B = "Nodes\n=====\n\nA node runs many services.\n\nLimits\n------\n\nEach node has a quota.\n"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    for name, text in (("store/guide/disks.rst", A), ("store/more.rst", "More\n====\n\nOf it all.\n"), ("net/nodes.rst", B), ("readme.rst", "Hello there.\n")):
        f = base / "docs" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    root = store.build(spark, str(base / "docs"), str(base / "index"), "1.2.0")
    return base, root


def test_operations(spark, index):
    base, root = index
    e = Engine(spark, str(base / "index"))
    assert e.root == root
    hits = e.search_docs("disk objects")
    assert hits[0]["source_file"] == "store/guide/disks.rst" and len(hits[0]) == 13
    assert e.search_docs("disk", "net")  # falls back to all components
    assert e.search_examples("disk add", language="bash")[0]["code"] == "rados disk add mine 3"
    page = e.get_doc_page("net/nodes.rst")
    assert page["section_count"] == 2 and [s["section_path"] for s in page["sections"]] == ["Nodes", "Nodes > Limits"]
    assert e.get_doc_chunk(page["sections"][0]["entity_id"])["title"] == "Nodes"
    assert e.find_docs_for_command("rados disk")["references"][0]["source"] == "store/guide/disks.rst"
    assert {c["name"] for c in e.list_components()} == {"net", "store", "unknown"}
    assert e.list_topics("store") == {"component": "store", "topics": ["general", "guide"]}
    assert "available" in e.list_topics("nope")
    assert e.health()["total_chunks"] == 5 and e.capabilities()["version"] == "1.2.0"
    assert "error" in json.loads(e.call("nothing")) and "error" in json.loads(e.call("search_docs"))
    assert json.loads(e.call("search_docs", {"query": "node quota", "limit": 1}))[0]["component"] == "net"


def test_settings_and_missing_vectors(spark, index, tmp_path):
    _, root = index
    copy = f"{tmp_path}/tables"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("embeddings"))
    e = Engine(spark, copy, settings=hybrid.Settings(quality_weight=0.0, default_limit=2, max_limit=3))
    assert e.vectors is None and Engine(spark, root).vectors is not None
    assert all(r["search_source"] == "bm25" for r in e.search_docs("disk objects"))  # the second tier gives nothing
    assert e._limit(None) == 2 and e._limit(50) == 3 and e._limit(0) == 1
    assert hybrid.semantic_limit(2, 10, 0.2) == 0 and hybrid.semantic_limit(2, 10) == 8
    scored = spark.createDataFrame([(0.5, 1.0)], "score double, quality_score double")
    assert hybrid.rerank(scored, 0.0).first()["score"] == 0.5 and hybrid.rerank(scored).first()["score"] == 0.65


def test_update_and_stream(spark, index):
    base, root = index
    assert incremental.update(spark, str(base / "docs"), root, "1.2.1") == []
    (base / "docs/net/nodes.rst").write_text(B + "\nNew\n---\n\nA fresh part.\n")
    (base / "docs/readme.rst").unlink()
    query = follow.follow(spark, str(base / "docs"), root, "1.2.1", str(base / "checkpoint"), once=True)
    query.awaitTermination()
    chunks = store.load(spark, root, ("chunks",))["chunks"]
    assert {r["section_path"] for r in chunks.where("component = 'net'").collect()} == {"Nodes", "Nodes > Limits", "Nodes > New"}
    assert chunks.where("component = 'unknown'").count() == 0 and chunks.where("component = 'store'").count() == 2
    assert Engine(spark, root).health()["total_chunks"] == 5
