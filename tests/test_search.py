import math

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.functions import quality
from docengine.functions import text as T
from docengine.operators import bm25, hybrid, lookups, xref
from docengine.plans import catalog
from docengine.schemas import RESULT


def chunks(spark, rows):
    """rows of (entity_id, component, title, content)."""
    data = [(*r, "s.rst", k, k, False) for k, r in enumerate(rows)]
    out = spark.createDataFrame(data, "entity_id string, component string, title string, content string, source_file string, file_ord long, chunk_ord int, deprecated boolean")
    return out.withColumn("warnings", F.array().cast("array<string>"))


def okapi(rows, query):
    out = {}
    for component in {r[1] for r in rows}:
        docs = {r[0]: T.query_tokens(f"{r[2]} {r[3]}") for r in rows if r[1] == component}
        n, mean = len(docs), sum(map(len, docs.values())) / len(docs) or 1
        df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
        raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0
        idf = {t: floor if x < 0 else x for t, x in raw.items()}
        for i, d in docs.items():
            out[i] = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in T.query_tokens(query))
    return {k: v for k, v in out.items() if v > 1e-12}


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("disk pool snap mirror the is quota node".split()), min_size=1, max_size=8), min_size=2, max_size=7))
def test_bm25_against_plain_python(spark, texts):
    rows = [(f"c{k}", "xy"[k % 2], w[0], " ".join(w)) for k, w in enumerate(texts)]
    want = okapi(rows, "disk pool disk quota")
    df = chunks(spark, rows)
    got = {r["entity_id"]: r["score"] for r in bm25.scores(df, "disk pool disk quota").collect()}
    assert got == pytest.approx(want)
    found = {r["entity_id"]: r["score"] for r in bm25.search_index(bm25.build_index(df), "disk pool disk quota", None, 50).collect()}
    top = max(want.values(), default=1)
    assert found == pytest.approx({k: v / top for k, v in want.items()})


def test_empty_query_and_unknown_component(spark):
    df = chunks(spark, [("a", "x", "Disk", "disk"), ("b", "y", "Pool", "pool of all"), ("c", "x", "Other", "words here"), ("d", "x", "Third", "more words")])  # df = N / 2 would give idf 0
    assert bm25.search(df, "the of").count() == 0
    assert bm25.search(df, "disk", "nowhere").first()["entity_id"] == "a"


def test_quality_orders(spark):
    rows = [("code", "x", "T", "Run this command now\n```\nrados pool list\n```\n"), ("plain", "x", "T", "Run it now"), ("toc", "x", "T", "toctree of many")]
    q = {r["entity_id"]: r["quality_score"] for r in quality.scored(chunks(spark, rows)).collect()}
    assert q["code"] > q["plain"] > q["toc"] and all(0 <= v <= 1 for v in q.values())


def test_commands_and_lookups(spark):
    rows = [("a", "x", "T", "$ rados pool list\n"), ("b", "x", "T", "a rados pool\nrbd snap create"), ("c", "x", "T", "`rados status`")]
    x = xref.build(chunks(spark, rows)).persist()
    got = {(r["command"], r["chunk_id"]) for r in x.collect()}
    assert got == {("rados pool", "a"), ("rados pool list", "a"), ("rados pool", "b"), ("rados pool rbd", "b"), ("rados pool rbd snap", "b"), ("rados pool rbd snap create", "b")}
    assert [r["chunk_id"] for r in xref.find(x, "rados pool")[1].collect()] == ["a", "b"]
    keys, refs = xref.find(x, "rados pool li")
    assert keys == ["rados pool", "rados pool list"] and [r["chunk_id"] for r in refs.collect()] == ["a", "b"]
    assert {r["chunk_id"] for r in xref.lookup(x, "  RADOS   pool ").collect()} == {"a", "b"}


@pytest.fixture(scope="module")
def with_exact_command(spark, tmp_path_factory):
    """A table in which the prefix asked for is a command itself, beside longer and shorter ones, in more than 20 documents."""
    texts = ["Title\nwith the an", "with the", "with the an heat of it", "none here", "with the andes\nwith the an", "that the an", "Title\nwith the an\nwith the a", "with them all"] * 5
    d = tmp_path_factory.mktemp("lookup")
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return str(d)


def by_sql(d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    return con.execute(catalog.oracle_sql()[name]).fetchall()


def test_prefix_lookup_where_the_prefix_is_a_command(spark, with_exact_command):
    d = with_exact_command
    assert xref.find(xref.build(catalog.chunks(spark, d), catalog.VOCABULARY), catalog.PREFIX)[0] is None  # the exact tier alone would answer
    want = by_sql(d, "command_lookup_prefix")
    assert len(want) == 20 and [tuple(r) for r in catalog.command_lookup_prefix(spark, d).collect()] == want


def test_uncapped_lookup_where_the_prefix_is_a_command(spark, with_exact_command):
    want = by_sql(with_exact_command, "command_lookup_uncapped")
    assert len(want) == 25 and sorted(map(tuple, catalog.command_lookup_uncapped(spark, with_exact_command).collect())) == sorted(want)


def test_gate_and_clamp():
    assert [hybrid.semantic_limit(n, 10) for n in (0, 3, 5)] == [10, 7, 0]
    assert hybrid.semantic_limit(1, 1) == 0 and hybrid.semantic_limit(0, 1) == 1
    assert [hybrid.clamp(x) for x in (0, 7, 99)] == [1, 7, 50]


def test_merge_rules(spark):
    kind = "entity_id string, component string, chunk_ord int, score double"
    one = spark.createDataFrame([("s", "x", 0, 0.3)], kind)
    assert [(r["search_source"], r["score"]) for r in hybrid.merge(spark.createDataFrame([], kind), one, 5).collect()] == [("semantic", 1.0)]


def test_versions():
    assert lookups.resolve_version(["doc-9.2.0", "doc-20.2", "doc-20.2.1"]) == "doc-20.2.1"
    assert lookups.resolve_version(["doc-9.2.0"], "9.2.0") == "doc-9.2.0"
    with pytest.raises(FileNotFoundError):
        lookups.resolve_version(["doc-9"], "8")
    assert len(RESULT) == 13
