"""Matching, versions, routing, reports, SQL text, access, and the shape of answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodework.operators import chunking, embedding, graph, guards, matching, report, routing, structured
from lodework.plans import evaluate
from lodework.sources import sql


def test_phrases_in_texts(spark):
    texts = spark.createDataFrame([(1, "The Red fox and the red hen", "x"), (2, None, "x"), (3, "", "x"), (4, "nothing", "x"), (1, "red", "x")], "doc_id int, text string, phrase string")
    want = spark.createDataFrame([("Red",), ("red fox",), ("",), (None,), ("RED",)], "phrase string")
    for k in ({}, {"pass_chars": 3}):
        assert sorted(tuple(r) for r in matching.phrases_in(texts, want, **k).collect()) == [(1, "red"), (1, "red"), (1, "red fox")]
    assert matching.phrases_in(texts, want.limit(0)).count() == 0


def test_versions_and_reembedding(spark):
    rows = spark.createDataFrame([("a", [1.0], "new"), ("b", [2.0], "old"), ("c", [3.0], None), ("d", None, " ")], "chunk_id string, vector array<float>, embedding_version string")
    state = {r["chunk_id"]: r["s"] for r in rows.select("chunk_id", embedding.version_state(F.col("embedding_version"), "new").alias("s")).collect()}
    assert state == {"a": "current", "b": "stale", "c": "unversioned", "d": "unversioned"} and embedding.compatible(rows, "new").count() == 1
    texts = spark.createDataFrame([("b", "some words"), ("b", "some words"), ("c", "other words")], "chunk_id string, text string")
    with pytest.raises(embedding.EmbeddingError):
        embedding.reembed(rows, texts, "new", None)
    out = {r["chunk_id"]: r for r in embedding.reembed(rows, texts, "new", lambda t: t.select("doc", F.array(F.lit(9.0).cast("float")).alias("vector"))).collect()}
    assert [out[k]["vector"] for k in "abcd"] == [[1.0], [9.0], [9.0], None] and out["d"]["embedding_version"] == " " and out["b"]["embedding_version"] == "new"
    assert embedding.mode(None) == "lexical-hash"
    v = embedding.hashed_vectors(spark.createDataFrame([("t", 1, "red fox"), ("t", 2, None)], "tenant_id string, doc int, text string")).collect()
    assert len(v) == 1 and len(v[0]["vector"]) == 384 and abs(sum(x * x for x in v[0]["vector"]) - 1) < 1e-6


def test_routing(spark):
    schema = "tenant_id string, source_uri string, block_no int, kind string, table_headers array<string>, table_rows array<array<string>>"
    b = spark.createDataFrame([("t", "u", 1, "table", ["a", "b"], [["1", "2", "3"], ["4"], None, [None, "5"]]), ("t", "u", 2, "table", None, [["x"]]), ("t", "u", 3, "prose", ["a"], [["x"]]), ("t", "u", 4, "table", ["a"], None)], schema)
    got = sorted((r["row_index"], [tuple(c) for c in r["cells"]]) for r in routing.table_records(b).collect())
    assert got == [(0, [("a", "1"), ("b", "2")]), (1, [("a", "4")]), (3, [("b", "5")])]
    assert routing.table_records(b, 1).count() == 1
    kinds = spark.createDataFrame([("record",), ("table",), ("heading",), ("list",), (None,)], "kind string")
    assert [r["m"] for r in kinds.select(routing.method(F.col("kind")).alias("m")).collect()] == ["record", "table", None, "prose", "prose"]
    assert routing.backend() == "regex" == routing.backend("nobody")
    routing.register_backend("mine", "json", lambda df: df)
    assert routing.backend("mine") == "mine"


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, 1), ("a", None, 2)], "name string, x double, n int")
    lines = [r["line"] for r in report.markdown(df, [F.col("name")], "T", 2).orderBy("line_no").collect()]
    assert lines == ["# T", "", "| name | x | n |", "|---|---|---|", "| a |  | 2 |", "| b | 0.50 | 1 |"]
    report.write(report.markdown(df, [F.col("name")], "T"), str(tmp_path / "r"), df)
    assert spark.read.text(str(tmp_path / "r" / "markdown")).count() == 6 and spark.read.json(str(tmp_path / "r" / "json")).count() == 2


def test_sql_text(spark):
    t = spark.createDataFrame([(i, "drop; it") for i in range(5)], "i int, s string")
    assert [r["i"] for r in sql.run(spark, "SELECT i FROM {t} WHERE i >= :lo", {"t": t}, {"lo": 2}, row_cap=2).collect()] == [2, 3]
    assert sql.run(spark, "select i from {t} where s = 'drop; it'", {"t": t}).count() == 5
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", ""):
        with pytest.raises(sql.QueryError):
            sql.run(spark, bad, {})


def test_access_and_bounds(spark):
    keys = spark.createDataFrame([("k", "a_bot", ["read"]), ("w", "a_bot", ["read", "write"]), ("r", "root_bot", ["admin"]), ("n", "new_bot", ["read"])], "api_key string, tenant_id string, scopes array<string>")
    there = spark.createDataFrame([("a_bot",), ("b_bot",), ("root_bot",)], "tenant_id string")
    rows = [(1, "k", None, "read"), (2, "k", None, "write"), (3, "k", "b_bot", "read"), (4, "w", " A_BOT ", "write"), (5, "r", "b_bot", "write"), (6, "zzz", None, "read"), (7, "n", None, "read"), (8, None, None, None)]
    req = spark.createDataFrame(rows, "request_id int, api_key string, claimed string, scope string")
    got = {r["request_id"]: (r["status"], r["tenant_id"]) for r in guards.access(keys, req, there).collect()}
    assert got == {1: (200, "a_bot"), 2: (403, None), 3: (403, None), 4: (200, "a_bot"), 5: (200, "b_bot"), 6: (401, None), 7: (404, None), 8: (401, None)}
    assert guards.allowed_types(["cites", "BAD"], ["CITES", "X"], ["X"]) == ["CITES"] and guards.allowed_types(["BAD"], ["CITES"], ["X"]) == ["X"] == guards.allowed_types(None, [], ["X"])
    assert guards.in_bounds("top_k", 20) == 20
    for name, v in (("top_k", 21), ("depth", 0), ("query", 1), ("content", 9)):
        with pytest.raises(guards.GuardError):
            guards.in_bounds(name, v)


def test_shape_and_preflight(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, doc string, rank int")
    nodes = spark.createDataFrame([(1, "t", "x", 0), (1, "t", "y", 1)], "query_id int, tenant_id string, entity_id string, hop int")
    want = spark.createDataFrame([(1, True), (2, False)], "query_id int, include_subgraph boolean")
    assert sorted(tuple(r) for r in evaluate.shape(hits, nodes, want, 1).collect()) == [(1, 1, "a", 2), (2, 1, "c", None)]
    with pytest.raises(guards.GuardError):
        evaluate.shape(hits, nodes, want, 0)
    empty = spark.createDataFrame([(" ",), (None,)], "text string")
    with pytest.raises(evaluate.CorpusError):
        evaluate.preflight(empty, want)
    evaluate.preflight(spark.createDataFrame([("x",)], "text string"), want)


def test_widen_and_merge(spark):
    found = spark.createDataFrame([(1, "t", "a")], "query_id int, tenant_id string, entity_id string")
    wanted = spark.createDataFrame([(1, "t", 1), (2, "t", 2)], "query_id int, tenant_id string, n int")
    pool = spark.createDataFrame([("t", x) for x in "abc"] + [("u", "z")], "tenant_id string, entity_id string")
    assert sorted(tuple(r) for r in graph.widen(found, wanted, pool, 2).collect()) == [(1, "t", "a", False), (2, "t", "a", True), (2, "t", "b", True)]
    n = spark.createDataFrame([(1, "t", "a", 0), (1, "t", "b", 1)], "query_id int, tenant_id string, entity_id string, hop int")
    merged = graph.merge_nodes(n, n.selectExpr("query_id", "tenant_id", "case when entity_id = 'b' then 'c' else entity_id end as entity_id", "9 as hop"), 2)
    assert sorted((r["entity_id"], r["hop"]) for r in merged.collect()) == [("a", 0), ("b", 1)]
    e = spark.createDataFrame([(1, "t", "a", "X", "b"), (1, "t", "a", "X", "c")], "query_id int, tenant_id string, source_id string, edge_type string, target_id string")
    assert [r["target_id"] for r in graph.merge_edges(e, e, merged).collect()] == ["b"]


def test_aliases(spark):
    schema = "record_id long, tenant_id string, source_uri string, cells array<struct<column_name:string,cell_value:string>>"
    r = spark.createDataFrame([(i, "t", "f", [("herb", f"Plant {'ABCDEFGHIJ'[i]}"), ("local name", f"Kraut {i}, Pflanze {i}" if i % 2 else None)]) for i in range(10)], schema)
    got = {(x["entity_id"], x["alias"]) for x in structured.aliases(r, structured.profile_columns(r)).collect()}
    assert ("canon_entity_plant_b", "Kraut 1") in got and ("canon_entity_plant_b", "Pflanze 1") in got and len(got) == 10


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "lead\n\n# A\none\n\n \ntwo\n## B\n"), (2, "  "), (3, None)], "doc_id int, text string")
    assert [(r["pos"], r["section"], r["body"]) for r in chunking.paragraphs(df).orderBy("pos").collect()] == [(0, None, "lead"), (1, "A", "one"), (2, "A", "two")]


def test_json_in_words(spark):
    from lodework.functions import text as tx
    from lodework.operators import proposals

    df = spark.createDataFrame([(1, 'Sure!\\n```json\\n{"a": 1}\\n```'), (2, "none"), (3, None), (4, "{broken")], "i int, t string")
    assert {r["i"]: r["x"] and r["x"]["a"] for r in df.select("i", tx.tolerant_json(F.col("t"), "a int").alias("x")).collect()} == {1: 1, 2: None, 3: None, 4: None}
    chunks = spark.createDataFrame([("c", "Ada wrote")], "chunk_id string, text string")
    answer = 'Here: {"entities": [{"name": "Ada", "label": "Person", "confidence": 0.9}], "relations": []} done'
    e, r = proposals.propose(chunks, lambda df: df.select("chunk_id", F.lit(answer).alias("answer")))
    assert [tuple(x) for x in e.collect()] == [("c", "Ada", "Person", 0.9)] and r.count() == 0
    assert proposals.propose(chunks, None)[0].count() == 0
    cut = spark.createDataFrame([("aaa bbb ccc",), ("aaaaaaaaaaaa",), ("short",), (None,)], "t string").select(tx.truncate(F.col("t"), 9).alias("x"))
    assert [x["x"] for x in cut.collect()] == ["aaa bbb", "aaaaaaaaa", "short", None]
    assert [graph.clamp_limit(x) for x in (0, 50, 1000)] == [1, 50, 100]


def test_table_functions(spark):
    from lodework.functions import registry

    assert {"lode_names", "lode_blocks", "lode_cosine"} <= set(registry.register(spark))
    assert [(r["kind"], r["body"]) for r in spark.sql("SELECT * FROM lode_blocks('# A\\n\\ntext')").collect()] == [("heading", "A"), ("prose", "text")]
    assert spark.sql("SELECT name, label FROM lode_names('Who knows? Ada Lovelace directed it.', 'film')").first()["name"] == "Ada Lovelace"
