from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodework.operators import guards
from lodework.plans.engine import Engine, hybrid
from lodework.sources import files
from lodework.sources.store import Store
from lodework.streaming import streams

DOCS = [
    ("d1", "# Inception\n\nInception is a 2010 film about dreams and shared sleep. Christopher Nolan directed Inception for Warner Bros. Pictures in that year."),
    ("d2", "# Dunkirk\n\nDunkirk is a 2017 film about an evacuation by sea. Christopher Nolan directed Dunkirk with a large ensemble of young actors."),
    ("d3", "   "),
]


def test_ingest_search_and_repeat(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"), {"movies_bot": "film"})
    with pytest.raises(guards.TenantError):
        e.store.read(guards.Tenant("movies_bot"), "chunks")
    e.provision("movies_bot")
    e.provision("other_bot")
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    first = {r["table"]: r.asDict() for r in e.ingest("movies_bot", docs).collect()}
    again = {r["table"]: r.asDict() for r in e.ingest("movies_bot", docs).collect()}
    assert first == again and first["chunks"]["rows"] == 2 and first["edges"]["rows"] >= 2
    assert all(r["duplicate_keys"] == 0 and r["foreign_rows"] == 0 for r in first.values())
    assert e.store.tenants() == ["movies_bot", "other_bot"]
    q = spark.createDataFrame([(1, "Which film about an evacuation by sea was directed by Christopher Nolan?")], "query_id int, query_text string")
    out = e.search("movies_bot", q)
    best = out.hits.orderBy("rank").first()
    assert best["doc"].startswith("d2") and out.nodes.count() >= 3 and out.context.count() >= 1
    assert e.search("other_bot", q).hits.count() == 0
    with pytest.raises(guards.GuardError):
        e.search("movies_bot", spark.createDataFrame([(1, "x; DROP DATABASE y")], "query_id int, query_text string"))


def test_plan_is_carried_out(spark):
    edge = lambda a, b: ("t", a, "KNOWS", b, 0.9)
    edges = spark.createDataFrame([edge("a", "b"), edge("b", "c"), edge("c", "d"), edge("d", "e")], "tenant_id string, source_id string, edge_type string, target_id string, confidence double")
    names = {"a": "Alba Corvane", "b": "Bexley Works", "c": "Cidran Hall", "d": "Dorvane Mill", "e": "Elbrus Yard"}
    entities = spark.createDataFrame([("t", k, "Person", n, None) for k, n in names.items()], "tenant_id string, entity_id string, label string, entity_name string, aliases array<string>")
    chunks = spark.createDataFrame([("t", "c1", "Alba Corvane wrote about rivers"), ("t", "c2", "Nothing like it stands here"), ("t", "c3", "Mills are old")], "tenant_id string, chunk_id string, text string")
    mentions = spark.createDataFrame([("t", "a", "c1"), ("t", "b", "c2"), ("t", "d", "c3")], "tenant_id string, entity_id string, chunk_id string")
    asked = ["Who is connected to someone related through Alba Corvane?", "Give an overview of the main themes across the whole collection of relations", "Who is the author Alba Corvane?"]
    out = hybrid(spark.createDataFrame([(i, "t", q) for i, q in enumerate(asked)], "query_id int, tenant_id string, query_text string"), chunks, entities, edges, mentions)
    plan = {r["query_id"]: r for r in out.plan.collect()}
    assert plan[0]["graph_depth"] == 3 and plan[1]["use_community"] and plan[2]["use_expansion"]
    hops = {r["entity_id"]: r["hop"] for r in out.nodes.where("query_id = 0").collect()}
    assert hops["d"] <= 3 and {"a", "b", "c", "d"} <= set(hops)
    assert "community" in {r["path"] for r in out.hits.where("query_id = 1").collect()}
    alone = hybrid(spark.createDataFrame([(2, "t", "Who is alba corvane, \"wrote about rivers\"?"), (3, "t", "Who directed Alba Corvene Rivers?")], "query_id int, tenant_id string, query_text string"), chunks, entities.where("false"), edges, mentions)
    local = {r["query_id"] for r in alone.plan.where("use_expansion").collect()}
    paths = {(r["query_id"], r["doc"]): r["path"] for r in alone.hits.collect()}
    assert local and all(paths.get((q, "c2")) == "expansion" for q in local)


def test_store_refuses_foreign_and_double_rows(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    t = guards.Tenant("a_bot")
    s.provision(t)
    row = lambda tenant, n=1: spark.createDataFrame([(tenant, "e", "c")] * n, "tenant_id string, entity_id string, chunk_id string")
    with pytest.raises(Exception, match="another tenant"):
        s.upsert(t, "mentions", row("b_bot"))
    with pytest.raises(ValueError, match="twice"):
        s.upsert(t, "mentions", row("a_bot", 2))
    s.upsert(t, "mentions", row("a_bot"))
    s.upsert(t, "mentions", row("a_bot"))
    assert s.read(t, "mentions").count() == 1
    s.drop(t)
    assert s.tenants() == []


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿name,"note"\nAda,"two\nlines"\nBob,\n', encoding="utf-8")
    rows = files.read_any(spark, str(tmp_path / "a.csv")).orderBy("row_index").collect()
    assert [[c["cell_value"] for c in r["cells"]] for r in rows] == [["Ada", "two\nlines"], ["Bob", ""]] and rows[0]["cells"][0]["column_name"] == "name"
    (tmp_path / "b.jsonl").write_text('{"z": 1, "a": null}\n\n[1]\n{"b": "x"}\n')
    rows = files.read_any(spark, str(tmp_path / "b.jsonl")).collect()
    assert [c["column_name"] for c in rows[0]["cells"]] == ["z", "a", "b"] and len(rows) == 2
    (tmp_path / "c.json").write_text(json.dumps({"meta": 1, "rows": [{"k": "v"}, {"k": "w"}]}))
    assert files.read_any(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_any(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "d.html").write_text("<html><script>x()</script><h2>Head</h2><p>One &amp; two</p><ul><li>a</li></ul></html>")
    assert files.read_any(spark, str(tmp_path / "d.html")).first()["text"] == "## Head\n\nOne & two\n\n- a"
    (tmp_path / "e.md").write_text("# T\n\nbody text")
    assert files.read_folder(spark, str(tmp_path), "*.md").count() == 1
    with pytest.raises(files.SourceError):
        files.read_any(spark, "x.docx")
    with pytest.raises(files.SourceError):
        files.read_any(spark, "x.exe")


def test_films(spark):
    movies = spark.createDataFrame([("A", "2010-01-02", '[{"name": "War"}]', "Plot."), ("B", None, None, None)], "title string, release_date string, genres string, overview string")
    credits = spark.createDataFrame([("A", '[{"name": "X"}]', '[{"name": "Old", "job": "Director"}]', 0), ("A", '[{"name": "Y"}]', '[{"name": "D", "job": "Director"}, {"name": "E", "job": "Editor"}]', 1)], "title string, cast string, crew string, row_index int")
    out = {r["title"]: r["text"] for r in files.films(movies, credits).select("title", files.render_film().alias("text")).collect()}
    assert out["A"] == "# A (2010)\nPlot.\nDirected by D.\nStarring Y.\nGenres: War." and out["B"].startswith("# B")


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    rows = [(i, "k", f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3, 11, 12))]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    limiter = streams.Limiter(10, 2)
    batch = {r["event_id"]: r["allowed"] for r in limiter.batch(df).collect()}
    assert batch == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limiter.stream(source).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["allowed"] for r in spark.table("limits").collect()} == batch


def test_ingest_stream_runs_once_per_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = streams.ingest_stream(source, lambda df, _: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) == 5
    assert streams.latency_windows(spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 2.0D value")).first()["calls"] == 1


def test_shorter_document_leaves_nothing_behind(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"), {"movies_bot": "film"})
    e.provision("movies_bot")
    long = "# One\n\n" + DOCS[0][1][13:] + "\n\n# Two\n\nDunkirk is a 2017 film about an evacuation by sea. Christopher Nolan directed Dunkirk with young actors."
    first = {r["table"]: r["rows"] for r in e.ingest("movies_bot", spark.createDataFrame([("d", long)], "doc_id string, text string")).collect()}
    again = {r["table"]: r["rows"] for r in e.ingest("movies_bot", spark.createDataFrame([("d", DOCS[0][1])], "doc_id string, text string")).collect()}
    assert first["chunks"] == 2 and again["chunks"] == 1
    t = guards.Tenant("movies_bot")
    assert {r["chunk_id"] for r in e.store.read(t, "mentions").collect()} <= {r["chunk_id"] for r in e.store.read(t, "chunks").collect()}
    assert e.store.missing(t) == {"missing": [], "extra": []} and e.store.missing(guards.Tenant("no_bot"))["missing"] == ["chunks", "edges", "entities", "mentions"]


def test_records_tables_and_communities(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"))
    e.provision("herbs_bot")
    rows = [(i, "sheet.csv", i, [("herb", f"{'ABCDEF'[i % 6]}root Plant"), ("symptom", ["fever, cough", "gout"][i % 2]), ("local name", f"Kraut {i % 6}")]) for i in range(12)]
    records = spark.createDataFrame(rows, "record_id long, source_uri string, row_index int, cells array<struct<column_name:string,cell_value:string>>")
    got = {r["table"]: r for r in e.ingest_records("herbs_bot", records).collect()}
    assert got["chunks"]["rows"] == 12 and got["edges"]["rows"] > 0 and all(r["duplicate_keys"] == 0 for r in got.values())
    t = guards.Tenant("herbs_bot")
    assert any(r["aliases"] for r in e.store.read(t, "entities").collect())
    doc = "# Remedies\n\n| herb | symptom |\n| --- | --- |\n| Gray Moss | gout |\n| Gray Moss | fever |\n"
    e.ingest("herbs_bot", spark.createDataFrame([("page", doc)], "doc_id string, text string"))
    assert e.store.read(t, "entities").where("entity_name = 'Gray Moss'").count() == 1
    told = e.communities("herbs_bot")
    assert told.count() >= 1 and {r["kind"] for r in e.counts("herbs_bot").where("table = 'chunks'").collect()} >= {"record", "community_report"}
    q = spark.createDataFrame([(1, "Give an overview of the main themes across the whole collection of relations"), (2, "it"), (3, "Which herb helps against gout?")], "query_id int, query_text string")
    out = e.search("herbs_bot", q)
    assert "community" in {r["path"] for r in out.hits.where("query_id = 1").collect()}
    assert [(r["query_id"], r["reason"]) for r in out.questions.collect()] == [(2, "anaphora_without_antecedent")] and out.hits.where("query_id = 2").count() == 0
    assert out.hits.where("query_id = 3 and path <> 'community'").count() > 0 and e.ready() == []


def test_version_cache(spark):
    from lodework.sources.cache import VersionCache

    now, built = [0.0], []
    cache = VersionCache(lambda: now[0])
    get = lambda v: cache.get(("t", "x"), v, 10, lambda: built.append(v) or spark.range(3))
    get("a"), get("a")
    now[0] = 11.0
    get("a"), get("b")
    assert built == ["a", "a", "b"] and cache.age(("t", "x")) == 0
    cache.drop()
    assert cache.age(("t", "x")) is None


def test_json_lines_are_split(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"k": i, **({"late": "z" * 50} if i == 700 else {})}) + "\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_json(spark, str(tmp_path / "x.jsonl"), lines=True).orderBy("row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_index"] for r in rows] == list(range(1000)) and [r["cells"][0]["cell_value"] for r in rows] == [str(i) for i in range(1000)]
    assert all([c["column_name"] for c in r["cells"]] == ["k", "late"] for r in rows)
