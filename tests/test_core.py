from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodework.functions import registry
from lodework.functions import text as tx
from lodework.functions.similarity import Likeness, hashed_cosine_of, jaro_winkler_of
from lodework.operators import chunking, community, context, extract, graph, guards, metrics, resolve, retrieval, structured, understand
from lodework.operators.skew import join_stats


def one(spark, expr, **values):
    return spark.range(1).select(expr(*[F.lit(v) for v in values.values()]).alias("x")).first()["x"]


def test_names_and_tokens(spark):
    assert one(spark, tx.normalize_name, a="  Warner Bros. ") == "warner_bros"
    assert one(spark, tx.normalize_name, a="GPT-4!") == one(spark, tx.normalize_name, a="GPT 4")
    assert one(spark, tx.slug, a=" A b/c ") == "a_b_c"
    assert one(spark, tx.slug, a="...") == "untitled"
    assert one(spark, tx.terms, a="The GPT-4 is a model of the_year") == ["gpt-4", "model", "the_year"]
    assert one(spark, tx.token_count, a="") == 0 and one(spark, tx.token_count, a="naïve café.") == 3
    assert one(spark, lambda c: tx.tail_words(c, 4), a="a b c d e") == "c d e"
    assert one(spark, tx.split_values, a="A, B and C; none") == ["A", "B", "C"]


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    out = row.select(tx.cosine("a", "b").alias("ab"), tx.cosine("a", "z").alias("az"), tx.cosine("a", "s").alias("as_")).first()
    assert round(out["ab"], 4) == 0.7071 and out["az"] == 0 and out["as_"] == 0


def test_jaro_winkler():
    assert round(jaro_winkler_of("inception", "incepton"), 4) == 0.9778
    assert round(jaro_winkler_of("openai", "open_ai_inc"), 4) == 0.9091
    assert jaro_winkler_of("a", "") == 0 and jaro_winkler_of("same", "same") == 1


def test_sql_functions(spark):
    registry.register(spark)
    assert round(spark.sql("SELECT lode_jaro_winkler('inception', 'incepton') x").first()["x"], 4) == 0.9778
    assert [r["term"] for r in spark.sql("SELECT * FROM lode_terms('the big GPT-4')").collect()] == ["big", "gpt-4"]
    rows = spark.sql("SELECT t.id, s.sentence FROM VALUES (1, 'One. Two.') t(id, text), LATERAL lode_sentences(t.text) s").collect()
    assert [r["sentence"] for r in rows] == ["One.", "Two."]


def test_join_stats_keeps_every_row(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), "id").unionByName(spark.range(3000).select((F.col("id") + 10).alias("k"), "id"))
    stats = rows.groupBy("k").count()
    assert join_stats(rows, stats, ["k"], "count", 8000).count() == 8000


def test_bm25_ranks_and_repeats(spark):
    docs = spark.createDataFrame([("t", 1, "zebra stripes zebra"), ("t", 2, "zebra"), ("t", 3, "lion"), ("t", 4, " "), ("u", 5, "zebra"), ("t", 1, "zebra stripes zebra")], "tenant_id string, chunk_no long, text string")
    index = retrieval.build_index(docs)
    q = spark.createDataFrame([(1, "t", "zebra zebra stripes")], "query_id long, tenant_id string, query_text string")
    out = retrieval.top(retrieval.bm25(index, retrieval.query_terms(q)), 5).orderBy("rank").collect()
    assert [r["doc"] for r in out] == [1, 2] and out[0]["relative"] == 1.0
    assert retrieval.index_stats(index).where("tenant_id = 't'").first()["n_docs"] == 3
    assert retrieval.bm25(retrieval.build_index(docs.limit(0)), retrieval.query_terms(q)).count() == 0


def test_fusion(spark):
    lists = spark.createDataFrame([(1, d, p, r) for p, ds in (("vector", "abc"), ("graph", "cad")) for r, d in enumerate(ds, 1)], "query_id int, doc string, path string, rank int")
    out = retrieval.fuse(lists).orderBy("rank").collect()
    assert {out[0]["doc"], out[1]["doc"]} == {"a", "c"} and out[0]["path"] == "fused"
    assert [r["score"] for r in out] == sorted((r["score"] for r in out), reverse=True)
    assert retrieval.fuse(lists, weights={"graph": 9.0}).orderBy("rank").first()["doc"] == "c"
    seen = retrieval.first_seen(lists.withColumn("list_no", F.when(F.col("path") == "vector", 1).otherwise(2))).orderBy("rank").collect()
    assert [r["doc"] for r in seen] == ["a", "b", "c", "d"]


def test_rerank(spark):
    q = spark.createDataFrame([(1, "t", "red fox")], "query_id int, tenant_id string, query_text string")
    texts = spark.createDataFrame([("a", "nothing here"), ("b", "the red fox ran")], "doc string, text string")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc string, rank int")
    assert retrieval.rerank(ranked, q, texts, 1).first()["doc"] == "b"
    assert retrieval.rerank(ranked.limit(0), q, texts, 1).count() == 0


def test_exact_search_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, "a" if i % 3 else None, v.tolist()) for i, v in enumerate(x)] + [(60, "a", [0.0] * 8), (61, "a", None), (62, "a", [1.0])], "doc long, g string, vector array<double>")
    out = retrieval.exact_search(df.where("doc % 5 = 0").withColumnRenamed("doc", "query_id"), df, 3, "g", block=7)
    got = {(r["query_id"], r["rank"]): r["doc"] for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 60, 5):
        s = {i: u[q] @ u[i] for i in range(60) if i != q and bool(i % 3) == bool(q % 3)}
        best = [i for i in sorted(s, key=lambda i: -round(s[i], 6)) if s[i] > 0][:3]
        assert [got.get((q, k)) for k in range(1, len(best) + 1)] == best


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, source_id string, edge_type string, target_id string, confidence double")


def test_edge_gate_first_reason_wins(spark):
    v = spark.createDataFrame([("t", "a"), ("t", "b")], "tenant_id string, entity_id string")
    e = edges_of(spark, [("t", "a", "BAD", "zz", 0.1), ("t", "a", "cites", "b", 0.1), ("t", "a", "CITES", "zz", None), ("t", "a", "CITES", "a", 1.0), ("t", "a", "CITES", "b", 0.9)])
    assert sorted(str(r["reason"]) for r in graph.edge_gate(e, v, ["CITES"]).collect()) == ["None", "dangling", "low_confidence", "not_in_schema", "self_loop"]


def test_dedupe_upsert(spark):
    e = edges_of(spark, [("t", "a", "x", "b", 0.85), ("t", "a", "X", "b", 0.95), ("t", "a", "X", "a", 1.0)])
    r = graph.dedupe_edges(e).collect()
    assert len(r) == 1 and r[0]["confidence"] == 0.95 and r[0]["support_count"] == 2
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), (None, 2), ("c", 2)], "k string, v int")
    assert sorted((str(r["k"]), r["v"]) for r in graph.upsert(old, new, ["k"]).collect()) == [("None", 2), ("a", 1), ("b", 2), ("c", 2)]


def test_traversal_bounds_and_hubs(spark):
    e = edges_of(spark, [("t", "a", "X", "b", 1.0), ("t", "c", "X", "b", 1.0), ("t", "c", "X", "d", 1.0), ("t", "d", "X", "e", 1.0), ("t", "a", "HAS_ATTRIBUTE", "hub", 1.0), ("u", "a", "X", "other", 1.0), ("t", "a", "X", "a", 1.0)])
    s = spark.createDataFrame([(1, "t", "a")], "query_id int, tenant_id string, entity_id string")
    got = lambda d, **k: {r["entity_id"]: r["hop"] for r in graph.traverse(e, s, d, **k).collect()}
    assert got(1) == {"a": 0, "b": 1, "hub": 1} and got(-5) == got(1)
    assert got(9) == got(3) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert got(2, types=[]) == {"a": 0} and len(got(3, limit=2)) == 2
    assert [graph.clamp_depth(x) for x in (1, 2, 3, 9, 0, -5)] == [1, 2, 3, 3, 1, 1]


def test_prune_keeps_seed_and_hub(spark):
    nodes = spark.createDataFrame([(1, f"n{i}", i == 9) for i in range(10)], "query_id int, entity_id string, is_seed boolean")
    edges = spark.createDataFrame([(1, "n0", "X", f"n{i}") for i in range(1, 6)], "query_id int, source_id string, edge_type string, target_id string")
    kept, left = graph.prune(nodes, edges, 4)
    ids = {r["entity_id"] for r in kept.collect()}
    assert {"n9", "n0"} <= ids and len(ids) == 4
    assert all({r["source_id"], r["target_id"]} <= ids for r in left.collect())


def test_markdown_blocks():
    text = "# A\n\nintro\n\n## B\n- x\n- y\n\n| h1 | h2 |\n| --- | :-: |\n| 1 | 2 |\n\n# C\nend"
    blocks = chunking.markdown_blocks_of(text)
    assert [b[0] for b in blocks] == ["heading", "prose", "heading", "list", "table", "heading", "prose"]
    assert blocks[3][3] == ["A", "B"] and blocks[4][4] == ["h1", "h2"] and blocks[4][5] == [["1", "2"]] and blocks[6][3] == ["C"]


def packed(spark, texts, **k):
    rows = [("t", "d", i, kind, t, path, None, None) for i, (kind, t, path) in enumerate(texts)]
    df = spark.createDataFrame(rows, "tenant_id string, doc_key string, block_pos int, kind string, text string, section_path array<string>, table_headers array<string>, table_rows array<array<string>>")
    return chunking.chunk_blocks(df, **k).orderBy("chunk_index").collect()


def test_packing_and_overlap(spark):
    sentences = " ".join(f"Sentence number {i} is here." for i in range(40))
    out = packed(spark, [("prose", sentences, ["A"])], target=30, most=40, overlap=15)
    assert len(out) > 2 and [r["chunk_index"] for r in out] == list(range(len(out)))
    assert not out[0]["has_overlap"] and any(r["has_overlap"] for r in out[1:])
    assert not any(r["has_overlap"] for r in packed(spark, [("prose", sentences, ["A"])], target=30, most=40, overlap=0))
    assert packed(spark, [("prose", " ", None), ("prose", "", None)]) == []
    two = packed(spark, [("prose", "one here", ["A"]), ("heading", "B", ["B"]), ("prose", "two here", ["B"]), ("record", "a: 1", None)])
    assert [r["kind"] for r in two] == ["prose", "prose", "record"] and not two[1]["has_overlap"]


def test_links_and_validation(spark):
    df = spark.createDataFrame([("t", "d", i, "prose", t) for i, t in enumerate(["short", "this text has quite enough words to be kept as it is", "1234567890 123 456 789 123 456 789 0", ""])], "tenant_id string, doc string, chunk_index int, kind string, text string")
    v = chunking.validate(df.withColumn("token_count", tx.token_count(F.col("text")))).orderBy("chunk_index").collect()
    assert [[i["code"] for i in r["issues"]] for r in v] == [["too_short"], [], ["low_alpha"], ["empty"]]
    links = chunking.linked(df).orderBy("chunk_index").collect()
    assert links[0]["prev_chunk_id"] is None and links[-1]["next_chunk_id"] is None and links[1]["prev_chunk_id"] == links[0]["chunk_id"]


def extract_one(spark, text, domain):
    rows = extract.extract(spark.createDataFrame([("t", "c", text), ("t", "n", None)], "tenant_id string, chunk_id string, text string"), {"t": domain}).collect()
    return [r for r in rows if r["row"] == "vertex"], [r for r in rows if r["row"] == "edge"]


def test_extraction(spark):
    text = "Christopher Nolan directed Inception in 2010. Inception is a film. However, January was cold."
    vertices, edges = extract_one(spark, text, "film")
    names = {v["name"]: v["label"] for v in vertices}
    assert names["Christopher Nolan"] == "Person" and names["Inception"] == "Film" and not {"However", "January"} & set(names)
    triples = lambda es: [(e["entity_id"], e["edge_type"], e["target_id"]) for e in es]
    assert triples(edges) == [("canon_person_christopher_nolan", "DIRECTED", "canon_film_inception")]
    assert all(e["confidence"] >= 0.8 for e in edges) and extract_one(spark, "", "generic") == ([], [])
    passive = extract_one(spark, "The film Inception was directed by Christopher Nolan.", "film")[1]
    assert triples(passive) == [("canon_person_christopher_nolan", "DIRECTED", "canon_film_inception")]


def test_coordinated_relations(spark):
    edges = extract_one(spark, "Acme Cure treats Gout Fever, Swamp Pox, Dry Rot, Cold Feet. In time Acme Cure treats Gout Fever. Old Salve helps Bad Luck.", "generic")[1]
    got = {(e["entity_id"].split("_", 2)[2], e["target_id"].split("_", 2)[2]): e["confidence"] for e in edges if e["edge_type"] == "AFFECTS"}
    assert got == {("acme_cure", "gout_fever"): 0.86, ("acme_cure", "swamp_pox"): 0.83, ("acme_cure", "dry_rot"): 0.8}


def test_opening_subject():
    text = "Quorvex, first shown in May, is a film of 1999. Years later people still spoke about Quorvex at length."
    late = [m for m in extract.mentions_of(text, "film") if m.name == "Quorvex"]
    assert {(m.label, m.confidence) for m in late} == {("Film", 0.82)}


def test_resolution(spark):
    rows = [(1, "t", "Film", "Inception"), (2, "t", "Film", "inception"), (3, "t", "Film", "Incepton"), (4, "t", "Person", "Inception"), (5, "t", "Film", "Dunkirk"), (6, "t", "Film", None), (7, "u", "Film", "Inception")]
    e = spark.createDataFrame(rows, "vertex_id long, tenant_id string, label string, entity_name string")
    out = {r["vertex_id"]: (r["canonical_id"], r["method"]) for r in resolve.greedy_merge(e).collect()}
    assert out == {1: (1, "new"), 2: (1, "exact"), 3: (1, "string_match"), 4: (4, "new"), 5: (5, "new"), 7: (7, "new")}
    pairs = {(r["a"], r["b"]) for r in resolve.matches(resolve.candidates(resolve.names_of(e))).collect()}
    assert pairs == {(1, 3)}


def greedy_by_hand(rows):
    """The merge row by row: what the set-based one has to equal."""
    from lodework.functions.similarity import hashed_cosine_of

    canon, out = {}, {}
    for vid, tenant, label, norm in sorted(rows):
        best = None
        keys = lambda n: {n[:3], *(t for t in n.split("_") if len(t) >= 4)}
        for (t, k, other), cid in canon.items():
            if (t, k) != (tenant, label) or not keys(norm) & keys(other):
                continue
            if other == norm:
                best = (cid, 1.0, "exact")
                break
            x = jaro_winkler_of(norm, other)
            if x >= 0.85:
                found = (cid, x, "string_match")
            elif x >= 0.60 and hashed_cosine_of(norm, other) >= 0.80:
                found = (cid, round(0.6 * hashed_cosine_of(norm, other) + 0.4 * x, 4), "vector_assisted")
            else:
                continue
            if best is None or found[1] > best[1]:
                best = found
        if best is None:
            canon[(tenant, label, norm)] = vid
            best = (vid, 1.0, "new")
        out[vid] = (best[0], round(best[1], 4), best[2])
    return out


def test_links_by_blocks(spark):
    """Names of one busy key, dealt out over many blocks: the links of every pair, each once, whatever the parts."""
    words = ["bo", "ravel", "ravle", "the", "motion", "pictures", "Ünal", "limited", "日本", "x" * 70]
    norms = sorted({"_".join(sorted({words[i % 10].lower(), words[i // 10 % 10].lower(), "studio", words[i * 7 % 10].lower()}, key=lambda w: (len(w) * (i + 1) % 7, w))) for i in range(90)})
    names = spark.createDataFrame([("t", "Studio", n, 1000 - i, 1) for i, n in enumerate(norms)] + [(None, "Studio", "ravel_studio", 2000, 1), ("u", None, "ravel_studio", 2001, 1)], "tenant_id string, label string, norm string, id long, n long")
    want = set()
    ids = sorted((1000 - i, n) for i, n in enumerate(norms))
    for a, x in ids:
        for b, y in ids:
            if a < b:
                jw, c = round(jaro_winkler_of(x, y), 9), hashed_cosine_of(x, y)
                if jw >= 0.85:
                    want.add((a, b, jw, "string_match"))
                elif jw >= 0.6 and c >= 0.8:
                    want.add((a, b, round(0.6 * c + 0.4 * jw, 4), "vector_assisted"))
    assert {m for *_, m in want} == {"string_match", "vector_assisted"}
    for part in (3, 17, 1024):
        got = [tuple(r) for r in resolve.links(names, part).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_likeness_of_many_pairs_at_once():
    names = ["a", "ab", "ba", "dixon", "dicksonx", "martha", "marhta", "aaaaaaaaaa", "aabbaabbaa", "日本語", "日語本", "the_ab" * 11, "the_ba" * 11, "dwayne_pictures", "duane_pictures"] + [chr(0x4E00 + i) * 2 for i in range(130)]
    many = Likeness(names)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(names)), np.arange(len(names))))
    want = np.array([jaro_winkler_of(names[i], names[j]) for i, j in zip(a, b, strict=True)])
    assert (many.jaro_winkler(a, b, 0.0) == want).all()
    assert (many.may_reach(a, b) >= want - 1e-9).all()
    assert (many.jaro_winkler(a, b, 0.85)[want >= 0.85] == want[want >= 0.85]).all()


def test_greedy_merge_against_rows_in_order(spark, sf):
    e = spark.createDataFrame([(1, "t", "Person", "Christopher Nolan"), (2, "t", "Person", "Kristopher Nolan"), (3, "t", "Person", "Catherine Smith"), (4, "t", "Person", "Katherine Smith"), (5, "t", "Org", "Warner Brothers Pictures"), (6, "t", "Org", "Pictures Warner Brothers"), (7, None, "Org", "Warner Brothers"), (8, None, "Org", "warner brothers"), (9, "t", "Org", "?!")], "vertex_id long, tenant_id string, label string, entity_name string")
    got = {r["vertex_id"]: (r["canonical_id"], r["method"]) for r in resolve.greedy_merge(e).collect()}
    assert got == {1: (1, "new"), 2: (1, "string_match"), 3: (3, "new"), 4: (3, "string_match"), 5: (5, "new"), 6: (5, "vector_assisted"), 7: (7, "new"), 8: (7, "exact")}
    table = spark.read.parquet(f"{sf}/entities.parquet")
    rows = [(r["vertex_id"], r["tenant_id"], r["label"], r["n"]) for r in table.where("entity_name is not null").select("vertex_id", "tenant_id", "label", tx.normalize_name(F.col("entity_name")).alias("n")).where("n <> ''").collect()]
    assert {r["vertex_id"]: (r["canonical_id"], r["score"], r["method"]) for r in resolve.greedy_merge(table).collect()} == greedy_by_hand(rows)


def test_hashed_search_stays_in_its_tenant(spark):
    texts = [("a", 1, "red fox runs"), ("b", 2, "red fox runs"), (None, 3, "red fox runs"), ("a", 4, ""), ("a", 5, None), ("a", 6, "blue whale")]
    rows = retrieval.hash_rows(spark.createDataFrame(texts, "tenant_id string, doc long, text string"))
    q = retrieval.hash_rows(spark.createDataFrame([("a", 1, "red fox"), (None, 2, "red fox")], "tenant_id string, doc long, text string"))
    got = {(r["tenant_id"], r["query_id"]): r["doc"] for r in retrieval.hashed_search(q, rows, 3, block=1).where("rank = 1").collect()}
    assert got == {("a", 1): 1, (None, 2): 3}
    assert {r["doc"] for r in retrieval.hashed_pairs(q, rows, 0.7).collect()} == {1, 3}
    assert retrieval.hashed_search(q, rows.limit(0), 3).count() == 0


def test_bm25_salts_hot_terms(spark, monkeypatch):
    docs = spark.createDataFrame([("t", i, f"common word{i % 7}" + " common" * (i % 3)) for i in range(300)], "tenant_id string, chunk_no long, text string")
    q = retrieval.query_terms(spark.createDataFrame([(1, "t", "common word3"), (2, "t", "word4")], "query_id long, tenant_id string, query_text string"))
    score = lambda: {(r["query_id"], r["doc"]): round(r["score"], 9) for r in retrieval.bm25(retrieval.build_index(docs), q).collect()}
    plain = score()
    monkeypatch.setattr(retrieval, "SALTS", 4)
    assert score() == plain and len(plain) > 300


def test_link_mentions(spark):
    e = spark.createDataFrame([("t", "p1", "Person", "Christopher Nolan", ["Chris Nolan"]), ("t", "p2", "Person", "Nolan Bush", None)], "tenant_id string, entity_id string, label string, entity_name string, aliases array<string>")
    m = spark.createDataFrame([(1, "t", "Christopher Nolan"), (1, "t", "Chris  Nolan"), (2, "t", "Christofer Nolan"), (3, "t", "Zzz")], "query_id int, tenant_id string, mention string")
    out = {r["mention"]: (r["entity_id"], r["method"]) for r in resolve.link_mentions(m, e).collect()}
    assert out == {"Christopher Nolan": ("p1", "exact"), "Chris  Nolan": ("p1", "exact"), "Christofer Nolan": ("p1", "string_match")}


def test_mentions_meet_all_names(spark):
    names = {"p1": "Christopher Nolan", "p2": "Catherine Smith", "p3": "Dune Part Two", "p4": "Warner Brothers Pictures"}
    e = spark.createDataFrame([("t", k, "X", n, None) for k, n in names.items()], "tenant_id string, entity_id string, label string, entity_name string, aliases array<string>")
    m = spark.createDataFrame([(1, "t", "Rchistopher Nolan"), (1, "t", "Katherine Smith"), (2, "t", "Dune"), (2, "t", "Pictures Warner Brothers"), (3, "u", "Dune")], "query_id int, tenant_id string, mention string")
    out = {r["mention"]: (r["entity_id"], r["method"]) for r in resolve.link_mentions(m, e).collect()}
    assert out == {"Rchistopher Nolan": ("p1", "string_match"), "Katherine Smith": ("p2", "string_match"), "Dune": ("p3", "string_match"), "Pictures Warner Brothers": ("p4", "vector_knn")}


def test_communities(spark):
    e = edges_of(spark, [("t", a, "X", b, 1.0) for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "c"), ("c", "gone"))])
    v = spark.createDataFrame([("t", k, k.upper(), "Film") for k in "abcxyz"], "tenant_id string, entity_id string, entity_name string, label string")
    adjacent = community.adjacency(e, v)
    labels = community.propagate(adjacent, 6)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["community"], set()).add(r["entity_id"])
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["x", "y", "z"]]
    ranked = community.rank_communities(labels, e)
    assert [(r["members"], r["internal_edges"]) for r in ranked.collect()] == [(3, 3), (3, 3)]
    assert all(r["title"].count("&") == 1 for r in community.reports(labels, ranked, adjacent, v).collect())


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, d, i) for i, d in enumerate("abcd", 1)], "query_id int, doc string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z"), (3, "q")], "query_id int, doc string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    out = {r["query_id"]: r for r in metrics.ranking_metrics(ranked, relevant, q, 10).collect()}
    assert (out[1]["recall"], out[1]["precision"], out[1]["mrr"], out[1]["hit"]) == (0.5, 0.25, 0.5, 1.0)
    assert (out[2]["recall"], out[2]["mrr"], out[2]["ndcg"]) == (1.0, 0.0, 1.0)
    assert (out[3]["recall"], out[3]["precision"], out[3]["hit"]) == (0.0, 0.0, 0.0)
    steps = spark.createDataFrame([("r", "embed", float(x)) for x in (1, 2, 3, 100)], "request_id string, step string, latency_ms double")
    s = metrics.stage_report(steps).first()
    assert (s["p50"], s["p95"], s["share"]) == (2.0, 100.0, 1.0)
    calls = spark.createDataFrame([("r", "m1", 1_000_000, 0), ("r", "unknown", 5, 5)], "request_id string, model string, prompt_tokens int, completion_tokens int")
    prices = spark.createDataFrame([("m1", 2.0, 4.0)], "model string, input_usd double, output_usd double")
    t = {r["step"]: r for r in metrics.telemetry(steps, ["embed", "rerank"], calls, prices).collect()}
    assert t["rerank"]["latency_ms"] == 0 and t["embed"]["cost_usd"] == 2.0 and t["embed"]["priced"] is False
    g = {r["name"]: r["passed"] for r in metrics.gates(spark.createDataFrame([("p95", 400.0)], "name string, value double"), spark.createDataFrame([("p95", "<=", 500.0), ("gone", ">=", 0.0)], "name string, op string, target double")).collect()}
    assert g == {"p95": True, "gone": False}


def test_guards(spark):
    texts = ["MATCH (n); DROP TABLE x", "call dbms.x", "a /* b */", "x -- y", "${x}", "plain question?", "x" * 2001, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r["i"]: r["v"] for r in df.select("i", guards.violation(F.col("t")).alias("v")).collect()}
    assert [bool(out[i]) for i in range(8)] == [True] * 5 + [False, True, False]
    assert guards.Tenant("  AI_Trends_Bot  ").name == "ai_trends_bot"
    for bad in ("", "1abc", "a-b", "a;b", "../x", "a b", "é" * 3):
        with pytest.raises(guards.GuardError):
            guards.tenant_of(bad)
    with pytest.raises(guards.GuardError):
        guards.safe_identifier("x; DROP")
    with pytest.raises(guards.TenantError):
        guards.scoped(df, None)
    keys = spark.createDataFrame([("k1", "t1")], "api_key string, tenant_id string")
    req = spark.createDataFrame([(1, "k1", None), (2, "k1", "t2"), (3, "nope", None)], "request_id int, api_key string, claimed string")
    assert {r["request_id"]: r["status"] for r in guards.tenant_for_key(keys, req).collect()} == {1: 200, 2: 403, 3: 401}
    b = guards.battery(spark, [("injection", "x; DROP DATABASE y", True), ("benign", "who is it?", False)])
    assert all(r["checks"] == r["passed"] for r in b.collect())


def test_query_understanding(spark):
    texts = ["What are the main themes overall?", "Who directed Inception and also wrote it?", 'find "exact phrase" GPT-4', "it", "more", "more herbs", "treatment", "", None]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query_text string")
    out = {r["query_id"]: r for r in understand.plan(understand.analyse(q)).collect()}
    assert out[0]["intent"] == "global" and out[0]["use_community"] and not out[0]["use_lexical"]
    assert out[1]["hops"] == 2 and out[1]["mentions"] == ["Inception"] and out[1]["intent"] == "local" and out[1]["use_graph"]
    assert out[2]["intent"] == "lexical" and out[2]["identifiers"] == ["GPT-4"] or out[2]["intent"] == "hybrid"
    assert [out[i]["intent"] for i in (3, 4, 5)] == ["clarify"] * 3 and out[6]["intent"] != "clarify" and not out[3]["use_vector"]
    turns = spark.createDataFrame([("c", 1, "Who is Ada?"), ("c", 2, "more"), ("c", 3, "herbs")], "conv_id string, turn int, text string")
    assert [r["resolved_text"] for r in understand.resolve_context(turns).orderBy("turn").collect()] == ["Who is Ada?", "Who is Ada?", "more herbs"]


def test_context_pack(spark):
    ranked = spark.createDataFrame([(1, "a", 1, "alpha beta gamma delta."), (1, "b", 2, "Alpha beta gamma delta"), (1, "c", 3, "other words entirely here."), (1, "d", 4, " ".join(["long"] * 200))], "query_id int, doc string, rank int, text string")
    out = context.pack(ranked, budget=20).orderBy("position").collect()
    assert [r["doc"] for r in out] == ["a", "c"] and sum(r["tokens"] for r in out) <= 20
    assert context.summary(context.pack(ranked, budget=20), 20).first()["passages"] == 2


def test_profiles(spark):
    rows = [(i, "t", "f", [("title", f"Film {i}"), ("genre type", "War, Drama" if i % 2 else "War"), ("notes", "x" * 50), ("unknown", "n/a")]) for i in range(30)]
    r = spark.createDataFrame(rows, "record_id long, tenant_id string, source_uri string, cells array<struct<column_name:string,cell_value:string>>")
    p = {x["column"]: x for x in structured.profile_columns(r).collect()}
    assert p["title"]["role"] == "entity" and p["genre type"]["role"] == "attribute" and p["genre type"]["multi_valued"] and p["notes"]["role"] == "freetext" and "unknown" not in p
    v, e = structured.record_graph(r, structured.profile_columns(r))
    assert e.count() == 30 + 15 and {x["edge_type"] for x in e.collect()} == {"HAS_ATTRIBUTE"}
    assert structured.verbalize(r, structured.profile_columns(r)).where("record_id = 0").first()["text"].startswith("# Film 0\n")


def test_proposals(spark):
    from lodework.operators import proposals

    labels, edges = ["Person", "Artifact", "Entity"], ["AFFECTS", "CITES"]
    e = spark.createDataFrame([("c", "Ada", "person", 0.9), ("c", "Book X", "book", 0.9), ("c", "Odd", "Gizmo", 0.9), ("c", "", "Person", 0.9), ("c", "Weak", "Person", 0.5), ("c", None, None, None)], "chunk_id string, name string, label string, confidence double")
    r = spark.createDataFrame([("c", "Ada", "mentions", "book x", 0.9), ("c", "Ada", "wobbles", "Book X", 0.9), ("c", "Ada", "cites", "Gone", 0.9), ("c", "Ada", "CITES", "ada", 0.9), ("c", "Ada", "CITES", "Odd", 0.1)], "chunk_id string, source string, relation string, target string, confidence double")
    x, y = proposals.accept(e, r, labels, edges)
    assert {(i["name"], i["coerced"], i["reason"]) for i in x.collect()} == {("Ada", "Person", None), ("Book X", "Artifact", None), ("Odd", "Entity", None), ("", "Person", "bad_name"), ("Weak", "Person", "low_confidence"), (None, "Entity", "bad_name")}
    assert sorted((i["relation"], str(i["reason"])) for i in y.collect()) == [("CITES", "low_confidence"), ("CITES", "self_loop"), ("cites", "endpoint_not_extracted"), ("mentions", "None"), ("wobbles", "unknown_relation")]


def test_pass_rules(spark):
    rows = [("rejects", None, True, True), ("retrieves_any", None, True, False), ("abstains", "bad text", False, False), ("abstains", "fine", False, True), ("retrieves_text", "the Good one", False, True), ("retrieves_text", None, False, False), ("clarifies", None, False, True), (None, "x", False, True)]
    df = spark.createDataFrame(rows, "rule string, text string, rejected boolean, want boolean")
    texts = F.when(F.col("text").isNotNull(), F.array("text"))
    ok = metrics.pass_rule(F.col("rule"), texts, F.array(F.lit("good")), F.array(F.lit("BAD")), F.lit("clarify"), F.lit("global"), F.lit(0), F.lit(None).cast("int"), F.size(F.coalesce(texts, F.array().cast("array<string>"))), F.col("rejected"))
    assert all(r["ok"] == r["want"] for r in df.withColumn("ok", ok).collect())


def test_boilerplate_is_the_whole_text(spark):
    texts = ["See also:", "COPYRIGHT", "page 12.", "Copyright law in Germany protects works for seventy years after death.", "Subscribe to the view that rivers change their beds."]
    df = spark.createDataFrame([(i, "prose", t) for i, t in enumerate(texts)], "i int, kind string, text string").withColumn("token_count", F.lit(50))
    got = {r["i"]: "boilerplate" in [x["code"] for x in r["issues"]] for r in chunking.validate(df).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_quotes_and_continuations(spark):
    q = spark.createDataFrame([(1, "find 'exact words' here"), (2, 'and "these" or \'those\'')], "query_id int, query_text string")
    assert {r["query_id"]: r["quoted"] for r in understand.analyse(q).collect()} == {1: ["exact words"], 2: ["these", "those"]}
    turns = spark.createDataFrame([("c", 1, "Which herbs help?"), ("c", 2, "more herbs"), ("d", 1, "Who is Ada?"), ("d", 2, "documents")], "conv_id string, turn int, text string")
    got = {(r["conv_id"], r["turn"]): r["resolved_text"] for r in understand.resolve_context(turns).collect()}
    assert got[("c", 2)] == "Which herbs help?" and got[("d", 2)] == "Who is Ada? documents"
