"""SQL of the queries in `extended`, and of core queries over hashed embeddings and configurations."""

from __future__ import annotations

from lodework.functions import text as tx
from lodework.operators import metrics
from lodework.plans import core_sql as c

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def _embed(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in `name` (tenant_id, key, bucket, w): hashed embeddings of unit length."""
    return f"""{name}_t AS (SELECT tenant_id, {key} AS key, sha1(unnest({_TOKENS.format(text)})) AS h FROM {source}),
{name}_b AS (SELECT tenant_id, key, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 384 AS b0, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % 384 AS b1, CASE WHEN CAST(('0x' || substr(h, 17, 2)) AS BIGINT) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM {name}_t),
{name}_x AS (SELECT tenant_id, key, bucket, sum(w) AS w FROM (SELECT tenant_id, key, b0 AS bucket, s AS w FROM {name}_b UNION ALL SELECT tenant_id, key, b1, s * 0.5 FROM {name}_b) GROUP BY ALL HAVING sum(w) <> 0),
{name} AS (SELECT tenant_id, key, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY tenant_id, key)) AS w FROM {name}_x)"""


def _hashed(text: str, k: int) -> str:
    """CTEs that end in `hv` (query_id, doc, score, rank): the k nearest chunks of a query's own tenant."""
    return _embed("qe", "queries", "query_id", text) + ",\n" + _embed("ce", "c", "doc", "text") + f""",
hs AS (SELECT q.key AS query_id, x.key AS doc, round(sum(q.w * x.w), 6) AS s FROM qe q JOIN ce x ON x.tenant_id = q.tenant_id AND x.bucket = q.bucket GROUP BY ALL HAVING round(sum(q.w * x.w), 6) > 0),
hv AS (SELECT query_id, doc, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS rank FROM hs QUALIFY rank <= {k})"""


_HITS = c._INDEX + c._bm25("a", "passage") + """, h AS (SELECT a_r.query_id, a_r.tenant_id, c.chunk_id, rank FROM a_r JOIN c USING (doc) WHERE rank <= 8)"""
_FROM_HITS = """seeds AS (SELECT query_id, tenant_id, entity_id FROM (
  SELECT query_id, tenant_id, entity_id, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT DISTINCT tenant_id, chunk_id, entity_id FROM mentions WHERE entity_id IS NOT NULL) JOIN h USING (tenant_id, chunk_id) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_chunks DESC, entity_id) <= 60)"""

# ---------------------------------------------------------------- configurations

_CONFIG_LISTS = c._INDEX + c._bm25("a", "passage") + ",\n" + _hashed("passage", 30) + ",\n" + c._traverse(1, None) + """,
gf AS (SELECT query_id, tenant_id, entity_id FROM nodes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, entity_id) <= 25),
gg AS (SELECT query_id, chunk_id, count(*) AS n FROM (SELECT DISTINCT tenant_id, entity_id, chunk_id FROM mentions WHERE entity_id IS NOT NULL AND chunk_id IS NOT NULL) JOIN gf USING (tenant_id, entity_id) GROUP BY ALL),
gr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS rank FROM gg QUALIFY rank <= 30),
lists AS MATERIALIZED (SELECT query_id, doc, 'vector' AS path, rank, 1 AS list_no FROM hv UNION ALL SELECT query_id, doc, 'lexical', rank, 2 FROM a_r WHERE rank <= 30 UNION ALL SELECT query_id, doc, 'graph', rank, 3 FROM gr JOIN c USING (chunk_id))""" + ", " + c._RELEVANT + ", rn AS MATERIALIZED (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1)"


def _configurations() -> str:
    sql, rows = _CONFIG_LISTS, []
    for key, name, paths, rrf, again in metrics.CONFIGURATIONS:
        own = f"(SELECT * FROM lists WHERE path IN {c._in(paths.split())})"
        k = "config_" + key.lower()
        if rrf:
            sql += f""",
{k}0 AS (SELECT query_id, doc, round(sum(1.0 / (60 + rank)), 6) AS score FROM {own} GROUP BY ALL),
{k}1 AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {k}0 QUALIFY rank <= 30)"""
        else:
            sql += f""",
{k}0 AS (SELECT * FROM {own} QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY list_no, rank) = 1),
{k}1 AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, doc) AS rank FROM {k}0)"""
        last = f"{k}1"
        if again:
            sql += f""",
{k}2 AS (SELECT f.query_id, f.doc, f.rank AS before, list_distinct({_TOKENS.format('q.passage')}) AS qt, {_TOKENS.format('c.text')} AS tt FROM {k}1 f JOIN queries q USING (query_id) JOIN c USING (doc) WHERE rank <= 40),
{k}3 AS (SELECT query_id, doc, before, CASE WHEN len(qt) > 0 AND len(tt) > 0 THEN round(0.75 * len(list_intersect(qt, list_distinct(tt))) / len(qt) + 0.25 * least(len(list_intersect(qt, list_distinct(tt))) / sqrt(len(tt)), 1.0), 4) ELSE 0.0 END AS score FROM {k}2),
{k}4 AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, doc) AS rank FROM {k}3 QUALIFY rank <= 10)"""
            last = f"{k}4"
        sql += f""",
{k}g AS (SELECT r.query_id, count(*) AS n_returned, count(rel.doc) AS n_hit, min(CASE WHEN rel.doc IS NOT NULL THEN rank END) AS first_hit, sum(CASE WHEN rel.doc IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM {last} r LEFT JOIN rel ON r.query_id = rel.query_id AND r.doc = rel.doc WHERE rank <= 10 GROUP BY 1),
{k}m AS (SELECT round(coalesce(n_hit, 0) / n_relevant, 6) AS recall, round(CASE WHEN coalesce(n_returned, 0) = 0 THEN 0.0 ELSE n_hit / n_returned END, 6) AS precision, round(coalesce(1 / first_hit, 0), 6) AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n_relevant, 10) AS INT) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM rn LEFT JOIN {k}g USING (query_id))"""
        rows.append(f"SELECT '{key}' AS config, '{name}' AS name, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM {k}m")
    return sql + "\n" + "\nUNION ALL ".join(rows)


# ---------------------------------------------------------------- linking

_LETTERS, _SIGNS = "éñášöžáàâäåæçèêëíìîïóòôõøúùûüýß", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#%&*"


def _jw(a: str, b: str) -> str:
    """Jaro-Winkler by characters: letters beyond ASCII are renamed, since this engine compares bytes."""
    letters, signs = _LETTERS[: len(_SIGNS)], _SIGNS[: len(_LETTERS)]
    return f"jaro_winkler_similarity(translate({a}, '{letters}', '{signs}'), translate({b}, '{letters}', '{signs}'))"


_LINKED = c._analyse("passage") + f""",
m0 AS (SELECT query_id, tenant_id, unnest(mentions) AS mention FROM an JOIN queries USING (query_id)),
m AS (SELECT DISTINCT *, {c._norm('mention')} AS norm FROM m0),
e0 AS (SELECT tenant_id, entity_id, label, unnest(list_distinct(list_concat([entity_name], coalesce(aliases, [])))) AS n FROM entities WHERE entity_id IS NOT NULL),
e AS (SELECT tenant_id, entity_id, {c._norm('n')} AS enorm, min(label) AS label FROM e0 WHERE n IS NOT NULL AND {c._norm('n')} <> '' GROUP BY ALL),
asked AS (SELECT DISTINCT tenant_id, norm FROM m WHERE norm <> ''), known AS (SELECT DISTINCT tenant_id, enorm FROM e),
""" + _embed("ae", "asked", "norm", "replace(norm, '_', ' ')") + ",\n" + _embed("ke", "known", "enorm", "replace(enorm, '_', ' ')") + f""",
cs AS (SELECT a.tenant_id, a.key AS norm, k.key AS enorm, round(round(sum(a.w * k.w), 6), 4) AS cosine FROM ae a JOIN ke k ON k.tenant_id = a.tenant_id AND k.bucket = a.bucket GROUP BY ALL HAVING round(sum(a.w * k.w), 6) >= 0.7),
jw AS (SELECT tenant_id, norm, enorm, {_jw('norm', 'enorm')} AS x FROM asked JOIN known USING (tenant_id)),
al AS (SELECT tenant_id, norm, enorm, CASE WHEN norm = enorm THEN 1.0 ELSE round(x, 4) END AS score, CASE WHEN norm = enorm THEN 'exact' ELSE 'string_match' END AS method FROM jw WHERE norm = enorm OR round(x, 4) >= 0.85
  UNION ALL SELECT tenant_id, norm, enorm, round(0.7 * cosine + 0.3 * x, 4), 'vector_knn' FROM jw JOIN cs USING (tenant_id, norm, enorm) WHERE x >= 0.55 AND round(x, 4) < 0.85)
SELECT query_id, m.tenant_id, mention, entity_id, label, CAST(score AS DOUBLE) AS score, method FROM m JOIN al USING (tenant_id, norm) JOIN e USING (tenant_id, enorm)
QUALIFY row_number() OVER (PARTITION BY query_id, mention ORDER BY score DESC, entity_id, method) = 1"""

_ROUNDS = 8


def _greedy() -> str:
    """The merge by rounds of decisions, as many as are unrolled here."""
    sql = f"""WITH n0 AS (SELECT tenant_id, label, {c._norm('entity_name')} AS norm, vertex_id FROM entities WHERE entity_name IS NOT NULL),
n AS (SELECT tenant_id, label, norm, min(vertex_id) AS id FROM n0 WHERE norm <> '' GROUP BY ALL),
k AS (SELECT *, unnest(list_distinct(list_concat([label || ':' || substr(norm, 1, 3)], list_transform(list_filter(string_split(norm, '_'), lambda t: length(t) >= 4), lambda t: label || ':tok:' || t)))) AS key FROM n),
p AS (SELECT DISTINCT a.tenant_id, a.id AS a, b.id AS b, a.norm AS na, b.norm AS nb FROM k a JOIN k b ON a.tenant_id = b.tenant_id AND a.key = b.key AND a.id < b.id),
d AS (SELECT DISTINCT tenant_id, norm FROM n),
""" + _embed("de", "d", "norm", "replace(norm, '_', ' ')") + f""",
j AS (SELECT *, round({_jw('na', 'nb')}, 9) AS x FROM p),
co AS (SELECT j.a, j.b, round(sum(u.w * v.w), 6) AS c FROM j JOIN de u ON u.tenant_id = j.tenant_id AND u.key = j.na JOIN de v ON v.tenant_id = j.tenant_id AND v.key = j.nb AND v.bucket = u.bucket WHERE x >= 0.6 AND x < 0.85 GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b, x AS score, 'string_match' AS method FROM j WHERE x >= 0.85 UNION ALL SELECT a, b, round(0.6 * c + 0.4 * x, 4), 'vector_assisted' FROM j JOIN co USING (a, b) WHERE c >= 0.8),
s0 AS MATERIALIZED (SELECT id, CASE WHEN id NOT IN (SELECT b FROM e) THEN 'canonical' END AS state FROM n)"""
    for i in range(1, _ROUNDS + 1):
        sql += f""",
t{i} AS (SELECT b AS id, bool_or(coalesce(state = 'canonical', false)) AS taken, bool_and(state IS NOT NULL) AS whole FROM e JOIN s{i - 1} ON id = a GROUP BY b),
s{i} AS MATERIALIZED (SELECT id, coalesce(state, CASE WHEN taken THEN 'merged' WHEN whole THEN 'canonical' END) AS state FROM s{i - 1} LEFT JOIN t{i} USING (id))"""
    return sql + f""",
r AS (SELECT vertex_id, id, state FROM n0 JOIN n ON n.tenant_id IS NOT DISTINCT FROM n0.tenant_id AND n.label IS NOT DISTINCT FROM n0.label AND n.norm = n0.norm JOIN s{_ROUNDS} USING (id)),
ab AS (SELECT a AS canon, b AS id, score, method FROM e UNION ALL SELECT b, a, score, method FROM e)
SELECT vertex_id, id AS canonical_id, CAST(1.0 AS DOUBLE) AS score, CASE WHEN vertex_id = id THEN 'new' ELSE 'exact' END AS method FROM r WHERE state = 'canonical'
UNION ALL (SELECT r.vertex_id, canon, round(score, 4), method FROM r JOIN ab USING (id) JOIN s{_ROUNDS} f ON f.id = canon AND f.state = 'canonical' WHERE r.state = 'merged' AND canon < r.vertex_id QUALIFY row_number() OVER (PARTITION BY r.vertex_id ORDER BY score DESC, canon) = 1)"""


# a fold over the events of each user: the times that were let through, and what was decided
_LIMITED = """WITH o AS (SELECT user_id, list({'kept': CAST([] AS DOUBLE[]), 'out': CAST([] AS BOOLEAN[]), 't': epoch(ts)} ORDER BY ts, event_id) AS xs, list(event_id ORDER BY ts, event_id) AS ids FROM events WHERE ts IS NOT NULL GROUP BY 1),
f AS (SELECT ids, list_reduce(list_prepend({'kept': CAST([] AS DOUBLE[]), 'out': CAST([] AS BOOLEAN[]), 't': 0.0::DOUBLE}, xs),
  lambda acc, x: {'kept': CASE WHEN len(list_filter(acc.kept, lambda k: k > x.t - 3600)) < 3 THEN list_append(list_filter(acc.kept, lambda k: k > x.t - 3600), x.t) ELSE list_filter(acc.kept, lambda k: k > x.t - 3600) END,
                  'out': list_append(acc.out, len(list_filter(acc.kept, lambda k: k > x.t - 3600)) < 3), 't': x.t}).out AS out FROM o)
SELECT unnest(ids) AS event_id, unnest(out) AS allowed FROM f"""

_REASON = r"""CASE WHEN query_id % 7 <> 0 THEN NULL WHEN query_id % 5 IN (0, 4) THEN 'anaphora_without_antecedent' WHEN query_id % 5 = 1 THEN 'continuation_without_prior_turn' WHEN query_id % 5 IN (2, 3) THEN 'category_without_entity' END"""
_SAID = "['it', 'more', 'herbs', 'other documents', 'what about that?'][CAST(query_id % 5 + 1 AS INT)]"
_MENTIONED = c._analyse("passage")


def _ways() -> str:
    """Ranked lists of the fused way and of vectors alone, with their metrics."""
    def metric(name: str) -> str:
        return f""",
{name}g AS (SELECT r.query_id, count(*) AS n, count(rel.doc) AS n_hit FROM {name} r LEFT JOIN rel ON r.query_id = rel.query_id AND r.doc = rel.doc WHERE rank <= 10 GROUP BY 1),
{name}m AS (SELECT q.query_id, coalesce(n_relevant, 0) AS n_relevant, round(CASE WHEN coalesce(n_relevant, 0) = 0 THEN 1.0 ELSE coalesce(n_hit, 0) / n_relevant END, 6) AS recall, coalesce(n, 0) AS n FROM queries q LEFT JOIN rn USING (query_id) LEFT JOIN {name}g USING (query_id)),
{name}k AS (SELECT *, CASE WHEN n_relevant = 0 THEN n = 0 ELSE recall >= 0.5 END AS ok FROM {name}m)"""
    return c._INDEX + c._bm25("a", "passage") + ",\n" + _hashed("passage", 20) + ", " + c._RELEVANT + """, rn AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
fu AS (SELECT query_id, doc, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, doc, rank FROM a_r WHERE rank <= 20 UNION ALL SELECT query_id, doc, rank FROM hv) GROUP BY ALL),
hy AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM fu QUALIFY rank <= 10)""" + metric("hy") + metric("hv") + """
SELECT category, count(*) AS n, count(*) FILTER (WHERE a.n_relevant > 0) AS n_scored, round(avg(CASE WHEN a.n_relevant > 0 THEN a.recall END), 6) AS hybrid_recall, round(avg(CASE WHEN a.n_relevant > 0 THEN b.recall END), 6) AS vector_recall,
count(*) FILTER (WHERE a.ok) AS hybrid_passed, count(*) FILTER (WHERE b.ok) AS vector_passed, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS only_hybrid, count(*) FILTER (WHERE b.ok AND NOT a.ok) AS only_vector
FROM queries JOIN hyk a USING (query_id) JOIN hvk b USING (query_id) GROUP BY 1"""


_BY_CATEGORY = c._INDEX + c._bm25("a", "query_text") + c._metrics("a") + """,
bc AS (SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY GROUPING SETS ((category), ()))"""


def _both_metrics() -> str:
    """Metrics m of the query text and m2 of the passage."""
    second = c._metrics("b").replace(f", {c._RELEVANT},\nrn AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1)", "").replace("\ng AS (", "\ng2 AS (").replace("\nm AS (", "\nm2 AS (").replace("LEFT JOIN g USING", "LEFT JOIN g2 USING")
    return c._INDEX + c._bm25("a", "query_text") + c._bm25("b", "passage") + c._metrics("a") + second


SQL: dict[str, str] = {
    "knn_hashed": f"WITH {c._CHUNKS}, {_hashed('query_text', 10)} SELECT query_id, doc, score, rank FROM hv",
    "configurations": _configurations(),
    "configuration_lift": _both_metrics() + " SELECT m.category, count(*) AS n, round(avg(m.recall), 6) AS base, round(avg(m2.recall), 6) AS other, round(avg(m2.recall - m.recall), 6) AS lift, count(*) FILTER (WHERE m2.recall > 0 AND m.recall = 0) AS only_other FROM m JOIN m2 USING (query_id) GROUP BY 1",
    "multi_hop_advantage": _both_metrics() + " SELECT coalesce(requires_multi_hop, false) AS multi_hop, count(*) AS n, round(avg(m.recall), 6) AS a, round(avg(m2.recall), 6) AS b, round(avg(m2.recall) - avg(m.recall), 6) AS advantage FROM m JOIN m2 USING (query_id) JOIN queries USING (query_id) GROUP BY 1",
    "linked_mentions": _LINKED,
    "resolution_greedy": _greedy(),
    "rate_limit_exact": _LIMITED,
    "clarifications": f"""SELECT query_id, {_REASON} AS reason, 'clarify' AS intent, CASE {_REASON} WHEN 'anaphora_without_antecedent' THEN 'What does "' || {_SAID} || '" refer to?' WHEN 'continuation_without_prior_turn' THEN 'There is no earlier question to continue. What would you like to know?' ELSE '"' || {_SAID} || '" names a kind of thing. Which one do you mean?' END AS prompt
FROM queries WHERE query_id % 7 = 0""",
    "expanded_chunks": _HITS + ",\n" + c._traverse(1, None, seeds=_FROM_HITS) + """, f AS (SELECT query_id, tenant_id, entity_id FROM nodes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, entity_id) <= 25),
x AS (SELECT query_id, chunk_id, count(*) AS n_entities FROM (SELECT DISTINCT tenant_id, entity_id, chunk_id FROM mentions WHERE entity_id IS NOT NULL AND chunk_id IS NOT NULL) JOIN f USING (tenant_id, entity_id) GROUP BY ALL),
y AS (SELECT query_id, chunk_id, n_entities, row_number() OVER (PARTITION BY query_id ORDER BY n_entities DESC, chunk_id) AS rank FROM x QUALIFY rank <= 30)
SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = y.query_id AND h.chunk_id = y.chunk_id)""",
    "merged_subgraph": "WITH " + c._traverse(2, None, None).replace("nodes AS (", "n2 AS (") + """,
d0 AS (SELECT tenant_id, source_id, target_id FROM edges WHERE source_id <> target_id),
d AS (SELECT DISTINCT tenant_id, source_id AS x, target_id AS y FROM d0 UNION SELECT DISTINCT tenant_id, target_id, source_id FROM d0),
one AS (SELECT query_id, tenant_id, entity_id, 0 AS hop FROM seeds UNION ALL SELECT DISTINCT s.query_id, s.tenant_id, d.y, 1 FROM seeds s JOIN d ON d.tenant_id = s.tenant_id AND d.x = s.entity_id WHERE NOT EXISTS (SELECT 1 FROM seeds o WHERE o.query_id = s.query_id AND o.tenant_id = s.tenant_id AND o.entity_id = d.y)),
a AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, entity_id) <= 100), b AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, entity_id) <= 100),
u AS (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b),
w AS (SELECT query_id, tenant_id, entity_id, hop, part FROM u QUALIFY row_number() OVER (PARTITION BY query_id, tenant_id, entity_id ORDER BY part, hop) = 1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, hop, entity_id) AS rank FROM w QUALIFY rank <= 100""",
    "candidate_pool": _MENTIONED + f""",
nm AS (SELECT DISTINCT query_id, tenant_id, {c._norm('m')} AS norm FROM (SELECT query_id, tenant_id, unnest(mentions) AS m FROM an JOIN queries USING (query_id))),
en AS (SELECT DISTINCT tenant_id, entity_id, {c._norm('entity_name')} AS norm FROM entities WHERE entity_id IS NOT NULL),
fo AS (SELECT DISTINCT query_id, tenant_id, entity_id FROM nm JOIN en USING (tenant_id, norm)),
sh AS (SELECT an.query_id, q.tenant_id FROM an JOIN queries q USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS have FROM fo GROUP BY 1) USING (query_id) WHERE coalesce(have, 0) < len(mentions)),
po AS (SELECT tenant_id, entity_id FROM (SELECT DISTINCT tenant_id, entity_id FROM en) QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY entity_id) <= 200)
SELECT *, false AS widened FROM fo UNION ALL SELECT query_id, tenant_id, entity_id, true FROM sh JOIN po USING (tenant_id) WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.query_id = sh.query_id AND fo.entity_id = po.entity_id)""",
    "foreign_hits": c._INDEX + c._bm25("a", "query_text") + ",\n" + _hashed("query_text", 10) + """
SELECT path, count(*) AS n, CAST(0 AS BIGINT) AS foreign_rows FROM (SELECT 'vector' AS path, query_id, doc FROM hv UNION ALL SELECT 'lexical', query_id, doc FROM a_r WHERE rank <= 10) GROUP BY 1""",
    "sql_parameters": "SELECT tenant_id, source_id, upper(edge_type) AS edge_type, target_id, max(confidence) AS confidence FROM edges WHERE tenant_id = 'movies_bot' AND confidence >= 0.8 GROUP BY ALL ORDER BY source_id, edge_type, target_id LIMIT 200",
    "shaped_response": _HITS + ",\n" + c._traverse(1, None) + """, n AS (SELECT query_id, count(*) AS n FROM nodes GROUP BY 1)
SELECT h.query_id, h.rank, h.chunk_id AS doc, CASE WHEN requires_multi_hop THEN coalesce(n, 0) END AS subgraph_nodes FROM h JOIN queries q USING (query_id) LEFT JOIN n USING (query_id) WHERE rank <= 3""",
    "access_decisions": """WITH r AS (SELECT query_id, tenant_id, CASE WHEN query_id % 11 = 0 THEN NULL ELSE tenant_id END AS own, CASE WHEN query_id % 5 = 0 THEN 'ai_trends_bot' WHEN query_id % 5 = 1 THEN tenant_id WHEN query_id % 35 = 2 THEN 'never_bot' END AS claimed, CASE WHEN query_id % 3 = 0 THEN 'write' ELSE 'read' END AS scope FROM queries),
s AS (SELECT *, coalesce(claimed, own) AS target, own = 'movies_bot' AS admin, CASE own WHEN 'movies_bot' THEN ['admin'] WHEN 'ai_trends_bot' THEN ['read', 'write'] ELSE ['read'] END AS scopes FROM r),
t AS (SELECT *, CASE WHEN own IS NULL THEN 401 WHEN target <> own AND NOT admin THEN 403 WHEN NOT admin AND NOT list_contains(scopes, scope) THEN 403 WHEN target NOT IN (SELECT DISTINCT tenant_id FROM queries) THEN 404 ELSE 200 END AS status FROM s)
SELECT query_id AS request_id, CASE WHEN status = 200 THEN target END AS tenant_id, status FROM t""",
    "embedding_versions": f"""WITH {c._CHUNKS}, v AS (SELECT tenant_id, chunk_id, CASE WHEN coalesce(trim(embedding_version), '') = '' THEN 'unversioned' WHEN embedding_version = 'sim-embed/96/v2' THEN 'current' ELSE 'stale' END AS state FROM indexed_chunks)
SELECT v.tenant_id, state, count(*) AS n, count(c.chunk_id) AS n_texts FROM v LEFT JOIN c USING (chunk_id) GROUP BY ALL""",
    "reembedded": f"""WITH {c._CHUNKS}, v AS (SELECT i.tenant_id, embedding_version, len(vector) AS size, coalesce(len({_TOKENS.format('c.text')}), 0) > 0 AS made FROM indexed_chunks i LEFT JOIN c USING (chunk_id) WHERE coalesce(embedding_version <> 'sim-embed/96/v2', true))
SELECT tenant_id, CASE WHEN made THEN 'lexical-hash/384/v1' ELSE coalesce(embedding_version, 'none') END AS version, count(*) AS n, count(*) FILTER (WHERE made OR size = 384) AS n_new FROM v GROUP BY ALL""",
    "chunk_kinds": f"""WITH {c._RANKED} SELECT tenant_id, chunk_kind AS kind, count(*) AS n FROM indexed_chunks WHERE coalesce(chunk_kind <> 'community_report', true) GROUP BY ALL UNION ALL SELECT tenant_id, 'community_report', count(*) FROM ranked GROUP BY 1""",
    "routed_methods": "SELECT tenant_id, CASE kind WHEN 'record' THEN 'record' WHEN 'table' THEN 'table' WHEN 'heading' THEN 'none' ELSE 'prose' END AS method, count(*) AS blocks, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM blocks GROUP BY ALL",
    "table_records": f"""WITH r AS (SELECT block_no, table_headers AS h, generate_subscripts(table_rows[1:200], 1) - 1 AS row_index, unnest(table_rows[1:200]) AS r FROM blocks WHERE kind = 'table' AND len(table_headers) > 0),
z AS (SELECT block_no, row_index, list_filter(list_zip(h, r[1:len(h)]), lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL) AS cells FROM r WHERE r IS NOT NULL)
SELECT block_no, CAST(row_index AS INT) AS row_index, len(cells) AS n_cells, array_to_string(list_transform(list_filter(cells, lambda x: lower(trim(x[2])) NOT IN {c._in(tx.NULLS_CELL)}), lambda x: x[1] || ': ' || trim(x[2])), chr(10)) AS text FROM z WHERE len(cells) > 0""",
    "plain_paragraphs": rf"""WITH p AS (SELECT doc_id, generate_subscripts(s, 1) AS part, unnest(s) AS t FROM (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n(#{{1,6}}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) AS s FROM documents WHERE trim(text) <> '')),
h AS (SELECT doc_id, part, nullif(rtrim(regexp_extract(t, '^#{{1,6}}[ \t]+(\S[^\n]*)', 1)), '') AS section, t FROM p),
b AS (SELECT doc_id, part, section, generate_subscripts(s, 1) AS nth, unnest(s) AS body FROM (SELECT doc_id, part, section, string_split_regex(CASE WHEN section IS NULL THEN t ELSE regexp_replace(t, '^[^\n]*\n?', '') END, '\n[ \t]*\n') AS s FROM h)),
k AS (SELECT doc_id, part, nth, section, regexp_replace(body, '^\s+|\s+$', '', 'g') AS text FROM b)
SELECT doc_id AS doc, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, nth) - 1 AS INT) AS pos, section, text AS body, {c._TOKENS.format("replace(text, chr(160), ' ')")} AS tokens FROM k WHERE text <> ''""",
    "corpus_summary": "SELECT coalesce(source, 'none') AS source, count(*) AS documents, count(*) FILTER (WHERE coalesce(length(text), 0) >= 200) AS usable, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, max(coalesce(length(text), 0)) AS longest FROM documents GROUP BY 1",
    "case_outcomes": c._analyse("query_text") + ", " + c._INDEX.removeprefix("WITH ") + c._bm25("a", "query_text") + f""",
hc AS (SELECT query_id, count(*) AS n_hits FROM a_r WHERE rank <= 5 GROUP BY 1), gu AS (SELECT query_id, {c._GUARD.replace('text', 'query_text')} AS bad FROM queries)
SELECT query_id, CASE WHEN bad IS NOT NULL THEN 'refused' WHEN coalesce(n_hits, 0) > 0 THEN 'answered' ELSE 'empty' END AS outcome, bad AS reason, intent, CASE WHEN bad IS NULL THEN coalesce(n_hits, 0) ELSE 0 END AS n_hits FROM an JOIN gu USING (query_id) LEFT JOIN hc USING (query_id)""",
    "question_set": _ways(),
    "rules_passed": c._analyse("query_text") + ", " + c._INDEX.removeprefix("WITH ") + c._bm25("a", "passage") + ",\n" + c._traverse(1, None) + c._RECOVER + f""",
hj AS (SELECT a_r.query_id, lower(string_agg(text, ' ')) AS joined, count(*) AS n FROM a_r JOIN c USING (doc) WHERE rank <= 5 GROUP BY 1), re AS (SELECT query_id, count(*) AS n_edges FROM rec GROUP BY 1),
gu AS (SELECT query_id, {c._GUARD.replace('text', 'query_text')} IS NOT NULL AS bad FROM queries),
al AS (SELECT q.*, intent, joined, coalesce(n, 0) AS n, coalesce(n_edges, 0) AS n_edges, bad, unnest({metrics.RULES}) AS r FROM queries q JOIN an USING (query_id) JOIN gu USING (query_id) LEFT JOIN hj USING (query_id) LEFT JOIN re USING (query_id))
SELECT query_id, r AS rule, CASE WHEN r = 'rejects' THEN bad WHEN bad THEN false WHEN r = 'abstains' THEN len(list_filter(coalesce(expected_text, []), lambda t: contains(coalesce(joined, ''), lower(t)))) = 0 WHEN r = 'routes_to' THEN intent = 'local' WHEN r = 'clarifies' THEN intent = 'clarify'
WHEN r = 'retrieves_graph' THEN n_edges >= greatest(1, coalesce(hops, 1)) WHEN r = 'retrieves_text' THEN len(list_filter(coalesce(expected_text, []), lambda t: NOT contains(coalesce(joined, ''), lower(t)))) = 0 ELSE n > 0 END AS passed FROM al""",
    "sql_functions": f"SELECT vertex_id, {c._ident('label', 'entity_name')} AS canonical, {c._TOKENS.format('entity_name')} AS tokens, round((2 + vertex_id % 7) / (sqrt(1 + (vertex_id % 7) * (vertex_id % 7)) * sqrt(5)), 6) AS cosine FROM entities",
    "passage_citations": r"""SELECT block_no, concat_ws(' · ', doc_key, CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') END, 'via ' || kind) AS citation,
CASE WHEN length(text) <= 80 THEN text ELSE coalesce(nullif(rtrim(regexp_extract(substr(text, 1, 80), '(?s)^(.*)\s', 1)), ''), substr(text, 1, 80)) END AS head FROM blocks""",
    "report_markdown": _BY_CATEGORY + """
SELECT CAST(i AS INT) AS line_no, line FROM (VALUES (1, '# Retrieval by category'), (2, ''), (3, '| category | n | recall | mrr | ndcg |'), (4, '|---|---|---|---|---|')) t(i, line)
UNION ALL SELECT CAST(row_number() OVER (ORDER BY category) + 4 AS INT), '| ' || concat_ws(' | ', category, n, printf('%.4f', recall), printf('%.4f', mrr), printf('%.4f', ndcg)) || ' |' FROM bc""",
    "first_nodes": """WITH r AS (SELECT tenant_id, source_id, target_id, upper(edge_type) AS edge_type FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
s AS (SELECT tenant_id, source_id AS entity_id, source_id, edge_type, target_id, 0 AS side FROM r UNION ALL SELECT tenant_id, target_id, source_id, edge_type, target_id, 1 FROM r),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY source_id, edge_type, target_id, side) = 1)
SELECT tenant_id, entity_id, row_number() OVER (PARTITION BY tenant_id ORDER BY source_id, edge_type, target_id, side, entity_id) AS place FROM f""",
}
_ALIASED = c._PROFILE.replace("SELECT record_id, tenant_id, generate_subscripts(cells, 1) - 1 AS ordinal, unnest(cells) AS c FROM records", "SELECT record_id, tenant_id, generate_subscripts(cells, 1) - 1 AS ordinal, unnest(list_transform(cells, lambda x: {'column_name': CASE WHEN x.column_name = 'tagline' THEN 'local title' ELSE x.column_name END, 'cell_value': x.cell_value})) AS c FROM records")
SQL["record_aliases"] = _ALIASED + f""", po AS (SELECT p.*, m.ordinal FROM prof p JOIN mu m USING (tenant_id, "column")),
ha AS (SELECT tenant_id, bool_or(role = 'alias') AS has_alias FROM prof GROUP BY 1),
sub AS (SELECT tenant_id, "column" AS subject FROM po JOIN ha USING (tenant_id) WHERE role = 'entity' QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY CASE WHEN has_alias THEN 0 ELSE CAST(multi_valued AS INT) END, ordinal, "column") = 1),
cc AS (SELECT c.*, p.role, p.label, p.multi_valued, s.subject FROM cells_ c JOIN prof p USING (tenant_id, "column") JOIN sub s USING (tenant_id)),
nm AS (SELECT record_id, tenant_id, min_by(value, ordinal) AS name, min(label) AS label FROM cc WHERE "column" = subject GROUP BY ALL),
ot AS (SELECT record_id, tenant_id, unnest(CASE WHEN multi_valued THEN {c._values('value', tx.NULLS_RECORD)} ELSE [value] END) AS alias FROM cc WHERE role = 'alias')
SELECT DISTINCT tenant_id, {c._ident('label', 'name')} AS entity_id, alias FROM ot JOIN nm USING (record_id, tenant_id) WHERE lower(alias) <> lower(name)"""
