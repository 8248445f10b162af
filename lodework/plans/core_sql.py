"""SQL of the core queries, for an independent engine over the same tables."""

from __future__ import annotations

from lodework.functions import text as tx
from lodework.functions import vocabulary as vo
from lodework.operators import chunking, guards, proposals, structured, understand

_Q = "'" + "', '".join(tx.STOPWORDS) + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\p{{L}}\p{{N}}\p{{M}}_\s-]', '', 'g'), '[\s-]+', '_', 'g'), '_')"


def _ident(label: str, name: str) -> str:
    return f"'canon_' || lower({label}) || '_' || {_norm(name)}"


_CHUNKS = "c AS (SELECT tenant_id, chunk_no AS doc, max(chunk_id) AS chunk_id, max(text) AS text FROM lexical_docs GROUP BY ALL HAVING max(text) IS NOT NULL)"
_TERMS = r"list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_][a-z0-9]+)*'), lambda t: t NOT IN (" + _Q + "))"
_TOKENS = r"CAST(CASE WHEN len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_\s]')) = 0 THEN 0 ELSE greatest(1, floor(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_\s]')) * 1.3)) END AS INT)"
_INDEX = f"""WITH {_CHUNKS},
w AS (SELECT tenant_id, doc, {_TERMS.format('text')} AS w FROM c),
l AS (SELECT tenant_id, doc, w, len(w) AS doc_len FROM w WHERE len(w) > 0),
p AS (SELECT tenant_id, doc, doc_len, term, count(*) AS tf FROM (SELECT tenant_id, doc, doc_len, unnest(w) AS term FROM l) GROUP BY ALL),
s AS (SELECT tenant_id, count(*) AS n_docs, avg(doc_len) AS avg_len FROM l GROUP BY 1),
df AS (SELECT tenant_id, term, count(*) AS df FROM p GROUP BY ALL)"""


def _bm25(name: str, column: str) -> str:
    return f""",
{name}_q AS (SELECT query_id, tenant_id, term, count(*) AS times FROM (SELECT query_id, tenant_id, unnest({_TERMS.format(column)}) AS term FROM queries) GROUP BY ALL),
{name} AS (SELECT query_id, tenant_id, doc, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) AS score
  FROM {name}_q JOIN df USING (tenant_id, term) JOIN p USING (tenant_id, term) JOIN s USING (tenant_id) GROUP BY ALL),
{name}_r AS (SELECT query_id, tenant_id, doc, score, round(score, 6) AS rs, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) AS rank FROM {name})"""


_LISTS = _INDEX + _bm25("a", "query_text") + _bm25("b", "passage") + """,
lists AS (SELECT query_id, doc, 'text' AS path, rank, 1 AS list_no FROM a_r WHERE rank <= 20 UNION ALL SELECT query_id, doc, 'passage', rank, 2 FROM b_r WHERE rank <= 20)"""


def _fused(weight: str, k: int) -> str:
    return f""",
f AS (SELECT query_id, doc, round(sum({weight} / (60 + rank)), 6) AS score, CASE WHEN count(DISTINCT path) > 1 THEN 'fused' ELSE min(path) END AS path FROM lists GROUP BY ALL),
fr AS (SELECT query_id, doc, score, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM f)"""


_RELEVANT = "rel AS (SELECT DISTINCT q.query_id, c.doc FROM (SELECT query_id, tenant_id, unnest(expected_entities) AS entity_id FROM queries) q JOIN mentions m USING (tenant_id, entity_id) JOIN c ON m.chunk_id = c.chunk_id)"


def _metrics(name: str) -> str:
    return f""", {_RELEVANT},
rn AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
g AS (SELECT r.query_id, count(*) AS n_returned, count(rel.doc) AS n_hit, min(CASE WHEN rel.doc IS NOT NULL THEN rank END) AS first_hit, sum(CASE WHEN rel.doc IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
  FROM {name}_r r LEFT JOIN rel ON r.query_id = rel.query_id AND r.doc = rel.doc WHERE rank <= 10 GROUP BY 1),
m AS (SELECT q.query_id, category, coalesce(n_relevant, 0) AS n_relevant,
  round(CASE WHEN coalesce(n_relevant, 0) = 0 THEN 1.0 ELSE coalesce(n_hit, 0) / n_relevant END, 6) AS recall,
  round(CASE WHEN coalesce(n_returned, 0) = 0 THEN 0.0 ELSE n_hit / n_returned END, 6) AS precision,
  round(coalesce(1 / first_hit, 0), 6) AS mrr,
  round(CASE WHEN coalesce(n_relevant, 0) = 0 THEN 1.0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n_relevant, 10) AS INT) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg,
  CASE WHEN coalesce(n_relevant, 0) = 0 OR coalesce(n_hit, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit
  FROM queries q LEFT JOIN rn USING (query_id) LEFT JOIN g USING (query_id))"""


_USABLE = "i AS (SELECT tenant_id, chunk_no AS doc, CAST(vector AS DOUBLE[]) AS v FROM indexed_chunks WHERE embedding_version = 'sim-embed/96/v2' AND len(vector) = 96 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0)"


def _knn(source: str, group: str) -> str:
    on = f"q.{group} IS NOT DISTINCT FROM i.{group} AND" if group else ""
    return f"""WITH {source},
z AS (SELECT q.doc AS query_id, i.doc AS doc, round(list_cosine_similarity(q.v, i.v), 6) AS s FROM i q JOIN i ON {on} q.doc % 50 = 0 AND q.doc <> i.doc WHERE list_inner_product(q.v, q.v) > 0 AND list_inner_product(i.v, i.v) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS rank FROM z WHERE s > 0)
SELECT query_id, doc, round(s, 4) AS score, rank FROM r WHERE rank <= 10"""


_SEEDS = "seeds AS (SELECT DISTINCT query_id, tenant_id, unnest(expected_entities) AS entity_id FROM queries)"


def _traverse(depth: int, types: list[str] | None, limit: int | None = 100, seeds: str = _SEEDS) -> str:
    hubs = "AND upper(edge_type) NOT IN ('HAS_ATTRIBUTE', 'ASSOCIATED_WITH')" if depth > 1 else ""
    only = f"AND upper(edge_type) IN {_in(types)}" if types else ""
    sql = f"""{seeds},
e0 AS (SELECT tenant_id, source_id, target_id FROM edges WHERE source_id <> target_id {hubs} {only}),
e AS (SELECT DISTINCT tenant_id, source_id AS x, target_id AS y FROM e0 UNION SELECT DISTINCT tenant_id, target_id, source_id FROM e0),
h0 AS (SELECT query_id, tenant_id, entity_id, 0 AS hop FROM seeds)"""
    for i in range(1, depth + 1):
        sql += f""",
h{i} AS (SELECT * FROM h{i - 1} UNION ALL (SELECT DISTINCT h.query_id, h.tenant_id, e.y, {i} FROM h{i - 1} h JOIN e ON h.tenant_id = e.tenant_id AND h.entity_id = e.x WHERE h.hop = {i - 1} AND NOT EXISTS (SELECT 1 FROM h{i - 1} o WHERE o.query_id = h.query_id AND o.tenant_id = h.tenant_id AND o.entity_id = e.y)))"""
    cut = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, entity_id) <= {limit}" if limit else ""
    return sql + f",\nnodes AS (SELECT query_id, tenant_id, entity_id, hop FROM h{depth} {cut})"


_RECOVER = """,
rec AS (SELECT query_id, tenant_id, source_id, edge_type, target_id FROM (SELECT DISTINCT tenant_id, source_id, upper(edge_type) AS edge_type, target_id FROM edges) e
  JOIN nodes a USING (tenant_id) JOIN nodes b USING (tenant_id, query_id) WHERE a.entity_id = e.source_id AND b.entity_id = e.target_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY source_id, edge_type, target_id) <= 100)"""
_PRUNE = """,
deg AS (SELECT query_id, entity_id, count(*) AS degree FROM (SELECT query_id, source_id AS entity_id FROM rec UNION ALL SELECT query_id, target_id FROM rec) GROUP BY ALL),
kept AS (SELECT n.query_id, n.entity_id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY n.query_id ORDER BY (hop = 0) DESC, coalesce(degree, 0) DESC, n.entity_id) AS rank FROM nodes n LEFT JOIN deg USING (query_id, entity_id) QUALIFY rank <= 10)"""
_VERTICES = "v AS (SELECT tenant_id, entity_id, entity_name, label FROM entities WHERE entity_id IS NOT NULL UNION ALL SELECT tenant_id, entity_id, entity_name, label FROM subjects)"
_ADJACENT = _VERTICES + """,
k AS (SELECT DISTINCT tenant_id, entity_id FROM v),
e AS (SELECT ed.tenant_id, source_id, target_id FROM edges ed JOIN k a ON a.tenant_id = ed.tenant_id AND a.entity_id = source_id JOIN k b ON b.tenant_id = ed.tenant_id AND b.entity_id = target_id WHERE source_id <> target_id),
adj AS MATERIALIZED (SELECT tenant_id, source_id AS x, target_id AS y FROM e UNION SELECT tenant_id, target_id, source_id FROM e)"""


def _rounds(n: int) -> str:
    sql = ",\nl0 AS MATERIALIZED (SELECT DISTINCT tenant_id, x AS entity_id, x AS community FROM adj)"
    for i in range(1, n + 1):
        sql += f""",
l{i} AS MATERIALIZED (SELECT tenant_id, entity_id, community FROM (
  SELECT a.tenant_id, a.x AS entity_id, n.community, count(*) AS n, o.community AS own FROM adj a JOIN l{i - 1} n ON n.tenant_id = a.tenant_id AND n.entity_id = a.y JOIN l{i - 1} o ON o.tenant_id = a.tenant_id AND o.entity_id = a.x GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY n DESC, community <> own, community) = 1)"""
    return sql


_RANKED = f"""{_ADJACENT}{_rounds(12)}, sz AS (SELECT tenant_id, community, count(*) AS members FROM l12 GROUP BY ALL HAVING count(*) >= 3),
ins AS (SELECT e.tenant_id, a.community, count(*) AS n FROM (SELECT DISTINCT tenant_id, source_id, upper(edge_type), target_id FROM edges WHERE source_id <> target_id) e JOIN l12 a ON a.tenant_id = e.tenant_id AND a.entity_id = source_id JOIN l12 b ON b.tenant_id = e.tenant_id AND b.entity_id = target_id WHERE a.community = b.community GROUP BY ALL),
ranked AS (SELECT tenant_id, community, members, coalesce(n, 0) AS internal_edges, row_number() OVER (PARTITION BY tenant_id ORDER BY members DESC, community) AS position, round(coalesce(n, 0) / members, 4) AS density FROM sz LEFT JOIN ins USING (tenant_id, community) QUALIFY position <= 200)"""
_REPORTS = """nm AS (SELECT tenant_id, entity_id, min(entity_name) AS name, min(label) AS label FROM v GROUP BY ALL),
dg AS (SELECT tenant_id, x AS entity_id, count(*) AS degree FROM adj GROUP BY ALL),
mem AS (SELECT l.tenant_id, l.entity_id, l.community, members, internal_edges, coalesce(name, l.entity_id) AS name, coalesce(label, 'Entity') AS label, row_number() OVER (PARTITION BY l.tenant_id, l.community ORDER BY degree DESC NULLS LAST, l.entity_id) AS r
  FROM l12 l JOIN ranked USING (tenant_id, community) LEFT JOIN dg ON dg.tenant_id = l.tenant_id AND dg.entity_id = l.entity_id LEFT JOIN nm ON nm.tenant_id = l.tenant_id AND nm.entity_id = l.entity_id),
lst AS (SELECT tenant_id, community, members, internal_edges, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 15) AS who, string_agg(name, ' & ' ORDER BY r) FILTER (WHERE r <= 2) AS title FROM mem GROUP BY ALL),
knd AS (SELECT tenant_id, community, string_agg(n || ' ' || label, ', ' ORDER BY n DESC, label) AS what FROM (SELECT tenant_id, community, label, count(*) AS n FROM mem GROUP BY ALL) GROUP BY ALL),
tl AS (SELECT a.tenant_id, a.community, a.name || ' ' || lower(replace(d.edge_type, '_', ' ')) || ' ' || b.name AS line, row_number() OVER (PARTITION BY a.tenant_id, a.community ORDER BY source_id, d.edge_type, target_id) AS r
  FROM (SELECT DISTINCT tenant_id, source_id, upper(edge_type) AS edge_type, target_id FROM edges WHERE source_id <> target_id) d JOIN mem a ON a.tenant_id = d.tenant_id AND a.entity_id = source_id JOIN mem b ON b.tenant_id = d.tenant_id AND b.entity_id = target_id WHERE a.community = b.community),
ts AS (SELECT tenant_id, community, string_agg(line, '; ' ORDER BY r) AS told FROM tl WHERE r <= 6 GROUP BY ALL),
rep AS (SELECT tenant_id, community, substr(title, 1, 80) AS title, 'A group of ' || members || ' (' || what || ') with ' || internal_edges || ' relations.' || coalesce(' Key relations: ' || told || '.', '') || ' Members: ' || who || '.' AS summary, members FROM lst JOIN knd USING (tenant_id, community) LEFT JOIN ts USING (tenant_id, community))"""

_CELLS = f"""c0 AS (SELECT record_id, tenant_id, generate_subscripts(cells, 1) - 1 AS ordinal, unnest(cells) AS c FROM records),
cells_ AS (SELECT record_id, tenant_id, ordinal, c.column_name AS "column", trim(c.cell_value) AS value FROM c0 WHERE c.cell_value IS NOT NULL AND lower(trim(c.cell_value)) NOT IN {_in(tx.NULLS_COLUMN)} AND c.column_name IS NOT NULL)"""
_SPLIT = r"(?i)\s*[;,/|]\s*|\s+and\s+"


def _values(c: str, nulls: list[str]) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({c}, {_s(_SPLIT)}, chr(1), 'g'), chr(1)), lambda x: trim(x, ' .;,')), lambda x: lower(trim(x)) NOT IN {_in(nulls)})"


def _case(c: str, families: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {_s(p)}) THEN '{v}'" for p, v in families) + f" ELSE {default} END"


_PROFILE = f"""WITH {_CELLS},
mu AS (SELECT tenant_id, "column", bool_or(regexp_matches(value, {_s(_SPLIT)})) AS multi_valued, min(ordinal) AS ordinal FROM cells_ GROUP BY ALL),
ev AS (SELECT tenant_id, "column", multi_valued, unnest(CASE WHEN multi_valued THEN {_values('value', tx.NULLS_COLUMN)} ELSE [value] END) AS v FROM cells_ JOIN mu USING (tenant_id, "column")),
su AS (SELECT tenant_id, "column", multi_valued, count(*) AS occurrences, count(DISTINCT lower(v)) AS distinct_values, sum(length(v)) / count(*) AS mean, replace(lower("column"), '_', ' ') AS name FROM ev GROUP BY ALL),
ro AS (SELECT *, {_case('name', structured.ROLES, 'NULL')} AS hinted FROM su),
pr AS (SELECT *, CASE WHEN regexp_matches(name, {_s(structured.ALIAS)}) THEN 'alias' WHEN hinted = 'entity' AND mean > 80 THEN 'freetext' WHEN hinted IS NOT NULL THEN hinted
  WHEN mean > 80 THEN 'freetext' WHEN occurrences >= 20 AND distinct_values / occurrences > 0.95 THEN 'ignore' WHEN distinct_values <= 40 AND mean <= 40 THEN 'attribute' ELSE 'entity' END AS role FROM ro),
prof AS (SELECT tenant_id, "column", multi_valued, occurrences, distinct_values, round(mean, 4) AS mean_length, role, CASE WHEN role = 'attribute' THEN 'Attribute' WHEN role = 'entity' THEN {_case('name', structured.LABELS, "'Entity'")} ELSE 'Entity' END AS label FROM pr)"""
_SUBJECT = """,
po AS (SELECT p.*, m.ordinal FROM prof p JOIN mu m USING (tenant_id, "column")),
sub AS (SELECT tenant_id, "column" AS subject FROM po WHERE role = 'entity' QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY multi_valued, ordinal, "column") = 1)"""
_RECORDGRAPH = _PROFILE + _SUBJECT + f""",
cc AS (SELECT c.*, p.role, p.label, p.multi_valued, s.subject FROM cells_ c JOIN prof p USING (tenant_id, "column") JOIN sub s USING (tenant_id)),
nm AS (SELECT record_id, tenant_id, min_by(value, ordinal) AS subject_name, min(label) AS subject_label FROM cc WHERE "column" = subject GROUP BY ALL),
ot AS (SELECT record_id, tenant_id, "column", role, label, unnest(list_slice(CASE WHEN multi_valued THEN {_values('value', tx.NULLS_RECORD)} ELSE [value] END, 1, 8)) AS value FROM cc WHERE "column" <> subject AND role IN ('entity', 'attribute') AND length(value) <= 120),
bo AS (SELECT * FROM ot JOIN nm USING (record_id, tenant_id))"""

_LEAD, _TRAIL = understand.LEADING, understand.TRAILING
def _analyse(column: str) -> str:
    return rf"""WITH q0 AS (SELECT query_id, coalesce({column}, '') AS t FROM queries),
q1 AS (SELECT *, list_transform(regexp_extract_all(t, '\b[A-Z][a-zA-Z0-9''’\-]*(?:\s+[A-Z][a-zA-Z0-9''’\-]*)*'), lambda p: trim(regexp_replace(regexp_replace(p, {_s(_LEAD)}, ''), {_s(_TRAIL)}, ''))) AS runs0,
  list_filter(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9''’\-]*'), lambda w: length(w) >= 3 AND lower(w) NOT IN {_in(understand.STOP)}) AS words0 FROM q0),
q2 AS (SELECT *, list_filter(runs0, lambda p: length({_norm('p')}) > 1) AS runs1 FROM q1),
q3 AS (SELECT *, list_filter(runs1, lambda p, i: list_position(list_transform(runs1, lambda z: {_norm('z')}), {_norm('p')}) = i) AS runs2,
  list_filter(words0, lambda p, i: list_position(list_transform(words0, lambda z: {_norm('z')}), {_norm('p')}) = i) AS words1 FROM q2),
q4 AS (SELECT query_id, t, list_slice(CASE WHEN len(runs2) > 0 THEN runs2 ELSE words1 END, 1, 8) AS mentions,
  list_slice(list_filter(list_filter(regexp_extract_all(t, {_s(understand.IDENTIFIER)}), lambda w: length(w) >= 2 AND lower(w) NOT IN {_in(understand.STOP)}), lambda w: true), 1, 6) AS identifiers,
  regexp_matches(t, {_s(understand.GLOBAL)}) AS g, regexp_matches(t, {_s(understand.LOCAL)}) AS l, regexp_matches(t, {_s(understand.MULTIHOP)}) AS h,
  len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS n_words, len(regexp_extract_all(t, {_s(understand.QUOTED)})) AS quoted FROM q3),
q5 AS (SELECT *, CASE WHEN g THEN 3.0 ELSE 0.0 END + CASE WHEN len(mentions) = 0 THEN 1.0 ELSE 0.0 END AS global_score,
  round(CASE WHEN l THEN 1.5 ELSE 0.0 END + CASE WHEN len(mentions) > 0 AND NOT g THEN 1.0 + least(len(mentions), 3) * 0.3 ELSE 0.0 END + CASE WHEN n_words <= 3 AND len(mentions) > 0 THEN 0.5 ELSE 0.0 END + CASE WHEN h THEN 1.0 ELSE 0.0 END, 4) AS local_score,
  round(CASE WHEN quoted > 0 THEN 2.5 ELSE 0.0 END + CASE WHEN len(identifiers) > 0 THEN 1.5 ELSE 0.0 END + CASE WHEN n_words <= 3 AND len(mentions) > 0 THEN 0.8 ELSE 0.0 END, 4) AS lexical_score FROM q4),
q6 AS (SELECT *, greatest(global_score, local_score, lexical_score) AS best, list_sort([global_score, local_score, lexical_score], 'DESC')[2] AS second FROM q5),
an AS (SELECT query_id, mentions, identifiers, CASE WHEN h THEN 2 ELSE 1 END AS hops, global_score, local_score, lexical_score,
  CASE WHEN best <= 0 OR round(best - second, 4) < 0.75 THEN 'hybrid' WHEN global_score = best THEN 'global' WHEN local_score = best THEN 'local' ELSE 'lexical' END AS intent,
  round(CASE WHEN best <= 0 OR round(best - second, 4) < 0.75 THEN 0.4 ELSE least(1.0, best / 4) END, 4) AS confidence, len(mentions) > 0 OR len(identifiers) > 0 AS anchor FROM q6)"""


_ANALYSE = _analyse("query_text")


def _pick(local: str, lexical: str, hybrid: str, wide: str) -> str:
    return f"CASE intent WHEN 'local' THEN {local} WHEN 'lexical' THEN {lexical} WHEN 'hybrid' THEN {hybrid} ELSE {wide} END"


_GUARD = "CASE WHEN length(text) > 2000 THEN 'too long' " + " ".join(f"WHEN regexp_matches(text, {_s(p)}) THEN '{n}'" for p, n in guards.DANGEROUS) + " END"
_TYPES = sorted({t for x in vo.DOMAINS.values() for t in x["edges"]})
_TAIL = r"list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')"
_RECORDTEXT = f"list_filter(cells, lambda c: c.cell_value IS NOT NULL AND lower(trim(c.cell_value)) NOT IN {_in(tx.NULLS_CELL)})"
_ALPHA = r"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) ELSE 0.0 END"

SQL: dict[str, str] = {
    "normalized_names": f"SELECT vertex_id, {_norm('entity_name')} AS norm, {_ident('label', 'entity_name')} AS canonical, lower(label) AS slug FROM entities",
    "text_measures": f"WITH {_CHUNKS} SELECT doc, {_TOKENS.format('text')} AS tokens, round({_ALPHA}, 6) AS alpha, len(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS n_sentences, array_to_string(list_slice({_TAIL}, greatest(1, len({_TAIL}) - 14), len({_TAIL})), ' ') AS tail, len({_TERMS.format('text')}) AS n_terms FROM c",
    "null_tokens": f"SELECT c.column_name AS column_name, count(*) AS n, count(*) FILTER (WHERE c.cell_value IS NULL OR lower(trim(c.cell_value)) IN {_in(tx.NULLS_CELL)}) AS n_null, count(*) FILTER (WHERE c.cell_value IS NULL OR lower(trim(c.cell_value)) IN {_in(tx.NULLS_COLUMN)}) AS n_null_wide FROM (SELECT unnest(cells) AS c FROM records) GROUP BY 1",
    "hash_embedding": f"""WITH {_CHUNKS}, t AS (SELECT doc, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM c),
b AS (SELECT doc, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 384 AS b0, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % 384 AS b1, CASE WHEN CAST(('0x' || substr(h, 17, 2)) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END AS s FROM t),
x AS (SELECT doc, bucket, sum(w) AS w FROM (SELECT doc, b0 AS bucket, s AS w FROM b UNION ALL SELECT doc, b1, s * 0.5 FROM b) GROUP BY ALL HAVING sum(w) <> 0)
SELECT doc, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM x""",
    "key_fingerprints": "SELECT entity_id, substr(sha256(entity_id), 1, 12) AS fingerprint FROM subjects",
    "bm25_index_stats": _INDEX + " SELECT s.tenant_id, n_docs, (SELECT count(*) FROM df WHERE df.tenant_id = s.tenant_id) AS n_terms, round(avg_len, 1) AS avg_len FROM s",
    "bm25_top10": _INDEX + _bm25("a", "query_text") + " SELECT query_id, doc, rank, round(rs / max(rs) OVER (PARTITION BY query_id), 4) AS relative, round(score, 4) AS score FROM a_r WHERE rank <= 10",
    "bm25_phrase_boost": _INDEX + _bm25("a", "passage") + """, h AS (SELECT a.query_id, a.doc, a.score, len(list_filter(coalesce(q.expected_text, []), lambda p: contains(lower(c.text), lower(p)))) AS hits FROM a JOIN c USING (doc) JOIN queries q ON q.query_id = a.query_id)
SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY round(score * (1 + 0.5 * hits), 6) DESC, doc) AS rank, hits FROM h QUALIFY rank <= 5""",
    "knn_exact": _knn(_USABLE, "tenant_id"),
    "knn_embeddings": _knn("i AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)", ""),
    "rrf_fused": _LISTS + _fused("1.0", 10) + " SELECT query_id, doc, rank, path, score FROM fr WHERE rank <= 10",
    "rrf_weighted": _LISTS + _fused("CASE path WHEN 'text' THEN 0.7 ELSE 1.6 END", 10) + " SELECT query_id, doc, rank, path, score FROM fr WHERE rank <= 10",
    "lists_first_seen": _LISTS + """, u AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY list_no, rank) = 1)
SELECT query_id, doc, path, row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, doc) AS rank FROM u""",
    "lexical_rerank": _LISTS + _fused("1.0", 20) + """, rr AS (SELECT f.query_id, f.doc, f.rank AS before, list_distinct(regexp_extract_all(lower(q.query_text), '[a-z0-9]+')) AS qt, regexp_extract_all(lower(c.text), '[a-z0-9]+') AS tt FROM fr f JOIN queries q USING (query_id) JOIN c USING (doc) WHERE rank <= 20),
rs AS (SELECT query_id, doc, before, CASE WHEN len(qt) > 0 AND len(tt) > 0 THEN round(0.75 * len(list_intersect(qt, list_distinct(tt))) / len(qt) + 0.25 * least(len(list_intersect(qt, list_distinct(tt))) / sqrt(len(tt)), 1.0), 4) ELSE 0.0 END AS score FROM rr)
SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, doc) AS rank, score FROM rs QUALIFY rank <= 5""",
    "search_fallback": _LISTS + """, f AS (SELECT query_id, doc, path, rank FROM lists WHERE path = 'text' AND rank <= 3)
SELECT * FROM f UNION ALL SELECT query_id, doc, 'fallback' AS path, rank FROM lists WHERE path = 'passage' AND rank <= 3 AND query_id NOT IN (SELECT query_id FROM f)""",
    "relevant_chunks": f"WITH {_CHUNKS}, {_RELEVANT} SELECT query_id, doc FROM rel",
    "marker_counts": "SELECT marker, count(*) AS n FROM (SELECT DISTINCT unnest(expected_text) AS marker FROM queries) JOIN documents ON contains(lower(text), lower(marker)) GROUP BY 1",
    "ranking_metrics": _INDEX + _bm25("a", "query_text") + _metrics("a") + " SELECT query_id, n_relevant, recall, precision, mrr, ndcg, CAST(hit AS DOUBLE) AS hit FROM m",
    "metrics_by_category": _INDEX + _bm25("a", "query_text") + _metrics("a") + " SELECT category, CAST(grouping(category) AS INT) AS is_total, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit FROM m GROUP BY GROUPING SETS ((category), ())",
    "gate_report": _INDEX + _bm25("a", "query_text") + _metrics("a") + """, va AS (SELECT 'recall' AS name, round(avg(recall), 4) AS value FROM m UNION ALL SELECT 'mrr', round(avg(mrr), 4) FROM m),
ru AS (SELECT * FROM (VALUES ('recall', '>=', CAST(0.7 AS DOUBLE), false), ('mrr', '>=', 0.6, false), ('isolation', '>=', 1.0, true)) t(name, op, target, hard))
SELECT name, op, target, hard, value, coalesce(value >= target, false) AS passed FROM ru LEFT JOIN va USING (name)""",
    "stage_report": "SELECT event_type AS step, count(*) AS calls, round(avg(value), 4) AS mean, round(quantile_disc(value, 0.5), 4) AS p50, round(quantile_disc(value, 0.95), 4) AS p95, round(quantile_disc(value, 0.99), 4) AS p99, round(sum(value) / (SELECT sum(value) FROM events), 4) AS share FROM events GROUP BY 1",
    "telemetry_grid": "WITH t AS (SELECT CAST(user_id AS VARCHAR) AS request_id, round(sum(value), 4) AS total_ms FROM events GROUP BY 1), s AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'never_run']) AS step), p AS (SELECT CAST(user_id AS VARCHAR) AS request_id, event_type AS step, sum(value) AS v FROM events GROUP BY ALL) SELECT request_id, step, total_ms, round(coalesce(v, 0), 4) AS latency_ms FROM t CROSS JOIN s LEFT JOIN p USING (request_id, step)",
    "slowest_requests": "WITH t AS (SELECT CAST(user_id AS VARCHAR) AS request_id, round(sum(value), 4) AS total_ms FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT request_id, total_ms, coalesce(round(sum(value) FILTER (WHERE event_type = 'click'), 4), 0) AS click, coalesce(round(sum(value) FILTER (WHERE event_type = 'view'), 4), 0) AS view, coalesce(round(sum(value) FILTER (WHERE event_type = 'purchase'), 4), 0) AS purchase, coalesce(round(sum(value) FILTER (WHERE event_type = 'signup'), 4), 0) AS signup, coalesce(round(sum(value) FILTER (WHERE event_type = 'error'), 4), 0) AS error FROM t JOIN events ON CAST(user_id AS VARCHAR) = request_id GROUP BY 1, 2",
    "edge_reasons": f"""WITH {_VERTICES}, k AS (SELECT DISTINCT tenant_id, entity_id FROM v),
r AS (SELECT CASE WHEN NOT coalesce(upper(edge_type) IN {_in(_TYPES)}, false) THEN 'not_in_schema' WHEN coalesce(e.confidence, 1.0) < 0.8 THEN 'low_confidence' WHEN a.entity_id IS NULL OR b.entity_id IS NULL THEN 'dangling' WHEN source_id = target_id THEN 'self_loop' ELSE 'accepted' END AS reason
FROM edges e LEFT JOIN k a ON a.tenant_id = e.tenant_id AND a.entity_id = source_id LEFT JOIN k b ON b.tenant_id = e.tenant_id AND b.entity_id = target_id) SELECT reason, count(*) AS n FROM r GROUP BY 1""",
    "entity_reasons": "SELECT tenant_id, CASE WHEN coalesce(trim(entity_id), '') = '' THEN 'missing_id' WHEN coalesce(trim(entity_name), '') = '' THEN 'missing_name' WHEN NOT coalesce(label IN ('Person', 'Studio', 'Organization', 'Film', 'Model'), false) THEN 'label_not_in_schema' ELSE 'accepted' END AS reason, count(*) AS n FROM entities GROUP BY ALL",
    "edges_deduped": "SELECT tenant_id, source_id, upper(edge_type) AS edge_type, target_id, max(coalesce(confidence, 1.0)) AS confidence, count(*) AS support_count FROM edges WHERE source_id <> target_id GROUP BY ALL",
    "entities_canonical": "SELECT tenant_id, entity_id, max_by(label, (coalesce(confidence, -1.0), vertex_id)) AS label, max_by(entity_name, (coalesce(confidence, -1.0), vertex_id)) AS entity_name, CAST(sum(coalesce(mention_count, 0)) AS BIGINT) AS mention_count, max(confidence) AS confidence FROM entities WHERE entity_id IS NOT NULL GROUP BY ALL",
    "entities_upserted": "WITH n AS (SELECT tenant_id, entity_id, max_by(label, (coalesce(confidence, -1.0), vertex_id)) AS label, max_by(entity_name, (coalesce(confidence, -1.0), vertex_id)) AS entity_name FROM entities WHERE entity_id IS NOT NULL GROUP BY ALL) SELECT * FROM n UNION ALL SELECT tenant_id, entity_id, label, entity_name FROM subjects s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tenant_id IS NOT DISTINCT FROM s.tenant_id AND n.entity_id = s.entity_id)",
    "traverse_1hop": "WITH " + _traverse(1, None) + " SELECT * FROM nodes",
    "traverse_2hop": "WITH " + _traverse(2, None) + " SELECT * FROM nodes",
    "traverse_3hop_typed": "WITH " + _traverse(3, _TYPES) + " SELECT * FROM nodes",
    "recovered_edges": "WITH " + _traverse(2, None) + _RECOVER + " SELECT * FROM rec",
    "graph_to_text": "WITH " + _traverse(1, None) + """, f AS (SELECT query_id, tenant_id, entity_id FROM nodes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, entity_id) <= 25),
g AS (SELECT query_id, chunk_id, count(*) AS n_entities FROM (SELECT DISTINCT tenant_id, entity_id, chunk_id FROM mentions WHERE entity_id IS NOT NULL AND chunk_id IS NOT NULL) JOIN f USING (tenant_id, entity_id) GROUP BY ALL)
SELECT query_id, chunk_id, n_entities, row_number() OVER (PARTITION BY query_id ORDER BY n_entities DESC, chunk_id) AS rank FROM g QUALIFY rank <= 30""",
    "text_to_graph": _INDEX + _bm25("a", "passage") + """, h AS (SELECT a_r.query_id, a_r.tenant_id, c.chunk_id FROM a_r JOIN c USING (doc) WHERE rank <= 8),
g AS (SELECT query_id, tenant_id, entity_id, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT DISTINCT tenant_id, chunk_id, entity_id FROM mentions WHERE entity_id IS NOT NULL) JOIN h USING (tenant_id, chunk_id) GROUP BY ALL)
SELECT query_id, tenant_id, entity_id, n_chunks, row_number() OVER (PARTITION BY query_id ORDER BY n_chunks DESC, entity_id) AS rank FROM g QUALIFY rank <= 60""",
    "pruned_nodes": "WITH " + _traverse(2, None) + _RECOVER + _PRUNE + " SELECT query_id, entity_id, degree, rank FROM kept",
    "pruned_edges": "WITH " + _traverse(2, None) + _RECOVER + _PRUNE + " SELECT r.query_id, source_id, edge_type, target_id FROM rec r JOIN kept a ON a.query_id = r.query_id AND a.entity_id = source_id JOIN kept b ON b.query_id = r.query_id AND b.entity_id = target_id",
    "graph_passages": "WITH " + _traverse(2, None) + _RECOVER + f""", {_VERTICES}, nm AS (SELECT tenant_id, entity_id, min(entity_name) AS entity_name FROM v GROUP BY ALL),
d AS (SELECT tenant_id, source_id, upper(edge_type) AS edge_type, target_id, max(coalesce(confidence, 1.0)) AS confidence FROM edges WHERE source_id <> target_id GROUP BY ALL),
x AS (SELECT r.query_id, r.source_id, r.edge_type, r.target_id, confidence, a.entity_name AS sn, b.entity_name AS tn, EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = r.query_id AND s.entity_id IN (r.source_id, r.target_id)) AS at_seed
FROM rec r JOIN d USING (tenant_id, source_id, edge_type, target_id) JOIN nm a ON a.tenant_id = r.tenant_id AND a.entity_id = r.source_id JOIN nm b ON b.tenant_id = r.tenant_id AND b.entity_id = r.target_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY at_seed DESC, confidence DESC, source_id, edge_type, target_id) AS rank, concat_ws(' ', sn, lower(replace(edge_type, '_', ' ')), tn || '.') AS passage FROM x QUALIFY rank <= 5""",
    "entity_mentions": "SELECT tenant_id, entity_id, count(DISTINCT mention_id) AS mentions, count(DISTINCT chunk_id) AS chunks, max(seen_at) AS last_seen FROM mentions WHERE entity_id IS NOT NULL GROUP BY ALL",
    "adjacency": f"WITH {_ADJACENT} SELECT * FROM adj",
    "communities": f"WITH {_ADJACENT}{_rounds(12)} SELECT * FROM l12",
    "communities_ranked": f"WITH {_RANKED} SELECT * FROM ranked",
    "community_reports": f"""WITH {_RANKED}, {_REPORTS} SELECT tenant_id, community, title, summary, members FROM rep""",
    "community_report_chunks": f"""WITH {_RANKED}, {_REPORTS} SELECT tenant_id, concat_ws(':', 'community', tenant_id, community) AS chunk_id, 'communities' AS doc, 'community_report' AS kind, title || chr(10) || summary AS text, 'Community report · ' || title AS citation FROM rep""",
    "document_headings": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE trim(text) <> '')
SELECT doc_id, count(*) AS headings, CAST(min(length(regexp_extract(line, '^[ \t]{0,3}(#{1,6})', 1))) AS INT) AS top_level FROM l WHERE regexp_matches(line, '^[ \t]{0,3}#{1,6}[ \t]+\S') GROUP BY 1""",
    "block_issues": f"""WITH b AS (SELECT block_no, kind, text, {_TOKENS.format('text')} AS tk, coalesce(trim(text), '') = '' AS blank, {_ALPHA} AS alpha FROM blocks),
x AS (SELECT block_no, list_filter([CASE WHEN blank THEN 'empty:reject' END, CASE WHEN NOT blank AND tk < 8 AND kind <> 'record' THEN 'too_short:reject' END, CASE WHEN regexp_matches(trim(text), {_s(chunking.BOILERPLATE)}) THEN 'boilerplate:reject' END, CASE WHEN NOT blank AND alpha < 0.35 THEN CASE WHEN kind = 'prose' THEN 'low_alpha:reject' ELSE 'low_alpha:warn' END END, CASE WHEN tk > 1800 THEN 'oversized:warn' END], lambda z: z IS NOT NULL) AS i FROM b)
SELECT block_no, array_to_string(i, ',') AS issues, len(list_filter(i, lambda z: contains(z, ':reject'))) = 0 AS valid FROM x""",
    "sibling_links": "WITH b AS (SELECT block_no, tenant_id, doc_key, block_pos, doc_key || '_c' || block_pos AS chunk_id FROM blocks WHERE doc_key IS NOT NULL) SELECT block_no, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM b WINDOW w AS (PARTITION BY tenant_id, doc_key ORDER BY block_pos)",
    "table_chunks": """WITH r AS (SELECT block_no, table_headers AS h, generate_subscripts(table_rows, 1) - 1 AS pos, unnest(table_rows) AS cells FROM blocks WHERE kind = 'table'),
g AS (SELECT block_no, CAST(floor(pos / 20) AS INT) AS part, count(*) AS n_rows, string_agg(array_to_string(list_transform(cells, lambda c: coalesce(c, '')), ' | '), chr(10) ORDER BY pos) AS body, any_value(h) AS h FROM r GROUP BY ALL)
SELECT block_no, part, n_rows, CASE WHEN len(h) > 0 THEN array_to_string(h, ' | ') || chr(10) ELSE '' END || body AS text FROM g""",
    "record_blocks": f"SELECT record_id, tenant_id, len({_RECORDTEXT}) AS n_fields, array_to_string(list_transform({_RECORDTEXT}, lambda c: c.column_name || ': ' || trim(c.cell_value)), chr(10)) AS text FROM records WHERE len({_RECORDTEXT}) > 0",
    "block_citations": r"""SELECT block_no, concat_ws(' · ', nullif(regexp_extract(source_uri, '([^/\\]+)$', 1), ''), 'p.' || page, 'row ' || row_index, CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') END) AS citation,
CASE WHEN kind = 'prose' AND len(section_path) > 0 THEN array_to_string(section_path, ' > ') || chr(10) || chr(10) || text ELSE text END AS embedded FROM blocks""",
    "document_summary": "SELECT tenant_id, doc_key, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("heading", "prose", "list", "table", "code", "caption", "record")) + ", CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, count(*) AS n_blocks FROM blocks GROUP BY ALL",
    "column_profiles": _PROFILE + ' SELECT tenant_id, "column", multi_valued, occurrences, distinct_values, mean_length, role, label FROM prof',
    "record_edges": _RECORDGRAPH + f""", ee AS (SELECT DISTINCT tenant_id, {_ident('subject_label', 'subject_name')} AS source_id, CASE WHEN role = 'attribute' THEN 'HAS_ATTRIBUTE' ELSE {_case("replace(lower(\"column\"), '_', ' ')", structured.EDGES, "'ASSOCIATED_WITH'")} END AS edge_type, {_ident('label', 'value')} AS target_id, record_id, CAST(1.0 AS DOUBLE) AS confidence FROM bo)
SELECT * FROM ee WHERE source_id <> target_id""",
    "record_vertices": _RECORDGRAPH + f""" SELECT tenant_id, entity_id, label, min(name) AS name FROM (SELECT tenant_id, {_ident('subject_label', 'subject_name')} AS entity_id, subject_label AS label, subject_name AS name FROM nm UNION ALL SELECT tenant_id, {_ident('label', 'value')}, label, value FROM bo) GROUP BY ALL""",
    "records_verbalized": _PROFILE + _SUBJECT + """, li AS (SELECT c.record_id, c.ordinal, CASE WHEN c."column" = subject THEN 0 ELSE 1 END AS f, CASE WHEN c."column" = subject THEN '# ' || value ELSE c."column" || ': ' || value END AS line FROM cells_ c JOIN prof p USING (tenant_id, "column") LEFT JOIN sub USING (tenant_id) WHERE role <> 'ignore')
SELECT record_id, string_agg(line, chr(10) ORDER BY f, ordinal, line) AS text FROM li GROUP BY 1""",
    "resolution_matches": f"""WITH n0 AS (SELECT tenant_id, label, {_norm('entity_name')} AS norm, vertex_id FROM entities WHERE entity_name IS NOT NULL),
n AS (SELECT tenant_id, label, norm, min(vertex_id) AS id FROM n0 WHERE norm <> '' GROUP BY ALL),
k AS (SELECT *, unnest(list_distinct(list_concat([label || ':' || substr(norm, 1, 3)], list_transform(list_filter(string_split(norm, '_'), lambda t: length(t) >= 4), lambda t: label || ':tok:' || t)))) AS key FROM n),
c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.norm AS norm_a, b.norm AS norm_b FROM k a JOIN k b ON a.tenant_id = b.tenant_id AND a.key = b.key AND a.id < b.id)
SELECT a, b, norm_a, norm_b, round(jaro_winkler_similarity(strip_accents(norm_a), strip_accents(norm_b)), 4) AS score FROM c WHERE round(jaro_winkler_similarity(strip_accents(norm_a), strip_accents(norm_b)), 4) >= 0.85""",
    "mentions_remapped": f"""WITH e AS (SELECT tenant_id, entity_id, min({_ident('label', 'entity_name')}) AS canonical_id FROM entities WHERE entity_id IS NOT NULL GROUP BY ALL)
SELECT DISTINCT m.tenant_id, coalesce(canonical_id, m.entity_id) AS entity_id, chunk_id FROM mentions m LEFT JOIN e ON e.tenant_id = m.tenant_id AND e.entity_id = m.entity_id WHERE m.entity_id IS NOT NULL AND chunk_id IS NOT NULL""",
    "query_analysis": _ANALYSE + " SELECT query_id, array_to_string(mentions, '|') AS mentions, array_to_string(identifiers, '|') AS identifiers, hops, CAST(global_score AS DOUBLE) AS global_score, CAST(local_score AS DOUBLE) AS local_score, CAST(lexical_score AS DOUBLE) AS lexical_score, intent, CAST(confidence AS DOUBLE) AS confidence FROM an",
    "query_plans": _ANALYSE + f""" SELECT query_id, intent, true AS use_vector, {_pick('true', 'true', 'true', 'false')} AS use_lexical, {_pick('anchor', 'anchor', 'anchor', 'false')} AS use_graph, {_pick('false', 'false', 'NOT anchor', 'true')} AS use_community, {_pick('true', 'false', 'anchor', 'false')} AS use_expansion,
{_pick('20', '10', '20', '20')} AS vector_k, {_pick('20', '20', '20', '0')} AS lexical_k, {_pick('least(hops + 1, 3)', '1', 'least(hops + 1, 3)', '0')} AS graph_depth, {_pick('CASE WHEN hops > 1 THEN 2 ELSE 1 END', '0', '1', '0')} AS expansion_hops,
CAST({_pick('1.0', '0.7', '1.0', '1.0')} AS DOUBLE) AS w_vector, CAST({_pick('0.8', '1.6', '1.0', '0.0')} AS DOUBLE) AS w_lexical, CAST({_pick('1.4', '0.6', '1.0', '0.0')} AS DOUBLE) AS w_graph, CAST({_pick('0.0', '0.0', '0.8', '1.5')} AS DOUBLE) AS w_community FROM an""",
    "context_resolved": """WITH t AS (SELECT tenant_id AS conv_id, query_id AS turn, CASE WHEN query_id % 14 = 0 THEN 'what about it?' WHEN query_id % 7 = 0 THEN 'more' ELSE query_text END AS text FROM queries),
b AS (SELECT *, trim(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS before, CASE WHEN turn % 14 = 0 THEN 'anaphora_without_antecedent' WHEN turn % 7 = 0 THEN 'continuation_without_prior_turn' END AS reason FROM t)
SELECT conv_id, turn, text, reason, CASE WHEN reason IS NULL OR before IS NULL OR before = '' THEN text ELSE before END AS resolved_text FROM b""",
    "input_guard": f"SELECT doc_id, violation FROM (SELECT doc_id, {_GUARD} AS violation FROM documents) WHERE violation IS NOT NULL",
    "tenant_purity": "SELECT m.tenant_id, count(*) AS n, count(*) FILTER (WHERE m.tenant_id <> c.tenant_id) AS foreign_rows FROM mentions m JOIN indexed_chunks c USING (chunk_id) WHERE m.entity_id IS NOT NULL GROUP BY 1",
    "rate_limit_window": "SELECT event_id, count(*) OVER w AS arrivals, count(*) OVER w > 3 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)",
    "latency_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS step, count(*) AS calls, round(sum(value) / count(*), 6) AS mean_value FROM events GROUP BY ALL",
    "coerced_labels": "SELECT vertex_id, CASE WHEN label IN " + _in(vo.DOMAINS["generic"]["labels"]) + " THEN label " + " ".join(f"WHEN lower(label) = '{k}' THEN '{v}'" for k, v in [*((a.lower(), a) for a in vo.DOMAINS["generic"]["labels"]), *proposals.LABELS.items()]) + " ELSE 'Entity' END AS label FROM entities",
    "coerced_edges": "SELECT edge_type, CASE WHEN replace(upper(edge_type), '-', '_') IN " + _in(vo.DOMAINS["generic"]["edges"]) + " THEN upper(edge_type) " + " ".join(f"WHEN lower(edge_type) = '{k}' THEN '{v}'" for k, v in proposals.RELATIONS.items()) + " END AS coerced, count(*) AS n FROM edges GROUP BY ALL",
    "passed_cases": _INDEX + _bm25("a", "passage") + """, h AS (SELECT a_r.query_id, lower(string_agg(text, ' ' ORDER BY text)) AS joined, count(*) AS n FROM a_r JOIN c USING (doc) WHERE rank <= 5 GROUP BY 1)
SELECT q.query_id, CASE rule WHEN 'REFUSES' THEN 'abstains' WHEN 'ANSWERS' THEN 'retrieves_any' ELSE 'retrieves_text' END AS rule, CASE rule WHEN 'REFUSES' THEN len(list_filter(coalesce(expected_text, []), lambda t: contains(coalesce(joined, ''), lower(t)))) = 0
WHEN 'ANSWERS' THEN coalesce(n, 0) > 0 ELSE len(list_filter(coalesce(expected_text, []), lambda t: NOT contains(coalesce(joined, ''), lower(t)))) = 0 END AS passed FROM queries q LEFT JOIN h USING (query_id)""",
}
