"""Queries: the full relation graph, its profiles and evidence, and the resolution of requested ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import graph as G
from lodestack.operators import identify as I
from lodestack.plans.duck import ENT, REL, given
from lodestack.plans.registry import register
from lodestack.sources.catalogue import entities, relations

#: References of an entity: when it has any, their SQL, and the canonical ids of the same. The types of some are set apart for more verbs.
_TYPE = "CASE WHEN k % 20 = 9 THEN 'benchmark' WHEN k % 20 = 14 THEN 'agent' ELSE type END"
_REFS: dict[str, tuple[str, list[str], list[str]]] = {
    "base_model": ("k % 5 = 0", ["'Org/' || slug", "'xy'"], ["'hf-model--org--' || slug"]),
    "datasets": ("k % 3 = 0", ["'squad'", "'hf-dataset--' || slug"], ["'hf-dataset--squad'", "'hf-dataset--' || slug"]),
    "arxiv_refs": ("k % 4 = 0", ["'2401.01234v2'"], ["'arxiv-paper--2401.01234'"]),
    "models_used": ("type = 'space'", ["slug", "'ollama-model--' || slug"], ["'hf-model--' || slug", "'ollama-model--' || slug"]),
    "benchmarks": ("k % 2 = 0", ["'gpqa'", "'average'", "'mmlu_pro'"], ["'benchmark--openllm--gpqa'", "'benchmark--openllm--mmlu_pro'"]),
    "implementations": ("k % 3 = 1", ["'gh-model--' || slug"], ["'gh-model--' || slug"]),
    "dependencies": ("k % 2 = 1", ["'mcp-tool--x' || slug", "'langchain'"], ["'mcp-tool--x' || slug", "'gh-tool--langchain'"]),
    "features": ("k % 7 = 0", ["'fast-' || slug"], ["'fast-' || slug"]),
    "knowledge_tags": ("k % 11 = 0", ["'knowledge--what-is-rag'"], ["'knowledge--what-is-rag'"]),
}
_ONLY = {c: " AND type IN (" + ", ".join(f"'{t}'" for t in ts) + ")" for c, ts in G.READ_OF.items()}
_SRC = "CASE type WHEN 'benchmark' THEN 'benchmark--' || regexp_replace(id, '^[a-z]+-[a-z]+--', '') WHEN 'agent' THEN 'hf-agent--' || regexp_replace(id, '^[a-z]+-[a-z]+--', '') ELSE id END"
_STACK_TEXT = "lower(array_to_string(tags, ' ') || ' ' || description || ' ' || name)"
_PARTS = [f"SELECT {_SRC} AS src, type AS src_type, {e} AS dst, '{G.REFERENCES[c][0]}' AS dst_type, " + ("CASE WHEN type = 'benchmark' THEN 'USES' ELSE 'TRAINED_ON' END" if c == "datasets" else f"'{G.REFERENCES[c][1]}'") + f" AS verb, {G.REFERENCES[c][2]}E0 AS conf FROM t WHERE ({cond}){_ONLY.get(c, '')}" for c, (cond, _, found) in _REFS.items() for e in found]
_PARTS += [f"SELECT {_SRC}, type, 'hf-model--' || slug, 'model', 'DEMO_OF', 0.9E0 FROM t WHERE type = 'space' AND k % 3 = 0", f"SELECT {_SRC}, type, 'concept--trending-now', 'concept', 'TRENDING', 0.8E0 FROM t WHERE velocity > 0.5"]
_PARTS += [f"SELECT {_SRC}, type, '{tool}', 'tool', 'STACK', 0.8E0 FROM t WHERE type = 'model' AND contains({_STACK_TEXT}, '{word}')" for word, tool in G.TOOLS.items()]
_EDGES = f"t AS (SELECT * REPLACE ({_TYPE} AS type) FROM ent), edge AS ({' UNION ALL '.join(_PARTS)})"


def referring(spark: SparkSession, d: str) -> DataFrame:
    """Entities with columns of references."""
    e = entities(spark, d).withColumn("type", F.expr(_TYPE))
    none = "cast(array() as array<string>)"
    arrays = {c: F.expr(f"CASE WHEN {cond} THEN array({', '.join(given_)}) ELSE {none} END") for c, (cond, given_, _) in _REFS.items()}
    return e.withColumns({**arrays, "sdk": F.expr("CASE WHEN type = 'space' AND k % 3 = 0 THEN 'gradio' END"), "model_id": F.col("slug")})


@register("graph_relations", given(f"{_EDGES} SELECT * FROM edge", ENT))
def graph_relations(spark: SparkSession, d: str) -> DataFrame:
    """G1: all verbs in one pass, with canonical ids at both ends."""
    return G.extract_relations(referring(spark, d))


@register("graph_edges", given(f"{_EDGES} SELECT src, dst, verb, max(conf) AS conf, count(*) AS evidence FROM edge GROUP BY src, dst, verb", ENT))
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge of each kind, with the number of references that speak for it."""
    return G.extract_relations(referring(spark, d)).groupBy("src", "dst", "verb").agg(F.max("conf").alias("conf"), F.count("*").alias("evidence"))


@register("graph_hubs", given(f"{_EDGES} SELECT dst, dst_type, count(*) AS n FROM edge GROUP BY ALL ORDER BY n DESC, dst, dst_type LIMIT 20", ENT))
def graph_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The twenty targets of most edges."""
    return G.extract_relations(referring(spark, d)).groupBy("dst", "dst_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst", "dst_type").limit(20)


_NODE = "CASE " + " ".join(f"WHEN regexp_matches(dst, '^(?:{'|'.join(kinds)})--') THEN '{kind}'" for kind, kinds in G.NODE_TYPES.items()) + " ELSE 'unknown' END"


@register("graph_node_types", given(f"{_EDGES}, n AS (SELECT DISTINCT dst FROM edge UNION SELECT src FROM edge) SELECT {_NODE} AS type, count(*) AS n FROM n GROUP BY 1", ENT))
def graph_node_types(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by the type that their ids tell."""
    e = G.extract_relations(referring(spark, d))
    nodes = e.select("dst").unionByName(e.select(F.col("src").alias("dst"))).distinct()
    return nodes.groupBy(G.node_type(F.col("dst")).alias("type")).agg(F.count("*").alias("n"))


@register("graph_profiles", given("e AS (SELECT src, dst, verb, max(conf) AS conf FROM rel GROUP BY ALL), n AS (SELECT k, name, type, source_url FROM ent WHERE score >= 10), r AS (SELECT e.*, n.name, n.type, coalesce(n.source_url, '') AS url, row_number() OVER (PARTITION BY src ORDER BY conf DESC, dst, verb) AS rn, count(*) OVER (PARTITION BY src) AS n FROM e JOIN n ON n.k = e.dst) SELECT src, CAST((rn - 1) // 1000 AS INT) AS chunk, max(n) AS n, string_agg(verb || ' ' || name || ' ' || type || ' ' || url, ';' ORDER BY rn) AS relations FROM r GROUP BY src, chunk", ENT, REL))
def graph_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with names, types and addresses of all resolved targets; others drop."""
    nodes = entities(spark, d).filter("score >= 10").select(F.col("k").alias("id"), "name", "type", "source_url")
    p = G.baked_profiles(G.dedupe_edges(relations(spark, d)), nodes)
    text = F.transform("relations", lambda x: F.concat_ws(" ", x["verb"], x["name"], x["type"], F.coalesce(x["source_url"], F.lit(""))))
    return p.select("src", "chunk", "n", F.array_join(text, ";").alias("relations"))


_TALK = "'see 2401.0' || CAST(1000 + k % 9 AS VARCHAR(20)) || 'v2 and datasets: squad_v' || CAST(k % 3 AS VARCHAR(20)) || ', more'"
_CALLED = "CASE WHEN k % 4 = 0 THEN slug ELSE slug || ' v' || CAST(k % 7 AS VARCHAR(20)) END"


@register("graph_discovered", given(f"""n AS (SELECT id, lower({_CALLED}) AS name, {_TALK} AS t, k FROM ent), d AS (SELECT id AS src, 'arxiv-paper--2401.0' || CAST(1000 + k % 9 AS VARCHAR) AS dst, 'paper_id' AS kind, 0.9E0 AS conf FROM n UNION ALL SELECT id, 'hf-dataset--squad_v' || CAST(k % 3 AS VARCHAR), 'dataset_id', 0.6E0 FROM n UNION ALL SELECT id, 'base:' || regexp_extract(name, '^(.+?)[ -]v\\d+$', 1), 'base_model', 0.7E0 FROM n WHERE k % 4 > 0),
 v AS (SELECT substr(dst, 6) AS base, src AS dst FROM d WHERE kind = 'base_model'), b AS (SELECT name AS base, min(id) AS src FROM n GROUP BY name), many AS (SELECT base FROM v GROUP BY base HAVING count(*) > 1)
 SELECT * FROM d UNION ALL SELECT b.src, v.dst, 'variant', 0.8E0 FROM v JOIN b USING (base) SEMI JOIN many USING (base)""", ENT))
def graph_discovered(spark: SparkSession, d: str) -> DataFrame:
    """Relations that texts and names speak of, and variants of a base."""
    e = entities(spark, d).selectExpr("id", f"{_CALLED} AS name", f"{_TALK} AS talk")
    return G.discover_relations(e, F.col("talk"))


@register("graph_urns", given("""x AS (SELECT 'urn:model:' || id AS m, 'urn:author:' || author AS a, CASE WHEN k % 9 = 0 THEN 'urn:repo:https://github.com/' || slug END AS r, list_filter(list_append(tags, pipeline_tag), lambda t: t IS NOT NULL) AS tags FROM ent)
 SELECT m AS source, a AS target, 'authored_by' AS type FROM x WHERE a IS NOT NULL UNION SELECT a, m, 'authored_model' FROM x WHERE a IS NOT NULL UNION SELECT m, r, 'code_for' FROM x WHERE r IS NOT NULL UNION SELECT r, m, 'implements_model' FROM x WHERE r IS NOT NULL UNION SELECT m, 'urn:tag:' || t, 'has_tag' FROM (SELECT m, unnest(tags) AS t FROM x)""", ENT))
def graph_urns(spark: SparkSession, d: str) -> DataFrame:
    """Edges between URNs, each once."""
    url = F.when(F.col("k") % 9 == 0, F.concat(F.lit("https://github.com/"), "slug")).otherwise(F.col("source_url"))
    return G.urn_edges(entities(spark, d).withColumn("source_url", url))


@register("graph_assertions", given("""p AS (SELECT source_url, min(k) AS a FROM ent WHERE source_url IS NOT NULL GROUP BY source_url), s AS (SELECT a, e.k AS b FROM ent e JOIN p USING (source_url) WHERE e.k > a), two AS (SELECT a AS member, a, b FROM s UNION ALL SELECT b, a, b FROM s)
 SELECT member % 8 AS shard, count(*) AS rows, count(DISTINCT a) AS groups, min(substr(sha256(a || '|' || b || '|same-url'), 1, 32)) AS first_id FROM two GROUP BY 1""", ENT))
def graph_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Assertions that two entities are one, a row for either member, by shard of the member, with a summary."""
    from lodestack.functions.text import assertion_id

    s = G.same_source_pairs(entities(spark, d), "k", "source_url")
    two = s.withColumn("member", F.explode(F.array("a", "b")))
    digest = assertion_id(F.col("a").cast("string"), F.col("b").cast("string"), F.lit("same-url"))
    return two.groupBy((F.col("member") % 8).alias("shard")).agg(F.count("*").alias("rows"), F.countDistinct("a").alias("groups"), F.min(digest).alias("first_id"))


@register("graph_trails", given("""e AS (SELECT k AS edge, CASE k % 5 WHEN 0 THEN [] WHEN 1 THEN [k] WHEN 2 THEN [k, k + 1] WHEN 3 THEN [k + 1000000] ELSE [k - 1, k] END AS refs FROM ent), r AS (SELECT edge, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM e), el AS (SELECT k AS ref, CASE WHEN k % 7 = 0 THEN '' ELSE 'm' END AS method, CASE WHEN k % 11 = 0 THEN '' ELSE 'p' END AS producer, CASE WHEN k % 13 = 0 THEN '' ELSE 'f' END AS field FROM ent),
 f AS (SELECT edge, pos, CASE WHEN el.ref IS NULL THEN 'unresolvable-ref:' || r.ref WHEN method = '' THEN 'bad-method:' || r.ref WHEN producer = '' THEN 'bad-producer:' || r.ref WHEN field = '' THEN 'empty-source_field:' || r.ref END AS fault FROM r LEFT JOIN el ON el.ref = r.ref)
 SELECT e.edge, CASE WHEN len(refs) = 0 THEN 'no-refs' ELSE coalesce((SELECT arg_min(fault, pos) FROM f WHERE f.edge = e.edge AND fault IS NOT NULL), '') END AS reason FROM e""", ENT))
def graph_trails(spark: SparkSession, d: str) -> DataFrame:
    """Whether the evidence of each edge is complete, and its first fault."""
    k = F.col("k")
    e = entities(spark, d)
    refs = F.when(k % 5 == 0, F.array().cast("array<bigint>")).when(k % 5 == 1, F.array(k)).when(k % 5 == 2, F.array(k, k + 1)).when(k % 5 == 3, F.array(k + 1000000)).otherwise(F.array(k - 1, k))
    flag = lambda n, x: F.when(k % n == 0, "").otherwise(x)
    elements = e.select(k.alias("ref"), flag(7, "m").alias("method"), flag(11, "p").alias("producer"), flag(13, "f").alias("field"))
    return G.checked_trails(e.select(k.alias("edge"), refs.alias("refs")), elements)


_HF = "k % 5 IN (0, 1)"


@register("id_reconciled", given(f"""c AS (SELECT id, type, substr(id, strpos(id, '--') + 2) AS tail, k % 17 = 0 AS private, k % 3 > 0 AS own, k % 4 = 0 AS other, CASE WHEN k % 6 = 0 THEN type ELSE CASE type WHEN 'model' THEN 'dataset' ELSE 'model' END END AS said, k % 2 = 0 AS data_url FROM ent WHERE {_HF}),
 d AS (SELECT *, CASE WHEN private THEN 'PRIVATE' WHEN own AND other THEN 'DUAL' WHEN other THEN CASE WHEN (CASE type WHEN 'dataset' THEN NOT data_url ELSE data_url END) AND said <> type THEN 'PHANTOM' WHEN (CASE type WHEN 'dataset' THEN NOT data_url ELSE data_url END) <> (said <> type) THEN 'CONFLICT' ELSE 'STALE' END WHEN own THEN 'NOT_A_CANDIDATE' ELSE 'STALE' END AS class FROM c)
 SELECT id, class, CASE WHEN class = 'PHANTOM' THEN CASE type WHEN 'dataset' THEN 'hf-model--' ELSE 'hf-dataset--' END || tail END AS survivor, (SELECT count(*) = 0 FROM d WHERE class = 'CONFLICT') AS publishable FROM d""", ENT))
def id_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Records of a wrong type by membership and provenance, what survives them, and whether the run may be published."""
    k = F.col("k")
    e = entities(spark, d).filter(_HF)
    said = F.when(k % 6 == 0, F.col("type")).otherwise(F.when(F.col("type") == "model", "dataset").otherwise("model"))
    rows = e.select("id", "type", (k % 17 == 0).alias("private"), (k % 3 > 0).alias("own"), (k % 4 == 0).alias("other"), said.alias("said"), (k % 2 == 0).alias("data_url"))
    return I.reconciled(rows)


_ASK = "CASE k % 6 WHEN 0 THEN id WHEN 1 THEN slug WHEN 2 THEN upper(id) WHEN 3 THEN 'hf-model--' || slug WHEN 4 THEN substr(sha256(id), 1, 16) ELSE 'no--such' || CAST(k AS VARCHAR(20)) END"
_ROUTE = "CASE WHEN k % 18 = 1 THEN 'model' WHEN k % 18 = 7 THEN 'paper' END"


@register("id_match", given(f"""q AS (SELECT k AS req_no, lower(trim({_ASK})) AS req, {_ROUTE} AS route FROM ent WHERE k % 2 = 0 OR k % 3 = 1), p AS (SELECT *, CASE WHEN req LIKE 'hf-model--%' THEN 'model' WHEN req LIKE 'hf-dataset--%' THEN 'dataset' WHEN req LIKE 'arxiv-paper--%' THEN 'paper' WHEN req LIKE 'gh-tool--%' THEN 'tool' WHEN req LIKE 'hf-space--%' THEN 'space' END AS told, regexp_replace(req, '^[a-z]+-[a-z]+--', '') AS bare FROM q),
 e AS (SELECT id, type, slug, substr(sha256(id), 1, 16) AS umid FROM ent),
 c AS (SELECT p.req_no, p.route, p.told, e.id, e.type, e.id = p.req AS exact, e.umid = p.req AS by_umid FROM p JOIN e ON e.id = p.req UNION SELECT p.req_no, p.route, p.told, e.id, e.type, e.id = p.req, true FROM p JOIN e ON e.umid = p.req UNION SELECT p.req_no, p.route, p.told, e.id, e.type, e.id = p.req, e.umid = p.req FROM p JOIN e ON e.slug = p.bare),
 a AS (SELECT req_no, any_value(route) AS route, any_value(told) AS told, count(DISTINCT id) AS n, max(CASE WHEN exact THEN id END) AS xid, max(CASE WHEN exact THEN type END) AS xtype, max(CASE WHEN by_umid THEN id END) AS uid, max(CASE WHEN by_umid THEN type END) AS utype, count(DISTINCT CASE WHEN type = coalesce(route, told) THEN id END) AS nt, min(CASE WHEN type = coalesce(route, told) THEN id END) AS tid, min(id) AS one FROM c GROUP BY req_no),
 s AS (SELECT p.req_no, CASE WHEN a.xid IS NOT NULL AND p.told IS NOT NULL AND a.xtype <> p.told THEN 'TYPE_CONFLICT' WHEN a.xid IS NOT NULL AND (p.route IS NULL OR a.xtype = p.route) THEN 'FOUND' WHEN a.uid IS NOT NULL AND (p.route IS NULL OR a.utype = p.route) THEN 'FOUND' WHEN coalesce(p.route, p.told) IS NOT NULL THEN CASE WHEN coalesce(a.nt, 0) = 0 THEN 'NOT_FOUND' WHEN a.nt = 1 AND a.n <= 25 THEN 'FOUND' ELSE 'AMBIGUOUS' END WHEN coalesce(a.n, 0) = 0 THEN 'NOT_FOUND' WHEN a.n = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN a.xid IS NOT NULL AND (p.told IS NOT NULL AND a.xtype <> p.told OR p.route IS NULL OR a.xtype = p.route) THEN a.xid WHEN a.uid IS NOT NULL AND (p.route IS NULL OR a.utype = p.route) THEN a.uid WHEN coalesce(p.route, p.told) IS NOT NULL THEN a.tid ELSE a.one END AS id, coalesce(a.n, 0) AS n FROM p LEFT JOIN a USING (req_no))
 SELECT req_no, status, CASE WHEN status IN ('FOUND', 'TYPE_CONFLICT') THEN id END AS id, least(n, 25) AS candidates FROM s""", ENT))
def id_match(spark: SparkSession, d: str) -> DataFrame:
    """G16, G17, entity: a requested id by exact id, digest, type and slug: found, conflicting, ambiguous or absent."""
    e = entities(spark, d)
    asked = e.filter("k % 2 = 0 OR k % 3 = 1").selectExpr("k AS req_no", f"{_ASK.replace('sha256(id)', 'sha2(id, 256)')} AS req", f"{_ROUTE} AS route")
    return I.matched(asked, e.select("id", "type", "slug"))


@register("id_probes", given("""r AS (SELECT k, CASE k % 4 WHEN 0 THEN '2401.0' || CAST(1000 + k % 9000 AS VARCHAR) WHEN 1 THEN 'Org/' || slug WHEN 2 THEN id ELSE 'cs.2401.01234' END AS raw, id FROM ent)
 SELECT k, CASE k % 4 WHEN 0 THEN raw || ' arxiv--' || raw || ' unknown--' || raw WHEN 1 THEN lower(raw) || ' ' || replace(lower(raw), '/', '--') || ' hf-model--' || replace(lower(raw), '/', '--') || ' hf-dataset--' || replace(lower(raw), '/', '--') || ' hf-space--' || replace(lower(raw), '/', '--') || ' gh-tool--' || replace(lower(raw), '/', '--') || ' gh-agent--' || replace(lower(raw), '/', '--') || ' arxiv-paper--' || replace(lower(raw), '/', '--') WHEN 2 THEN id || ' ' || regexp_replace(id, '^[a-z]+-[a-z]+--', '') || CASE WHEN id LIKE 'arxiv-%' THEN '' ELSE '' END ELSE raw || ' hf-model--' || raw || ' hf-dataset--' || raw || ' hf-space--' || raw || ' gh-tool--' || raw || ' gh-agent--' || raw || ' arxiv-paper--' || raw END AS probes FROM r""", ENT))
def id_probes(spark: SparkSession, d: str) -> DataFrame:
    """The forms under which a requested id may be stored, the likeliest first."""
    k = F.col("k")
    raw = F.when(k % 4 == 0, F.concat(F.lit("2401.0"), (1000 + k % 9000).cast("string"))).when(k % 4 == 1, F.concat(F.lit("Org/"), "slug")).when(k % 4 == 2, F.col("id")).otherwise("cs.2401.01234")
    return entities(spark, d).select("k", F.array_join(I.probe_keys(raw), " ").alias("probes"))
