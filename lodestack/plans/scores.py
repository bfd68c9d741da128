"""Queries: scores, percentiles, rankings, statistics, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import metadata as M
from lodestack.functions import scoring as S
from lodestack.operators import rank as R
from lodestack.plans.duck import ENT, HIST, given
from lodestack.plans.registry import register
from lodestack.sources.catalogue import entities, history, read

TODAY = "2024-02-01"


def days_since(column: str) -> Column:
    return F.datediff(F.lit(TODAY).cast("date"), F.col(column))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Entities with the five factors f_s..f_q, unrounded, and raw popularity."""
    e = entities(spark, d)
    pop = S.raw_popularity(F.col("id"), F.col("likes"), F.col("downloads"), F.col("stars"), F.col("forks"), F.col("citations"))
    complete = S.completeness(F.col("type"), F.lit(0), F.col("source_url").isNotNull(), F.col("citations"), F.col("params_billions").isNotNull(), F.size("tags") > 0, F.col("author"))
    useful = S.utility(F.col("has_ollama") | F.col("has_gguf") | F.col("pipeline_tag").isNotNull(), F.lit(False))
    parts = S.factors(F.col("id"), F.col("type"), pop, F.col("mesh_points"), days_since("last_modified"), complete, useful, F.col("semantic_score"))
    return e.withColumns({f"f_{k}": v for k, v in parts.items()} | {"raw_pop": pop, "complete": complete, "useful": useful})


_COEF = "CASE WHEN id LIKE 'hf-%' THEN 1.0 WHEN id LIKE 'gh-%' THEN 5.0 WHEN id LIKE 'arxiv-%' OR id LIKE 's2-%' THEN 30.0 ELSE 0.2 END"
_POP = "CASE WHEN id LIKE 'hf-%' THEN coalesce(likes, 0) + coalesce(downloads, 0) * 0.01E0 WHEN id LIKE 'gh-%' THEN coalesce(stars, 0) + coalesce(forks, 0) * 2E0 WHEN id LIKE 'arxiv-%' OR id LIKE 's2-%' THEN coalesce(citations, 0) * 1E0 ELSE coalesce(likes, 0) * 20E0 + coalesce(downloads, 0) END"
_DECAY = "CASE WHEN type IN ('model', 'tool', 'agent') THEN 0.002E0 WHEN type IN ('prompt', 'space') THEN 0.025E0 ELSE 0.005E0 END"
_COMPLETE = "(CASE WHEN type = 'paper' THEN (CASE WHEN source_url IS NOT NULL THEN 20 ELSE 0 END) + (CASE WHEN coalesce(citations, 0) > 0 THEN 10 ELSE 0 END) ELSE (CASE WHEN params_billions IS NOT NULL THEN 30 ELSE 0 END) END) + 15 + (CASE WHEN author IS NOT NULL AND author <> 'Community' THEN 15 ELSE 0 END)"
_USEFUL = "least(100, 30 + CASE WHEN has_ollama OR has_gguf OR pipeline_tag IS NOT NULL THEN 40 ELSE 0 END)"
FACTORS = f"""fac AS (SELECT *, {_POP} AS raw_pop, {_COMPLETE} AS complete, {_USEFUL} AS useful,
 least(99.9E0, coalesce(semantic_score, 50E0)) AS f_s,
 least(99.9E0, 99.9E0 * (1 - pow(10E0, -(log10(mesh_points + 1) / 4)))) AS f_a,
 least(99.9E0, 99.9E0 * (1 - pow(10E0, -(log10(({_POP}) * ({_COEF}) + 1) / 8)))) AS f_p,
 least(99.9E0, 100E0 * exp(-({_DECAY}) * greatest(coalesce(date_diff('day', last_modified, DATE '{TODAY}'), 365), 0))) AS f_r,
 least(99.9E0, ({_COMPLETE} + {_USEFUL}) / 2E0) AS f_q FROM ent)"""
_TOTAL = "least(99.9E0, 0.35E0 * f_s + 0.25E0 * f_a + 0.15E0 * f_p + 0.15E0 * f_r + 0.1E0 * f_q)"
_STALE = f"CASE WHEN last_seen IS NULL OR date_diff('day', last_seen, DATE '{TODAY}') < 1 THEN 1E0 ELSE exp(-(CASE WHEN type IN ('model', 'tool', 'agent') THEN 0.005E0 WHEN type IN ('dataset', 'collection') THEN 0.003E0 WHEN type = 'paper' THEN 0.001E0 ELSE 0.008E0 END) * greatest(date_diff('day', last_seen, DATE '{TODAY}'), 0)) END"


def duck1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


FINAL = f"fin AS (SELECT *, {duck1(f'{_TOTAL} * ({_STALE})')} AS total FROM fac)"


def with_total(spark: SparkSession, d: str) -> DataFrame:
    e = scored(spark, d)
    parts = {k: F.col(f"f_{k}") for k in S.WEIGHTS}
    return e.withColumn("total", S.round1(S.composite(parts) * S.staleness(F.col("type"), days_since("last_seen"))))


@register("score_composite", given(f"{FACTORS}, {FINAL} SELECT id, total, {', '.join(duck1(f'f_{k}') + f' AS {k}' for k in 'sapr')}, {duck1('f_q')} AS q, CAST(floor(raw_pop + 0.5) AS BIGINT) AS pop FROM fin", ENT))
def score_composite(spark: SparkSession, d: str) -> DataFrame:
    """The five-factor score with staleness."""
    return with_total(spark, d).select("id", "total", *(S.round1(F.col(f"f_{k}")).alias(k) for k in S.WEIGHTS), F.floor(F.col("raw_pop") + 0.5).alias("pop"))


@register("score_mesh_estimate", given("SELECT id, CAST(coalesce(citations, 0) * (CASE WHEN id LIKE 'arxiv-%' THEN 30 WHEN id LIKE 'gh-%' THEN 5 ELSE 1 END) + CASE WHEN coalesce(citations, 0) = 0 AND reach > 0 THEN floor(log10(reach + 1) * 10) ELSE 0 END AS BIGINT) AS points FROM (SELECT *, CASE WHEN id LIKE 'gh-%' THEN coalesce(stars, 0) + coalesce(forks, 0) * 2 WHEN id LIKE 'arxiv-%' THEN 0 ELSE coalesce(likes, 0) END AS reach FROM ent)", ENT))
def score_mesh_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Authority points from citations or a proxy."""
    return entities(spark, d).select("id", S.estimated_mesh_points(F.col("id"), F.col("citations"), F.lit(0), F.col("likes"), F.col("stars"), F.col("forks")).cast("long").alias("points"))


@register("score_legacy", given(f"""{FACTORS}, b AS (SELECT *, 100E0 * exp(-({_DECAY}) * greatest(coalesce(date_diff('day', last_modified, DATE '{TODAY}'), 365), 0)) AS fresh, least(99.9E0, 99.9E0 * (1 - pow(10E0, -(log10(raw_pop * ({_COEF}) + 1) / 8))) * (1 + (complete + useful) / 500E0)) AS base FROM fac)
 SELECT id, {duck1('least(99.9E0, least(99.9E0, base * (1 + fresh / 500)) * 0.45E0 + fresh * 0.3E0 + 99.9E0 * (1 - pow(10E0, -(log10(mesh_points + 1) / 4))) * 0.25E0)')} AS score FROM b""", ENT))
def score_legacy(spark: SparkSession, d: str) -> DataFrame:
    """The older three-factor score."""
    e = scored(spark, d)
    return e.select("id", S.round1(S.legacy_score(F.col("raw_pop") * S.source_coefficient(F.col("id")), days_since("last_modified"), F.col("type"), F.col("mesh_points"), F.col("complete"), F.col("useful"))).alias("score"))


@register("score_explain", given(f"""{FACTORS}, w AS (SELECT *, 0.35E0 * f_s AS ws, 0.25E0 * f_a AS wa, 0.15E0 * f_p AS wp, 0.15E0 * f_r AS wr, 0.1E0 * f_q AS wq FROM fac)
 SELECT id, CASE WHEN ws = m THEN 's' WHEN wa = m THEN 'a' WHEN wp = m THEN 'p' WHEN wr = m THEN 'r' ELSE 'q' END AS dominant, {duck1('m')} AS points FROM (SELECT *, greatest(ws, wa, wp, wr, wq) AS m FROM w)""", ENT))
def score_explain(spark: SparkSession, d: str) -> DataFrame:
    """The factor that contributes most."""
    e = scored(spark, d)
    parts = {k: F.col(f"f_{k}") for k in S.WEIGHTS}
    return e.select("id", S.dominant_factor(parts).alias("dominant"), S.round1(F.greatest(*(S.WEIGHTS[k] * parts[k] for k in parts))).alias("points"))


_MID = "CAST(greatest(1, floor((1 - (rank() OVER (ORDER BY total DESC) - 1 + (count(*) OVER (PARTITION BY total) - 1) / 2E0) / count(*) OVER ()) * 100 + 0.5)) AS INT)"


@register("rank_midrank_percentile", given(f"{FACTORS}, {FINAL} SELECT id, total, {_MID} AS percentile FROM fin", ENT))
def rank_midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Tie-aware percentile of the composite score."""
    return R.midrank_percentile(with_total(spark, d).select("id", "total"), "total").select("id", "total", "percentile")


@register("rank_badges", given("SELECT id, rk AS rank, CASE WHEN s >= 99.9E0 THEN 'top_0.1%' WHEN s >= 99 THEN 'top_1%' WHEN s >= 95 THEN 'top_5%' WHEN s >= 90 THEN 'top_10%' WHEN s >= 75 THEN 'top_25%' WHEN s >= 50 THEN 'top_50%' ELSE 'standard' END AS badge FROM (SELECT id, rk, (n - rk) / CAST(n AS DOUBLE) * 100 AS s FROM (SELECT id, rank() OVER (ORDER BY score DESC) AS rk, count(*) OVER () AS n FROM ent))", ENT))
def rank_badges(spark: SparkSession, d: str) -> DataFrame:
    """Competition rank and badge."""
    return R.competition_rank(entities(spark, d), "score").select("id", "rank", R.badge(F.col("rank"), F.col("total")).alias("badge"))


@register("rank_thresholds", given("o AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS i, count(*) OVER () AS n FROM ent) SELECT percent, score AS threshold FROM o JOIN (VALUES (0.1E0), (1E0), (5E0), (10E0), (25E0)) p(percent) ON i = floor(n * percent / 100)", ENT))
def rank_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Score at the top 0.1, 1, 5, 10, 25 percent."""
    return R.thresholds(entities(spark, d), "score", [0.1, 1, 5, 10, 25])


@register("rank_order_statistics", given("o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM ent) SELECT max(CASE WHEN i = floor(n * 0.5) THEN score END) AS median, max(CASE WHEN i = floor(n * 0.1) THEN score END) AS p10, max(CASE WHEN i = floor(n * 0.9) THEN score END) AS p90, max(score) AS max, round(sum(CASE WHEN score = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS zero_share, count(*) AS n FROM o", ENT))
def rank_order_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A10: median, deciles, maximum, share of zeros, by index without interpolation."""
    return R.order_statistics(entities(spark, d), "score", {"median": 0.5, "p10": 0.1, "p90": 0.9}).withColumn("zero_share", F.round("zero_share", 6))




def _order() -> list[Column]:
    return [F.desc("score"), F.desc_nulls_last("downloads"), F.asc("id")]


@register("rank_groups_paged", given("g AS (SELECT 'all' AS grp, * FROM ent UNION ALL SELECT 'category:' || primary_category, * FROM ent WHERE primary_category IS NOT NULL UNION ALL SELECT 'type:' || type, * FROM ent) SELECT grp, id, rank, CAST(floor((rank - 1) / 50) + 1 AS BIGINT) AS page FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY score DESC, downloads DESC NULLS LAST, id) AS rank FROM g) WHERE rank <= 2500", ENT))
def rank_groups_paged(spark: SparkSession, d: str) -> DataFrame:
    """Top 2500 of all, each category and each type, in pages of 50."""
    return R.ranking_groups(entities(spark, d), "primary_category", "type", _order(), 2500, 50).select("grp", "id", "rank", "page")


@register("rank_trending", given("SELECT id, type, score FROM ent ORDER BY score DESC, downloads DESC NULLS LAST, id LIMIT 1000", ENT))
def rank_trending(spark: SparkSession, d: str) -> DataFrame:
    """The global top 1000 with its type."""
    return entities(spark, d).orderBy(*_order()).limit(1000).select("id", "type", "score")


@register("rank_row_index", given("SELECT id, CAST(floor((1 - (row_number() OVER (PARTITION BY type ORDER BY score DESC, downloads DESC NULLS LAST, id) - 1) / CAST(count(*) OVER (PARTITION BY type) AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS percentile FROM ent", ENT))
def rank_row_index(spark: SparkSession, d: str) -> DataFrame:
    """Percentile by row index, ties by order, within a type."""
    from pyspark.sql import Window

    w = Window.partitionBy("type").orderBy(*_order())
    n = F.count("*").over(Window.partitionBy("type"))
    return entities(spark, d).select("id", F.floor((1 - (F.row_number().over(w) - 1) / n) * 100 + 0.5).alias("percentile"))


@register("rank_params_first", given("SELECT id, params_billions, score FROM ent WHERE type = 'model' ORDER BY CASE WHEN params_billions > 0 THEN 0 ELSE 1 END, score DESC, id LIMIT 100", ENT))
def rank_params_first(spark: SparkSession, d: str) -> DataFrame:
    """Entities with known size before the others."""
    return entities(spark, d).filter("type = 'model'").orderBy(F.when(F.col("params_billions") > 0, 0).otherwise(1), F.desc("score"), "id").limit(100).select("id", "params_billions", "score")


@register("rank_page", given("SELECT id, score, count(*) OVER () AS total FROM ent ORDER BY score DESC, id LIMIT 20 OFFSET 40", ENT))
def rank_page(spark: SparkSession, d: str) -> DataFrame:
    """Page three of twenty, with the total."""
    e = entities(spark, d)
    return e.orderBy(F.desc("score"), "id").offset(40).limit(20).select("id", "score").crossJoin(e.agg(F.count("*").alias("total")))


@register("rank_four_lists", given("""x AS (SELECT 'hot' AS list, id, row_number() OVER (ORDER BY likes DESC NULLS LAST, id) AS rn FROM ent UNION ALL SELECT 'trending', id, row_number() OVER (ORDER BY downloads DESC NULLS LAST, id) FROM ent
 UNION ALL SELECT 'new', id, row_number() OVER (ORDER BY last_modified DESC NULLS LAST, id) FROM ent UNION ALL SELECT 'rising', id, row_number() OVER (ORDER BY velocity DESC, id) FROM ent WHERE velocity > 0.5) SELECT list, id, rn FROM x WHERE rn <= 100""", ENT))
def rank_four_lists(spark: SparkSession, d: str) -> DataFrame:
    """Hot, trending, new and rising, a hundred each."""
    e = entities(spark, d)
    out = None
    for name, column, rows in (("hot", "likes", e), ("trending", "downloads", e), ("new", "last_modified", e), ("rising", "velocity", e.filter("velocity > 0.5"))):
        top = rows.orderBy(F.desc_nulls_last(column), "id").limit(100).select(F.lit(name).alias("list"), "id", F.col(column).cast("string").alias("v"), column)
        part = R.top_n(top.select("list", "id", F.col(column).alias("by")).withColumn("by", F.col("by").cast("double") if column != "last_modified" else F.unix_date("by").cast("double")), ["list"], [F.desc_nulls_last("by"), F.asc("id")], 100).select("list", "id", "rn")
        out = part if out is None else out.unionByName(part)
    return out


@register("rank_rising_star", given("o AS (SELECT id, velocity, row_number() OVER (ORDER BY velocity DESC) - 1 AS i, count(*) OVER () AS n FROM ent) SELECT id, velocity FROM o WHERE velocity >= (SELECT velocity FROM o WHERE i = floor(n * 0.05E0))", ENT))
def rank_rising_star(spark: SparkSession, d: str) -> DataFrame:
    """Entities at or above the velocity of the top five percent."""
    e = entities(spark, d)
    return e.crossJoin(F.broadcast(R.thresholds(e, "velocity", [5]).select("threshold"))).filter("velocity >= threshold").select("id", "velocity")


@register("stats_category", given("r AS (SELECT coalesce(primary_category, 'other') AS category, id, score, row_number() OVER (PARTITION BY coalesce(primary_category, 'other') ORDER BY score DESC, id) AS rn FROM ent) SELECT category, count(*) AS n, round(avg(CASE WHEN score > 0 THEN score END), 1) AS avg_score, max(score) AS max_score, string_agg(CASE WHEN rn <= 5 THEN id END, ',' ORDER BY rn) AS top5 FROM r GROUP BY category", ENT))
def stats_category(spark: SparkSession, d: str) -> DataFrame:
    """A2-A4: count, mean, maximum and exact top five of each category."""
    e = entities(spark, d).withColumn("category", F.coalesce("primary_category", F.lit("other")))
    sums = e.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 1).alias("avg_score"), F.max("score").alias("max_score"))
    top = R.top_n(e, ["category"], [F.desc("score"), F.asc("id")], 5).groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]), ",").alias("top5"))
    return sums.join(top, "category")


@register("stats_facets", given("SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(primary_category) = 0 THEN 'category' ELSE 'source' END AS facet, coalesce(type, primary_category, source) AS value, count(*) AS n FROM (SELECT type, coalesce(primary_category, 'other') AS primary_category, source FROM ent) GROUP BY GROUPING SETS ((type), (primary_category), (source))", ENT))
def stats_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type, category and source in one pass."""
    e = entities(spark, d).select("type", F.coalesce("primary_category", F.lit("other")).alias("category"), "source")
    return e.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("type", "category", "source")))).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


_FILLED = ["author", "pipeline_tag", "primary_category", "license", "likes", "downloads", "params_billions", "source_url", "last_modified"]


@register("stats_fill_rate", given(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS filled, round(count({c}) * 100E0 / count(*), 4) AS percent FROM ent" for c in _FILLED), ENT))
def stats_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    """Filled values of each column, in one pass."""
    one = entities(spark, d).agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in _FILLED))
    return one.select("n", F.explode(F.map_from_arrays(F.array(*map(F.lit, _FILLED)), F.array(*_FILLED))).alias("field", "filled")).select("field", "filled", F.round(F.col("filled") * 100 / F.col("n"), 4).alias("percent"))


@register("stats_conditional", given("SELECT source, count(*) AS n, sum(CASE WHEN downloads IS NULL THEN 1 ELSE 0 END) AS no_downloads, sum(CASE WHEN score >= 80 THEN 1 ELSE 0 END) AS high FROM ent GROUP BY source", ENT))
def stats_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts."""
    return entities(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("downloads").isNull()).alias("no_downloads"), F.count_if(F.col("score") >= 80).alias("high"))


@register("stats_wilson", "SELECT event_type, k, n, round((p + 3.8416E0 / (2 * n) - 1.96E0 * sqrt((p * (1 - p) + 3.8416E0 / (4 * n)) / n)) / (1 + 3.8416E0 / n), 8) AS lower FROM (SELECT event_type, k, n, k / CAST(n AS DOUBLE) AS p FROM (SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS k, count(*) AS n FROM events GROUP BY event_type))")
def stats_wilson(spark: SparkSession, d: str) -> DataFrame:
    """Lower bound of a success rate for each group."""
    return read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n")).withColumn("lower", F.round(S.wilson_lower(F.col("k"), F.col("n")), 8))


@register("stats_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stats_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@register("stats_harvest_health", "WITH y AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS yield FROM events GROUP BY ALL), p AS (SELECT *, lag(yield) OVER (PARTITION BY source ORDER BY day) AS before FROM y) SELECT source, day, yield, before, CASE WHEN yield < 50 THEN 'red' WHEN before IS NOT NULL AND yield < before * 0.8E0 THEN 'degraded' ELSE 'green' END AS status FROM p")
def stats_harvest_health(spark: SparkSession, d: str) -> DataFrame:
    """Daily yield against a floor and the day before."""
    from pyspark.sql import Window

    y = read(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count("*").alias("yield"))
    before = y.withColumn("before", F.lag("yield").over(Window.partitionBy("source").orderBy("day")))
    return before.withColumn("status", F.when(F.col("yield") < 50, "red").when(F.col("yield") < F.col("before") * 0.8, "degraded").otherwise("green"))


_TREND = f"""r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC) AS back, row_number() OVER (PARTITION BY id ORDER BY day) AS fwd, count(*) OVER (PARTITION BY id) AS points FROM hist),
 t AS (SELECT id, points, max(CASE WHEN back = 1 THEN score END) AS latest, max(CASE WHEN fwd = 1 THEN score END) AS oldest, max(CASE WHEN back = least(7, points) THEN score END) AS week FROM r WHERE points >= 2 GROUP BY id, points),
 tr AS (SELECT id, points, latest, CASE WHEN oldest > 0 THEN {duck1('(latest - oldest) / oldest * 100')} ELSE 0 END AS change_window, {duck1('latest - week')} AS change_7d FROM t)"""


@register("trend_changes", given(f"{_TREND} SELECT id, points, round(latest, 6) AS latest, change_window, change_7d, CASE WHEN change_window > 1 THEN 'up' WHEN change_window < -1 THEN 'down' ELSE 'stable' END AS direction FROM tr", HIST))
def trend_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes over all kept points and over seven, with direction."""
    t = R.trends(history(spark, d), "id", "day", "score")
    return t.select("id", F.col("points").cast("long").alias("points"), F.round("latest", 6).alias("latest"), "change_window", "change_7d", "direction")


@register("trend_summary", given(f"{_TREND} SELECT id % 5 AS tag, count(*) AS n, sum(CASE WHEN change_7d > 1 THEN 1 ELSE 0 END) AS rising, sum(CASE WHEN change_7d < -1 THEN 1 ELSE 0 END) AS falling, CASE WHEN sum(CASE WHEN change_7d > 1 THEN 1 ELSE 0 END) > sum(CASE WHEN change_7d < -1 THEN 1 ELSE 0 END) THEN 'rising' WHEN sum(CASE WHEN change_7d > 1 THEN 1 ELSE 0 END) < sum(CASE WHEN change_7d < -1 THEN 1 ELSE 0 END) THEN 'falling' ELSE 'stable' END AS trend FROM tr GROUP BY 1", HIST))
def trend_summary(spark: SparkSession, d: str) -> DataFrame:
    """A5: rising and falling ids of each tag."""
    t = R.trends(history(spark, d), "id", "day", "score").groupBy((F.col("id") % 5).alias("tag")).agg(F.count("*").alias("n"), F.count_if(F.col("change_7d") > 1).alias("rising"), F.count_if(F.col("change_7d") < -1).alias("falling"))
    return t.withColumn("trend", F.when(F.col("rising") > F.col("falling"), "rising").when(F.col("rising") < F.col("falling"), "falling").otherwise("stable"))


@register("trend_last_90", given("SELECT id, day, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC) AS rn FROM hist) WHERE rn <= 90", HIST))
def trend_last_90(spark: SparkSession, d: str) -> DataFrame:
    """The last ninety points of each id."""
    return R.last_points(history(spark, d), "id", "day", 90).select("id", "day", F.round("score", 6).alias("score"))


@register("trend_follows", given("d AS (SELECT DISTINCT day FROM hist) SELECT day, lead(day) OVER (ORDER BY day DESC) AS follows FROM d", HIST))
def trend_follows(spark: SparkSession, d: str) -> DataFrame:
    """Each report and the one it follows; days are few however many rows there are."""
    from pyspark.sql import Window

    return history(spark, d).select("day").distinct().select("day", F.lead("day").over(Window.orderBy(F.desc("day"))).alias("follows"))


@register("label_metadata", given("SELECT id, CASE WHEN license IS NULL OR license = '' THEN 'unknown' WHEN regexp_matches(lower(license), 'mit|apache-2.0|bsd-2-clause|bsd-3-clause|isc|unlicense|cc0-1.0|wtfpl|zlib|bsl-1.0|openrail') THEN 'permissive' WHEN regexp_matches(lower(license), 'gpl-2.0|gpl-3.0|lgpl-2.1|mpl-2.0') THEN 'copyleft' WHEN regexp_matches(lower(license), 'cc-by-nc|llama2|llama 2') THEN 'non-commercial' ELSE 'unknown' END AS license_class, CASE WHEN p_days <= 30 THEN 'active' WHEN p_days <= 90 THEN 'maintained' WHEN p_days <= 365 THEN 'stable' WHEN p_days IS NOT NULL THEN 'legacy' END AS activity, CASE WHEN params_billions IS NULL THEN 'unknown' WHEN params_billions < 7 THEN 'small' WHEN params_billions <= 13 THEN 'medium' WHEN params_billions > 70 THEN 'huge' ELSE 'large' END AS size, CASE WHEN CAST(nullif(regexp_extract(name, '(\\d+(?:\\.\\d+)?)\\s*[Bb]', 1), '') AS DOUBLE) BETWEEN 0.1 AND 2000 THEN CAST(regexp_extract(name, '(\\d+(?:\\.\\d+)?)\\s*[Bb]', 1) AS DOUBLE) END AS named_params FROM (SELECT *, date_diff('day', last_modified, DATE '" + TODAY + "') AS p_days FROM ent)", ENT))
def label_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Licence class, activity, size bucket, parameters in the name."""
    return entities(spark, d).select("id", M.license_class(F.col("license")).alias("license_class"), M.activity(days_since("last_modified")).alias("activity"), M.size_bucket(F.col("params_billions")).alias("size"), M.params_from_name(F.col("name")).alias("named_params"))


@register("label_architecture", given("SELECT id, CASE k % 6 WHEN 0 THEN 'llama3' WHEN 1 THEN 'qwen2' WHEN 2 THEN 'bert' WHEN 3 THEN 'mixtral' END AS architecture FROM ent", ENT))
def label_architecture(spark: SparkSession, d: str) -> DataFrame:
    """Architecture from tags, exact before partial."""
    return entities(spark, d).select("id", M.architecture(F.col("tags")).alias("architecture"))


@register("label_memory", given(f"SELECT id, {duck1('params_billions * 0.75E0 + (CASE WHEN context_length <= 8192 THEN CASE WHEN params_billions > 30 THEN 2.0 ELSE 0.8 END WHEN context_length <= 32768 THEN CASE WHEN params_billions > 30 THEN 5.0 ELSE 2.0 END ELSE CASE WHEN params_billions > 30 THEN 12.0 ELSE 4.0 END END) + 0.5E0')} AS vram_q4, round(params_billions * 2.2E0, 6) AS fp16 FROM ent WHERE params_billions > 0", ENT))
def label_memory(spark: SparkSession, d: str) -> DataFrame:
    """Memory by quantisation and context."""
    e = entities(spark, d).filter("params_billions > 0")
    return e.select("id", M.vram_with_context(F.col("params_billions"), "q4", F.col("context_length"), F.lit(False)).alias("vram_q4"), F.round(M.vram_gb(F.col("params_billions")), 6).alias("fp16"))


@register("label_badges", given("SELECT id, CASE WHEN score >= 90 THEN '#4c1' WHEN score >= 70 THEN '#08c' WHEN score >= 50 THEN '#dfb317' ELSE '#e05d44' END AS colour, CASE WHEN score >= 90 THEN 'High signal' WHEN score >= 70 THEN 'Medium signal' WHEN score >= 50 THEN 'Low signal' ELSE 'Insufficient signal' END AS label, CASE WHEN score <= 0 THEN '0.3' WHEN score >= 80 THEN '0.9' WHEN score >= 60 THEN '0.8' WHEN score >= 40 THEN '0.7' WHEN score >= 20 THEN '0.5' ELSE '0.4' END AS priority FROM ent", ENT))
def label_badges(spark: SparkSession, d: str) -> DataFrame:
    """Badge and sitemap priority."""
    s = F.col("score")
    return entities(spark, d).select("id", M.badge_colour(s).alias("colour"), M.badge_label(s).alias("label"), M.sitemap_priority(s).alias("priority"))


@register("label_compact_numbers", given("SELECT id, CASE WHEN downloads >= 1000000 THEN printf('%.1fM', floor(downloads / 100000E0 + 0.5) / 10) WHEN downloads >= 1000 THEN printf('%.1fK', floor(downloads / 100E0 + 0.5) / 10) ELSE CAST(downloads AS VARCHAR) END AS downloads_text FROM ent", ENT))
def label_compact_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as 1.5K or 2.0M."""
    return entities(spark, d).select("id", F.replace(M.compact_number(F.col("downloads")), F.lit(","), F.lit("")).alias("downloads_text"))


@register("verb_explain", given(f"{FACTORS}, e AS (SELECT * REPLACE (50E0 AS f_s) FROM fac), b AS (SELECT *, 0.35E0 * f_s AS w_s, 0.25E0 * f_a AS w_a, 0.15E0 * f_p AS w_p, 0.15E0 * f_r AS w_r, 0.1E0 * f_q AS w_q FROM e) SELECT id, {', '.join(f'round(f_{k}, 4) AS {k}' for k in 'sapr')}, round(f_q, 4) AS q, round({_TOTAL}, 4) AS total FROM b", ENT))
def verb_explain(spark: SparkSession, d: str) -> DataFrame:
    """explain, X8: the factors of every entity's score and what they make together."""
    from lodestack.api import Catalogue

    e = entities(spark, d).withColumn("days", days_since("last_modified"))
    return Catalogue(e).explain(days="days").select("id", *(F.round(k, 4).alias(k) for k in "saprq"), F.round("total", 4).alias("total"))
