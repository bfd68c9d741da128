"""Scores of an entity as column expressions: the five-factor score and its parts, quality, velocity, trust labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score.
SOURCE_COEFFICIENT = {"hf-": 1.0, "gh-": 5.0, "arxiv-": 30.0, "s2-": 30.0}
DEFAULT_COEFFICIENT = 0.2
DECAY = {"model": 0.002, "tool": 0.002, "agent": 0.002, "dataset": 0.005, "collection": 0.005, "paper": 0.005, "prompt": 0.025, "space": 0.025}
DEFAULT_DECAY = 0.005
STALENESS = {"model": 0.005, "tool": 0.005, "agent": 0.005, "dataset": 0.003, "collection": 0.003, "paper": 0.001, "prompt": 0.008, "space": 0.008}
DEFAULT_STALENESS = 0.005
WEIGHTS = {"s": 0.35, "a": 0.25, "p": 0.15, "r": 0.15, "q": 0.10}
CAP = 99.9
NEUTRAL = 50.0
UNDATED_DAYS = 365


def pick(column: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def round1(x: Column) -> Column:
    """One decimal, halves upward."""
    return F.floor(x * 10 + 0.5) / 10


def source_coefficient(id: Column) -> Column:
    out = F.lit(DEFAULT_COEFFICIENT)
    for prefix, value in SOURCE_COEFFICIENT.items():
        out = F.when(id.startswith(prefix), value).otherwise(out)
    return out


def raw_popularity(id: Column, likes: Column, downloads: Column, stars: Column, forks: Column, citations: Column) -> Column:
    n = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    paper = id.startswith("arxiv-") | id.startswith("s2-")
    return F.when(id.startswith("hf-"), n(likes) + n(downloads) * 0.01).when(id.startswith("gh-"), n(stars) + n(forks) * 2).when(paper, n(citations)).otherwise(n(likes) * 20 + n(downloads))


def saturating(x: Column, base: int) -> Column:
    """From 0 towards the cap as x grows by powers of ten."""
    return F.least(F.lit(CAP), CAP * (1 - F.pow(F.lit(10.0), -(F.log10(x + 1) / base))))


def recency(type: Column, days: Column) -> Column:
    return F.least(F.lit(CAP), 100 * F.exp(-pick(type, DECAY, DEFAULT_DECAY) * F.greatest(F.coalesce(days, F.lit(UNDATED_DAYS)), F.lit(0))))


def staleness(type: Column, days_since_seen: Column) -> Column:
    d = F.greatest(days_since_seen, F.lit(0))
    return F.when(d.isNull() | (d < 1), 1.0).otherwise(F.exp(-pick(type, STALENESS, DEFAULT_STALENESS) * d))


def estimated_mesh_points(id: Column, citations: Column, degree: Column, likes: Column, stars: Column, forks: Column) -> Column:
    n = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    paper = id.startswith("arxiv-") | id.startswith("s2-")
    weight = F.when(paper, 30).when(id.startswith("gh-"), 5).otherwise(1)
    reach = F.when(id.startswith("gh-"), n(stars) + n(forks) * 2).when(~paper, n(likes)).otherwise(0.0)
    proxy = F.when((n(citations) == 0) & (reach > 0), F.floor(F.log10(reach + 1) * 10)).otherwise(0)
    return n(citations) * weight + n(degree) + proxy


def completeness(type: Column, body_length: Column, has_reference: Column, citations: Column, has_params: Column, has_tags: Column, author: Column) -> Column:
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    paper = points(has_reference, 20) + points(F.coalesce(citations, F.lit(0)) > 0, 10)
    return points(body_length > 500, 40) + F.when(type == "paper", paper).otherwise(points(has_params, 30)) + points(has_tags, 15) + points(author.isNotNull() & (author != "Community"), 15)


def utility(runnable: Column, used: Column) -> Column:
    return F.least(F.lit(100), 30 + F.when(runnable, 40).otherwise(0) + F.when(used, 30).otherwise(0))


def factors(id: Column, type: Column, popularity: Column, mesh_points: Column, days: Column, complete: Column, useful: Column, semantic: Column | None = None) -> dict[str, Column]:
    """The five factors, 0 to 99.9, before rounding."""
    s = F.least(F.lit(CAP), F.coalesce(semantic, F.lit(NEUTRAL)) if semantic is not None else F.lit(NEUTRAL))
    return {
        "s": s,
        "a": saturating(mesh_points, 4),
        "p": saturating(popularity * source_coefficient(id), 8),
        "r": recency(type, days),
        "q": F.least(F.lit(CAP), (complete + useful) / 2),
    }


def composite(parts: dict[str, Column]) -> Column:
    total = sum((WEIGHTS[k] * parts[k] for k in WEIGHTS), F.lit(0.0))
    return F.least(F.lit(CAP), total)


def dominant_factor(parts: dict[str, Column]) -> Column:
    """The factor that adds most to the score; of equals the first in the order s, a, p, r, q."""
    top = F.greatest(*(WEIGHTS[k] * parts[k] for k in WEIGHTS))
    out = F.lit(None).cast("string")
    for k in reversed(list(WEIGHTS)):
        out = F.when(WEIGHTS[k] * parts[k] == top, k).otherwise(out)
    return out


def legacy_score(popularity: Column, days: Column, type: Column, mesh_points: Column, complete: Column, useful: Column) -> Column:
    """The older score of three factors: popularity raised by quality and freshness, freshness, gravity of the mesh."""
    fresh = 100 * F.exp(-pick(type, DECAY, DEFAULT_DECAY) * F.greatest(F.coalesce(days, F.lit(UNDATED_DAYS)), F.lit(0)))
    base = F.least(F.lit(CAP), CAP * (1 - F.pow(F.lit(10.0), -(F.log10(popularity + 1) / 8))) * (1 + (complete + useful) / 500))
    raised = F.least(F.lit(CAP), base * (1 + fresh / 500))
    gravity = CAP * (1 - F.pow(F.lit(10.0), -(F.log10(mesh_points + 1) / 4)))
    return F.least(F.lit(CAP), raised * 0.45 + fresh * 0.30 + gravity * 0.25)


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval of k hits in n trials; null for no trials."""
    p, zz = k / n, z * z
    return F.when(n > 0, (p + zz / (2 * n) - z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n))


def velocity(likes_now: Column, likes_before: Column, days: Column) -> Column:
    return F.when(days > 0, (likes_now - likes_before) / days).otherwise(0.0)


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(df: Column, n: Column, avg_len: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 of a term that occurs once in a document of length one."""
    return bm25_idf(df, n) * (k1 + 1) / (1 + k1 * (1 - b + b / avg_len))

