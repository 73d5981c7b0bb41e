"""Risk scores as pure Column expressions over a map of entity counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import taxonomy as X


def weight(entity_type: Column) -> Column:
    return F.coalesce(X.literal_map(X.WEIGHTS)[X.normalized(entity_type)], F.lit(X.DEFAULT_WEIGHT))


def category(entity_type: Column) -> Column:
    return F.coalesce(X.literal_map(X.CATEGORIES)[X.normalized(entity_type)], F.lit("unknown"))


def categories(counts: Column) -> Column:
    """Distinct named categories of a map's entity types."""
    return F.array_except(F.array_distinct(F.transform(F.map_keys(counts), category)), F.array(F.lit("unknown")))


def multiplier(cats: Column) -> Column:
    """The largest multiplier whose categories are all present, 1 if none."""
    fits = [F.when(F.size(F.array_except(F.array(*map(F.lit, need)), cats)) == 0, F.lit(m)).otherwise(F.lit(1.0)) for _, m, need in X.CO_OCCURRENCE]
    return F.greatest(*fits, F.lit(1.0))


def triggered(cats: Column) -> Column:
    """Names of the rules that reach the largest multiplier above 1, in their order."""
    best = multiplier(cats)
    named = [F.when((F.size(F.array_except(F.array(*map(F.lit, need)), cats)) == 0) & (best == m), F.lit(n)) for n, m, need in X.CO_OCCURRENCE]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def content_score(counts: Column, confidence: float = X.CONFIDENCE) -> Column:
    base = F.aggregate(
        F.map_entries(counts),
        F.lit(0.0),
        lambda acc, e: acc + weight(e["key"]) * X.WEIGHT_SCALE * (1 + F.log(F.greatest(F.lit(1), e["value"]).cast("double"))) * confidence,
    )
    return F.coalesce(F.least(F.lit(100.0), base * multiplier(categories(counts))), F.lit(0.0))


def exposure_multiplier(level: Column, table: dict = X.EXPOSURES) -> Column:
    return F.coalesce(X.literal_map(table)[F.upper(level)], F.lit(1.0))


def tier_of(score: Column, tiers=X.TIERS) -> Column:
    out = F.lit("MINIMAL")
    for name, least in reversed(tiers):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score_columns(counts: Column, exposure: Column) -> list[Column]:
    """content_score, exposure_multiplier, risk_score (half-even) and risk_tier (of the unrounded score)."""
    content, times = content_score(counts), exposure_multiplier(exposure)
    score = F.least(F.lit(100.0), content * times)
    return [content.alias("content_score"), times.alias("exposure_multiplier"), F.bround(score).cast("int").alias("risk_score"), tier_of(score).alias("risk_tier")]


def simple_score(total: Column, exposure: Column) -> tuple[Column, Column]:
    """The agent pool's score: ten points an entity, capped before exposure."""
    score = F.least(F.lit(100.0), F.least(total * 10, F.lit(100)) * exposure_multiplier(exposure, X.SIMPLE_EXPOSURES))
    return score, tier_of(score, X.SIMPLE_TIERS)
