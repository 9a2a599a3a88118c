"""Scoring stages as column expressions over a candidate table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86400.0


def time_decay(timestamp: Column, level: Column, now: int, l0: float = 0.05, l1: float = 0.03) -> Column:
    age = (F.lit(now) - timestamp) / F.lit(DAY)
    return F.exp(-F.when(level == 0, F.lit(l0)).otherwise(F.lit(l1)) * age)


def relieved(decay: Column, strength: Column, relief: float) -> Column:
    """Age penalty eased by a strong match; `relief` 0 leaves it alone."""
    if relief <= 0:
        return decay
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength))
    return decay + (1 - decay) * min(relief, 1.0) * s


def authority(provenance: Column, trust: Column) -> Column:
    role = F.when(provenance == "evidence", 0.5).when(provenance == "cue", 0.8).otherwise(1.0)
    rank = F.when(trust.isNull() | (trust == "a1"), 1.0).when(trust == "a2", 0.92).otherwise(0.8)
    return role * rank


def attribution(attributed_to: Column, fact_type: Column, boost: float = 1.0, damp: float = 1.0) -> Column:
    state = fact_type.isin("preference_or_decision", "project_state")
    return (F.when((attributed_to == "user") & state, F.lit(boost))
            .when((attributed_to == "assistant") & state, F.lit(damp)).otherwise(F.lit(1.0)))


def level_boost(level: Column, counting: Column | bool = False) -> Column:
    c = counting if isinstance(counting, Column) else F.lit(counting)
    normal = F.when(level == 1, 1.5).when(level == 0, 1.0).otherwise(0.8)
    reverse = F.when(level == 0, 1.5).when(level == 1, 0.7).otherwise(0.8)
    return F.when(c, reverse).otherwise(normal)


def chunk_adjusted(score: Column, tier: Column, decay: Column, importance: Column, access: Column,
                   fact_type: Column, access_weight: float = 0.0, medium: float = 1.0) -> Column:
    """Tier, importance, access and preference factors on a fused score."""
    t = F.coalesce(tier, F.lit("default"))
    core = F.when(decay > 0, 1 / decay).otherwise(1.0) * 2.0
    pinned = F.when((decay < 0.8) & (decay > 0), 0.8 / decay).otherwise(1.0) * 1.5
    by_tier = (F.when(t == "core", core).when(t == "pinned", pinned)
               .when(t == "ephemeral", decay * 0.5).otherwise(1.0))
    by_access = F.when(access > 0, 1 + F.log1p(access) * max(access_weight, 0.0)).otherwise(1.0)
    by_type = F.when(fact_type == "preference_or_decision", 1.5).otherwise(1.0)
    return score * by_tier * F.coalesce(importance, F.lit(medium)) * by_access * by_type


def recency(timestamp: Column, now: int, tau_days: float = 30.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now) - timestamp) / F.lit(DAY))
    return F.exp(-age / tau_days)


def importance_from_surprise(surprise: Column) -> Column:
    return F.when(surprise > 0.5, 1.5).when(surprise > 0.2, 1.0).otherwise(0.7)
