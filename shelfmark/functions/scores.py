"""Evidence scores, their weighted mean, and the wording that explains them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, scores and thresholds of the match model.
MOVIE_WEIGHTS = {"title_score": 0.5, "year_score": 0.35, "runtime_score": 0.15}
EPISODE_WEIGHTS = {
    "title_score": 0.35, "season_score": 0.2, "episode_score": 0.2,
    "episode_title_score": 0.15, "runtime_score": 0.1,
}
TYPE_MISMATCH = 0.3
RUNTIME_SCORES = (1.0, 0.6, 0.0)
RUNTIME_CLOSE, RUNTIME_ROUGH = 0.05, 0.15
AUTO_MIN_SCORE, AUTO_MIN_GAP, PLAUSIBLE_MIN_SCORE = 0.90, 0.10, 0.60


def year_score(local: Column, other: Column) -> Column:
    """Null when the local year is unknown: missing evidence is not a mismatch."""
    gap = F.abs(local - other)
    return F.when(local.isNotNull(), F.when(other.isNull(), 0.5).when(gap == 0, 1.0).when(gap == 1, 0.6).otherwise(0.0))


def _runtime_ratio(local: Column, other: Column) -> Column:
    return F.when(local.isNotNull() & (other != 0), F.abs(local - other) / F.nullif(other, F.lit(0)))


def runtime_score(local: Column, other: Column) -> Column:
    ratio = _runtime_ratio(local, other)
    return F.when(ratio.isNotNull(), F.when(ratio <= RUNTIME_CLOSE, 1.0).when(ratio <= RUNTIME_ROUGH, 0.6).otherwise(0.0))


def exact_score(local: Column, other: Column) -> Column:
    return F.when(local.isNotNull(), F.when(local == other, 1.0).otherwise(0.0))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean over the components present; an absent one carries no weight."""
    total = sum((F.coalesce(score * F.lit(weight), F.lit(0.0)) for score, weight in parts), F.lit(0.0))
    weights = sum((F.when(score.isNotNull(), weight).otherwise(0.0) for score, weight in parts), F.lit(0.0))
    return F.when(weights == 0, 0.0).otherwise(total / F.nullif(weights, F.lit(0.0)))


def confidence_for(score: Column) -> Column:
    return F.when(score >= AUTO_MIN_SCORE, "HIGH").when(score >= PLAUSIBLE_MIN_SCORE, "MEDIUM").otherwise("LOW")


def reasons(*texts: Column) -> Column:
    """The texts that apply, in order."""
    return F.array_compact(F.array(*texts))


# Fixed values in the functions below: the wording of reasons.


def title_reason(label: str, score: Column) -> Column:
    return (
        F.when(score >= 0.999, f"exact normalized {label} match")
        .when(score >= 0.8, f"close {label} similarity")
        .when(score > 0, f"weak {label} similarity")
        .otherwise(f"no meaningful {label} similarity")
    )


def year_reason(local: Column, other: Column) -> Column:
    gap = F.abs(local - other)
    return (
        F.when(local.isNull(), "local year unknown")
        .when(other.isNull(), "candidate release year unknown")
        .when(gap == 0, "exact release year match")
        .when(gap == 1, "release year off by 1 year")
        .otherwise(F.format_string("release year mismatch (%d vs %d)", local, other))
    )


def runtime_reason(local: Column, other: Column) -> Column:
    score = runtime_score(local, other)
    return (
        F.when(score == 1.0, "runtime closely matches")
        .when(score == 0.6, "runtime roughly matches")
        .when(score.isNotNull(), F.format_string(
            "runtime disagrees (%ds vs %ds)", F.bround(local, 0).cast("long"), other.cast("long")))
    )


def number_reason(label: str, local: Column, other: Column) -> Column:
    return (
        F.when(local.isNull(), f"local {label} number unknown")
        .when(local == other, f"exact {label} match")
        .otherwise(F.format_string(f"{label} mismatch (%d vs %d)", local, other))
    )


def episode_title_reason(score: Column) -> Column:
    return F.when(score >= 0.8, "episode title corroborates").when(
        score.isNotNull(), "episode title does not corroborate")


def type_reason(matches: Column, local_type: Column, provider_type: str) -> Column:
    return F.when(~matches, F.format_string(
        f"local candidate type %s does not match provider type {provider_type}", local_type))
