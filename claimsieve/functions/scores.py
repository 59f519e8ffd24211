"""Fitness, schedules and hyper-parameter coding as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FitnessWeights:
    # How much each metric and the size penalty count.
    f1: float = 0.35
    accuracy: float = 0.20
    precision: float = 0.15
    recall: float = 0.15
    complexity: float = 0.15
    penalty_exponent: float = 0.5
    max_penalty: float = 0.3
    min_features: int = 5


@dataclass(frozen=True)
class SvmRanges:
    # Search ranges of the SVM settings.
    c: tuple[float, float] = (0.1, 10.0)
    gamma: tuple[float, float] = (0.001, 1.0)


def log10(x: float) -> Column:
    return F.lit(math.log10(x))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def complexity_penalty(selected: Column, total: Column, weights: FitnessWeights = FitnessWeights()) -> Column:
    power = F.lit(weights.penalty_exponent)
    share = F.pow(selected.cast("double"), power) / F.pow(total.cast("double"), power)
    return F.least(share, F.lit(weights.max_penalty))


def subset_fitness(
    accuracy: Column,
    precision: Column,
    recall: Column,
    f1: Column,
    selected: Column,
    total: Column,
    weights: FitnessWeights = FitnessWeights(),
) -> Column:
    """Weighted metrics minus the size penalty, not below 0; 0 for too few features or no metrics."""
    value = (
        weights.f1 * f1
        + weights.accuracy * accuracy
        + weights.precision * precision
        + weights.recall * recall
        - weights.complexity * complexity_penalty(selected, total, weights)
    )
    scored = F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    return F.when(selected < weights.min_features, F.lit(0.0)).otherwise(scored)


def setting_fitness(f1: Column, c: Column, gamma: Column) -> Column:
    """Mean F1 minus 0.01 per decade away from C = 1 and from gamma = 0.1, not below 0."""
    value = f1 - 0.01 * F.abs(F.log10(c)) - 0.01 * F.abs(F.log10(gamma / F.lit(0.1)))
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def decayed(start: float, generation: Column, generations: int, floor: float = 0.01) -> Column:
    """``start`` shrinking linearly with the generation, never below ``floor``."""
    left = F.lit(1.0) - generation.cast("double") / F.lit(float(generations))
    return F.greatest(F.lit(float(start)) * left, F.lit(float(floor)))


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def encode_log(value: Column, bounds: tuple[float, float]) -> Column:
    low, high = (math.log10(b) for b in bounds)
    return (F.log10(value) - F.lit(low)) / F.lit(high - low)


def decode_log(value: Column, bounds: tuple[float, float]) -> Column:
    low, high = (math.log10(b) for b in bounds)
    return F.pow(F.lit(10.0), F.lit(low) + clip01(value) * F.lit(high - low))


def encode_kernel(kernel: Column) -> Column:
    return F.when(kernel == "linear", 0.0).otherwise(1.0)


def decode_kernel(value: Column) -> Column:
    return F.when(value < 0.5, "linear").otherwise("rbf")
