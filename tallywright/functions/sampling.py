"""Unbiased estimators over the rollouts of a problem, and rates over verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The chance that at least one of k of the n rollouts, c of them correct, is correct."""
    missed = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when((n < k) | (c <= 0), 0.0).when(c >= n, 1.0).otherwise(1.0 - missed)


def pass_pow_k(n: Column, c: Column, k: int) -> Column:
    """The chance that all k of the n rollouts are correct."""
    hit = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (c - i) / (n - i))
    return F.when((n < k) | (c < k), 0.0).otherwise(hit)


def share(of: Column) -> Column:
    """The share of rows for which ``of`` holds."""
    return F.avg(of.cast("int"))


def complete_sum(value: Column, denominator: Column, scale: float = 100.0) -> Column:
    """The sum over problems by an explicit denominator; null if a problem lacks the value, or the denominator is zero."""
    return F.when((F.count(value) == F.count(F.lit(1))) & (denominator > 0), F.sum(value) * scale / denominator)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
