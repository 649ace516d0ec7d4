"""Relative entropy between the distributions of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kl_term(p: Column, q: Column) -> Column:
    return p * F.log(p / q)


def kl_matrix(dists: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """KL(P_i || P_j) for all clusters of a group: labels squared rows, a number
    the caller sets.  ``dists`` holds normalised ``p`` per label and bin."""
    keys = [*group_cols, "bin"]
    p = dists.select(*keys, F.col("label").alias("i"), F.col("p").alias("_p"))
    q = dists.select(*keys, F.col("label").alias("j"), F.col("p").alias("_q"))
    return p.join(q, keys).groupBy(*group_cols, "i", "j").agg(F.sum(kl_term(F.col("_p"), F.col("_q"))).alias("kl"))


def out_strengths(dists: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Row sums of the KL matrix: how far a cluster lies from the others.

    sum_j KL(i||j) = sum_b p_i (K ln p_i - sum_j ln p_j), so the matrix itself
    is never built.
    """
    in_bin = Window.partitionBy(*group_cols, "bin")
    own = F.col("p") * (F.count(F.lit(1)).over(in_bin) * F.log("p") - F.sum(F.log("p")).over(in_bin))
    return dists.withColumn("_term", own).groupBy(*group_cols, "label").agg(F.sum("_term").alias("strength"))


def in_strengths(dists: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Column sums of the KL matrix: how far the others lie from a cluster.

    sum_i KL(i||j) = sum_b (sum_i p_i ln p_i) - (sum_i p_i) ln p_j.
    """
    in_bin = Window.partitionBy(*group_cols, "bin")
    term = F.sum(F.col("p") * F.log("p")).over(in_bin) - F.sum("p").over(in_bin) * F.log("p")
    return dists.withColumn("_term", term).groupBy(*group_cols, "label").agg(F.sum("_term").alias("strength"))
