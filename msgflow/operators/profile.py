"""Profiling: missing values, distributions, samples, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from msgflow.functions.draws import rank_key


def missing_values(df: DataFrame) -> DataFrame:
    """(column, n_missing): one pass over the table; NaN counts as missing."""

    def missing(field: T.StructField):
        gone = F.col(f"`{field.name}`").isNull()
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            gone = gone | F.isnan(F.col(f"`{field.name}`"))
        return F.count_if(gone).alias(field.name)

    counts = df.agg(*[missing(f) for f in df.schema.fields])
    return counts.unpivot([], df.columns, "column", "n_missing")


def class_counts(df: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """(label, n) by descending count; null labels are left out; ties by label."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), F.col(label)))
    return counts if top is None else counts.limit(top)


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """(label, n, percent): percent of all rows, rows without a label included."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.select(F.count("*")).scalar()
    return (counts.where(F.col(label).isNotNull())
            .select(label, "n", F.round(F.col("n") * 100.0 / total, 2).alias("percent")))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, the same rows however the table is partitioned."""
    return (df.withColumn("_rank", rank_key(seed, F.col(id_col)))
            .orderBy("_rank", id_col).limit(n).drop("_rank"))


def table_shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, column names."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
    )
