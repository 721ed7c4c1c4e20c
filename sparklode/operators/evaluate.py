"""Relevance evaluation: graded rank scores, means per key, macro means per language, a report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import graded


def grade(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds ``score`` to cases (query_id, expected, ...): by the rank of the expected ``ord``, 0 where it is not among the results."""
    hit = ranked.select("query_id", F.col("ord").alias("expected"), "rank")
    return cases.join(hit, ["query_id", "expected"], "left").withColumn("score", graded(F.col("rank"))).drop("rank")


def require_index(index: DataFrame) -> None:
    """Evaluating against an empty index is an error; searching it is not."""
    if index.isEmpty():
        raise ValueError("no documents are indexed")


def key_means(graded_cases: DataFrame) -> DataFrame:
    """(lang, key, avg_score, sample_size)."""
    return graded_cases.groupBy("lang", "key").agg(F.avg("score").alias("avg_score"), F.count("*").alias("sample_size"))


def macro_means(means: DataFrame) -> DataFrame:
    """(lang, total_avg): the mean of key means, whatever their sample sizes."""
    return means.groupBy("lang").agg(F.avg("avg_score").alias("total_avg"))


@F.pandas_udf(T.StringType())
def four_places(x: pd.Series) -> pd.Series:
    """As C and SQL print a double: from its exact binary value, which the JVM's formatter replaces by its shortest digits."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.4f}")


# The rules of the report.
DOUBLE, SINGLE = "=" * 42, "-" * 42


def report_lines(graded_cases: DataFrame) -> DataFrame:
    """(lang, no, line): heading, keys with their queries, the language's total, with rules and blank lines, in order."""
    means = key_means(graded_cases)
    name = F.upper("lang")
    # JavaScript prints 1.0 as 1; scores are powers of two or 0.
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.col("score")), "0+$", ""), r"\.$", "")
    padded = F.when(F.length(shown) < 6, F.rpad(shown, 6, " ")).otherwise(shown)

    def rows(frame: DataFrame, part: int, sub: int, line, key=None, query=None) -> DataFrame:
        none = F.lit(None).cast("string")
        key, query = (none if c is None else F.col(c) for c in (key, query))
        return frame.select("lang", F.lit(part).alias("part"), key.alias("key"), F.lit(sub).alias("sub"), query.alias("query"), line.alias("line"))

    langs, totals = means.select("lang").distinct(), macro_means(means)
    every = (
        rows(langs, 0, 0, F.concat(F.lit("LANGUAGE: "), name))
        .union(rows(langs, 0, 1, F.lit(SINGLE)))
        .union(rows(means, 1, 0, F.concat(F.lit("Key: "), "key", F.lit(" (Avg: "), four_places(F.col("avg_score")), F.lit(")")), "key"))
        .union(rows(graded_cases, 1, 1, F.concat(F.lit("  - [Score: "), padded, F.lit("] Query: "), "query"), "key", "query"))
        .union(rows(means, 1, 2, F.lit(""), "key"))
        .union(rows(totals, 2, 0, F.concat(F.lit(">> TOTAL AVERAGE FOR "), name, F.lit(": "), four_places(F.col("total_avg")))))
        .union(rows(langs, 2, 1, F.lit(DOUBLE)))
        .union(rows(langs, 2, 2, F.lit("")))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("part", "key", "sub", "query", "line"))
    return every.select("lang", place.alias("no"), "line")


def full_report(graded_cases: DataFrame, at: Column | None = None) -> DataFrame:
    """(no, line) of the whole report, headed by the time ``at`` (now)."""
    at = F.current_timestamp() if at is None else at
    lines = report_lines(graded_cases)
    spark = graded_cases.sparkSession
    title = F.concat(F.lit("TEST RESULTS - "), F.date_format(at, "M/d/yyyy, h:mm:ss a"))
    head = spark.range(1).select(F.posexplode(F.array(title, F.lit(DOUBLE), F.lit(""))).alias("no", "line"))
    # A report has a line for each case.
    rest = lines.select((F.row_number().over(Window.orderBy("lang", "no")) + 2).alias("no"), "line")
    return head.union(rest)
