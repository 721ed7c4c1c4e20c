"""From ranked documents to text that can be inserted, and the whole completion flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lang import route
from ..functions.text import brace_query, leading_whitespace, nfc


def insert_text(comments: Column, snippets: Column, indent: Column) -> Column:
    """Comments, then snippets, a line each (normalised before, see ``nfc_lines``); all but a first comment are indented."""
    none = F.array().cast("array<string>")
    lines = F.concat(F.coalesce(comments, none), F.coalesce(snippets, none))
    joint = F.concat(F.lit("\n"), indent)
    head = F.when(F.size(F.coalesce(comments, none)) > 0, F.lit("")).otherwise(F.when(F.size(lines) > 0, joint).otherwise(""))
    joined = F.aggregate(lines, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).otherwise(F.concat(s, joint, x)))
    return F.concat(head, F.coalesce(joined, F.lit("")))


def edit_ranges(line: Column, character: Column, comments: Column) -> dict[str, Column]:
    """Where to insert, and which lines to remove after accepting."""
    return {
        "insert_line": line, "insert_character": F.greatest(character, F.lit(1)), "remove_from": line, "remove_to": line + F.coalesce(F.size(comments), F.lit(0)),
    }


def completions(
    lines: DataFrame, corpus: DataFrame, search: Callable[[DataFrame], DataFrame], languages: list[str]
) -> DataFrame:
    """Items for every cursor line whose line above is a query in braces.

    ``lines`` (doc_path, line_no, character, before); ``search`` takes
    (query_id, lang, text) and returns (query_id, lang, ord, score, rank);
    ``languages`` are those with an index, queries of others give no items.
    """
    asked = lines.where(F.col("line_no") > 0).withColumn("text", brace_query(F.col("before"))).where(F.col("text").isNotNull())
    asked = asked.withColumn("lang", route(F.col("text"))).where(F.col("lang").isin(languages))
    asked = asked.withColumn("query_id", F.xxhash64("doc_path", "line_no")).withColumn("indent", leading_whitespace(F.col("before")))
    found = search(asked.select("query_id", "lang", "text")).join(corpus.select("lang", "ord", "id", "comments", "snippets"), ["lang", "ord"])
    clean = found.withColumn("comments", nfc_lines("comments")).withColumn("snippets", nfc_lines("snippets"))
    rows = asked.join(clean.drop("lang"), "query_id")
    text = insert_text(F.col("comments"), F.col("snippets"), F.col("indent")).alias("insert_text")
    ranges = [c.alias(n) for n, c in edit_ranges(F.col("line_no"), F.col("character"), F.col("comments")).items()]
    return rows.select("doc_path", "line_no", "lang", "rank", "id", text, *ranges)


def nfc_lines(name: str) -> Column:
    """An array of lines, each in NFC (normalised as one text and split again)."""
    split = F.split(nfc(F.array_join(F.transform(F.col(name), lambda x: F.coalesce(x, F.lit(""))), "\u0001")), "\u0001")
    return F.when(F.size(name) > 0, split).otherwise(F.col(name))
