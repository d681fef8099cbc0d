"""Facet filters and ranked literal search with match spans.

Facet predicates come first, then the literal test, then counting, and spans are
made for hits only.  Literals are never patterns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgrid.functions.text import fold, fold_text, quoted, utf16_length

#: Fields in their order, and weights.
FIELDS = ("name", "subtitle", "instructor", "code", "keywords")
WEIGHTS = {"name": 3.0, "instructor": 2.0, "subtitle": 1.5, "code": 1.2, "keywords": 1.0}
SPANS = "array<struct<field:int,start:int,len:int>>"


def chosen(value: str | None) -> str | None:
    """The word "all" selects everything."""
    return None if value == "all" else value


def narrow(df: DataFrame, facets: Mapping[str, str | None]) -> DataFrame:
    """Rows with all given facet values; None leaves a facet open, an unknown value leaves nothing."""
    for column, value in facets.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def contains_literal(haystack: Column, query: str) -> Column:
    """The folded query within a folded haystack; an empty query is everywhere."""
    return F.contains(haystack, F.lit(fold_text(query))) if query else F.lit(True)


def occurrences(folded: Column, query: str) -> Column:
    """Leftmost non-overlapping occurrences in a folded field."""
    return ((F.length(folded) - F.length(F.replace(folded, F.lit(query), F.lit("")))) / F.lit(len(query))).cast("int")


def field_spans(folded: Column, query: str, field: int) -> Column:
    """Spans of the occurrences in UTF-16 units of the unfolded text (folding keeps lengths)."""
    width = len(query.encode("utf-16-be")) // 2
    pieces = F.split(folded, quoted(query), -1)
    start = F.struct(F.array().cast(SPANS).alias("out"), F.lit(0).alias("at"))

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + utf16_length(piece)
        span = F.struct(F.lit(field).alias("field"), at.alias("start"), F.lit(width).alias("len"))
        return F.struct(F.concat(s["out"], F.array(span)).alias("out"), (at + width).alias("at"))

    # Each piece but the last is followed by an occurrence.
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["out"])


def build_index(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """(key, fields folded): written as Parquet this is the native index."""
    return df.select(key, *[fold(F.coalesce(c, F.lit(""))).alias(n) for n, c in fields.items()])


def ranked(index: DataFrame, query: str, key: str = "idx", weights: Mapping[str, float] = WEIGHTS, spans: bool = True) -> DataFrame:
    """(key, score float, spans) of documents with the folded query, unordered; no query, no hits.

    The score is the weighted number of occurrences, added in 32-bit floats in
    the order of the index's fields.
    """
    q = fold_text(query)
    fields = [c for c in index.columns if c in weights]
    if not q:
        return index.where(F.lit(False)).select(key, F.lit(0).cast("float").alias("score"), F.array().cast(SPANS).alias("spans"))
    any_field = F.lit(False)
    for f in fields:
        any_field = any_field | F.contains(f, F.lit(q))
    hits = index.where(any_field).select("*", *[occurrences(F.col(f), q).alias(f"_{f}") for f in fields])
    score = F.lit(0).cast("float")
    for f in fields:
        score = (score + F.lit(weights[f]).cast("float") * F.col(f"_{f}").cast("float")).cast("float")
    found = F.concat(*[F.when(F.col(f"_{f}") > 0, field_spans(F.col(f), q, FIELDS.index(f) if f in FIELDS else k)).otherwise(F.array().cast(SPANS)) for k, f in enumerate(fields)])
    return hits.select(key, score.alias("score"), (found if spans else F.array().cast(SPANS)).alias("spans"))


def unranked(df: DataFrame, key: str = "idx") -> DataFrame:
    return df.select(key, F.lit(0).cast("float").alias("score"), F.array().cast(SPANS).alias("spans"))


def in_rank_order(hits: DataFrame, key: str = "idx", limit: int | None = None) -> DataFrame:
    ordered = hits.orderBy(F.desc("score"), key)
    return ordered.limit(limit) if limit else ordered


def name_spans(hits: DataFrame) -> DataFrame:
    """Hits with name spans only."""
    own = F.filter("spans", lambda s: s["field"] == 0)
    return hits.select("*", own.alias("name_spans")).where(F.size("name_spans") > 0)
