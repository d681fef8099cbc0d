"""Quality rules with risk-controlled cutoffs.

``measure`` counts, in one pass over each whole text, what the rules look at.
``calibrate`` picks the cutoffs of each stratum on the labelled holdout, by exact
binomial tails.  Cutoffs are added one by one in an order fixed beforehand, all
rules in turn from lenient to strict, and "the union of the rules so far rejects
more than ``alpha`` of good documents" is tested at each step; the first test that
fails ends the walk (fixed sequence).  What rejects no more than a certified union
is certified, so each rule may use any of its cutoffs up to there.  Lest one rule
that rejects many good documents ends the walk for all, each rule's grid is walked
alone, too, at ``alpha / rules``.  Half of a stratum's ``delta / strata`` goes to
the union, half to the rules in equal parts (Bonferroni); so with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents.  Among
certified cutoffs a rule uses the one that rejects most bad documents less
``good_cost`` times the good ones, lenient first on ties; of the two walks the one
that gains more is used, the union first on ties.  All labelled rows are counted;
a histogram of (stratum, rule or union, cutoff) is all that reaches the driver.

Nulls and odd input: a null or empty text has no words and fails the base rule;
a null stratum is a stratum of its own; null labels are left out; documents
labelled more than once count as good if any label says so.  A stratum with too
few labels gets no cutoff, so nothing of it is rejected beyond the base rule.
Repeated rows are judged each; empty tables work; columns of the input are kept,
and those whose names clash with a measure are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgrid.llm.common import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
#: The characters counted.
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Rule:
    """Reject where ``value`` is above a cutoff; ``grid``: from lenient to strict."""

    name: str
    value: str
    grid: tuple[float, ...]


#: Rules and grids.
RULES = (
    Rule("symbols", "n_symbols / n_words", (2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15)),
    Rule("capitals", "n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("punctuation", "n_punct / word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    Rule("duplicate_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("repeated_words", "n_repeat_words / n_words", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25)),
    Rule("word_length", "word_chars / n_words", (40.0, 30.0, 20.0, 15.0, 12.0, 10.0)),
)

#: In histograms, the name of the union of the rules.
UNION = "\0union"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words that stand in a window of ``k`` words found twice or more."""
    n = len(words)
    if n <= k:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    w = h[: n - k + 1] * _MIX[0]
    for i in range(1, k):
        w = (w ^ (w >> np.uint64(29))) * _MIX[i] + h[i : n - k + 1 + i]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    marked = np.zeros(n + 1, np.int32)
    at = np.nonzero(np.isin(w, twice))[0]
    marked[at] += 1
    marked[at + k] -= 1
    return int((np.cumsum(marked[:n]) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.split()
    n = len(text)
    dup, seen, lines = 0, set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    without = lambda chosen: n - len(text.translate(None, chosen))
    return len(words), chars, without(SYMBOLS), dup, repeated_words(words), lines, without(CAPITALS), without(PUNCTUATION)


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures (long) appended."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in MEASURES and (keep_text or f.name != text)]
    out = T.StructType([*kept, *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.cast(batch.column(batch.num_columns - 1), pa.binary()), b"")
            rows = np.array([counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names=out.names)

    quoted = lambda name: F.col(f"`{name}`")
    return docs.select(*[quoted(f.name) for f in kept], quoted(text).alias("_measured")).mapInArrow(run, out)


def measure_labelled(docs: DataFrame, labels: DataFrame, max_broadcast: int = 2_000_000) -> DataFrame:
    """The measures of the documents that have a label, for ``calibrate``; no other text is looked at.

    Labelled ids are counted; above ``max_broadcast`` the join is a shuffle join.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = materialize(ids, "labelled")
    return measure(docs.join(F.broadcast(ids) if ids.count() <= max_broadcast else ids, "doc_id", "left_semi"), keep_text=False)


def value(rule: Rule) -> Column:
    top, bottom = rule.value.split(" / ")
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def base_failed(min_words: int = 10, max_repeat: float = 0.2) -> Column:
    """Fewer words than ``min_words``, or more than ``max_repeat`` of them repeated."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of chance p, exactly summed in logarithms."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def steps(rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """For each rule, at which step of the union's walk (from 1) each of its cutoffs is added."""
    order = sorted(((k + 1) / len(r.grid), i, k) for i, r in enumerate(rules) for k in range(len(r.grid)))
    at = {(i, k): step for step, (_, i, k) in enumerate(order, 1)}
    return {r.name: [at[i, k] for k in range(len(r.grid))] for i, r in enumerate(rules)}


def above(cells: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """(good, bad) rows rejected at the first ``k`` cutoffs: a value above a lenient cutoff is above all stricter ones too."""
    return tuple(sum(c[i] for c in cells[len(cells) - k :]) for i in (0, 1))


def certified(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """How many tests in a row, with so many of ``n`` good rows rejected, hold before the first that fails."""
    for k, good in enumerate(rejected):
        if n == 0 or binomial_tail(good, n, alpha) > level:
            return k
    return len(rejected)


def choose(histogram: dict[tuple[str, str], list[tuple[int, int]]], strata: int, rules: tuple[Rule, ...] = RULES, alpha: float = 0.03, delta: float = 0.05, good_cost: float = 20.0) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff.  ``histogram``: (good, bad) rows by how many cutoffs of the grid their value exceeds.

    Under ``UNION``, by how many steps of the walk reject them; without it the
    union's rejections are bounded by the sum of the rules'.
    """
    chosen = {}
    level, at = delta / max(1, strata) / 2, steps(rules)
    last = sum(len(r.grid) for r in rules)
    for stratum in dict.fromkeys(s for s, _ in histogram):
        own = {r: histogram[stratum, r.name] for r in rules if (stratum, r.name) in histogram}
        n = max((sum(g for g, _ in cells) for cells in own.values()), default=0)
        if (stratum, UNION) in histogram:
            union = [above(histogram[stratum, UNION], k)[0] for k in range(1, last + 1)]
        else:
            union = [sum(above(cells, sum(s <= k for s in at[r.name]))[0] for r, cells in own.items()) for k in range(1, last + 1)]
        whole = certified(union, n, alpha, level)
        deepest = [
            {r: sum(s <= whole for s in at[r.name]) for r in own},
            {r: certified([above(cells, k)[0] for k in range(1, len(r.grid) + 1)], n, alpha / len(rules), level / len(rules)) for r, cells in own.items()},
        ]
        found = []
        for depth in deepest:
            total, cutoffs = 0.0, {}
            for r, cells in own.items():
                best = 0.0
                for k in range(depth[r]):
                    good, bad = above(cells, k + 1)
                    if (gain := bad - good_cost * good) > best:
                        best, cutoffs[stratum, r.name] = gain, r.grid[k]
                total += best
            found.append((total, cutoffs))
        chosen |= max(found, key=lambda f: f[0])[1]
    return chosen


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, alpha: float = 0.03, delta: float = 0.05, good_cost: float = 20.0, max_strata: int = 1000) -> dict[tuple[str, str], float]:
    """Cutoffs certified on the labelled rows of ``measured`` that pass the base rule.

    ``max_strata``: more strata than this are an error (the histogram is collected).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    at, last = steps(rules), sum(len(r.grid) for r in rules)
    # By the first step that rejects a row: of a rule, that of the most lenient cutoff its value exceeds.
    first = F.least(F.lit(last + 1), F.lit(last + 1), *[F.when(value(r) > c, s) for r in rules for c, s in zip(r.grid, at[r.name], strict=True)])
    rows = measured.where(~base_failed()).select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"), *[
        sum(((value(r) > c).cast("int") for c in r.grid), F.lit(0)).alias(r.name) for r in rules
    ], (last + 1 - first).alias(UNION)).join(known, "doc_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("cell")) for r in rules], F.struct(F.lit(UNION).alias("rule"), F.col(UNION).alias("cell"))))
    cells = rows.select("stratum", "good", pairs.alias("r")).groupBy("stratum", "r.rule", "r.cell").agg(F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") > 0, 0).otherwise(1)).alias("bad"))
    most = max_strata * (last + 1 + sum(len(r.grid) + 1 for r in rules))
    found = cells.limit(most + 1).collect()
    strata = {r["stratum"] for r in found}
    if len(found) > most or len(strata) > max_strata:
        raise ValueError(f"more than {max_strata} strata")
    histogram = {(s, r.name): [(0, 0)] * (len(r.grid) + 1) for s in strata for r in rules}
    histogram |= {(s, UNION): [(0, 0)] * (last + 1) for s in strata}
    for r in found:
        histogram[r["stratum"], r["rule"]][r["cell"]] = (r["good"], r["bad"])
    return choose(histogram, len(strata), rules, alpha, delta, good_cost)


def judge(measured: DataFrame, cutoffs: dict[tuple[str, str], float], stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with base_failed, failed_rules (array) and kept."""
    own = F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))
    fails = []
    for rule in rules:
        limits = {s: c for (s, name), c in cutoffs.items() if name == rule.name}
        if limits:
            table = F.create_map(*[F.lit(x) for s, c in sorted(limits.items()) for x in (s, float(c))])
            fails.append(F.when(value(rule) > F.try_element_at(table, own), rule.name))
    failed = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    return measured.withColumns({"base_failed": base_failed(), "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
