"""Day by period grids, conflicts and overlays.

Rows are exploded slots (key, term, day, period, and whatever orders them).
The order within a cell is an explicit column, so what stands in it does not hang
on partitions.  Grids of any size stay rows (``cell_rows``, ``cell_counts``,
``conflict_rows``, ``plan_conflict_rows``) or are put together from sorted ranges
(``whole_cells``); other lists of a cell's courses are for grids that someone looks
at: a plan, or the first ``page`` of each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from facetgrid.operators.dictionaries import small_side
from facetgrid.operators.slots import YEAR_LONG, in_term, on_grid


#: Labels of terms that year-long rows are dealt to.
MAX_TERMS = 1000


def placed(slots: DataFrame, term: str | None = None, key: str = "idx", rank: str | None = None, year_long: str = YEAR_LONG) -> DataFrame:
    """(day, period, key, rank): each key once in each cell of a term (or of all)."""
    rows = slots.where(on_grid(F.col("day"), F.col("period")) & in_term(F.col("term"), term, year_long))
    return rows.groupBy("day", "period", key).agg(F.min(rank or key).alias("rank"))


def cell_rows(placed_rows: DataFrame, key: str = "idx", page: int | None = None) -> DataFrame:
    """(day, period, at, key): keys of each cell by rank, from 1; the first ``page`` of each cell if given."""
    at = F.row_number().over(Window.partitionBy("day", "period").orderBy("rank", key))
    rows = placed_rows.select("day", "period", at.alias("at"), key)
    return rows if page is None else rows.where(F.col("at") <= page)


def cell_counts(placed_rows: DataFrame) -> DataFrame:
    """(day, period, n): courses in each cell."""
    return placed_rows.groupBy("day", "period").agg(F.count("*").alias("n"))


def cells(placed_rows: DataFrame, key: str = "idx", page: int | None = None) -> DataFrame:
    """(day, period, courses): keys in rank order, as lists; ``page`` bounds each."""
    if page is not None:
        placed_rows = cell_rows(placed_rows, key, page).withColumnRenamed("at", "rank")
    found = placed_rows.groupBy("day", "period").agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("ranked"))
    return found.select("day", "period", F.transform("ranked", lambda r: r[key]).alias("courses"))


def whole_cells(placed_rows: DataFrame, key: str = "idx") -> DataFrame:
    """(day, period, courses): as ``cells``, for cells of any size.

    Ranges of a cell are ordered by as many tasks; only their keys, without ranks,
    meet in the cell's list, which is one value by nature.
    """
    ranged = placed_rows.select("day", "period", "rank", key).repartitionByRange("day", "period", "rank", key)
    ranges = ranged.groupBy(F.spark_partition_id().alias("at"), "day", "period").agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("ranked"))
    lists = ranges.select("day", "period", F.struct("at", F.transform("ranked", lambda r: r[key]).alias("courses")).alias("range"))
    found = lists.groupBy("day", "period").agg(F.array_sort(F.collect_list("range")).alias("ranges"))
    return found.select("day", "period", F.flatten(F.transform("ranges", lambda r: r["courses"])).alias("courses"))


def build_grid(slots: DataFrame, term: str | None = None, key: str = "idx", rank: str | None = None, page: int | None = None) -> DataFrame:
    return cells(placed(slots, term, key, rank), key, page)


def unique_count(placed_rows: DataFrame, key: str = "idx") -> DataFrame:
    return placed_rows.agg(F.countDistinct(key).alias("n"))


def has_saturday(slots: DataFrame) -> DataFrame:
    """One row: whether any valid slot is on Saturday."""
    valid = on_grid(F.col("day"), F.col("period"))
    return slots.agg(F.coalesce(F.bool_or(valid & (F.col("day") == 5)), F.lit(False)).alias("has_saturday"))


def cell(grid: DataFrame, day: int, period: int) -> DataFrame:
    return grid.where((F.col("day") == day) & (F.col("period") == period))


def densify(grid: DataFrame, days: int = 6, periods: int = 6) -> DataFrame:
    """Every cell of ``days`` by ``periods``, empty ones with no courses; others dropped."""
    frame = grid.sparkSession.range(days * periods).select((F.col("id") / periods).cast("int").alias("day"), (F.col("id") % periods + 1).cast("int").alias("period"))
    kind = dict(grid.dtypes)["courses"]
    return frame.join(grid, ["day", "period"], "left").select("day", "period", F.coalesce("courses", F.array().cast(kind)).alias("courses"))


def day_count(saturday: bool) -> int:
    """Days that a grid shows: Saturday only if something is there."""
    return 6 if saturday else 5


def ordered_cells(grid: DataFrame) -> DataFrame:
    """Cells row by row: all days of the first period, then of the next."""
    return grid.orderBy("period", "day")


def clash_set(found: DataFrame, planned: DataFrame, key: str = "idx") -> DataFrame:
    """(key): candidates (day, period, key) that meet a course of the plan (day, period, key) in a cell and are not in it."""
    mine = planned.select("day", "period").distinct()
    return found.join(mine, ["day", "period"], "left_semi").select(key).distinct().join(planned.select(key).distinct(), key, "left_anti")


def conflicts(grid: DataFrame) -> DataFrame:
    return grid.where(F.size("courses") >= 2)


def conflict_rows(placed_rows: DataFrame, key: str = "idx") -> DataFrame:
    """(day, period, key) of cells with two courses and more."""
    many = cell_counts(placed_rows).where("n >= 2").select("day", "period")
    return placed_rows.join(F.broadcast(many), ["day", "period"], "left_semi").select("day", "period", key)


def year_long_rows(rows: DataFrame, terms: DataFrame, year_long: str = YEAR_LONG) -> DataFrame:
    """The year-long ones of ``rows`` (term and more), once for each of ``terms`` (base), the few labels of a facet; more than that are an error."""
    every = terms.select("base").distinct()
    found = [r["base"] for r in every.limit(MAX_TERMS + 1).collect()]
    if len(found) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    kind = every.schema["base"].dataType
    return rows.where(F.col("term") == year_long).withColumn("base", F.explode(F.array(*[F.lit(b) for b in sorted(found)]).cast(ArrayType(kind))))


def spread_terms(rows: DataFrame, terms: DataFrame, year_long: str = YEAR_LONG) -> DataFrame:
    """``rows`` (term and more) with base: their own term, or for year-long rows each of ``terms`` (base)."""
    return rows.where(F.col("term") != year_long).withColumn("base", F.col("term")).unionByName(year_long_rows(rows, terms, year_long))


def plan_conflict_rows(slots: DataFrame, key: str = "idx", order: Column | None = None, year_long: str = YEAR_LONG) -> DataFrame:
    """(day, period, key, term): clashes of each real term, the same clash once, in its first term.

    Year-long is no term of its own: its slots are dealt to every other term.
    Clashes of two terms are the same if their courses are, which two sums of
    hashes and the count tell, so that no list is formed.
    """
    order = F.col("term") if order is None else order
    at = F.struct(order.alias("o"), F.col("term").alias("t"))
    real = slots.where(F.col("term") != year_long)
    dealt = spread_terms(slots.where(on_grid(F.col("day"), F.col("period"))), real.select(F.col("term").alias("base")), year_long)
    rows = dealt.select(F.col("base").alias("term"), "day", "period", key).distinct()
    found = rows.groupBy("term", "day", "period").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key)).alias("h"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("g")).where("n >= 2")
    first = found.groupBy("day", "period", "n", "h", "g").agg(F.min_by("term", at).alias("term")).select("day", "period", "term")
    return rows.join(small_side(first), ["day", "period", "term"], "left_semi").select("day", "period", key, "term")


def plan_conflicts(slots: DataFrame, key: str = "idx", order: Column | None = None, year_long: str = YEAR_LONG) -> DataFrame:
    """(day, period, courses, term) of a plan: the rows of ``plan_conflict_rows`` as lists, which the plan's size bounds."""
    rows = plan_conflict_rows(slots, key, order, year_long)
    return rows.groupBy("day", "period", "term").agg(F.array_sort(F.collect_list(key)).alias("courses")).select("day", "period", "courses", "term")


def overlay(candidates: DataFrame, plan: DataFrame) -> DataFrame:
    """A plan's cell hides the candidates of that cell."""
    mine = plan.select("day", "period", F.col("courses").alias("own"))
    return candidates.join(mine, ["day", "period"], "full_outer").select("day", "period", F.coalesce("own", "courses").alias("courses"), F.col("own").isNotNull().alias("planned"))
