"""The query façade: it builds plans; the caller runs them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgrid.functions.text import haystack, parse_credits
from facetgrid.operators import grid as g
from facetgrid.operators import search as s
from facetgrid.operators.dictionaries import TERMS, known_order, small_side
from facetgrid.operators.gram_index import GramIndex
from facetgrid.operators.slots import YEAR_LONG
from facetgrid.operators.tallies import credit_axes
from facetgrid.plans.convert import Dataset


@dataclass(frozen=True)
class Filters:
    """None (or "all" through ``query``) leaves a facet open."""

    term: str | None = None
    department: str | None = None
    campus: str | None = None
    query: str = ""


@dataclass(frozen=True)
class QueryResult:
    cells: DataFrame
    count: DataFrame
    highlights: DataFrame


class Engine:
    """Facet filters, ranked search, grids and plan summaries over a dataset."""

    def __init__(self, data: Dataset, index: DataFrame | None = None) -> None:
        self.data = data
        self.index = index
        self.grams: GramIndex | None = None
        c = F.col
        text = haystack(c("nm"), c("sub"), c("prof"), c("cd"), c("department"), *[F.coalesce(c(x), F.lit("")) for x in ("bunya", "bunrui")])
        self.courses = data.courses.withColumn("haystack", text)

    def load_index(self, index: DataFrame) -> None:
        """Searches are ranked from now on."""
        self.index = index

    def load_grams(self, grams: GramIndex) -> None:
        """Searches are ranked from postings from now on; texts are not read."""
        self.grams = grams

    @property
    def dicts(self) -> dict[str, DataFrame]:
        return self.data.dictionaries

    def views(self) -> DataFrame:
        return self.data.courses.orderBy("idx")

    def has_saturday(self) -> DataFrame:
        return g.has_saturday(self.data.slots)

    def _term_is_known(self, term: str | None) -> bool:
        return term is not None and not self.data.dictionaries["semesters"].where(F.col("label") == term).isEmpty()

    def candidates(self, f: Filters) -> DataFrame:
        """Courses within all facets; an unknown value leaves none."""
        rows = s.narrow(self.courses, {"department": f.department, "campus_label": f.campus})
        if f.term is not None:
            known = self._term_is_known(f.term)
            own = self.data.slots.where(F.col("term").isin(f.term, YEAR_LONG) if known else F.lit(False)).select("idx").distinct()
            rows = rows.join(own, "idx", "left_semi")
        return rows

    def filter(self, f: Filters) -> DataFrame:
        """(idx) ascending: facets and the literal in the joined fields, unranked."""
        return self.candidates(f).where(s.contains_literal(F.col("haystack"), f.query)).select("idx").orderBy("idx")

    def search(self, f: Filters) -> DataFrame:
        """(idx, score, spans); without a query all candidates, without an index the filter's rows, both unranked."""
        if not f.query:
            return s.unranked(self.candidates(f))
        if self.grams is not None:
            found = self.grams.ranked(self.data.courses.sparkSession, f.query)
            return found.join(self.candidates(f).select("idx"), "idx", "left_semi")
        if self.index is None:
            return s.unranked(self.candidates(f).where(s.contains_literal(F.col("haystack"), f.query)))
        return s.ranked(self.index.join(self.candidates(f).select("idx"), "idx", "left_semi"), f.query)

    def _slots_of(self, rows: DataFrame) -> DataFrame:
        return self.data.slots.join(rows, "idx")

    def grid(self, indices: DataFrame, term: str | None = None, page: int | None = None) -> DataFrame:
        """Cells of courses (idx[, rank]), the first ``page`` of each if given; an unknown term does not filter."""
        term = term if self._term_is_known(term) else None
        return g.build_grid(self._slots_of(indices), term, rank="rank" if "rank" in indices.columns else None, page=page)

    def search_grid(self, hits: DataFrame, term: str | None = None, page: int | None = None) -> DataFrame:
        """Cells best first: the rank is the score, then the position; whole cells, or the first ``page`` of each."""
        ranked = hits.select("idx", F.struct((-F.col("score")).alias("s"), "idx").alias("rank"))
        if page is not None:
            return self.grid(ranked, term, page)
        return g.whole_cells(g.placed(self._slots_of(ranked), term if self._term_is_known(term) else None, rank="rank"))

    def query(self, term: str = "all", department: str = "all", campus: str = "all", query: str = "", page: int | None = None) -> QueryResult:
        """``page``: at most so many courses of a cell, the best; all of them without it."""
        f = Filters(s.chosen(term), s.chosen(department), s.chosen(campus), query)
        hits = self.search(f)
        known = f.term if self._term_is_known(f.term) else None
        rows = g.placed(self._slots_of(hits.select("idx")), known)
        names = s.name_spans(hits).join(self.data.courses.select("idx", "cd"), "idx").select("cd", "name_spans")
        return QueryResult(self.search_grid(hits, f.term, page), g.unique_count(rows), names)

    def filter_and_grid(self, days: int = 6, **facets: str | int) -> QueryResult:
        """``query`` with every cell present."""
        found = self.query(**facets)
        return QueryResult(g.densify(found.cells, days), found.count, found.highlights)

    def resolve(self, codes: DataFrame) -> DataFrame:
        """(idx) of known codes (cd), each once, ascending."""
        return resolve(self.data.courses, codes).orderBy("idx")

    def plan_grid(self, codes: DataFrame, term: str | None = None, days: int = 6) -> DataFrame:
        return g.densify(self.grid(self.resolve(codes), term), days)

    def plan_summary(self, indices: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(conflicts, credit tallies) of a plan (idx); repeated indices count again in the tallies only."""
        clashes = g.plan_conflicts(self._slots_of(indices.select("idx").distinct()), order=term_rank(F.col("term")))
        credits = self.data.courses.join(indices.select("idx"), "idx")
        unit = F.col("unit") if "unit" in credits.columns else F.lit(None).cast("string")
        return clashes, credit_axes(credits.withColumn("credit", parse_credits(unit)))


def resolve(courses: DataFrame, codes: DataFrame, code: str = "cd", key: str = "idx") -> DataFrame:
    """(key) of the courses whose code is among ``codes``, each once; unknown and repeated codes do nothing."""
    return courses.join(small_side(codes.select(code).distinct()), code, "left_semi").select(key)


def term_rank(term: Column) -> Column:
    return F.struct(known_order(term, TERMS), term)
