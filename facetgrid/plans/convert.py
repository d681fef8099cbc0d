"""Raw course rows to an encoded dataset, as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetgrid.functions.text import none_if_blank, or_other, utrim, weekday_index
from facetgrid.operators import dictionaries as dic
from facetgrid.operators import containers
from facetgrid.operators.bitmaps import bitmap_rows
from facetgrid.operators.dictionaries import small_side
from facetgrid.operators.grid import year_long_rows
from facetgrid.operators.slots import YEAR_LONG, good_slots, parse_slots, warnings_of


@dataclass(frozen=True)
class Dataset:
    """Frames of a converted catalogue.

    courses: (idx, cd, ... as on the wire, labels term, department, campus, kubun
    besides); slots: (idx, pos, term, day, period, s); dictionaries by name:
    (idx, label); members: (facet, value, idx), the relational form of the filter
    index; warnings: (ord, warning); facts: one row (totalRaw, year).
    """

    courses: DataFrame
    slots: DataFrame
    dictionaries: dict[str, DataFrame]
    members: DataFrame
    warnings: DataFrame
    facts: DataFrame


def with_ordinal(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ord", F.col("file_ord").cast("long") * (1 << 40) + F.col("item"))


def first_rows(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """The first row of each code; the later ones own nothing but slots.  ``copies``: a column for how many rows there were."""
    rest = [c for c in rows.columns if c not in ("cd", "ord")]
    more = [F.count("*").alias(copies)] if copies else []
    kept = rows.groupBy("cd").agg(F.min_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("ord"), *more)
    return kept.select("cd", "ord", "r.*", *([copies] if copies else []))


#: Rows of a file that are numbered in one task.
BLOCK = 100_000


def dense_index(first: DataFrame) -> DataFrame:
    """``first`` with idx: position by ordinal.

    Rows are counted and numbered by blocks of a file's positions, so no window
    spans a file; only the blocks' sizes are summed up in order, file by file and
    then over the files.
    """
    block = F.floor(F.col("item") / BLOCK)
    sizes = first.groupBy("file_ord", block.alias("block")).agg(F.count("*").alias("n"))
    of_file = W.partitionBy("file_ord").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inner = sizes.select("file_ord", "block", F.coalesce(F.sum("n").over(of_file), F.lit(0)).alias("inner"))
    files = sizes.groupBy("file_ord").agg(F.sum("n").alias("n"))
    before = files.select("file_ord", (F.sum("n").over(W.orderBy("file_ord")) - F.col("n")).alias("before"))
    start = small_side(inner.join(before, "file_ord").select("file_ord", "block", (F.col("inner") + F.col("before")).alias("start")))
    within = F.row_number().over(W.partitionBy("file_ord", "block").orderBy("ord")) - 1
    numbered = first.withColumn("block", block).withColumn("within", within)
    return numbered.join(start, ["file_ord", "block"]).withColumn("idx", (F.col("start") + F.col("within")).cast("int")).drop("start", "within", "block")


def merged_slots(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(cd, ord, pos, term, day, period): all slots of the first row, and of later ones what is new."""
    parsed = rows.select("cd", "ord", F.posexplode(good_slots(F.col("parsed"))).alias("pos", "slot")).select("cd", "ord", "pos", "slot.*")
    owned = parsed.join(first.select("cd", F.col("ord").alias("first_ord")), "cd").withColumn("own", F.col("ord") == F.col("first_ord"))
    same = W.partitionBy("cd", "term", "day", "period")
    judged = owned.select("*", F.bool_or("own").over(same).alias("has_own"), F.row_number().over(same.orderBy("ord", "pos")).alias("at"))
    return judged.where("own or (not has_own and at = 1)").select("cd", "ord", "pos", "term", "day", "period")


def warnings(rows: DataFrame, blank: DataFrame) -> DataFrame:
    """(ord, warning) in the order of the rows."""
    tag = F.concat(F.lit("["), F.col("kogiCd"), F.lit("] "))
    named = F.concat(tag, F.col("kogiNm"), F.lit(": "))
    empty_name = F.when(utrim("kogiNm") == "", F.array(F.concat(tag, F.lit("course name is empty"))))
    parts = F.transform(warnings_of(F.col("parsed")), lambda w: F.concat(named, w))
    nothing = F.when((F.col("jikanwari") != "") & (F.size(good_slots(F.col("parsed"))) == 0), F.array(F.concat(named, F.lit("no slot could be read from "), F.col("jikanwari"))))
    none = F.array().cast("array<string>")
    said = rows.select("ord", F.explode(F.concat(F.coalesce(empty_name, none), parts, F.coalesce(nothing, none))).alias("warning"))
    skipped = blank.select("ord", F.concat(F.lit("[item "), (F.col("item") + 1).cast("string"), F.lit("] course code is empty; skipped")).alias("warning"))
    return said.unionByName(skipped)


def convert(raw: DataFrame) -> Dataset:
    """``raw``: rows of ``sources.ingest.raw_courses``."""
    ordered = with_ordinal(raw).withColumn("cd", utrim("kogiCd"))
    blank = ordered.where("cd = ''")
    rows = ordered.where("cd <> ''").withColumn("parsed", parse_slots(F.col("jikanwari")))
    first = first_rows(rows.drop("parsed"))
    merged = merged_slots(rows, first)

    name, official = utrim("kogiNm"), utrim("gakusokuKamokuNm")
    labelled = dense_index(first).select(
        "idx", "cd", "ord", name.alias("nm"), none_if_blank("fukudai").alias("sub"), utrim("tantoKyoin").alias("prof"), F.col("jikanwari").alias("raw"),
        or_other("kogiKaikojikiNm").alias("term"), or_other("kogiKubunNm").alias("kubun"), or_other("sekininBushoNm").alias("department"), or_other("kochiNm").alias("campus_label"),
        F.when((official != "") & (official != name), official).alias("gaku"), none_if_blank("taishoGakka").alias("gakka"), none_if_blank("taishoNenji").alias("nen"),
        none_if_blank("kamokuBunrui").alias("bunrui"), none_if_blank("kamokuBunya").alias("bunya"), none_if_blank("syllabusKomokuPatternId").alias("pat"),
    )
    dictionaries = {
        "semesters": dic.terms(rows.select(F.explode(good_slots(F.col("parsed"))).alias("s")).select("s.term").where("term <> ''")),
        "departments": dic.catch_all_last(labelled.select("department")),
        "campuses": dic.campuses(labelled.select("campus_label")),
        "kubun": dic.catch_all_last(labelled.select("kubun")),
        "kaikojiki": dic.terms(labelled.select("term")),
    }
    encoded = labelled
    for column, source, into in (("term", "kaikojiki", "ki"), ("kubun", "kubun", "kbn"), ("department", "departments", "dept"), ("campus_label", "campuses", "campus")):
        encoded = dic.encode(encoded, column, dictionaries[source], into)

    placed = merged.join(labelled.select("cd", "idx"), "cd").withColumn("day", weekday_index("day"))
    slots = dic.encode(placed, "term", dictionaries["semesters"], "s", default=None).select("idx", "ord", "pos", "term", "day", "period", "s")
    listed = slots.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "s", "day", "period"))).alias("l"))
    slot = F.transform("l", lambda x: F.struct(x["s"].alias("s"), x["day"].alias("d"), x["period"].alias("p")))
    none = F.array().cast("array<struct<s:int,d:int,p:int>>")
    courses = encoded.join(listed, "idx", "left").withColumn("slots", F.coalesce(slot, none)).drop("l", "ord")

    own = slots.select(F.col("s").alias("value"), "idx")
    spread = year_long_rows(slots.where(F.col("term") == YEAR_LONG).select("term", "idx").distinct(), dictionaries["semesters"].select(F.col("idx").alias("base")))
    of_term = own.unionByName(spread.select(F.col("base").alias("value"), "idx")).distinct()
    members = of_term.select(F.lit("semester").alias("facet"), "value", "idx")
    for facet, column in (("department", "dept"), ("campus", "campus")):
        members = members.unionByName(encoded.select(F.lit(facet).alias("facet"), F.col(column).alias("value"), "idx"))

    year = none_if_blank("kaikoNendo")
    facts = ordered.agg(F.count("*").cast("int").alias("totalRaw"), F.coalesce(F.min_by(year, F.when(year.isNotNull(), F.col("ord"))), F.lit("")).alias("year"))
    return Dataset(courses, slots.drop("ord"), dictionaries, members, warnings(rows, blank), facts)


def with_details(courses: DataFrame, details: DataFrame) -> DataFrame:
    """Card fields of details: unit, dm (unknown is none) and ev (``kind`` or ``kind:weight``)."""
    mode = F.when(F.col("delivery.mode") != "unknown", F.col("delivery.mode"))
    kinds = F.transform("eval.rows", lambda r: F.concat(r["type"], F.when(r["weight"].isNull(), "").otherwise(F.concat(F.lit(":"), r["weight"].cast("string")))))
    card = details.select("cd", "unit", mode.alias("dm"), kinds.alias("ev"))
    return courses.join(card, "cd", "left")


def search_fields(courses: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(idx, name, subtitle, instructor, code, keywords), not yet folded."""
    rows = courses
    if details is not None:
        words = F.transform("keywords", lambda k: F.regexp_replace(k, "[\r\n]", " "))
        rows = rows.join(details.select("cd", F.array_join(words, " ").alias("_words")), "cd", "left")
    else:
        rows = rows.withColumn("_words", F.lit(None).cast("string"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select("idx", F.col("nm").alias("name"), F.coalesce("sub", F.lit("")).alias("subtitle"), F.col("prof").alias("instructor"), F.col("cd").alias("code"), F.concat_ws(" ", some("department"), some("bunya"), some("bunrui"), some("_words")).alias("keywords"))


def wire_bitmaps(members: DataFrame, n: int) -> DataFrame:
    """(facet, value, wire) of a catalogue of ``n`` rows."""
    keyed = members.select(F.struct("facet", "value").alias("of"), "idx")
    rows = bitmap_rows(keyed, "of", "idx").select("value.facet", F.col("value.value").alias("value"), "bucket", "bits")
    return containers.wire(rows, n, "facet", "value")


#: Courses of one part of a document.
PART_ROWS = 4096


def document_parts(data: Dataset, generated_at: str, details: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(part, text): the dataset document in pieces, safe to stand in HTML; in the order of ``part`` they are the document.

    Part 0 is the head with dictionaries and indices, the last one the tail;
    between them each part has the courses of
    ``part_rows`` positions, made by one task.  No part has all courses.
    """
    def ordered(df: DataFrame, order: str, value: Column) -> DataFrame:
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias("l"))

    courses = data.courses if details is None else with_details(data.courses, details)
    if details is None:
        courses = courses.withColumns({"unit": F.lit(None).cast("string"), "dm": F.lit(None).cast("string"), "ev": F.lit(None).cast("array<string>")})
    wire = F.struct("cd", "nm", "sub", "prof", "raw", "slots", "ki", "kbn", "dept", "campus", "gaku", "gakka", "nen", "bunrui", "bunya", "pat", "unit", "dm", "ev")
    n = data.courses.count()
    maps = wire_bitmaps(data.members, n)
    head = data.facts
    for name, entries in data.dictionaries.items():
        head = head.join(ordered(entries, "idx", F.col("label")).withColumnRenamed("l", f"d_{name}"), how="cross")
    for facet in ("semester", "department", "campus"):
        head = head.join(ordered(maps.where(F.col("facet") == facet), "value", F.col("wire")).withColumnRenamed("l", f"i_{facet}"), how="cross")
    opening = F.to_json(F.struct(
        F.lit(3).alias("version"), F.lit(generated_at).alias("generatedAt"), "year", "totalRaw",
        F.struct(*[F.col(f"d_{k}").alias(k) for k in ("semesters", "departments", "campuses", "kubun", "kaikojiki")]).alias("dicts"),
        F.struct(*[F.col(f"i_{k}").alias(k) for k in ("semester", "department", "campus")]).alias("indices"),
    ))
    opening = head.select(F.lit(0).alias("part"), F.concat(F.rtrim(opening, F.lit("}")), F.lit("}"), F.lit(',"courses":[')).alias("text"))
    of = (F.floor(F.col("idx") / part_rows) + 1).cast("int").alias("part")
    lists = courses.select(of, F.struct("idx", F.to_json(wire).alias("json")).alias("c")).groupBy("part").agg(F.array_sort(F.collect_list("c")).alias("l"))
    body = lists.select("part", F.concat(F.when(F.col("part") > 1, ",").otherwise(""), F.array_join(F.transform("l", lambda c: c["json"]), ",")).alias("text"))
    tail = data.courses.sparkSession.range(1).select(F.lit(n // part_rows + 2).alias("part"), F.lit("]}").alias("text"))
    return opening.unionByName(body).unionByName(tail).select("part", html_safe(F.col("text")).alias("text"))


def document(data: Dataset, generated_at: str, details: DataFrame | None = None) -> DataFrame:
    """One row, one column ``json``: the whole document, for catalogues that fit one value; others are written in parts."""
    parts = document_parts(data, generated_at, details)
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("json"))


def html_safe(json: Column) -> Column:
    """The signs that could end a script element, as escapes."""
    for sign in "<>&  ":
        json = F.replace(json, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return json
