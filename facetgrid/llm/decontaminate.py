"""Benchmark decontamination with a broadcast hash set of item n-grams.

Native: DataFrame and SQL functions only.  Items become windows of ``n`` words
(an item of fewer words is one window); equal windows are one row with the list
of their items, keyed by a 64-bit hash.  Documents are scanned once: each word
position is turned into its window's hash, which is looked up in the broadcast
set, and a found window is verified word by word.  Only hits, and one row for
each document, are shuffled.  The windows are written and counted first; above
``max_broadcast`` (or MAX_BROADCAST_BYTES of words) the look-up is a shuffle join
of hashes and positions, and what it finds is verified on the documents' words.

Nulls and odd input: a null text has no words; a null item text has no windows;
a null item_id marks words but is not listed.  Repeated rows give one row each,
also if their doc_id is null.  Rows with one doc_id and different texts are
documents of their own.  Empty tables give no hits, or no rows.  Columns beside
doc_id and text are untouched (``decontaminate``) or left out (``find_hits``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgrid.llm.common import ascii_lower, fresh, materialize

#: Words of lower-cased text, and of text as it stands.
LOWERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AS_IS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_BROADCAST_WINDOWS = 1_000_000
MAX_BROADCAST_BYTES = 128 << 20
MAX_BROADCAST_KEYS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(LOWERED), F.lit(0))


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(h, len, gram, items): each distinct window once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = items.withColumn("len", F.least(F.size("w"), F.lit(n)))
    each = sized.select("item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    grams = each.select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("h", F.xxhash64("gram"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, doc_key, n_words, n_hit, items, spans.

    ``spans``: maximal runs of hit words, ``array<struct<start, end>>`` (word
    positions, end exclusive).  ``doc_key``: hash of doc_id and text.
    """
    windows = materialize(item_windows(benchmark, n), "windows")
    known = windows.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("gram", " "))).alias("bytes"), F.array_sort(F.collect_set("len")).alias("lens")).first()
    lens = list(known["lens"]) or [n]
    small = known["rows"] <= max_broadcast and (known["bytes"] or 0) <= MAX_BROADCAST_BYTES

    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), words_of(F.col("text")).alias("w"))
    each = base.select("doc_id", "doc_key", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "_"))
    each = each.withColumn("pos", F.coalesce("pos", F.lit(0)))
    size = F.lit(lens[0]) if len(lens) == 1 else F.explode(F.array(*[F.lit(x) for x in lens]))
    each = each.select("doc_id", "doc_key", "w", "n_words", "pos", size.alias("len"))
    gram = F.slice(F.col("w"), F.col("pos") + 1, F.col("len"))
    h = F.when(F.col("pos") + F.col("len") <= F.col("n_words"), F.xxhash64(gram))
    first = (F.col("pos") == 0) & (F.col("len") == lens[0])
    key = ["doc_id", "doc_key", "n_words", "pos", "len"]
    found = windows.select("h", F.col("len").alias("wlen"), F.col("gram").alias("wgram"), "items")
    if small:
        on = (F.col("q.h") == F.col("found.h")) & (F.col("len") == F.col("wlen")) & (gram == F.col("wgram"))
        joined = each.withColumn("h", h).alias("q").join(F.broadcast(found.alias("found")), on, "left")
        rows = joined.where(F.col("items").isNotNull() | first).select(*key, "items", first.alias("first"))
    else:
        # Only hashes and positions are shuffled; what they find is verified on the texts of documents with finds.
        probes = each.select("doc_id", "doc_key", "pos", "len", h.alias("h")).where(F.col("h").isNotNull())
        on = (F.col("q.h") == F.col("found.h")) & (F.col("len") == F.col("wlen"))
        finds = probes.alias("q").join(found.alias("found"), on).select("doc_id", "doc_key", F.struct("pos", "len", "wgram", "items").alias("find"))
        finds = finds.groupBy("doc_id", "doc_key").agg(F.collect_set("find").alias("finds")).alias("f")
        same = F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.doc_key") == F.col("f.doc_key"))
        seen = base.alias("b").join(finds, same).select("b.doc_id", "b.doc_key", "w", F.explode("finds").alias("find"))
        true = seen.where(F.slice(F.col("w"), F.col("find.pos") + 1, F.col("find.len")) == F.col("find.wgram"))
        hits = true.select("doc_id", "doc_key", F.size("w").alias("n_words"), "find.pos", "find.len", "find.items", F.lit(False).alias("first"))
        none = F.lit(None).cast("array<string>").alias("items")
        heads = base.select("doc_id", "doc_key", F.size("w").alias("n_words"), F.lit(0).alias("pos"), F.lit(lens[0]).alias("len"), none, F.lit(True).alias("first"))
        rows = hits.unionByName(heads)

    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")))
    grouped = rows.groupBy("doc_id", "doc_key", "n_words").agg(
        F.count(F.when(F.col("first"), 1)).alias("copies"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # The longest hit at each position; a hit reaches over the n-1 next positions at most.
    longest = grouped.withColumn("hits", F.filter("hits", lambda t, i: F.coalesce(F.get(F.col("hits"), i + 1)["start"] != t["start"], F.lit(True))))
    hits = F.col("hits")
    back = lambda i: F.slice(hits, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)))
    starts = F.filter(hits, lambda t, i: ~F.exists(back(i), lambda p: p["end"] >= t["start"]))
    around = lambda i: F.slice(hits, F.greatest(i - n, F.lit(0)) + 1, F.lit(2 * n + 1))
    ends = F.filter(hits, lambda t, i: ~F.exists(around(i), lambda p: (p["start"] <= t["end"]) & (p["end"] > t["end"])))
    edges = longest.select("doc_id", "doc_key", "n_words", "copies", "items", F.transform(starts, lambda t: t["start"]).alias("s"), F.array_distinct(F.transform(ends, lambda t: t["end"])).alias("e"))
    spans = edges.withColumn("spans", F.zip_with("s", "e", lambda s, e: F.struct(s.alias("start"), e.alias("end"))))
    n_hit = F.aggregate("spans", F.lit(0), lambda t, s: t + s["end"] - s["start"])
    return spans.select("doc_id", "doc_key", "n_words", n_hit.alias("n_hit"), "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_c")).drop("_c")


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans and the separators after them."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(AS_IS), F.lit(0))
    gaps = F.split(text, AS_IS, -1)
    n = F.size(words)
    units = F.zip_with(words, F.slice(gaps, F.lit(2), n), lambda w, g: F.concat(w, g))
    froms = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    tos = F.concat(F.transform(spans, lambda s: s["start"]), F.array(n))
    kept = F.zip_with(froms, tos, lambda a, b: F.array_join(F.slice(units, a + 1, b - a), ""))
    return F.concat(gaps[0], F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = 10, max_broadcast: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """``docs`` without contaminated documents ("documents") or hit spans ("spans").

    The keys of contaminated documents are written to the shared folder and
    counted; up to ``max_broadcast`` they are broadcast and the texts are not
    shuffled, above it the join is a shuffle join.
    """
    if action not in ("documents", "spans"):
        raise ValueError(action)
    (key, doc, spans) = fresh(docs, "doc_key", "doc", "spans")
    hits = find_hits(docs.select("doc_id", "text"), benchmark, n).where(F.col("n_hit") > 0)
    hits = materialize(hits.select(F.col("doc_key").alias(key), F.col("doc_id").alias(doc), F.col("spans").alias(spans)).dropDuplicates([key, doc]), "hits")
    if hits.count() <= max_broadcast:
        hits = F.broadcast(hits)
    # Both the hash of the row and its doc_id must agree.
    same = (F.xxhash64("doc_id", "text") == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
    if action == "documents":
        return docs.join(hits, same, "left_anti").select(*docs.columns)
    joined = docs.join(hits, same, "left")
    text = F.when(F.col(spans).isNotNull(), without_spans(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns)
