"""Inverted index of character trigrams for literal search.

Texts are put one after another in blocks of some ``SLICE`` characters.  A row of
the index is a gram with its places in one block: UTF-16 units from the block's
start, ascending, as steps of one to five bytes.  A row of part -1 says where the
block's texts begin.  So an occurrence is one step, and a text is named once.
Every place begins one gram; those at the end of a text are shorter, so literals
of one or two letters are ranges of grams.

Rows are a Parquet table, partitioned by ``part`` (a hash of the gram) and sorted
by gram within.  A task writes the blocks of the texts that it reads: nothing is
shuffled, as postings take more room than texts.  Where that makes many small
files, they are merged.  A query reads the pages of its own grams in each file of
their parts.

A literal is found by places alone: grams at offsets that cover it are shifted to
where the literal starts, and what all of them share are its occurrences.  The
rarest gram is read first and its blocks narrow the others.

Long texts are indexed in slices that overlap by two characters, which may stand
in several blocks.  A null field is an empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgrid.functions.text import fold, fold_text
from facetgrid.operators.dictionaries import MAX_BROADCAST
from facetgrid.operators.search import FIELDS, SPANS, WEIGHTS
from facetgrid.sources.shared import located

PARTS = 64
SLICE = 1 << 20
#: Bytes that the files of a task should have at least; where they have less on average, they are merged.
SEGMENT = 4 << 20
#: The part of the rows that say where texts begin.
BOUNDS = -1
#: Ends a text, so that its last character begins a bigram too; no character has this code, and no gram stores it.
END = 0x110000


def utf16_len(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def part_of(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Block:
    """Of texts (or slices) in a row: distinct grams, bounds of their places, all places, the text of each, and where texts begin."""

    grams: list[str]
    bounds: np.ndarray
    places: np.ndarray
    texts: np.ndarray
    begins: np.ndarray


def _grams(texts: list[str], starts: list[int], ends: list[bool], size: int, block: bool = False) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | Block:
    """Of texts (or slices): for each text and distinct gram its text and string, bounds of the positions, and all positions.

    ``starts``: the position of a slice in its text.  A slice that does not end
    its text has up to two characters of the next one, which gives their grams.
    ``block``: the grams that begin at any place, whatever text has them.
    """
    codes = np.frombuffer("  ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts])
    firsts = np.cumsum(lengths + 2) - (lengths + 2)
    wide = np.concatenate([[0], np.cumsum(1 + (codes > 0xFFFF))])
    text = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(text)) + 2 * text  # places in ``codes`` of all but what ends a text
    own = at - firsts[text]
    last = np.array(ends)
    own_length = np.where(last, lengths, SLICE)
    keep = own < (own_length if size == 2 or block else np.minimum(own_length, lengths - 2))[text]
    if not keep.all():
        text, at = text[keep], at[keep]
    padded = codes.astype(np.int64)
    padded[np.concatenate([firsts + lengths, firsts + lengths + 1])] = END
    if block:
        order, numbers = _order(padded, at, size)
        text, at = text[order], at[order]
        new = numbers[1:] != numbers[:-1]
    else:
        packed = np.zeros(len(at), dtype=np.int64)
        for k in range(size):
            packed = packed << 21 | padded[at + k]
        order = np.lexsort((packed, text))
        text, packed, at = text[order], packed[order], at[order]
        new = (packed[1:] != packed[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(np.concatenate([[True], new]) if len(at) else np.zeros(0, dtype=bool))
    positions = wide[at] if block else (wide[at] - wide[firsts[text]] + np.array(starts)[text]).astype(np.int32)
    letters = np.stack([padded[at[heads] + k] for k in range(size)], axis=1)
    letters[:, 1:][np.logical_or.accumulate(letters == END, axis=1)[:, :-1]] = END
    ended = (letters == END).sum(axis=1)
    flat = np.where(letters == END, 0, letters).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    grams = [flat[k : k + size] for k in range(0, len(flat), size)]
    for k in np.flatnonzero(ended).tolist():
        grams[k] = grams[k][: -ended[k]]
    if block:
        return Block(grams, np.append(heads, len(at)), positions, text, wide[firsts])
    return text[heads], grams, np.append(heads, len(at)), positions


def _order(codes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` by the ``size`` characters from each, equal ones as they stand; and numbers of these characters in that order."""
    seen = np.zeros(END + 1, dtype=bool)
    seen[codes] = True
    bits, room = int(seen.sum()).bit_length(), len(at).bit_length()
    ids = (np.cumsum(seen) - 1)[codes]
    grams = np.zeros(len(at), dtype=np.int64)
    for k in range(size):
        grams = grams << bits | ids[at + k]
    if size * bits + room > 63:
        order = np.argsort(grams, kind="stable")
        return order, grams[order]
    grams = grams << room | np.arange(len(at))  # distinct numbers are sorted faster than places by numbers
    grams.sort()
    return grams & (1 << room) - 1, grams >> room


def _slices(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str], list[int], list[bool]]]:
    """Groups of some ``SLICE`` characters: rows, texts or slices of them, where they start, and whether they end their text."""
    group: list[tuple[int, str, int, bool]] = []
    have = 0
    for row, text in enumerate(texts):
        start = 0
        for at in range(0, len(text), SLICE):
            ends = at + SLICE >= len(text)
            group.append((row, text[at : at + SLICE + 2] if not ends else text[at:], start, ends))
            have += len(group[-1][1])
            if have >= SLICE:
                yield tuple(map(list, zip(*group, strict=True)))
                group, have = [], 0
            if not ends:
                start += utf16_len(text[at : at + SLICE])
    if group:
        yield tuple(map(list, zip(*group, strict=True)))


def steps(places: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ascending places as steps from one to the next, anew at each head, lowest seven bits first; and where each step's bytes begin."""
    step = np.diff(places, prepend=0)
    step[heads] = places[heads]
    size = 1 + sum((step >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    begins = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begins[-1], dtype=np.uint8)
    at = begins[:-1]
    while len(at):
        more = step > 127
        out[at] = step & 127 | more * 128
        at, step = at[more] + 1, step[more] >> 7
    return out, begins


def places_of(data: bytes) -> np.ndarray:
    """The places that ``steps`` made the bytes of."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, last - first + 1))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << shift, first))


def postings(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """(block, gram, texts, places, data, and for a block's bounds keys, fields, begins, starts, cut); ``fields`` are positions in ``fields``."""
    folded = df.select(key, F.posexplode(F.array(*[fold(F.coalesce(c, F.lit(""))) for c in fields.values()])).alias("field", "text")).where("text <> ''")
    kind = df.schema[key].dataType
    plain = T.StructType.fromDDL("block long, gram string, texts int, places int, data binary")
    bounds = T.StructType([T.StructField("keys", T.ArrayType(kind)), *T.StructType.fromDDL("fields array<int>, begins array<int>, starts array<int>, cut array<boolean>").fields])
    out = T.StructType([*plain.fields, *bounds.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, kinds = TaskContext.get().partitionId() << 32, {}, [pa.null()]

        def texts() -> Iterator[str]:
            row = 0
            for batch in batches:
                kinds[0] = batch.column(0).type
                for name, field, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    held[row] = name, field
                    row += 1
                    yield text

        ints = pa.list_(pa.int32())
        types = lambda: [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(kinds[0]), ints, ints, ints, pa.list_(pa.bool_())]
        for rows, parts, starts, ends in _slices(texts()):
            b = _grams(parts, starts, ends, 3, block=True)
            named = [held[r] for r in rows]
            for r in [r for r in held if r < rows[-1]]:
                del held[r]
            cut = [s > 0 or not e for s, e in zip(starts, ends, strict=True)]
            row = [[block], [""], [len(rows)], [0], [None], [[n[0] for n in named]], [[n[1] for n in named]], [b.begins.tolist()], [starts], [cut]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types(), strict=True)], names=out.names)
            heads, whose = b.bounds[:-1], np.array(rows)[b.texts]
            data, begins = steps(b.places, heads)
            other = np.concatenate([[True], whose[1:] != whose[:-1]])
            other[heads] = True
            n = len(heads)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(begins[b.bounds].astype(np.int32)), pa.py_buffer(data)])
            values = [pa.array(np.full(n, block)), pa.array(b.grams, pa.string()), pa.array(np.add.reduceat(other, heads, dtype=np.int32)), pa.array(np.diff(b.bounds).astype(np.int32)), packed]
            yield pa.RecordBatch.from_arrays([*values, *[pa.nulls(n, t) for t in types()[5:]]], names=out.names)
            block += 1

    return folded.mapInArrow(run, out)


def finder(at: Mapping[int, str], shifts: Mapping[int, int], rarest: int, key: str) -> Callable[[pa.Table], pa.Table]:
    """Of the rows of one block: (key, field, shift, starts), shift -1, of the literal that has the grams ``at``, each by ``shifts`` units from its start.

    No ``at``: all places of all grams.  A text that is cut gives the starts by
    each of its grams, as others may stand in another block.
    """

    def run(rows: pa.Table) -> pa.Table:
        bounds = next((r for r in rows.select(["fields", "begins", "starts", "cut"]).to_pylist() if r["fields"] is not None), None)
        keys = rows["keys"].combine_chunks()
        kind = keys.type.value_type
        keys = keys.flatten()
        of, field, shift, lists = [], [], [], []
        places: dict[str, np.ndarray] = {}
        for gram, data in zip(rows["gram"].to_pylist(), rows["data"].to_pylist(), strict=True):
            if data is not None:
                places[gram] = places_of(data)
        if bounds and places:
            begins, starts, cut = np.array(bounds["begins"]), np.array(bounds["starts"]), np.array(bounds["cut"])

            def add(found: np.ndarray, texts: np.ndarray, back: int, by: int) -> None:
                """Places ``found`` in ascending ``texts``."""
                if not len(found):
                    return
                each, first = np.unique(texts, return_index=True)
                for t, part in zip(each.tolist(), np.split(found - begins[texts] + starts[texts] - back, first[1:]), strict=True):
                    of.append(t)
                    shift.append(by)
                    lists.append(part.astype(np.int32))

            if not at:
                found = np.sort(np.concatenate(list(places.values())))
                add(found, np.searchsorted(begins, found, "right") - 1, 0, -1)
            else:
                if all(g in places for g in at.values()):
                    common = places[at[rarest]] - shifts[rarest]
                    for k in at:
                        if k != rarest and len(common):
                            common = common[np.isin(common, places[at[k]] - shifts[k], assume_unique=True)]
                    texts = np.searchsorted(begins, common, "right") - 1
                    whole = ~cut[texts] & (texts >= 0)
                    add(common[whole], texts[whole], 0, -1)
                if cut.any():
                    for k, gram in at.items():
                        found = places.get(gram, np.zeros(0, dtype=np.int64))
                        texts = np.searchsorted(begins, found, "right") - 1
                        add(found[cut[texts]], texts[cut[texts]], shifts[k], k)
            field = np.array(bounds["fields"], dtype=np.int32)[of] if of else []
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        values = pa.array(np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32), pa.int32())
        named = keys.take(pa.array(of, pa.int64())) if of else pa.array([], kind)
        return pa.table([named, pa.array(field, pa.int32()), pa.array(shift, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, "field", "shift", "starts"])

    return run


@dataclass(frozen=True)
class GramIndex:
    """An index at ``path``: the table ``postings``."""

    path: str
    key: str
    fields: tuple[str, ...]
    parts: int = PARTS

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def of(self, spark: SparkSession, name: str, size: int, grams: list[str]) -> DataFrame:
        """Rows of the given grams of ``size`` letters: their partitions and pages only.  Fewer than three letters are ranges of grams in all partitions."""
        rows = self.read(spark, name)
        if size < 3:
            return rows.where((F.col("part") != BOUNDS) & reduce(Column.__or__, [_starting(g) for g in grams]))
        parts = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(part_of(F.col("gram"), self.parts)).distinct().collect()]
        return rows.where(F.col("part").isin(parts) & F.col("gram").isin(grams))

    def counts(self, spark: SparkSession, size: int, grams: list[str]) -> dict[str, tuple[int, int]]:
        """Gram of three letters -> (texts, places), a cut text once for each block; one that no text holds is missing."""
        found = self.of(spark, "postings", size, grams).groupBy("gram").agg(F.sum("texts").alias("texts"), F.sum("places").alias("places"))
        return {r["gram"]: (r["texts"], r["places"]) for r in found.collect()}

    def occurrences(self, spark: SparkSession, query: str) -> DataFrame:
        """(key, field, starts): all places of the folded literal, overlapping ones included, ascending."""
        q = fold_text(query)
        postings = self.read(spark, "postings")
        kind = postings.schema["keys"].dataType.elementType
        out = T.StructType([T.StructField(self.key, kind), *T.StructType.fromDDL("field int, shift int, starts array<int>").fields])
        at = {k: q[k : k + 3] for k in range(len(q) - 2)}
        counts = self.counts(spark, 3, sorted(set(at.values()))) if at else {}
        if not q or len(counts) < len(set(at.values())):
            return spark.createDataFrame([], out).drop("shift")
        columns = ["block", "gram", "data", "keys", "fields", "begins", "starts", "cut"]
        bounds = postings.where(F.col("part") == BOUNDS).select(columns)
        if at:
            rarest = min(at, key=lambda k: (counts[at[k]], k))
            # Every third gram covers the literal, with the last one and the rarest.
            cover = {k: at[k] for k in sorted({*range(0, len(q) - 2, 3), len(q) - 3, rarest})}
            both = self.of(spark, "postings", 3, sorted(set(cover.values()))).select(columns).unionByName(bounds)
            first = self.of(spark, "postings", 3, [at[rarest]]).select("block")
            small = counts[at[rarest]][0] <= MAX_BROADCAST  # a block has one of the gram's texts at least
            cuts = bounds.where(F.exists("cut", lambda c: c)).select("block")  # what a cut text lacks here may stand in another block
            first = first.unionByName(cuts).distinct()
            both = both.join(F.broadcast(first) if small and cuts.isEmpty() else first, "block", "left_semi")
        else:
            rarest, cover = 0, {}
            both = self.of(spark, "postings", len(q), [q]).select(columns).unionByName(bounds)
        found = both.groupBy("block").applyInArrow(finder(cover, {k: utf16_len(q[:k]) for k in cover}, rarest, self.key), out)
        # What a literal's every gram has, for texts that are cut.  One shuffle serves all that groups by key.
        whole = found.repartition(self.key).groupBy(self.key, "field", "shift").agg(F.flatten(F.collect_list("starts")).alias("starts"))
        lists = whole.groupBy(self.key, "field").agg(F.collect_list("starts").alias("l"), F.min("shift").alias("least"))
        lists = lists.where((F.col("least") == -1) | (F.size("l") == len(cover)))
        shared = F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", 0), lambda a, b: F.array_intersect(a, b))
        return lists.select(self.key, "field", F.array_sort(shared).alias("starts")).where(F.size("starts") > 0)

    def containing(self, spark: SparkSession, query: str) -> DataFrame:
        """(key) of rows with the folded literal in any field."""
        return self.occurrences(spark, query).select(self.key).distinct()

    def ranked(self, spark: SparkSession, query: str, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
        """(key, score float, spans) as ``search.ranked`` gives them, from postings alone."""
        q = fold_text(query)
        width = utf16_len(q)
        found = self.occurrences(spark, query).select(self.key, "field", apart(F.col("starts"), width, any(q.startswith(q[k:]) for k in range(1, len(q)))).alias("starts"))
        name = F.element_at(F.array(*[F.lit(n) for n in self.fields]), F.col("field") + 1)
        wire = F.element_at(F.array(*[F.lit(FIELDS.index(n) if n in FIELDS else k) for k, n in enumerate(self.fields)]), F.col("field") + 1)
        weight = F.element_at(F.create_map(*[x for n in self.fields for x in (F.lit(n), F.lit(float(weights.get(n, 0))))]), name).cast("float")
        spans = F.transform("starts", lambda s: F.struct(wire.alias("field"), s.alias("start"), F.lit(width).alias("len")))
        row = F.struct("field", (weight * F.size("starts").cast("float")).cast("float").alias("gain"), spans.alias("spans"))
        grouped = found.where(F.lit(bool(q))).groupBy(self.key).agg(F.array_sort(F.collect_list(row)).alias("f"))
        score = F.aggregate("f", F.lit(0).cast("float"), lambda t, x: (t + x["gain"]).cast("float"))
        return grouped.select(self.key, score.alias("score"), F.flatten(F.transform("f", lambda x: x["spans"])).cast(SPANS).alias("spans"))


def apart(starts: Column, width: int, overlaps: bool) -> Column:
    """The leftmost of ascending places that do not overlap.  Only a literal that begins as it ends can overlap itself."""
    if not overlaps:
        return starts
    none = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-width).alias("last"))
    # One string of the kept places would grow with each step as well; runs of overlapping places are short.
    step = lambda s, p: F.when(p >= s["last"] + width, F.struct(F.concat(s["out"], F.array(p)).alias("out"), p.alias("last"))).otherwise(s)
    near = F.transform(starts, lambda p, k: F.struct(p.alias("p"), (p < F.coalesce(F.get(starts, k - 1), F.lit(-width)) + width).alias("near")))
    runs = F.transform(F.filter(F.transform(near, lambda x, k: F.struct(k.alias("k"), (~x["near"]).alias("head"))), lambda x: x["head"]), lambda x: x["k"])
    bounds = F.arrays_zip(runs.alias("a"), F.concat(F.slice(runs, 2, F.size(starts)), F.array(F.size(starts))).alias("b"))
    return F.flatten(F.transform(bounds, lambda r: F.aggregate(F.slice(starts, r["a"] + 1, r["b"] - r["a"]), none, step, lambda s: s["out"])))


def _starting(letters: str) -> Column:
    """Grams that begin so: one range, if the letter after the last one is a letter."""
    after = ord(letters[-1]) + 1
    if after in (0xD800, 0x110000):
        return F.startswith("gram", F.lit(letters))
    return (F.col("gram") >= letters) & (F.col("gram") < letters[:-1] + chr(after))


def _write(rows: DataFrame, path: str) -> None:
    plain = {"parquet.enable.dictionary#data": "false", "parquet.page.size": "65536", "parquet.page.row.count.limit": "512"}
    rows.sortWithinPartitions("part", "gram", "block").write.options(**plain).option("compression", "zstd").partitionBy("part").parquet(path)


def write(df: DataFrame, path: str, key: str, fields: Mapping[str, Column], parts: int = PARTS, tasks: int | None = None) -> GramIndex:
    """Build the index of ``df`` at ``path``.  ``tasks``: as many write it at most (those that read ``df`` if not given)."""
    spark = df.sparkSession
    rows = postings(df.coalesce(tasks) if tasks else df, key, fields)
    rows = rows.withColumn("part", F.when(F.col("keys").isNotNull(), BOUNDS).otherwise(part_of(F.col("gram"), parts)))
    _write(rows, f"{path}/written")
    written, system = located(spark, f"{path}/written")
    final, _ = located(spark, f"{path}/postings")
    size = system.getContentSummary(written)
    wanted = max(1, size.getLength() // SEGMENT)
    if size.getFileCount() > 2 * wanted * (parts + 1):
        _write(spark.read.parquet(f"{path}/written").coalesce(wanted), f"{path}/postings")
        system.delete(written, True)
    else:
        system.rename(written, final)
    return GramIndex(path, key, tuple(fields), parts)
