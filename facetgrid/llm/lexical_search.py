"""Ranked lexical search by windowed bucket scoring.

Queries are taken in blocks of bounded size.  For each block documents are read
once: a task counts the block's terms in each text and keeps (doc_id, n, terms,
counts), a small table written to the shared folder, from which the corpus
figures follow (N, L and df cover all documents).  Its rows are dealt by windows
of ``window`` consecutive doc_id values.  A task turns a window into postings and
traverses those of each query: weights are scatter-added into one array that
fits the cache, whose occupied places a bitset tells, and what is occupied is
harvested into the query's heap of ``k``.  The heap lives as long as the task,
so a task hands on ``k`` rows for each query, however many windows it had; a
ranking of these gives the result.

A window with more rows than ``window`` (repeated doc_ids) is scored in parts
of that many rows, so the arrays are bounded.  A text is cut into terms in
slices of a few MB at separators, so a very long one needs no list of all of them.

Nulls and odd input: a null or empty text has no terms and is no document of the
corpus; a query without terms, or whose terms no document holds, gives no rows.
Each row of ``docs`` is a document and each row of ``queries`` a query, so
repeated rows (or a repeated item_id) give rows each.  A null doc_id ranks after
all others of its score.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from facetgrid.llm.common import materialize

WINDOW = 4096
#: Queries of a block, and the bytes of their texts, that are sent along at most.
BLOCK_QUERIES, BLOCK_BYTES = 4096, 16 << 20
SLICE = 4 << 20

#: Fixed value: ASCII that separates terms; A-Z are lowered, all else stays.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = bytes.maketrans(SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of ``text`` (UTF-8) in lists, each from a slice that ends at a separator."""
    if len(text) <= size:
        yield terms_of(text)
        return
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + size)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row of ``docs`` with a term: its length, and the vocabulary's numbers in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            rows, lengths, ends, terms, tfs = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                data = text.as_py()
                if not data:
                    continue
                counts: Counter[bytes] = Counter()
                for part in slices(data):
                    counts.update(part)
                if not counts:
                    continue
                for term, tf in counts.items():
                    if (k := number(term)) is not None:
                        terms.append(k)
                        tfs.append(tf)
                rows.append(row)
                lengths.append(counts.total())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=out.names)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, out)


class Postings:
    """The postings of one window: places in it by term, with what a term of weight 1 gives."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, corpus: tuple[int, int]) -> None:
        docs, length = corpus
        m = 100 - 25 + (25 * n * docs) // length
        place = np.repeat(np.arange(len(n), dtype=np.int64), sizes)
        gain = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[place])
        order = np.argsort(terms, kind="stable")
        self.place, self.gain = place[order], gain[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.bounds = np.append(starts, len(terms))
        self.at = {t: k for k, t in enumerate(self.terms.tolist())}
        # A bitset for each term, so that a query's occupied places are the union of a few words.
        bits = np.zeros((len(self.terms), -(-len(n) // 64) * 64), dtype=bool)
        bits[np.repeat(np.arange(len(self.terms)), np.diff(self.bounds)), self.place] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def score(self, query: list[tuple[int, int]], sums: np.ndarray) -> np.ndarray:
        """Adds the query (term, weight) into ``sums``, which must be zero; the occupied places."""
        occupied = np.zeros(self.bits.shape[1], dtype=np.uint64)
        for term, weight in query:
            if (k := self.at.get(term)) is not None:
                a, b = self.bounds[k], self.bounds[k + 1]
                sums[self.place[a:b]] += weight * self.gain[a:b]
                occupied |= self.bits[k]
        return np.flatnonzero(np.unpackbits(occupied.view(np.uint8), bitorder="little"))


class Best:
    """The ``k`` best (score, doc_id) of each query that a task has met."""

    def __init__(self, queries: list[list[tuple[int, int]]], k: int) -> None:
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[int, float, int]]] = [[] for _ in queries]
        self.met = 0

    def add(self, doc_ids: np.ndarray, known: np.ndarray, postings: Postings) -> None:
        """``doc_ids`` in ascending order; ``known`` is false where one is null."""
        sums = np.zeros(len(doc_ids), dtype=np.int64)
        for query, heap in zip(self.queries, self.heaps, strict=True):
            places = postings.score(query, sums)
            scores = sums[places]
            sums[places] = 0
            least = max(heap[0][0], 1) if len(heap) == self.k else 1
            good = scores >= least
            places, scores = places[good], scores[good]
            if len(scores) > self.k:  # all above the k-th score, and those that equal it
                good = scores >= np.partition(scores, -self.k)[-self.k]
                places, scores = places[good], scores[good]
            for score, place in zip(scores.tolist(), places.tolist(), strict=True):
                self.met += 1
                entry = (score, (1, -int(doc_ids[place])) if known[place] else (0, 0), -self.met)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for query, heap in enumerate(self.heaps):
            for score, (known, minus), _ in heap:
                yield query, -minus if known else None, score


def _windows(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows of one window each, ``rows`` at most; a window's rows come in a row."""
    kept: list[pa.RecordBatch] = []
    have, now = 0, None
    for batch in batches:
        names = pc.fill_null(batch.column(0), -1 << 62).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            while start < end:
                if kept and (names[start] != now or have == rows):
                    yield pa.Table.from_batches(kept)
                    kept, have = [], 0
                now, take = names[start], min(end - start, rows - have)
                kept.append(batch.slice(start, take))
                have, start = have + take, start + take
    if kept:
        yield pa.Table.from_batches(kept)


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).combine_chunks()
    return pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def score_windows(counted: DataFrame, queries: list[list[tuple[int, int]]], corpus: tuple[int, int], k: int, window: int = WINDOW) -> DataFrame:
    """(query, doc_id, score): each task's ``k`` best of each query (lists of term and weight)."""
    shared = counted.sparkSession.sparkContext.broadcast(queries)
    out = "query int, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, k)
        for part in _windows(batches, window):
            ids = part.column("doc_id").combine_chunks()
            sizes, terms = _flat(part, "terms")
            postings = Postings(part.column("n").to_numpy(), sizes, terms, _flat(part, "tfs")[1], corpus)
            best.add(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False), postings)
        found = list(best.rows())
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    dealt = counted.select(F.floor(F.col("doc_id") / F.lit(window)).alias("window"), F.col("doc_id").cast("long"), "n", "terms", "tfs")
    return dealt.repartition("window").sortWithinPartitions("window", "doc_id").mapInArrow(run, out)


def _blocks(queries: DataFrame, most: int, most_bytes: int) -> Iterator[list[Row]]:
    block, size = [], 0
    for row in queries.toLocalIterator():
        more = len(row["text"] or "")
        if block and (len(block) == most or size + more > most_bytes):
            yield block
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield block


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, queries: DataFrame, k: int = 20, window: int = WINDOW, block: int = BLOCK_QUERIES, block_bytes: int = BLOCK_BYTES, weigh: Callable[[int, int], int] = weight) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``queries`` (item_id, text)."""
    spark = docs.sparkSession
    item = queries.schema["item_id"]
    schema = T.StructType([T.StructField("query", T.IntegerType()), item])
    parts = []
    for rows in _blocks(queries.select("item_id", "text"), block, block_bytes):
        asked = [Counter(t for part in slices((r["text"] or "").encode()) for t in part) for r in rows]
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*asked)))}
        counted = materialize(count_terms(docs, vocabulary), "counted")
        known = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weights = {t: weigh(n, known["docs"]) for t, n in df.items()}
        lists = [[(n, weights[n] * times) for t, times in terms.items() if (n := vocabulary[t]) in weights] for terms in asked]
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], schema)
        found = score_windows(counted, lists, (known["docs"], known["length"]), k, window)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], T.StructType([item, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, parts)
