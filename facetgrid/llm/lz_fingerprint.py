"""Document fingerprints from the phrases of a Lempel-Ziv parse.

A text is read as symbols, its words as they stand between single spaces (a word
of more than ``LONGEST_SYMBOL`` characters, as in scripts without spaces, counts
as its single characters).  The parse takes the shortest run of symbols that is
no phrase of the dictionary yet, adds it, and goes on behind it; what is left at
the end is a phrase as well.  Each phrase has a 48-bit hash, and the fingerprint
is the ``SIZE`` smallest of the distinct ones.  The share of common values among
the smallest of both together estimates the Jaccard likeness of two phrase sets:
texts that would compress each other well have much in common.  A set of at most
``SIZE`` phrases is compared exactly.

After ``DICTIONARY`` phrases the dictionary starts anew, as block compressors do,
and the smallest hashes so far are kept; a text is parsed slice by slice.  So
memory is bounded for texts of any length, all of which is parsed.

``edited_neighbours`` orders documents by doc_id without a single sort: the ids'
quantiles bound the ranges, ranges are tasks, and the row that opens a range is
also sent to the range before it.

Nulls and odd input: a null text is an empty text; two texts without phrases are
alike (1), one with none and one with some are not (0).  Repeated doc_ids follow
each other by text.  A row with a null doc_id has no place in the order: it is
fingerprinted, what concerns its next document is null.  A lone document is its
own next one.  Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes of a fingerprint, and the bits of one.
SIZE, BITS = 128, 48
LONGEST_SYMBOL = 24
DICTIONARY = 1 << 20
SLICE = 1 << 22
NUMBERED = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LONG = re.compile(r"[^ ]{%d,}" % (LONGEST_SYMBOL + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of ``text`` that end at a space where one comes within ``size`` characters more."""
    start = 0
    while len(text) - start > size:
        end = text.find(" ", start + size, start + 2 * size)
        end = start + 2 * size if end < 0 else end
        yield text[start:end]
        start = end + (text[end : end + 1] == " ")
    yield text[start:]


def symbols_of(part: str) -> list[str]:
    """Words between single spaces; long ones as single characters."""
    words = part.split(" ")
    if _LONG.search(part):
        return [s for w in words for s in (w if len(w) > LONGEST_SYMBOL else (w,))]
    return words


class Numbers(dict):
    """Symbol -> its number, as met in this worker; ``hashes`` has a 64-bit hash of each."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def __missing__(self, symbol: str) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        digest = hashlib.blake2b(symbol.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self.hashes[n] = int.from_bytes(digest, "little")
        self[symbol] = n
        return n


class Parser:
    """Fingerprints, with the numbers of symbols kept from text to text."""

    def __init__(self, size: int = SIZE, dictionary: int = DICTIONARY) -> None:
        self.size, self.dictionary = size, dictionary
        self.numbers = Numbers()
        # Powers by which a symbol's hash counts at its place in a slice.
        self.powers = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            steps = np.full(max(n, 2 * len(self.powers)), _ODD, dtype=np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
        return self.powers[:n]

    def fingerprint(self, text: str) -> np.ndarray:
        """The smallest hashes of the text's phrases, ascending."""
        least = np.zeros(0, dtype=np.uint64)
        if not text:
            return least
        if len(self.numbers) > NUMBERED:
            self.numbers = Numbers()
        nodes: dict[int, int] = {}
        for part in slices(text):
            ids = list(map(self.numbers.__getitem__, symbols_of(part)))
            ends = self._ends(ids, nodes)
            least = np.unique(np.concatenate([least, self._hashes(ids, ends)]))[: self.size]
        return least

    def _ends(self, ids: list[int], nodes: dict[int, int]) -> list[int]:
        """The places behind which a phrase ends.  ``nodes``: (phrase, next symbol) -> longer phrase."""
        get, node, ends = nodes.get, 0, []
        made = len(nodes)
        for place, symbol in enumerate(ids, 1):
            key = node + symbol
            if (longer := get(key)) is None:
                if made == self.dictionary:
                    nodes.clear()
                    made = 0
                    key = symbol
                made += 1
                nodes[key] = made << 32
                ends.append(place)
                node = 0
            else:
                node = longer
        if node:
            ends.append(len(ids))
        return ends

    def _hashes(self, ids: list[int], ends: list[int]) -> np.ndarray:
        """A phrase's hash: its symbols' hashes, each by a power for its place in the phrase."""
        powers = self._powers(len(ids) + 1)
        sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        # Powers fall towards the end of the slice, so dividing by the one at a phrase's end (an odd
        # number has an inverse) leaves the same value wherever the phrase stands.
        np.cumsum(self.numbers.hashes[ids] * powers[1:][::-1], out=sums[1:])
        ends = np.array(ends, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        raw = (sums[ends] - sums[starts]) * self._inverses(len(ids) + 1)[len(ids) - ends]
        return _mixed(raw + (ends - starts).astype(np.uint64)) >> np.uint64(64 - BITS)

    def _inverses(self, n: int) -> np.ndarray:
        if len(getattr(self, "inverse", ())) < n:
            steps = np.full(max(n, len(self.powers)), np.uint64(pow(int(_ODD), -1, 1 << 64)), dtype=np.uint64)
            steps[0] = 1
            self.inverse = np.cumprod(steps)
        return self.inverse[:n]


def packed(least: np.ndarray) -> str:
    """A fingerprint as text: its values, six bytes each, in base 64."""
    return base64.b64encode(least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(data), 8), dtype=np.uint8)
    out[:, 8 - BITS // 8 :] = data
    return out.reshape(-1).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of values in both among the ``size`` smallest of both together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    # The n-th distinct value comes after n plus the repeats before it.
    distinct = min(size, len(both) - int(np.count_nonzero(again)))
    rank = np.cumsum(np.concatenate([[True], ~again]))
    return int(np.count_nonzero(again & (rank[1:] <= distinct))) / distinct


_PARSERS: dict[tuple[int, int], Parser] = {}


def worker_parser(size: int, dictionary: int) -> Parser:
    """Kept from task to task of a worker."""
    return _PARSERS.setdefault((size, dictionary), Parser(size, dictionary))


def fingerprints(docs: DataFrame, text: str = "text", size: int = SIZE, dictionary: int = DICTIONARY) -> DataFrame:
    """``docs`` without its text, with ``fingerprint``; nothing is shuffled."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("fingerprint", text.lower())]
    out = T.StructType([*kept, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_parser(size, dictionary)
        for batch in batches:
            made = [packed(parser.fingerprint(t.as_py() or "")) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=out.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")).mapInArrow(run, out)


def likeness_column(a: Column, b: Column, size: int = SIZE) -> Column:
    """The likeness of two columns of fingerprints; null where one is null."""

    @F.arrow_udf(T.DoubleType())
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else likeness(unpacked(p), unpacked(q), size) for p, q in pairs], pa.float64())

    return compare(a, b)


def _ranges(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` ids, each of a row, the largest last: the upper ends of ranges with about equally many rows."""
    shares = F.array(*[F.lit((k + 1) / parts) for k in range(parts - 1)], F.lit(1.0))
    found = docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * parts))).alias("ends"), F.max("doc_id").alias("last")).first()
    return sorted({*found["ends"], found["last"]}) if found["last"] is not None else []


def edited_neighbours(docs: DataFrame, parts: int | None = None, size: int = SIZE, dictionary: int = DICTIONARY) -> DataFrame:
    """Each document against its half-replaced text and against the next one by descending doc_id.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text has the last floor(n_chars / 2) code
    points replaced by the first as many of the next document (the first
    document is next to the last).  ``parts``: ranges of ids (the session's
    shuffle partitions if not given).  Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ends = _ranges(rows, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.array(ends, dtype=np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(ids: pa.Array) -> pa.Array:
        """The range of an id and, if it is the largest of its range, the range above, as -1 - range."""
        out = []
        for i in ids.to_pylist():
            if i is None:
                out.append([0])
                continue
            own = int(np.searchsorted(bounds, i))
            out.append([own, -1 - (own + 1) % len(bounds)] if bounds[own] == i else [own])
        return pa.array(out, pa.list_(pa.int32()))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_parser(size, dictionary)
        before: tuple[int, str, np.ndarray] | None = None

        def against(doc: tuple[int, str, np.ndarray], text: str, least: np.ndarray) -> tuple:
            i, own, mark = doc
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            made = parser.fingerprint(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return i, len(own), digest, packed(mark), packed(made), likeness(mark, made, size), likeness(mark, least, size)

        for batch in batches:
            found = []
            for i, text, ahead in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if ahead and before is None:
                    continue  # a copy of a row that has served already
                text = text.as_py()
                least = parser.fingerprint(text)
                if i is None:
                    found.append((None, len(text), None, packed(least), None, None, None))
                    continue
                if before is not None:
                    found.append(against(before, text, least))
                before = None if ahead else (i, text, least)
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    sent = rows.select("doc_id", "text", F.explode(places("doc_id")).alias("place"))
    # Rows without an id are dealt by their text and come before a range's own; a range ends with the rows ahead.
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(max(len(ends), 1))).cast("int")).when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    sent = sent.select("doc_id", "text", (F.col("place") < 0).alias("ahead"), part.alias("part"))
    dealt = sent.repartitionById(max(len(ends), 1), F.col("part")).sortWithinPartitions("part", F.col("doc_id").isNotNull(), "ahead", F.desc("doc_id"), "text")
    return dealt.select("doc_id", "text", "ahead").mapInArrow(run, out)
