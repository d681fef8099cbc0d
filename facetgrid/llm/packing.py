"""Sum-of-squares packing of tokenized documents into sequences.

``tokenize_pieces`` gives each document's token ids, the end id after them, cut
into pieces of ``size`` ids only where it is longer.  ``pack`` places pieces:
among the open sequences' gaps (and a new sequence) it takes the one that leaves
the smallest sum of squared counts of open sequences per gap, the tightest first
on ties.  Its state is a count and a stack of open sequences for each of
``size`` gaps.  Pieces are dealt by a hash of their ids and content into groups of
about ``group`` pieces, so that the number of groups grows with the tokens of the
input, long documents included, and each group wastes a few open sequences only.  Within a group they come in hash order, but a sixteenth of
them is kept for the end, longest first, to close what is open by then.

Nulls and odd input: a null or empty text is the end id alone.  A piece of full
length is a sequence of its own.  Pieces of no length are not made.  Repeated
rows are packed each; rows of one doc_id and piece are dealt by their other columns
as well, so only rows that are equal throughout share a group.  An empty table gives an empty result.  Further columns are
ignored by ``tokenize_pieces`` and kept by ``pack``, but for those named
sequence_id or offset, which are replaced.  A lost executor's groups are packed again with the same outcome, as
the order within a group is fixed.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgrid.llm.token_count import byte_alphabet

SIZE = 2048
GROUP = 131_072
CACHE_ENTRIES = 400_000
#: Longer chunks (unbroken data, minified code) are tokenized anew each time, so the cache is bounded in bytes.
CACHED_CHUNK = 64
SLICE_BYTES = 8 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: Fixed value: ASCII punctuation but the apostrophe, which may begin a contraction.
PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class ChunkIds(dict):
    """Chunk between white space -> its ids (little-endian 32 bit), by the library.

    The tokenizer drops white space and no token reaches over it, so a text's
    ids are its chunks' ids one after another.  A chunk of Latin letters and then
    ASCII punctuation is two pretokens, whose ids the library's model gives
    without the normalizer's work; all else goes through the whole tokenizer.
    """

    def __init__(self, content: bytes, entries: int = CACHE_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.entries = entries
        self.words: dict[str, bytes] = {}
        self.marks: dict[bytes, bytes] = {}
        self.letters = byte_alphabet()

    def word(self, word: str) -> bytes:
        """Ids of lower-case letters."""
        found = self.words.get(word)
        if found is None:
            shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= CACHED_CHUNK:
                if len(self.words) >= self.entries:
                    self.words.clear()
                self.words[word] = found
        return found

    def mark(self, run: bytes) -> bytes:
        found = self.marks.get(run)
        if found is None:
            ids = self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(run) <= CACHED_CHUNK:
                if len(self.marks) >= self.entries:
                    self.marks.clear()
                self.marks[run] = found
        return found

    def forget_long(self, chunks: set[bytes]) -> None:
        for c in chunks:
            if len(c) > CACHED_CHUNK:
                self.pop(c, None)

    def learn(self, chunks: set[bytes]) -> None:
        new = chunks.difference(self)
        if len(self) + len(new) > self.entries:
            self.clear()
            self.words.clear()
            new = chunks
        other = []
        for c in new:
            base = c.rstrip(PUNCTUATION)
            word = base.decode("utf-8", "replace")
            if word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word):
                ids = self.word(word.lower())
                self[c] = ids + self.mark(c[len(base) :]) if len(base) < len(c) else ids
            else:
                other.append(c)
        for k in range(0, len(other), 20_000):
            part = other[k : k + 20_000]
            got = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)
            for c, e in zip(part, got, strict=True):
                ids = e.ids
                self[c] = struct.pack(f"<{len(ids)}I", *ids)


#: Kept from task to task of a worker: what it has learnt, by tokenizer.
_KNOWN: dict[bytes, ChunkIds] = {}


def chunk_ids(content: bytes) -> ChunkIds:
    if content not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[content] = ChunkIds(content)
    return _KNOWN[content]


def tokenize_pieces(docs: DataFrame, tokenizer: str | bytes, size: int = SIZE, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids) of all documents; ``ids`` as little-endian unsigned 32-bit numbers."""
    content = open(tokenizer, "rb").read() if isinstance(tokenizer, str) else tokenizer
    shared = docs.sparkSession.sparkContext.broadcast(content)
    tail, width = struct.pack("<I", end), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(shared.value)
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(pc.cast(whole.column(1), pa.binary())), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths), 0
            while at < whole.num_rows:
                before = ends[at - 1] if at else 0
                n = max(1, min(1000, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at))
                batch = whole.slice(at, n)
                at += n
                texts = pc.fill_null(pc.cast(batch.column(1), pa.binary()), b"")
                split = [t.as_py().split() for t in texts]
                chunks = set().union(*split)
                known.learn(chunks)
                doc, piece, start, length, ids = [], [], [], [], []
                for doc_id, row in zip(batch.column(0).to_pylist(), split, strict=True):
                    own = b"".join(map(known.__getitem__, row)) + tail
                    for k in range(0, len(own), width):
                        part = own[k : k + width]
                        doc.append(doc_id)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                known.forget_long(chunks)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


class SquaresPacker:
    """Places lengths one after another; memory grows with the open sequences only."""

    def __init__(self, size: int = SIZE) -> None:
        self.size = size
        self.count = np.zeros(size + 1)  # open sequences per gap
        self.count[0] = -0.5  # a closed sequence no longer counts
        self.usable = np.full(size + 1, -1e12)  # the counts of gaps that some sequence has
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, n: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``n`` ids."""
        size, count = self.size, self.count
        if not 0 < n <= size:
            raise ValueError(n)
        gap = size
        if n < size:
            cost = count[: size - n] - self.usable[n:size]
            best = int(cost.argmin())
            # Half the growth of the sum of squares, less one in both cases.
            if cost[best] <= count[size - n] - 0.5:
                gap = best + n
        if gap == size:
            sequence = self.made
            self.made += 1
        else:
            sequence = self.open[gap].pop()
            count[gap] -= 1
            self.usable[gap] = count[gap] if count[gap] else -1e12
        left = gap - n
        if left:
            self.open[left].append(sequence)
            count[left] += 1
            self.usable[left] = count[left]
        return sequence, size - gap


def estimated_pieces(docs: DataFrame, size: int = SIZE, text: str = "text") -> int:
    """About how many pieces the documents have, from their bytes (a token has four or so); no text is tokenized."""
    each = F.ceil((F.coalesce(F.octet_length(text), F.lit(0)) / 4 + 1) / size)
    return docs.agg(F.sum(each)).first()[0] or 0


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP, rows: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length and whatever else) with sequence_id and offset.

    ``rows``: about how many pieces there are; counted if not given.
    """
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    rows = pieces.count() if rows is None else rows
    groups = max(1, math.ceil(rows / group))
    names = pieces.columns
    at = names.index("length")
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SquaresPacker(size)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(at).to_pylist()]
            sequence = pa.array([base + s for s, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequence, pa.array([o for _, o in placed], pa.int64())], names=out.names)

    # All plain columns take part, so rows of one doc_id and piece part unless they are equal throughout.
    plain = [f"`{f.name}`" for f in pieces.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BinaryType))]
    dice = F.xxhash64(F.lit("order"), F.col("doc_id"), F.col("piece"))
    late = F.pmod(dice, F.lit(16)) == 0
    ordered = [late, F.when(late, -F.col("length")), dice, *[f"`{n}`" for n in names]]
    dealt = pieces.repartition(groups, F.xxhash64(*plain)).sortWithinPartitions(*ordered)
    return dealt.mapInArrow(run, out)
