"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pretokens as the byte-level tokenizer cuts it.  A pretoken
starts as a linked list of its bytes; a heap gives the adjacent pair of lowest
rank (leftmost first), which is merged, until no pair has a rank.  The count is
the number of bytes less the number of merges; no token ids are made.  Equal
pretokens, and equal chunks of text, are counted once per worker, in caches of
bounded size.

A chunk is what runs from a space that is followed by a non-space up to the next
such space.  The tokenizer's pattern always starts a pretoken there, so the sum
over chunks is the count of the whole text.

Nulls and odd input: a null text is an empty text (0 bytes, 0 tokens).  Strings
of special tokens inside a text count as one token each, as the library's
default has it.  One long word costs n log n.  Nothing is truncated.  Repeated
rows are counted each; an empty table gives an empty result; columns whose names
clash with an output column are replaced by it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern of the byte-level pretokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before white space, or at the end, starts no chunk.
NO_CUT = rb" (?=[\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80|$)"
CUT = rb" (?![\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80|\Z)"
CACHE_ENTRIES = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


class Merger:
    """Ranks of pairs of symbols, symbols being numbered, and the merge loop."""

    def __init__(self, spec: dict) -> None:
        merges = spec["model"]["merges"]
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.first = [number(c) for c in byte_alphabet()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((number(a), number(b)), (k, number(a + b)))

    def count(self, word: bytes) -> int:
        rank = self.rank.get
        symbol = [self.first[b] for b in word]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            if r := rank((symbol[k], symbol[k + 1])):
                heap.append((r[0], k, symbol[k], symbol[k + 1], r[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, a, b, to = heapq.heappop(heap)
            j = after[k]
            if symbol[k] != a or j >= n or symbol[j] != b:
                continue  # one of the two was merged away meanwhile
            symbol[k], symbol[j] = to, -1
            after[k] = nxt = after[j]
            left -= 1
            if nxt < n:
                before[nxt] = k
                if r := rank((to, symbol[nxt])):
                    heapq.heappush(heap, (r[0], k, to, symbol[nxt], r[1]))
            if (p := before[k]) >= 0 and (r := rank((symbol[p], to))):
                heapq.heappush(heap, (r[0], p, symbol[p], to, r[1]))
        return left


class Kept(dict):
    """Key -> number; a missing one is worked out and, if short, kept; full, it starts anew."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.entries = entries

    def find(self, key: bytes | str) -> int:
        raise NotImplementedError

    def __missing__(self, key: bytes | str) -> int:
        n = self.find(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[key] = n
        return n


class Words(Kept):
    """Pretoken -> tokens."""

    def __init__(self, spec: dict, entries: int = CACHE_ENTRIES) -> None:
        super().__init__(entries)
        self.merger = Merger(spec)

    def find(self, word: str) -> int:
        return self.merger.count(word.encode())


class Chunks(Kept):
    """Chunk, without the space that led it -> tokens."""

    def __init__(self, words: Words, lead: bytes = b"", entries: int = CACHE_ENTRIES) -> None:
        super().__init__(entries)
        self.words, self.lead = words, lead
        self.pretokens = regex.compile(PATTERN).findall

    def find(self, chunk: bytes) -> int:
        return sum(map(self.words.__getitem__, self.pretokens((self.lead + chunk).decode("utf-8", "replace"))))


#: Kept from task to task of a worker: the counter with what it has met, by tokenizer.
_KNOWN: dict[bytes, Callable[[bytes], int]] = {}


def worker_counter(content: bytes) -> Callable[[bytes], int]:
    if content not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[content] = counter(json.loads(content))
    return _KNOWN[content]


def counter(spec: dict) -> Callable[[bytes], int]:
    words = Words(spec)
    head, tail = Chunks(words), Chunks(words, b" ")
    odd, cut = regex.compile(NO_CUT).search, regex.compile(CUT).split
    specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
    split_special = regex.compile(b"|".join(map(regex.escape, specials))).split if specials else None

    def plain(text: bytes) -> int:
        parts = cut(text) if odd(text) else text.split(b" ")
        rest = iter(parts)
        return head[next(rest)] + sum(map(tail.__getitem__, rest))

    def count(text: bytes) -> int:
        if split_special and any(s in text for s in specials):
            parts = split_special(text)
            return len(parts) - 1 + sum(plain(p) for p in parts if p)
        return plain(text) if text else 0

    return count


def count_tokens(docs: DataFrame, tokenizer: str | bytes, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit.

    ``tokenizer``: the path of a byte-level BPE tokenizer.json (read on the
    driver and sent along, so executors need no file), or its content.
    """
    content = open(tokenizer, "rb").read() if isinstance(tokenizer, str) else tokenizer
    shared = docs.sparkSession.sparkContext.broadcast(content)
    drop = {"n_bytes", "n_tokens", "over_limit", text.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in drop]
    out = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_counter(shared.value)
        for batch in batches:
            texts = pc.fill_null(pc.cast(batch.column(batch.num_columns - 1), pa.large_binary()), b"")
            tokens = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens, pc.cast(pc.binary_length(texts), pa.int64())], names=out.names)

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`"))
    counted = rows.mapInArrow(run, out)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
