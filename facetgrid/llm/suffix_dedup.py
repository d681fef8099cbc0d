"""Exact removal of repeated passages by a distributed merge of sparse suffix runs.

A byte goes if a string of ``WIDTH`` bytes over it also starts in a document
with a smaller doc_id.  Suffixes are taken at anchors only: positions whose
16-byte hash is least among the ``SPAN`` such hashes of some ``WIDTH``-byte
string.  The choice depends on the string alone, so equal strings have equal
anchors at equal offsets, and nothing is lost.  What an anchor's suffix has to
tell is bounded: the ``WIDTH`` bytes from it and the ``SPAN - 1`` before it.

1. Whole copies are found by digest; all but the smallest doc_id need no suffix.
2. Texts go into chunks (one row each) in the shared folder.
3. Hashes of the 33 bytes from an anchor, and of those that end with its 16, are
   exchanged, 32 bits each, to see which occur in two documents (a ``WIDTH``-byte
   string over the anchor holds one of the two whole); a bit for each comes back
   to its chunk.  An anchor of which neither occurs twice goes no further.
4. The suffixes of those anchors are sorted and made distinct within each chunk,
   front-coded (length of the common prefix with the one before, and the rest,
   packed) and exchanged by their anchor's hash.
5. Each receiver merges its runs by a loser tree that compares keys only beyond
   the prefixes known to be common, and takes for each of the ``SPAN`` strings
   around an anchor the smallest doc_id, from the merged order and its prefixes.
6. Anchors with far more different suffixes than a bucket should have (a phrase of
   33 to 49 bytes in very many documents, the edges of a passage) take another way:
   each ``WIDTH``-byte string over them is named by 128 bits and dealt by its name,
   so they spread over as many tasks as they need.
7. These come back to the chunks' occurrences as byte spans to remove.

A passage that stands in a third of all documents counts once for each chunk, so
no task gets a row for each copy.  Replies are broadcast up to ``BROADCAST_MB``
and joined by a shuffle above it.

Nulls and odd input: a null text is empty; a null doc_id counts as larger than
any other, and rows with equal doc_ids never cover each other, so repeated rows
are treated alike.  Texts shorter than ``WIDTH`` bytes stay whole; a text longer
than a chunk is a chunk of its own.  Anchors are found, and suffixes made distinct,
slice by slice, so a long text of few different strings (one sign over and over)
needs memory for its anchors' positions only.  An empty table gives an empty
result.  Further columns are carried along; those whose names clash with
an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgrid.llm.common import materialize, release

WIDTH, KMER = 50, 16
SPAN = WIDTH - KMER + 1
KEY = WIDTH + SPAN - 1 + 2  # bytes onwards, bytes backwards, how many of each
BESIDE = (WIDTH - KMER + 1) // 2  # bytes beyond an anchor's on one side or the other
#: A chunk at 1 GB of text and the largest; between them it grows with the root of the
#: text, so that the rows exchanged, one for each chunk and bucket, grow in proportion.
CHUNK_BYTES, LARGEST_CHUNK = 2 << 20, 64 << 20
#: A reader holds a file's row group at once, so chunk files are kept small.
CHUNKS_PER_FILE = 4
SLICE = 1 << 20
KEYS_AT_ONCE = 1 << 16
BUCKET_BYTES = 8 << 20
BROADCAST_MB = 48
#: A bucket is large above twice the mean and HOT_KEYS, or above MOST_KEYS; an anchor in it
#: is hot above HOT_KEYS keys and above a 2**20th of all, so there are at most 2**20 of them.
HOT_KEYS, MOST_KEYS, MOST_ANCHORS = 1024, 1 << 20, 1 << 20
#: Names in one task, on average.
NAMES_AT_ONCE = 1 << 17
LAST = np.iinfo(np.int64).max

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` consecutive entries."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, 64-bit hashes) of the anchors of texts laid end to end, a slice at a time, in order."""
    total = len(data)
    late, late_h = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # found beyond their slice
    for a in range(0, max(0, total - WIDTH + 1), SLICE):
        seg = np.ascontiguousarray(data[a : a + SLICE + WIDTH - 1])
        n = len(seg)
        if n < WIDTH:
            break
        eight = np.ndarray((n - 7,), "<u8", seg, strides=(1,)).astype(np.uint64)
        h = eight[:-8] * _C1
        h ^= h >> np.uint64(31)
        h += eight[8:]
        h *= _C2
        h ^= h >> np.uint64(29)
        h *= _C3
        h ^= h >> np.uint64(32)
        q = (h >> np.uint64(20)).astype(np.uint32) | np.uint32(1)
        least = sliding(q, SPAN, np.minimum)
        starts = np.arange(a, a + len(least))
        least[starts + WIDTH > ends[np.searchsorted(ends, starts, "right")]] = 0
        pad = np.zeros(SPAN - 1, np.uint32)
        chosen = np.nonzero(sliding(np.concatenate((pad, least, pad)), SPAN, np.maximum) == q)[0]
        at, h = chosen + a, h[chosen]
        if len(late):
            at, first = np.unique(np.concatenate((late, at)), return_index=True)
            h = np.concatenate((late_h, h))[first]
        now = np.searchsorted(at, a + SLICE)
        late, late_h = at[now:], h[now:]
        yield at[:now], h[:now]
    if len(late):
        yield late, late_h


def beside(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``KMER + BESIDE`` bytes from each of ``begin``."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(len(begin), np.uint64)
    for o in range(0, KMER + BESIDE - 7, 8):
        h = (h ^ (h >> np.uint64(31))) * _C1 + eight[begin + o]
    for o in range(8 * ((KMER + BESIDE) // 8), KMER + BESIDE):
        h = (h ^ (h >> np.uint64(31))) * _C1 + data[begin + o]
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def suffix_keys(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A ``KEY``-byte row for each anchor, sorting as its suffix does; unused bytes are 255."""
    begin = np.concatenate(([0], ends[:-1]))[doc]
    onward = np.minimum(ends[doc] - at, WIDTH)
    backward = np.minimum(at - begin, SPAN - 1)
    keys = np.full((len(at), KEY), 255, np.uint8)
    padded = np.concatenate((data, np.zeros(WIDTH, np.uint8)))
    for k in range(WIDTH):
        keys[:, k] = np.where(k < onward, padded[at + k], 255)
    for k in range(SPAN - 1):
        keys[:, WIDTH + k] = np.where(k < backward, padded[at - 1 - k], 255)
    keys[:, -2], keys[:, -1] = onward, backward + 1  # never 0 at the end: numpy strips that
    return keys


def distinct_keys(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct key rows, the row of each anchor)."""
    found, which = [], []
    for a in range(0, len(at), KEYS_AT_ONCE):
        keys = suffix_keys(data, ends, doc[a : a + KEYS_AT_ONCE], at[a : a + KEYS_AT_ONCE])
        own, index = np.unique(keys.view(f"S{KEY}").ravel(), return_inverse=True)
        found.append(own)
        which.append(index.astype(np.uint32))
    if len(found) > 1:
        text, place = np.unique(np.concatenate(found), return_inverse=True)
        begins = np.cumsum([0, *map(len, found)])
        which = [place[b:][w].astype(np.uint32) for b, w in zip(begins[:-1].tolist(), which, strict=True)]
    else:
        text = found[0]
    return text.view(np.uint8).reshape(-1, KEY), np.concatenate(which)


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(common prefix with the row before, all rows' remaining bytes) of sorted rows."""
    lcp = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), KEY)
    return lcp, keys[np.arange(KEY) >= lcp[:, None]].tobytes()


def pack_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_bytes(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True)


def decode(lcp: bytes, packed: bytes) -> list[bytes]:
    out, last, at, rest = [], b"", 0, unpack_bytes(packed)
    for n in lcp:
        end = at + KEY - n
        last = last[:n] + rest[at:end]
        at = end
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs (keys, prefix lengths): (run of each key in order, its common prefix with the one before).

    A loser tree whose contenders know their common prefix with the last key put
    out: the longer prefix wins unread, and equal prefixes are compared beyond.
    """
    k = 1
    while k < len(runs):
        k *= 2
    keys: list[bytes] = [b""] * k
    known = [-1] * k  # common prefix with the last output; -1: run is over
    place = [0] * k
    for r, (own, _) in enumerate(runs):
        if own:
            keys[r], known[r] = own[0], 0

    def loses(a: int, b: int) -> bool:
        """Whether a loses to b; the loser's prefix is brought up to date."""
        x, y = known[a], known[b]
        if x != y:
            return x < y
        if x < 0:
            return False
        p, q = keys[a], keys[b]
        if p == q:
            known[b] = KEY
            return False
        while p[x] == q[x]:
            x += 1
        if p[x] < q[x]:
            known[b] = x
            return False
        known[a] = x
        return True

    tree = [0] * k
    level = list(range(k))
    width = k
    while width > 1:
        width //= 2
        winners = []
        for i in range(width):
            a, b = level[2 * i], level[2 * i + 1]
            if loses(a, b):
                a, b = b, a
            tree[width + i] = b
            winners.append(a)
        level = winners
    winner = level[0]
    order, prefix = [], []
    while known[winner] >= 0:
        order.append(winner)
        prefix.append(known[winner])
        own, lcps = runs[winner]
        place[winner] = i = place[winner] + 1
        if i < len(own):
            keys[winner], known[winner] = own[i], lcps[i]
        else:
            known[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = tree[node]
            x, y = known[winner], known[other]
            if x < y or x == y and x >= 0 and loses(winner, other):
                tree[node], winner = winner, other
            node >>= 1
    return order, prefix


def smallest_docs(keys: np.ndarray, prefix: np.ndarray, docs: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """For each key and each j < ``SPAN``: the smallest doc with the string from j bytes before the anchor.

    LAST where there is none.  ``docs`` and ``highs``: the smallest and largest
    doc of each key; keys of one document that share no anchor need no look.
    """
    out = np.full((len(keys), SPAN), LAST, np.int64)
    near = np.concatenate((prefix[1:] >= KMER, [False])) if len(prefix) else np.zeros(0, bool)
    live = np.nonzero((prefix >= KMER) | near | (docs < highs))[0]
    if not len(live):
        return out
    sub, low = keys[live], docs[live]
    # A key that stands alone between two groups keeps the groups apart.
    lcp = np.where(np.concatenate(([True], np.diff(live) > 1)), 0, prefix[live])
    onward, backward = sub[:, -2].astype(np.int64), sub[:, -1].astype(np.int64) - 1
    back = np.zeros(len(sub), np.uint64)
    for j in range(SPAN):
        if j:
            back = (back + sub[:, WIDTH + j - 1] + np.uint64(1)) * _C1
            back ^= back >> np.uint64(32)
        group = np.cumsum(lcp < WIDTH - j).astype(np.uint64)
        ok = np.nonzero((backward >= j) & (onward >= WIDTH - j))[0]
        if not len(ok):
            continue
        name = ((group * _C2) ^ (back * _C3))[ok]
        order = np.argsort(name, kind="stable")
        same = name[order]
        heads = np.nonzero(np.concatenate(([True], same[1:] != same[:-1])))[0]
        least = np.minimum.reduceat(low[ok][order], heads)
        out[live[ok[order]], j] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out


def _ints(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def decoded(lcp: bytes, packed: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(decode(lcp, packed)), np.uint8).reshape(-1, KEY)


def anchor_heads(keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys of each anchor begin."""
    return np.nonzero(np.concatenate(([True], (keys[1:, :KMER] != keys[:-1, :KMER]).any(1))))[0] if len(keys) else np.zeros(0, np.int64)


def is_hot(keys: np.ndarray, hot: list[bytes]) -> np.ndarray:
    """Which of the sorted keys have one of the anchors."""
    heads, known = anchor_heads(keys), set(hot)
    return np.repeat([keys[h, :KMER].tobytes() in known for h in heads.tolist()], np.diff(np.append(heads, len(keys)))).astype(bool)


def names_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of bytes, a multiple of eight."""
    a = np.full(len(text), 7, np.uint64)
    b = np.full(len(text), 11, np.uint64)
    for word in np.ascontiguousarray(text).view("<u8").T:
        a = (a ^ (a >> np.uint64(31)) ^ word) * _C1
        b = (b ^ (b >> np.uint64(29))) * _C2 + (word ^ (word >> np.uint64(33))) * _C3
    for m in (_C3, _C1):
        a = (a ^ (a >> np.uint64(32))) * m
        b = (b ^ (b >> np.uint64(30))) * m
    return a ^ (a >> np.uint64(29)), b ^ (b >> np.uint64(31))


def string_names(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(names in two halves, key, j) of each key's ``WIDTH``-byte strings, from j bytes before its anchor, sorted by name."""
    onward, backward = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64) - 1
    parts = []
    for j in range(SPAN):
        ok = np.nonzero((backward >= j) & (onward >= WIDTH - j))[0]
        text = np.zeros((len(ok), -(-WIDTH // 8) * 8), np.uint8)
        text[:, :j] = keys[ok, WIDTH : WIDTH + j][:, ::-1]
        text[:, j:WIDTH] = keys[ok, : WIDTH - j]
        parts.append((*names_of(text), ok, np.full(len(ok), j)))
    a, b, key, j = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((b, a))
    return a[order], b[order], key[order], j[order]


def name_heads(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[0] if len(a) else np.zeros(0, np.int64)


RUNS = "bucket int, chunk long, lcp binary, suffixes binary, lows binary, highs binary, kept binary"
NAMES = "bucket int, chunk long, piece int, a binary, b binary, lows binary, highs binary, keys binary, js binary, of_name binary"
COVER = "chunk long, bucket int, key binary, first binary, last binary, low binary"


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}


def hot_anchors(candidates: DataFrame, parts: int, hot_keys: int = HOT_KEYS) -> DataFrame | None:
    """(bucket, hot): the anchors of large buckets that have too many keys for one task; None if there are none."""
    sizes = candidates.groupBy("bucket").agg(F.sum(F.octet_length("lcp")).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("n") > max(hot_keys, min(2 * total // parts, MOST_KEYS))).select("bucket")
    n_large = large.count()
    if not n_large:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = decoded(row["lcp"], row["suffixes"])
            heads = anchor_heads(keys)
            n = np.diff(np.append(heads, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * len(heads), pa.int32()), pa.array([keys[h, :KMER].tobytes() for h in heads.tolist()], pa.binary()), pa.array(n)], names=["bucket", "anchor", "n"])

    runs = candidates.select("bucket", "lcp", "suffixes").join(F.broadcast(large) if n_large <= 500_000 else large, "bucket")
    counts = runs.mapInArrow(count, "bucket int, anchor binary, n long").groupBy("bucket", "anchor").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") > max(hot_keys, total // MOST_ANCHORS))
    hot = materialize(often.groupBy("bucket").agg(F.collect_list("anchor").alias("hot")), "hot")
    return hot if hot.limit(1).count() else None


def without_hot(candidates: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of ``RUNS``: the runs without the keys of hot anchors; ``kept`` has the places of the others if some are gone."""
    light = candidates.select("bucket", "chunk", "lcp", "suffixes", "lows", "highs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = decoded(row["lcp"], row["suffixes"])
            kept = np.nonzero(~is_hot(keys, row["hot"]))[0]
            if len(kept):
                lcp, rest = front_code(keys[kept])
                values = [row["bucket"], row["chunk"], lcp.tobytes(), pack_bytes(rest), *[_ints(np.frombuffer(row[n], "<i8")[kept], "<i8") for n in ("lows", "highs")], _ints(kept, "<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=["bucket", "chunk", "lcp", "suffixes", "lows", "highs", "kept"])

    whole = light.join(F.broadcast(hot), "bucket", "left_anti").withColumn("kept", F.lit(None).cast("binary"))
    return whole.unionByName(light.join(F.broadcast(hot), "bucket").mapInArrow(cut, RUNS))


def hot_covers(candidates: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``COVER`` for the keys of hot anchors, the table they are read from)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = decoded(row["lcp"], row["suffixes"])
            which = np.nonzero(is_hot(keys, row["hot"]))[0]
            lows, highs = np.frombuffer(row["lows"], "<i8"), np.frombuffer(row["highs"], "<i8")
            for piece, at in enumerate(range(0, len(which), KEYS_AT_ONCE // 4)):
                own = which[at : at + KEYS_AT_ONCE // 4]
                a, b, key, j = string_names(keys[own])
                heads = name_heads(a, b)
                if not len(heads):
                    continue
                key = own[key]
                values = [row["bucket"], row["chunk"], piece, a[heads].tobytes(), b[heads].tobytes(), _ints(np.minimum.reduceat(lows[key], heads), "<i8"), _ints(np.maximum.reduceat(highs[key], heads), "<i8"), _ints(key, "<u4"), _ints(j, "u1"), _ints(np.diff(np.append(heads, len(key))), "<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7), strict=True)], names=[c.split()[0] for c in NAMES.split(", ")])

    runs = candidates.select("bucket", "chunk", "lcp", "suffixes", "lows", "highs").join(F.broadcast(hot), "bucket")
    named = materialize(runs.mapInArrow(name, NAMES), "names", max_rows_per_file=CHUNKS_PER_FILE)
    total = (named.agg(F.sum(F.octet_length("a"))).first()[0] or 0) // 8
    bits = max(2, int(np.ceil(np.log2(max(1, total / NAMES_AT_ONCE)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            a = np.frombuffer(row["a"], "<u8")
            part = (a >> np.uint64(64 - bits)).astype(np.int64)
            heads = np.nonzero(np.concatenate(([True], part[1:] != part[:-1])))[0].tolist()
            edges = list(zip(heads, [*heads[1:], len(a)], strict=True))
            columns = [pa.array([int(part[x]) for x, _ in edges], pa.int32())]
            columns += [pa.array([row[n]] * len(edges), t) for n, t in (("chunk", pa.int64()), ("bucket", pa.int32()), ("piece", pa.int32()))]
            columns += [pa.array(heads, pa.int32()), *[pa.array([row[n][8 * x : 8 * y] for x, y in edges], pa.binary()) for n in ("a", "b", "lows", "highs")]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "bucket", "piece", "at", "a", "b", "lows", "highs"])

    def least(group: pd.DataFrame) -> pd.DataFrame:
        a, b, low, high = (np.concatenate([np.frombuffer(x, t) for x in group[n]]) for n, t in (("a", "<u8"), ("b", "<u8"), ("lows", "<i8"), ("highs", "<i8")))
        order = np.lexsort((b, a))
        heads = name_heads(a[order], b[order])
        found = np.empty(len(a), np.int64)
        found[order] = np.repeat(np.minimum.reduceat(low[order], heads), np.diff(np.append(heads, len(a))))
        out: dict[str, list] = {"chunk": [], "bucket": [], "piece": [], "at": [], "low": []}
        begin = 0
        for chunk, bucket, piece, at, names in zip(group["chunk"], group["bucket"], group["piece"], group["at"], group["a"], strict=True):
            end = begin + len(names) // 8
            hits = np.nonzero(found[begin:end] < high[begin:end])[0]
            if len(hits):
                for n, v in (("chunk", chunk), ("bucket", bucket), ("piece", piece), ("at", _ints(hits + at, "<u4")), ("low", _ints(found[begin:end][hits], "<i8"))):
                    out[n].append(v)
            begin = end
        return pd.DataFrame(out)

    dealt = named.select("chunk", "bucket", "piece", "a", "b", "lows", "highs").mapInArrow(deal, "part int, chunk long, bucket int, piece int, at int, a binary, b binary, lows binary, highs binary")
    found = dealt.repartition(1 << bits, "part").groupBy("part").applyInPandas(least, "chunk long, bucket int, piece int, at binary, low binary")
    found = found.groupBy("chunk", "bucket", "piece").agg(F.collect_list(F.struct("at", "low")).alias("found"))

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in group.itertuples():
            at = np.concatenate([np.frombuffer(f["at"], "<u4") for f in r.found]).astype(np.int64)
            low = np.concatenate([np.frombuffer(f["low"], "<i8") for f in r.found])
            n = np.frombuffer(r.of_name, "<u4").astype(np.int64)
            begin = (np.cumsum(n) - n)[at]
            member = np.arange(n[at].sum()) + np.repeat(begin - np.cumsum(n[at]) + n[at], n[at])
            parts.append((np.frombuffer(r.keys, "<u4")[member], np.frombuffer(r.js, "u1")[member].astype(np.int64), np.repeat(low, n[at])))
        key, j, low = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((j, key))
        key, j, low = key[order], j[order], low[order]
        edge = np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (j[1:] != j[:-1] + 1)))
        first = np.nonzero(edge)[0]
        last = np.append(first[1:] - 1, len(key) - 1)
        return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "bucket": [int(group["bucket"].iloc[0])], "key": [_ints(key[first], "<u4")], "first": [_ints(j[first], "u1")], "last": [_ints(j[last], "u1")], "low": [_ints(low[first], "<i8")]})

    both = named.select("chunk", "bucket", "piece", "keys", "js", "of_name").join(found, ["chunk", "bucket", "piece"])
    return both.groupBy("chunk", "bucket").applyInPandas(cover, COVER), named


CHUNKS = "chunk long, ids binary, copies binary, lengths binary, data binary, rest binary"
CANDIDATES = "bucket int, chunk long, lcp binary, suffixes binary, lows binary, highs binary, places binary, which binary, owners binary, of_owner binary"


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.cast(column, pa.binary()), b"")


def make_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``CHUNKS``.

    ``data`` has the texts end to end, but for copies; ``rest`` is an Arrow stream
    of the other columns.
    """
    first = docs.where(F.octet_length("text") >= WIDTH).select("doc_id", F.md5("text").alias("_digest"))
    first = first.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    first = materialize(first, "copies")
    if first.count() <= 500_000:
        first = F.broadcast(first)
    names = [c for c in docs.columns if c not in ("_digest", "_first")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.md5(F.coalesce("text", F.lit(""))).alias("_digest"))
    rows = keyed.join(first, "_digest", "left").select(*[F.col(f"`{c}`") for c in names if c != "text"], F.col("_first"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = made = 0
        base = TaskContext.get().partitionId() << 24

        def out() -> pa.RecordBatch:
            nonlocal made
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = _texts(whole.column(whole.num_columns - 1).chunk(0))
            ids = pc.fill_null(whole.column("doc_id").chunk(0), LAST).to_numpy(zero_copy_only=False)
            first = pc.fill_null(whole.column("_first").chunk(0), LAST).to_numpy(zero_copy_only=False)
            copies = first < ids
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            data = b"".join(t.as_py() for t, c in zip(texts, copies, strict=True) if not c)
            rest = whole.select(whole.column_names[:-2])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_table(rest)
            made += 1
            row = [base + made, _ints(ids, "<i8"), _ints(copies, "u1"), _ints(lengths, "<i8"), data, sink.getvalue().to_pybytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(row)], names=["chunk", "ids", "copies", "lengths", "data", "rest"])

        for batch in batches:
            lengths = pc.binary_length(_texts(batch.column(batch.num_columns - 1))).to_numpy(zero_copy_only=False).astype(np.int64)
            sums, a = np.cumsum(lengths), 0
            while a < batch.num_rows:
                before = int(sums[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(sums, before + chunk_bytes - size, "right")))
                held.append(batch.slice(a, b - a))
                size += int(sums[b - 1]) - before
                a = b
                if size >= chunk_bytes or a < batch.num_rows:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, CHUNKS)


class Chunk:
    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.copies = np.frombuffer(row["copies"], "u1").astype(bool)
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.data = np.frombuffer(row["data"], np.uint8)
        self.ends = np.cumsum(np.where(self.copies, 0, self.lengths))

    def occurrences(self, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Slices of (position, hash, document within the chunk, keys of the bytes onward and backward, whether there are so many bytes)."""
        begins = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        wide = KMER + BESIDE
        for at, h in anchors(self.data, self.ends):
            doc = np.searchsorted(self.ends, at, "right")
            sides, there = [], []
            for begin, salt in ((at, 0), (at - BESIDE, 1)):
                fits = (begin >= begins[doc]) & (begin + wide <= self.ends[doc])
                own = np.zeros(len(at), np.uint64)
                own[fits] = beside(self.data, begin[fits]) ^ np.uint64(salt << 63 | salt)
                sides.append(keyed_hashes(own, bits))
                there.append(fits)
            yield at, h, doc, sides, there


def keyed_hashes(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` (bucket) and the 32 bits after them."""
    return h >> np.uint64(32 - bits)


def least_and_most(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with the least of ``low`` and the largest of ``high``."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.zeros(0, np.int64)
    if not len(heads):
        return key, low, high
    return key[heads], np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads)


def exchanged(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct keys, whether two of its documents have each, and where a bucket's keys begin."""
    parts = []
    for _, _, doc, sides, there in chunk.occurrences(bits):
        key, own = np.concatenate([k[f] for k, f in zip(sides, there, strict=True)]), np.concatenate([doc[f] for f in there])
        parts.append(least_and_most(key, own, own))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(bool), none
    key, low, high = least_and_most(*map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0]
    bucket = key >> np.uint64(32)
    return key, low != high, np.nonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[0] if len(key) else np.zeros(0, np.int64)


def removed(docs: DataFrame, chunk_bytes: int | None = None, bucket_bytes: int = BUCKET_BYTES, broadcast_mb: float = BROADCAST_MB, hot_keys: int = HOT_KEYS) -> tuple[DataFrame, DataFrame]:
    """(chunks, spans): the chunk table, and (chunk, spans) with the merged byte spans to remove."""
    if chunk_bytes is None:
        text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunk_bytes = int(min(LARGEST_CHUNK, max(1, text / 2**30) ** 0.5 * CHUNK_BYTES))
    chunks = materialize(make_chunks(docs, chunk_bytes), "chunks", max_rows_per_file=CHUNKS_PER_FILE)
    total = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = max(2, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    parts = 1 << bits
    light = chunks.select("chunk", "ids", "copies", "lengths", "data")
    names = [f.name for f in light.schema.fields]

    def table(columns: dict[str, list], schema: T.StructType) -> pa.RecordBatch:
        kinds = {"integer": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], kinds[f.dataType.simpleString()]) for f in schema.fields], names=schema.names)

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            key, _, heads = exchanged(Chunk(row), bits)
            low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            edges = np.append(heads, len(key)).tolist()
            bucket = (key[heads] >> np.uint64(32)).astype(np.int64).tolist()
            yield table({"bucket": bucket, "chunk": [row["chunk"]] * len(bucket), "hashes": [low[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]}, hash_schema)

    hash_schema = T._parse_datatype_string("bucket int, chunk long, hashes binary")

    def find_shared(group: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(b, "<u4") for b in group["hashes"]]
        every = np.sort(np.concatenate(runs))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        marks = [np.packbits(np.isin(r, twice, assume_unique=True)).tobytes() for r in runs]
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "marks": marks})

    sent = light.mapInArrow(send_hashes, hash_schema)
    marks = sent.repartition(parts, "bucket").groupBy("bucket").applyInPandas(find_shared, "chunk long, bucket int, marks binary")
    marks = materialize(marks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "marks"))).alias("marks")), "marks")

    def joined(side: DataFrame, size: str) -> DataFrame:
        mb = (side.agg(F.sum(F.expr(size))).first()[0] or 0) / 2**20
        return F.broadcast(side) if mb <= broadcast_mb else side

    marked = light.join(joined(marks, "aggregate(marks, 0L, (s, m) -> s + octet_length(m.marks))"), "chunk").select(*names, "marks")
    candidate_schema = T._parse_datatype_string(CANDIDATES)

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            key, shared, heads = exchanged(chunk, bits)
            counts = np.diff(np.append(heads, len(key))).tolist()
            shared = shared | np.concatenate([np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=n) for m, n in zip(row["marks"], counts, strict=True)]).astype(bool)
            key = key[shared]
            kept: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint32), np.zeros(0, np.uint64))]
            for at, h, _, sides, there in chunk.occurrences(bits):
                keep = np.zeros(len(at), bool)
                if len(key):
                    for k, f in zip(sides, there, strict=True):
                        place = np.minimum(np.searchsorted(key, k), len(key) - 1)
                        keep |= f & (key[place] == k)
                kept.append((at[keep].astype(np.uint32), h[keep]))
            at, h = map(np.concatenate, zip(*kept, strict=True))
            columns: dict[str, list] = {f.name: [] for f in candidate_schema.fields}
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ordered = bucket[order]
            heads = np.nonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[0].tolist() if len(ordered) else []
            for begin, end in zip(heads, [*heads, len(ordered)][1:], strict=True):
                b = int(ordered[begin])
                place = at[order[begin:end]].astype(np.int64)
                doc = np.searchsorted(chunk.ends, place, "right")
                run, which = distinct_keys(chunk.data, chunk.ends, doc, place)
                ids = chunk.ids[doc]
                lows, highs = np.full(len(run), LAST), np.full(len(run), np.iinfo(np.int64).min)
                np.minimum.at(lows, which, ids)
                np.maximum.at(highs, which, ids)
                # Places are in order, so an owner's are one after another.
                new = np.nonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[0]
                of_owner = np.diff(np.append(new, len(doc)))
                lcp, rest = front_code(run)
                values = (b, row["chunk"], lcp.tobytes(), pack_bytes(rest), _ints(lows, "<i8"), _ints(highs, "<i8"), _ints(place, "<u4"), _ints(which, "<u4"), _ints(ids[new], "<i8"), _ints(of_owner, "<u4"))
                for f, v in zip(candidate_schema.fields, values, strict=True):
                    columns[f.name].append(v)
            yield table(columns, candidate_schema)

    candidates = materialize(marked.mapInArrow(send_runs, candidate_schema), "suffixes")
    def merge_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        runs = [(decode(l, s), l) for l, s in zip(group["lcp"], group["suffixes"], strict=True)]
        places = [None if k is None else np.frombuffer(k, "<u4") for k in group["kept"]]
        order, prefix = merge_runs(runs)
        if not order:
            return pd.DataFrame(columns=["chunk", "bucket", "key", "first", "last", "low"])
        run = np.array(order)
        # Each run's keys come out in its own order.
        step = np.argsort(run, kind="stable")
        begins = np.cumsum([0, *[len(k) for k, _ in runs]])
        within = np.empty(len(run), np.int64)
        within[step] = np.arange(len(run)) - np.repeat(begins[:-1], np.diff(begins))
        keys = np.frombuffer(b"".join(runs[r][0][i] for r, i in zip(order, within.tolist(), strict=True)), np.uint8).reshape(-1, KEY)
        lows = np.concatenate([np.frombuffer(x, "<i8") for x in group["lows"]])[begins[run] + within]
        highs = np.concatenate([np.frombuffer(x, "<i8") for x in group["highs"]])[begins[run] + within]
        least = smallest_docs(keys, np.array(prefix), lows, highs)
        useful = np.nonzero((least < highs[:, None]).any(1))[0]
        least = least[useful]
        edge = np.concatenate((np.ones((len(least), 1), bool), least[:, 1:] != least[:, :-1]), 1)
        row, first = np.nonzero(edge)
        last = np.append(first[1:] - 1, SPAN - 1)
        last[np.append(row[1:] != row[:-1], True)] = SPAN - 1
        low = least[row, first]
        owner = useful[row]
        good = low < highs[owner]
        owner, first, last, low = owner[good], first[good], last[good], low[good]
        out = {"chunk": [], "bucket": [], "key": [], "first": [], "last": [], "low": []}
        whose = run[owner]
        by = np.argsort(whose, kind="stable")
        cut = np.searchsorted(whose[by], np.arange(len(runs) + 1))
        for r, chunk in enumerate(group["chunk"]):
            mine = by[cut[r] : cut[r + 1]]
            if len(mine):
                key = within[owner[mine]] if places[r] is None else places[r][within[owner[mine]]]
                for name, v in (("chunk", chunk), ("bucket", group["bucket"].iloc[0]), ("key", _ints(key, "<u4")), ("first", _ints(first[mine], "u1")), ("last", _ints(last[mine], "u1")), ("low", _ints(low[mine], "<i8"))):
                    out[name].append(v)
        return pd.DataFrame(out)

    hot = hot_anchors(candidates, parts, hot_keys)
    if hot is None:
        runs = candidates.select("bucket", "chunk", "lcp", "suffixes", "lows", "highs", F.lit(None).cast("binary").alias("kept"))
    else:
        runs = without_hot(candidates, hot)
    covers = runs.repartition(parts, "bucket").groupBy("bucket").applyInPandas(merge_group, COVER)
    used = [marks, candidates]
    if hot is not None:
        more, named = hot_covers(candidates, hot)
        covers = covers.unionByName(more)
        used += [hot, named]
    places = candidates.select("bucket", "chunk", "places", "which", "owners", "of_owner")
    both = places.join(covers, ["chunk", "bucket"])

    def to_spans(group: pd.DataFrame) -> pd.DataFrame:
        begins, ends = [], []
        for r in group.itertuples():
            key, first, last, low = (np.frombuffer(x, t) for x, t in ((r.key, "<u4"), (r.first, "u1"), (r.last, "u1"), (r.low, "<i8")))
            at, which = np.frombuffer(r.places, "<u4").astype(np.int64), np.frombuffer(r.which, "<u4")
            owner = np.repeat(np.frombuffer(r.owners, "<i8"), np.frombuffer(r.of_owner, "<u4"))
            # Every occurrence of a key meets each of the key's rows.
            a, b = np.searchsorted(key, which, "left"), np.searchsorted(key, which, "right")
            n = b - a
            who = np.repeat(np.arange(len(at)), n)
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            hit = low[row] < owner[who]
            who, row = who[hit], row[hit]
            begins.append(at[who] - last[row])
            ends.append(at[who] - first[row] + WIDTH)
        begin, end = np.concatenate(begins), np.concatenate(ends)
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        reach = np.maximum.accumulate(end) if len(end) else end
        new = np.concatenate(([True], begin[1:] > reach[:-1])) if len(end) else np.zeros(0, bool)
        heads = np.nonzero(new)[0]
        tails = np.append(heads[1:] - 1, len(end) - 1) if len(end) else heads
        return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "begins": [_ints(begin[heads], "<i8")], "ends": [_ints(reach[tails], "<i8")]})

    spans = materialize(both.groupBy("chunk").applyInPandas(to_spans, "chunk long, begins binary, ends binary"), "spans")
    release(*used)
    return chunks, joined(spans, "octet_length(begins) + octet_length(ends)")


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the parts of characters that are not gone as a whole."""
    if not len(data):
        return gone
    lead = (data & 0xC0) != 0x80
    lead[0] = True
    starts = np.nonzero(lead)[0]
    return np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.append(starts, len(data))))


def remove_repeats(docs: DataFrame, as_text: bool = True, **sizes: float) -> DataFrame:
    """``docs`` with n_bytes, n_removed and n_spans, and what is left of each text.

    ``as_text``: what is left replaces ``text``, and a character goes only with
    all its bytes; the counts are of bytes removed then.  Otherwise the left
    bytes are in ``kept`` (binary) and ``text`` is left out.
    """
    added = {"n_bytes", "n_removed", "n_spans", "kept", "_digest", "_first"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]).withColumn("doc_id", F.col("doc_id").cast("long"))
    chunks, spans = removed(docs, **sizes)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    last = T.StructField("text", T.StringType()) if as_text else T.StructField("kept", T.BinaryType())
    out = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                chunk = Chunk(row)
                n = len(chunk.data)
                step = np.zeros(n + 1, np.int32)
                if row["begins"]:
                    np.add.at(step, np.frombuffer(row["begins"], "<i8"), 1)
                    np.add.at(step, np.frombuffer(row["ends"], "<i8"), -1)
                gone = np.cumsum(step[:n]) > 0
                if as_text:
                    gone = whole_characters(chunk.data, gone)
                sums = np.concatenate(([0], np.cumsum(gone)))
                begin = np.concatenate(([0], chunk.ends[:-1])) if len(chunk.ends) else chunk.ends
                head = gone & ~np.concatenate(([False], gone[:-1])) if n else gone
                head[begin[(begin < n) & (chunk.ends > begin)]] = gone[begin[(begin < n) & (chunk.ends > begin)]]
                heads = np.concatenate(([0], np.cumsum(head)))
                long_copy = chunk.copies & (chunk.lengths >= WIDTH)
                n_removed = np.where(chunk.copies, np.where(long_copy, chunk.lengths, 0), sums[chunk.ends] - sums[begin])
                n_spans = np.where(chunk.copies, long_copy, heads[chunk.ends] - heads[begin])
                left = []
                for a, b, cut in zip(begin.tolist(), chunk.ends.tolist(), n_removed.tolist(), strict=True):
                    part = chunk.data[a:b]
                    left.append((part[~gone[a:b]] if cut else part).tobytes())
                rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                columns = [rest.column(f.name).chunk(0) if rest.num_rows else rest.column(f.name).combine_chunks() for f in kept]
                body = pa.array(left, pa.binary())
                columns += [pa.array(chunk.lengths), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pc.cast(body, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)) if as_text else body]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return chunks.join(spans, "chunk", "left").select("ids", "copies", "lengths", "data", "rest", "begins", "ends").mapInArrow(run, out)
