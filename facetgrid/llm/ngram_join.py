"""Exact Jaccard self-join on word shingles with count-vector R-trees.

Documents with one shingle set are one node.  Shingle hashes are divided into
ranges ("groups"); a node's group counts are its point, and the overlap of two
nodes is at most the sum of the smaller of their counts.  Points are indexed in
R-trees whose boxes bound that sum from above; a pair whose bound reaches the
needed overlap is verified on the sets.

A tree over all points at once would not be distributed, so nodes first meet in
runs that lose no pair.  Elements have one order for all nodes, from rare to
frequent by a count sketch of all texts (any order is exact; this one keeps
boilerplate out of the keys).  A node's keys are the elements of its prefix in
that order, one more than a linked set may lack, so two linked nodes have a key
in common.  The nodes of a key are a run; equal runs count once.  Each run has
its R-tree, over points alone, and only pairs whose bound reaches the overlap
that a link needs stay: what shares a key by chance ends here.  The connected
components of these pairs are the blocks.  Nodes in blocks send their texts,
once, to the task that has their block's tree, where pairs are verified.

No key gathers in one task: keys that the sketch does not rule out are counted
(combined before the shuffle), and those of more than ``max_block`` nodes are cut
into parts, each pair of which is a run of its own.  Runs and blocks are cut
likewise, by nodes and by bytes, and joins on nodes and components split hot ones.
Pairs and links are spanning: one already connected in its task is not looked at
again, which leaves components as they are.

Nulls and odd input: a null or empty text, or one of white space, has no
shingles and is linked with nothing, its own component.  With fewer words than a
shingle the whole sequence is one.  Repeated rows and copies share a node; a null
doc_id can be linked but is never the smallest id, and is null if its component
has no other.  An empty table gives an empty result; further columns are ignored
(``link``) or kept (``keep_one``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetgrid.llm.common import fresh, materialize, release
from facetgrid.llm.components import components, split_join

PERCENT = 85
BROADCAST_ROWS = 500_000
MAX_BLOCK = 4096
#: Bytes of points or texts in a task's tree.
MAX_BLOCK_BYTES = 32 << 20
LEAF = 64
#: A counter of the sketch for each so many bytes of text, within these bounds in bits.
SKETCH_BYTES, SKETCH_BITS = 1024, (12, 22)
SKETCH_SLICES = 64
#: Text whose words are hashed at once.
SLICE_BYTES, SEGMENT = 4 << 20, 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _B
    return x ^ (x >> _S29)


#: Bytes of white space, a factor for each byte (A-Z as a-z), and powers of an odd number with their inverses.
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_FACTOR = mix(mix((np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) < 91))).astype(np.uint64) * _A + _C) * _C) | np.uint64(1)
_BASE = 0xD1342543DE82EF95


def powers(x: int) -> np.ndarray:
    out = np.full(SEGMENT, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def long_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of texts laid end to end, the text of each).

    A word's hash is its bytes' factors at a base of two to the 64th, from sums
    over a segment at once; words of half a segment and more are hashed one by one.
    """
    total, a = len(data), 0
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while a < total:
        b = min(a + SEGMENT, total)
        if b < total:  # cut after the last text or gap; a longer word stands alone
            gaps = np.flatnonzero(_GAP[data[a:b]])
            k = int(np.searchsorted(ends, b, "right"))
            cut = max(a + int(gaps[-1]) + 1 if len(gaps) else a, int(ends[k - 1]) if k else 0)
            if cut <= a:
                stop = int(ends[k])
                while b < stop and not _GAP[data[b : min(b + SEGMENT, stop)]].any():
                    b = min(b + SEGMENT, stop)
                if b < stop:
                    b += int(np.argmax(_GAP[data[b : min(b + SEGMENT, stop)]]))
                hashes.append(np.array([long_word(data[a:b].tobytes())], np.uint64))
                places.append(np.array([a]))
                a = b
                continue
            b = cut
        part = data[a:b]
        word = ~_GAP[part]
        edge = np.zeros(len(part) + 1, bool)  # a text ends before this byte
        edge[ends[np.searchsorted(ends, a) : np.searchsorted(ends, b, "right")] - a] = True
        edge[0] = edge[-1] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_FACTOR[part] * _POWER[: len(part)])))
        h = mix((sums[end] - sums[begin]) * _INVERSE[begin] + (end - begin).astype(np.uint64) * _C)
        for k in np.flatnonzero(end - begin >= SEGMENT // 2).tolist():
            h[k] = long_word(part[begin[k] : end[k]].tobytes())
        hashes.append(h)
        places.append(begin + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(ends, np.concatenate(places), "right")


def shingles_of(texts: pa.Array, k: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hashes of the ``k``-word shingles of several texts, in order and end to end, and where each text's end) for all ``texts``, some SLICE_BYTES at a time."""
    texts = pc.fill_null(pc.cast(texts, pa.binary()), b"")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        rows = max(1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at)
        data = np.frombuffer(b"".join(texts.slice(at, rows).to_pylist()), np.uint8)
        h, doc = word_hashes(data, ends[at : at + rows] - before)
        at += rows
        n = np.bincount(doc, minlength=rows)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        out = np.zeros(int(count.sum()), np.uint64)
        if len(h) >= k:
            last = len(h) - k + 1
            wide = h[:last] * _A + np.uint64(k)
            for i in range(1, k):
                wide = mix(wide) + h[i : last + i]
            out[np.repeat(n >= k, count)] = wide[doc[:last] == doc[k - 1 :]]
        begin, place = np.cumsum(n) - n, np.cumsum(count) - count
        for d in np.flatnonzero((n > 0) & (n < k)).tolist():
            own = h[begin[d] : begin[d] + n[d]]
            one = own[:1] * _A + np.uint64(len(own))
            for i in range(1, len(own)):
                one = mix(one) + own[i : i + 1]
            out[place[d]] = one[0]
        yield mix(out * _C), np.cumsum(count)


def shingle_sets(texts: pa.Array, k: int = 4) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    for h, ends in shingles_of(texts, k):
        a = 0
        for b in ends.tolist():
            yield np.unique(h[a:b])
            a = b


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits of a set: two independent sums of its elements' hashes, and its size."""
    sums = [int(mix(shingles * m + a).sum(dtype=np.uint64)) + len(shingles) * int(_B) for m, a in ((_A, _C), (_C, _B))]
    return mix(np.array([t % (1 << 64) for t in sums], np.uint64)).astype(">u8").tobytes()


def needed(total: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The least overlap of two linked sets whose sizes sum to ``total``."""
    return -(-percent * total // (100 + percent))


def prefix_keys(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketch counts) of a sorted set: its rarest elements; linked sets have one in common.

    A linked set has at least ``percent`` of the elements, so of one more than may
    be lacking at least one is shared, and the first shared one in the common
    order is in both prefixes.
    """
    own = counts[s >> np.uint64(64 - len(counts).bit_length() + 1)]
    first = np.argsort(own, kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]
    return s[first], own[first]


def planes(low: np.ndarray) -> np.ndarray:
    """Counts up to 3 in unary: a bit for each of "at least 1, 2, 3".

    The sum of minima of two rows is the number of bits they share, and the
    largest counts of several rows are the bits that any of them has.
    """
    return np.concatenate([np.packbits(low >= k, axis=1) for k in (1, 2, 3)], axis=1).view(np.uint64)


class RTree:
    """Points packed by sorting along size and the widest coordinates; boxes keep the largest counts and the range of sizes.

    ``points``: a row for each set, as ``point_of`` gives them.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.bits, self.over, self.sizes = planes(points[:, :-1]), points[:, -1].astype(np.int64), points.sum(axis=1, dtype=np.int64)
        wide = np.argsort(-points.var(axis=0), kind="stable") if len(points) > leaf else np.zeros(1, np.int64)

        def pack(rows: np.ndarray, depth: int) -> list[np.ndarray]:
            if len(rows) <= leaf:
                return [rows]
            axis = points[rows, wide[depth % len(wide)]] if depth else self.sizes[rows]
            rows = rows[np.argsort(axis, kind="stable")]
            half = len(rows) // 2
            return pack(rows[:half], depth + 1) + pack(rows[half:], depth + 1)

        self.leaves = pack(np.arange(len(points)), 0)
        level = [(np.bitwise_or.reduce(self.bits[r]), self.over[r].max(), self.sizes[r].min(), self.sizes[r].max()) for r in self.leaves]
        self.levels = []
        while True:
            self.levels.append([np.array(column) for column in zip(*level, strict=True)])
            if len(level) <= 16:
                break
            bits, over, low, top = self.levels[-1]
            level = [(np.bitwise_or.reduce(bits[k : k + 16]), over[k : k + 16].max(), low[k : k + 16].min(), top[k : k + 16].max()) for k in range(0, len(level), 16)]

    def near(self, k: int, percent: int = PERCENT) -> np.ndarray:
        """Points whose bound on the overlap with point ``k`` reaches what a link needs."""
        own, over, size = self.bits[k], self.over[k], int(self.sizes[k])
        bound = lambda bits, more: np.bitwise_count(bits & own).sum(axis=1, dtype=np.int64) + np.minimum(more, over)
        boxes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, more, low, top = (column[boxes] for column in self.levels[depth])
            boxes = boxes[(bound(bits, more) >= needed(size + low, percent)) & (100 * top >= percent * size) & (percent * low <= 100 * size)]
            if depth:
                boxes = (boxes[:, None] * 16 + np.arange(16)).ravel()
                boxes = boxes[boxes < len(self.levels[depth - 1][0])]
        if not len(boxes):
            return boxes
        rows = np.concatenate([self.leaves[b] for b in boxes])
        return rows[bound(self.bits[rows], self.over[rows]) >= needed(size + self.sizes[rows], percent)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def point_of(s: np.ndarray) -> np.ndarray:
    """Counts of hash ranges, about one element each, up to 3; what is beyond is the last coordinate.

    The sum of minima over all coordinates bounds the overlap.  The ranges are a
    power of two, so that a coarser point is a sum of neighbours.
    """
    ranges = 64
    while ranges * 3 < len(s) * 2:
        ranges *= 2
    counts = np.bincount((s >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64), minlength=ranges)
    low = np.minimum(counts, 3)
    return np.append(low, len(s) - low.sum()).astype(np.int32)


def pack_point(p: np.ndarray) -> bytes:
    four = p[:-1].astype(np.uint8).reshape(-1, 4)
    return int(p[-1]).to_bytes(4, "little") + (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def unpack_point(data: bytes) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8, offset=4)
    out = np.empty(4 * len(packed) + 1, np.int32)
    for k in range(4):
        out[k:-1:4] = packed >> np.uint8(2 * k) & np.uint8(3)
    out[-1] = int.from_bytes(data[:4], "little")
    return out


def coarsened(p: np.ndarray, ranges: int) -> np.ndarray:
    """The point of the same set with fewer ranges."""
    if len(p) == ranges + 1:
        return p
    counts = p[:-1].reshape(ranges, -1).sum(axis=1)
    low = np.minimum(counts, 3)
    return np.append(low, p[-1] + (counts - low).sum()).astype(np.int32)


def near_pairs(points: list[np.ndarray], percent: int = PERCENT, linked: Callable[[int, int], bool] = lambda a, b: True) -> np.ndarray:
    """Label (smallest position reachable) of each point by pairs that reach their bound and are ``linked``."""
    ranges = min(map(len, points)) - 1
    whole = np.stack([coarsened(p, ranges) for p in points])
    label = np.arange(len(points))
    if len(points) == 2:
        if np.minimum(whole[0], whole[1]).sum() >= needed(int(whole.sum()), percent) and linked(1, 0):
            label[1] = 0
        return label
    tree = RTree(whole)

    def reaches(a: int, b: int) -> bool:
        """The bound at the finest ranges that both have."""
        both = min(len(points[a]), len(points[b])) - 1
        return both == ranges or np.minimum(coarsened(points[a], both), coarsened(points[b], both)).sum() >= needed(int(tree.sizes[a] + tree.sizes[b]), percent)

    for k in range(1, len(points)):
        found = tree.near(k, percent)
        for p in found[found < k]:
            if label[p] != label[k] and reaches(k, int(p)) and linked(k, int(p)):
                low, high = sorted((label[p], label[k]))
                label[label == high] = low
    return label


def join_block(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Label (smallest position reachable) of each set by links among ``sets``."""
    return near_pairs([point_of(s) for s in sets], percent, lambda a, b: overlap(sets[a], sets[b]) >= needed(len(sets[a]) + len(sets[b]), percent))


def sketch(docs: DataFrame, bits: int, k: int) -> np.ndarray:
    """How many shingles of all texts fall on each of ``1 << bits`` counters by their upper hash bits.

    Each task adds up its texts and hands on packed slices, which are added in
    the tasks they are dealt to; only the sums, bounded in size, are collected.
    """
    step = (1 << bits) // SKETCH_SLICES

    def slices(total: np.ndarray, kind: str) -> pa.RecordBatch:
        parts = [pa.compress(total[i * step : (i + 1) * step].astype(kind).tobytes(), codec="zstd", asbytes=True) for i in range(SKETCH_SLICES)]
        return pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for h, _ in shingles_of(batch.column(0), k):
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            yield slices(np.minimum(total, 0xFFFFFFFF), "<u4")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(pa.decompress(packed, decompressed_size=4 * step, codec="zstd", asbytes=True), "<u4")
                sums[at] = sums[at] + own if at in sums else own.astype(np.uint64)
        if sums:
            parts = [np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition(SKETCH_SLICES, "slice").mapInArrow(add, schema)
    out = np.zeros(1 << bits, np.uint32)
    for row in sums.collect():
        out[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(row["counts"], "<u4")
    return out


PASS = "doc_id long, text_key long, n_shingles long, node binary, point binary, keys array<long>, often array<long>"


def scan(docs: DataFrame, counts: np.ndarray, max_block: int, k: int, percent: int) -> DataFrame:
    """One row for each document; its point and keys where its node is new to the task.

    ``keys``: those of at most ``max_block`` nodes by the sketch; ``often``: those that may have more.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "text_key", "n_shingles", "node", "point", "keys", "often"]
    shared = docs.sparkSession.sparkContext.broadcast(counts.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketched = np.frombuffer(shared.value, np.uint32)
        seen: set[bytes] = set()
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for s in shingle_sets(batch.column(2), k):
                node = set_id(s) if len(s) else None
                new = [None] * 3
                if node is not None and node not in seen:
                    seen.add(node)
                    keys, own = prefix_keys(s, sketched, percent)
                    keys = keys.view(np.int64)
                    new = [pack_point(point_of(s)), keys[own <= max_block], keys[own > max_block]]
                for column, value in zip(columns, (len(s), node, *new), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds[2:], strict=True)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, PASS)


def cut_large(members: DataFrame, group: str, weight: Column | int = 0, max_block: int = MAX_BLOCK, max_bytes: int = MAX_BLOCK_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``members`` (group, node and more) with groups above ``max_block`` nodes or ``max_bytes`` of weight as pairs of their parts; whether there were any."""
    parts = F.ceil(F.greatest(F.count("*") / (max_block // 2), F.sum(F.lit(weight) if isinstance(weight, int) else weight) / (max_bytes // 2)))
    size = members.groupBy(group).agg(F.count("*").alias("n"), parts.cast("int").alias("parts"))
    large = materialize(size.where((F.col("n") > 1) & (F.col("parts") > 2)).select(group, "parts"), "large")
    number = large.count()
    if not number:
        return members, False
    # Broadcast where small: a shuffle by group would gather each large one.
    cut = members.join(F.broadcast(large), group, "left") if number <= broadcast_rows else split_join(members, large, group, "left")
    cut = cut.withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.when(F.col("parts") == 1, F.col(group)).otherwise(F.md5(F.concat_ws(",", F.hex(group), F.least("part", "other"), F.greatest("part", "other"))).cast("binary") if dict(members.dtypes)[group] == "binary" else F.xxhash64(group, F.least("part", "other"), F.greatest("part", "other")))
    return cut.withColumn(group, name).select(*members.columns), True


def key_runs(passed: DataFrame, max_block: int, broadcast_rows: int) -> DataFrame:
    """(run, node) of each key that two nodes have; runs of the same nodes have one name."""
    keyed = lambda c: passed.where(F.col(c).isNotNull()).select(F.explode(c).alias("key"), "node")
    often, _ = cut_large(keyed("often"), "key", max_block=max_block, broadcast_rows=broadcast_rows)
    dealt = keyed("keys").unionByName(often).repartition("key").dropDuplicates(["key", "node"])
    of_key = Window.partitionBy("key")
    named = dealt.select("node", F.count("*").over(of_key).alias("n"), F.bit_xor(F.xxhash64("node")).over(of_key).alias("name"))
    return named.where("n > 1").select(F.xxhash64("name", "n").alias("run"), "node").distinct()


def spanning(grouped: DataFrame, label: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """(a, b) edges to the smallest node of each component of ``label`` over groups (group, node, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[bytes, bytes, bytes]]:
            for b in batches:
                content = pc.cast(b.column(2), pa.binary())
                for i, (group, node) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    yield group, node, content[i].as_py()

        a: list[bytes] = []
        to: list[bytes] = []
        for _, rows in itertools.groupby(each(), key=lambda r: r[0]):
            own = {node: content for _, node, content in rows}  # repeated rows send a text again
            nodes = sorted(own)
            if len(nodes) > 1:
                for i, target in enumerate(label([own[n] for n in nodes]).tolist()):
                    if target != i:
                        a.append(nodes[i])
                        to.append(nodes[target])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(to, pa.binary())], names=["a", "b"])
                a, to = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(to, pa.binary())], names=["a", "b"])

    group, node = grouped.columns[:2]
    return grouped.repartition(group).sortWithinPartitions(group, node).mapInArrow(run, "a binary, b binary")


def link(docs: DataFrame, k: int = 4, percent: int = PERCENT, max_block: int = MAX_BLOCK, max_bytes: int = MAX_BLOCK_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_shingles, node, component_id.

    ``text_key`` is ``xxhash64(text)``; ``node`` is null without shingles.
    """
    limits = {"max_block": max_block, "max_bytes": max_bytes, "broadcast_rows": broadcast_rows}
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    low, high = SKETCH_BITS
    counts = sketch(docs, min(high, max(low, (total // SKETCH_BYTES).bit_length())), k)
    passed = materialize(scan(docs, counts, max_block, k, percent), "shingles")
    rows = passed.select("doc_id", "text_key", "n_shingles", "node")
    runs = materialize(key_runs(passed.select("node", "keys", "often"), max_block, broadcast_rows), "runs")
    points = passed.where("point is not null").groupBy("node").agg(F.first("point").alias("point"))
    pointed = materialize(runs.join(points, "node").select("run", "node", "point"), "points")
    in_runs, _ = cut_large(pointed, "run", F.octet_length("point"), **limits)
    edges = spanning(in_runs, lambda found: near_pairs([unpack_point(p) for p in found], percent))
    blocks = materialize(components(edges).select(F.col("root").alias("block"), F.col("id").alias("node")), "blocks")
    release(runs, pointed)

    # One row of each node sends its text; the set is made where the tree is.
    picked = rows.where("node is not null").join(F.broadcast(blocks.select("node")) if blocks.count() <= broadcast_rows else blocks.select("node"), "node", "left_semi")
    picked = picked.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.max("n_shingles").alias("n"))
    member, oversize = cut_large(materialize(blocks.join(picked, "node"), "picked"), "block", 16 * F.col("n"), **limits)
    chosen = materialize(member.select("block", "node", F.col("r.doc_id").alias("of_doc"), F.col("r.text_key").alias("of_text")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))
    found = texts.join(F.broadcast(chosen) if chosen.count() <= broadcast_rows else chosen, same).select("block", "node", "text")
    links = materialize(spanning(found, lambda own: join_block(list(shingle_sets(pa.array(own, pa.binary()), k)), percent)), "links")
    if oversize:
        roots = materialize(components(links), "roots")
    else:  # each node's one link is to its component's smallest node
        roots = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    root = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    root = root.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    root = materialize(root, "roots")
    by_node = materialize(split_join(root, root.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "root", "component_id"), "components")
    release(blocks, chosen, links, root)
    joined = split_join(rows, by_node, "node", "left")
    return joined.select("doc_id", "text_key", "n_shingles", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, broadcast_rows: int = 1_000_000, **how: int) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (then text hash) stays.

    Rows without shingles all stay.
    """
    linked = materialize(link(docs.select("doc_id", "text"), **how).where("root is not null").select("root", "doc_id", "text_key"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    best = linked.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best")
    each = linked.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    judged = split_join(each, best, "root").withColumn("stays", F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key")))
    doc, text = fresh(docs, "of_doc", "of_text")
    judged = materialize(judged.where("not stays or rows > 1").select(F.col("doc_id").alias(doc), F.col("text_key").alias(text), "stays"), "judged")
    release(linked)
    small = judged.count() <= broadcast_rows
    side = lambda df: F.broadcast(df) if small else df
    # Both doc_id and the text's hash must agree.
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    left = docs.join(side(judged.where("not stays").select(doc, text)), same, "left_anti")
    repeated = judged.where("stays").select(doc, text)
    if repeated.limit(1).count():
        (key,) = fresh(docs, "row_key")
        single = left.join(side(repeated), same, "left_semi").withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
        left = left.join(side(repeated), same, "left_anti").unionByName(single)
    return left.select(*docs.columns)
