"""Phrase collocations: candidates from a count sketch, counted by automata.

Texts (lower-cased A-Z) are split at ``BREAKS`` into pieces and those at spaces
and tabs into words; a phrase is 2 to ``longest`` words of one piece.  Everything
is counted for each language.  Documents are read five times, each time whole:

1-3. A sketch of hashed cells counts words, then the pairs of words that passed,
   then longer phrases all of whose pairs passed.  Tasks hand on their cells with
   counts, by blocks of ``BLOCK`` cells, and the blocks are summed in streams; of
   a sketch only a bitmap of the cells with ``least`` or more stays, whose size
   is bounded by ``MOST_BITS``.  A cell's sum is never below a phrase's count.
4. Phrases whose bounds, and those of all phrases in them, pass are candidates.
   A share of the documents is read first; what it has is not named again by the
   tasks that read the others, so few candidates are named more than once.
5. Candidates, and the words they begin and end with, become Aho-Corasick
   automata of patterns with a delimiter on both sides, of ``PART_BYTES`` each;
   tasks scan their share of the texts for overlapping matches.  More candidates
   make more automata and scans, each over the languages it has.  Counts are
   handed on in blocks as well, ``COUNTS`` phrases each.

The counts are summed, and thresholds, scores and ranks are DataFrame operations
on them.  Products are decimals of 38 digits, so scores are exact.

Nulls and odd input: a null text has no words; a null language is ``und``.  Each
row counts, repeated or not.  A very long text is read in slices that begin with
the last words of the slice before.  Empty tables give no rows; other columns
are ignored.  A full sketch (far more phrases than cells) lets more candidates
pass and changes no result.
"""

from __future__ import annotations

import operator
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetgrid.llm.common import materialize, release

#: Fixed value: what ends a piece.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes.maketrans(BREAKS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(BREAKS) + b" abcdefghijklmnopqrstuvwxyz")

LONGEST, LEAST, TOP = 5, 100, 2000
#: Cells of a sketch, as a power of two: at least, at most (a bitmap of 64 MB).
FEWEST_BITS, MOST_BITS = 16, 29
BLOCK = 1 << 16
#: Cells that a task gathers before it hands them on; bytes of text worked on at once; words kept with their hashes.
GATHERED, SLICE, KNOWN = 1 << 22, 2 << 20, 1 << 19
#: Bytes of the patterns of one automaton, and phrases a task keeps apart before it hands them on.
PART_BYTES, APART = 2 << 20, 1 << 18
#: Phrases of a block of counts; one in so many documents is read first for candidates; hashes of candidates sent along.
COUNTS, FIRST_SHARE, MOST_FOUND = 4096, 16, 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Slice:
    """Words of one language: ``words`` has empty ones and b"\\n" between pieces; the first ``carried`` words were counted before."""

    def __init__(self, lang: str, text: bytes, carried: int = 0) -> None:
        self.lang, self.carried = lang, carried
        self.words = text.replace(b"\n", b" \n ").split(b" ")


def slices(rows: Iterable[tuple[str, bytes]], size: int = SLICE, carry: int = LONGEST - 1) -> Iterator[Slice]:
    """Short texts of a language together, long ones in parts that share ``carry`` words."""
    waiting: dict[str, list[bytes]] = defaultdict(list)
    have = 0
    for lang, text in rows:
        text = text.translate(FOLD)
        if len(text) > size:
            yield from _parts(lang, text, size, carry)
            continue
        waiting[lang].append(text)
        have += len(text) + 1
        if have > size:
            for name, texts in waiting.items():
                yield Slice(name, b"\n".join(texts))
            waiting.clear()
            have = 0
    for name, texts in waiting.items():
        yield Slice(name, b"\n".join(texts))


def _parts(lang: str, text: bytes, size: int, carry: int) -> Iterator[Slice]:
    start, kept = 0, []
    while start < len(text):
        ends = [e for e in (text.find(b" ", start + size), text.find(b"\n", start + size)) if e >= 0]
        end = min(ends, default=len(text))
        part = b" ".join([*kept, text[start:end]])
        yield Slice(lang, part, len(kept))
        kept = part[part.rfind(b"\n") + 1 :].split()[-carry:] if carry else []
        start = end


class WordHashes(dict):
    """Word -> 64 bits; 0 for no word, 1 for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) | 2 if word not in (b"", b"\n") else len(word)
        self[word] = h
        return h


class Phrases:
    """Hashes of the phrases of a slice, by length: ``at[k][i]`` is that of the k words from the i-th on."""

    def __init__(self, part: Slice, known: WordHashes, longest: int = LONGEST) -> None:
        if len(known) > KNOWN:
            known.clear()
        all_words = np.fromiter(map(known.__getitem__, part.words), np.uint64, len(part.words))
        self.places = np.flatnonzero(all_words)  # in part.words
        h = all_words[self.places]
        word = h != 1
        lang = np.uint64(xxhash.xxh3_64_intdigest(part.lang.encode()))
        self.at, self.there, self.new = {}, {}, {}
        now, there = h ^ lang, word
        for k in range(1, longest + 1):
            if k > 1:
                now = (now[:-1] ^ (now[:-1] >> np.uint64(31))) * _ODD + h[k - 1 :]
                there = there[:-1] & word[k - 1 :]
            if not len(now):
                break
            self.at[k], self.there[k] = now, there
            # Of what was carried over, only phrases that end behind it are new.
            self.new[k] = there & (np.arange(len(now)) + k > part.carried) if part.carried else there

    def cells(self, k: int, bits: int) -> np.ndarray:
        h = self.at[k]
        h = (h ^ (h >> np.uint64(29))) * _ODD
        return ((h ^ (h >> np.uint64(32))) * _ODD >> np.uint64(64 - bits)).astype(np.uint32)

    def passing(self, sketches: list[Sketch]) -> dict[int, np.ndarray]:
        """By length: whether the phrase and all in it pass the sketches of their lengths."""
        out: dict[int, np.ndarray] = {}
        for k in self.at:
            sketch = next((s for s in sketches if k in s.lengths), None)
            if sketch is None:
                break
            good = self.there[k] & (out[k - 1][:-1] & out[k - 1][1:] if k > 1 else True)
            at = np.flatnonzero(good)
            good = np.zeros(len(good), dtype=bool)
            good[at] = sketch.has(self.cells(k, sketch.bits)[at])
            out[k] = good
        return out


class Sketch:
    """The cells with enough phrases of the given lengths, as a bitmap."""

    def __init__(self, lengths: range, bits: int, bitmap: np.ndarray) -> None:
        self.lengths, self.bits, self.bitmap = lengths, bits, bitmap

    def has(self, cells: np.ndarray) -> np.ndarray:
        return (self.bitmap[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8) & 1).astype(bool)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                yield lang, text.as_py()


def _gathered(cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (block, cells, counts) of a task's cells so far."""
    if cells:
        distinct, counts = np.unique(np.concatenate(cells), return_counts=True)
        blocks = distinct // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(distinct)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        low, counts = (distinct % BLOCK).astype("<u2"), counts.astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks[cuts[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["block", "cells", "counts"],
        )


def _summed(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, bits) from rows (block, cells, counts) in order of blocks."""
    now, sums = None, np.zeros(BLOCK, dtype=np.int64)

    def full() -> pa.RecordBatch:
        bits = np.packbits(sums >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if block != now:
                if now is not None:
                    yield full()
                now = block
                sums[:] = 0
            # The cells of a row are distinct.
            sums[np.frombuffer(cells.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<u4")
    if now is not None:
        yield full()


def sketch(docs: DataFrame, lengths: range, below: list[Sketch], bits: int, least: int) -> Sketch:
    """The sketch of phrases of the given lengths all of whose parts pass the sketches ``below``."""
    shared = docs.sparkSession.sparkContext.broadcast(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells, have = WordHashes(), [], 0
        for part in slices(_rows(batches)):
            phrases = Phrases(part, known, lengths[-1])
            passed = phrases.passing(shared.value)
            inner = max(passed, default=0)  # the longest phrases that were sketched before
            for k in lengths:
                if k not in phrases.at:
                    break
                good = phrases.new[k]
                for start in range(k - inner + 1) if inner else ():
                    good = good & passed[inner][start : start + len(good)]
                cells.append(phrases.cells(k, bits)[good])
                have += len(cells[-1])
            if have >= GATHERED:
                yield from _gathered(cells)
                cells, have = [], 0
        yield from _gathered(cells)

    found = docs.mapInArrow(run, "block int, cells binary, counts binary")
    blocks = found.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _summed(b, least), "block int, bits binary")
    bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in blocks.where(F.expr("bits != repeat(X'00', length(bits))")).toLocalIterator(prefetchPartitions=True):
        bitmap[row["block"] * (BLOCK // 8) :][: BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    shared.unpersist()
    return Sketch(lengths, bits, bitmap)


def candidates(docs: DataFrame, sketches: list[Sketch], longest: int = LONGEST, found: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, h): all phrases whose upper bounds pass, with their hashes, and (h null) single words that these begin or end with.

    ``found``: ascending hashes of phrases that need not be named again.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sketches, np.zeros(0, dtype=np.uint64) if found is None else found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, known_before = shared.value
        known, met = WordHashes(), set()

        def rows() -> pa.RecordBatch:
            langs, phrases, hashes = zip(*met, strict=True) if met else ((), (), ())
            signed = pa.array([None if h is None else h - (h >> 63 << 64) for h in hashes], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([p.decode() for p in phrases], pa.string()), signed], names=["lang", "phrase", "h"])

        seen: set[int] = set()  # hashes of phrases in ``met``
        for part in slices(_rows(batches)):
            phrases = Phrases(part, known, longest)
            for k, good in phrases.passing(sketches).items():
                if k == 1:
                    continue
                hashes, first = np.unique(phrases.at[k][good], return_index=True)
                new = ~np.isin(hashes, known_before, assume_unique=True)
                at = np.flatnonzero(good)[first[new]]
                for h, i in zip(hashes[new].tolist(), at.tolist(), strict=True):
                    if h not in seen:
                        seen.add(h)
                        words = [part.words[p] for p in phrases.places[i : i + k]]
                        met |= {(part.lang, b" ".join(words), h), (part.lang, words[0], None), (part.lang, words[-1], None)}
            if len(met) > APART:
                yield rows()
                met.clear()
                seen.clear()
        yield rows()

    return docs.mapInArrow(run, "lang string, phrase string, h long").distinct()


def all_candidates(docs: DataFrame, sketches: list[Sketch], longest: int = LONGEST) -> DataFrame:
    """(lang, phrase) of the candidates of all documents, each once."""
    share = F.pmod(F.xxhash64("text"), F.lit(FIRST_SHARE))
    first = materialize(candidates(docs.where(share == 0), sketches, longest), "phrases")
    hashes = first.where(F.col("h").isNotNull()).select("h").limit(MOST_FOUND).toArrow().column(0).to_numpy()
    rest = candidates(docs.where(share != 0), sketches, longest, np.sort(hashes.view(np.uint64)))
    return first.unionByName(rest).select("lang", "phrase").distinct()


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds the phrases in text whose words have single spaces around them; values are positions in the list."""
    made = ahocorasick.Automaton()
    for n, phrase in enumerate(phrases):
        made.add_word(f" {phrase} ", n)
    made.make_automaton()
    return made


def _counts(lang: str, block: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([block], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["lang", "block", "counts"])


def count(docs: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """(lang, phrase, f): counts of the phrases, by language, and with a null phrase those of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        automata: dict[str, ahocorasick.Automaton] = {}
        found: dict[str, np.ndarray] = {}
        words: Counter[str] = Counter()
        value, place = operator.itemgetter(1), operator.itemgetter(0)
        for part in slices(_rows(batches)):
            there = list(filter(None, part.words))
            words[part.lang] += len(there) - there.count(b"\n") - part.carried
            if part.lang not in lists:
                continue
            if part.lang not in automata:
                automata[part.lang] = automaton(lists[part.lang])
                found[part.lang] = np.zeros(len(lists[part.lang]), dtype=np.int64)
            text = f" {b' '.join(there).decode()} "
            matches = automata[part.lang].iter(text)
            if part.carried:
                old = len(b" ".join(there[: part.carried]).decode()) + 1  # the delimiter behind what was carried over
                matches = (m for m in matches if place(m) > old)
            numbers = np.fromiter(map(value, matches), np.int64)
            found[part.lang] += np.bincount(numbers, minlength=len(found[part.lang]))
        for lang, counts in found.items():
            for at in range(0, len(counts), COUNTS):
                yield _counts(lang, at // COUNTS, counts[at : at + COUNTS])
        for lang, n in words.items():
            yield _counts(lang, -1, np.array([n]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        now, sums = None, np.zeros(0, dtype=np.int64)

        def full() -> pa.RecordBatch:
            lang, block = now
            names = [None] if block < 0 else lists[lang][block * COUNTS :][: len(sums)]
            there = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array([names[k] for k in there], pa.string()), pa.array(sums[there])], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                more = np.frombuffer(counts.as_buffer(), "<i8")
                if (lang, block) != now:
                    if now is not None:
                        yield full()
                    now, sums = (lang, block), np.zeros(len(more), dtype=np.int64)
                sums += more
        if now is not None:
            yield full()

    blocks = docs.mapInArrow(run, "lang string, block int, counts binary")
    return blocks.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(total, "lang string, phrase string, f long")


def _automata(wanted: DataFrame, most: int) -> Iterator[dict[str, list[str]]]:
    """The phrases in parts of at most ``most`` bytes (one phrase at least), one part at a time on the driver."""
    part: dict[str, list[str]] = defaultdict(list)
    have = 0
    for row in wanted.orderBy("lang", "phrase").toLocalIterator():
        if have and have + len(row["phrase"]) + 2 > most:
            yield dict(part)
            part, have = defaultdict(list), 0
        part[row["lang"]].append(row["phrase"])
        have += len(row["phrase"]) + 2
    yield dict(part)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, phrase, f) of all phrases with f >= ``least``, of single words among their ends, and with a null phrase of all words.

    ``bits``: cells of a sketch as a power of two; by default about a cell for each 16 bytes of text, up to ``MOST_BITS``.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        bits = min(max((size // 16).bit_length(), FEWEST_BITS), MOST_BITS)
    sketches: list[Sketch] = []
    for lengths in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if len(lengths):
            sketches.append(sketch(texts, lengths, sketches, bits, least))
    wanted = materialize(all_candidates(texts, sketches, longest), "phrases")
    counted = []
    for n, part in enumerate(_automata(wanted, part_bytes)):
        some = texts if n == 0 else texts.where(F.col("lang").isin(list(part)))
        found = count(some, part).where(F.col("phrase").isNotNull() | F.lit(n == 0))
        counted.append(materialize(found, "counts"))
    release(wanted)
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out.where((F.col("f") >= least) | F.col("phrase").isNull())


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = 100, bits: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    ``a``, ``l``, ``r``: counts of the phrase and of the two parts of its weakest
    cut; ``score``: floor(1000 * a * n / (l * r)).  A phrase inside a longer one
    with at least ``percent`` hundredths of its count is dropped.
    """
    counts = phrase_counts(docs, longest, least, bits, part_bytes)
    whole = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    parts = counts.where("phrase is not null")
    words = parts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    size = F.size("w")
    run = lambda start, n: F.array_join(F.slice("w", start, n), " ")

    cuts = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("first"), run(F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(whole, "lang")
    score = F.expr("(cast(1000 as decimal(5,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Each part of two words or more, with the highest count of a phrase that it stands in.
    length = F.explode(F.sequence(F.lit(2), size - 1)).alias("size")
    inner = words.where(size > 2).select("lang", "a", "w", length).select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), size - F.col("size") + 1)).alias("at"))
    within = inner.groupBy("lang", run(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
