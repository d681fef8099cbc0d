"""Ranked lexical search, collocations and Lempel-Ziv fingerprints against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from facetgrid.llm import collocations, lexical_search, lz_fingerprint, queries
from facetgrid.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 11: ranked lexical search ---


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    held = [(i, Counter(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"window": 8}, {"window": 8, "block": 3}, {"block_bytes": 1}])
def test_search(spark, how):
    rng = random.Random(11)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "ÉTÉ", "42", "x", "数学", "w1", "w2", "w3"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", ", ", "\n", "_"]) for _ in range(rng.randrange(40)))
    docs = [(rng.choice([-5, -9, 0, 1, 10**12]) + k, text()) for k in range(90)]
    docs += [(500, None), (501, ""), (502, " -- "), (503, "beta"), (503, "beta"), (503, "beta gamma"), (None, "alpha beta"), (None, "alpha beta 42"), (504, "w1 " * 5000)]
    items = [(k, text()) for k in range(6)] + [(7, None), (8, ""), (9, "nowhere"), (10, "beta BETA x"), (None, "alpha")]
    got = lexical_search.search(spark.createDataFrame(docs, DOC + "").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=5, **how)
    assert found(got) == plain_search(docs, items, 5)


def test_search_cuts_long_texts():
    text = ("Alpha beta-" * 50 + "x" * 300 + " gamma").encode()
    assert [t for part in lexical_search.slices(text, 64) for t in part] == lexical_search.terms_of(text)
    assert len(list(lexical_search.slices(text, 64))) > 3


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "alpha")], DOC), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert found(lexical_search.search(docs, items)) == plain_search([(1, "alpha")], [(1, "alpha")], 20)
    assert lexical_search.search(docs.limit(0), items).collect() == [] and lexical_search.search(docs, items.limit(0)).collect() == []
    extra = docs.selectExpr("*", "'a' as query", "1 as score", "2 as rank", "3 as n", "4 as window", "5 as terms")
    assert found(lexical_search.search(extra, items)) == found(lexical_search.search(docs, items))


def test_window_scores_are_sums_over_postings():
    rng = np.random.default_rng(1)
    docs = [Counter(rng.integers(0, 9, rng.integers(1, 30)).tolist()) for _ in range(100)]
    n = np.array([c.total() for c in docs])
    terms, tfs = (np.array([x for c in docs for x in part(c)], dtype=np.int64) for part in (Counter.keys, Counter.values))
    postings = lexical_search.Postings(n, np.array([len(c) for c in docs]), terms, tfs, (1000, 20_000))
    sums = np.zeros(100, dtype=np.int64)
    query = [(2, 7), (5, 3), (77, 1)]
    places = postings.score(query, sums)
    assert places.tolist() == [k for k, c in enumerate(docs) if 2 in c or 5 in c]
    m = 75 + 25 * n * 1000 // 20_000
    assert sums.tolist() == [sum(w * (10**9 * c[t] // (1000 * c[t] + 12 * int(m[k]))) for t, w in query if t in c) for k, c in enumerate(docs)]


def test_search_over_the_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert found(queries.op11_lexical_search(spark, SF)) == plain_search(docs, items, 20)


# --- 12: collocations ---


def plain_collocations(docs, longest, least, top, percent=100):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    good = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = {}
    for (lang, w), a in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = (lang, w[i : i + k])
                longer[key] = max(longer.get(key, 0), a)
    out = []
    for lang in {lang for lang, _ in good}:
        scored = []
        for (of, w), a in good.items():
            if of == lang and not 100 * longer.get((of, w), 0) >= percent * a:
                s, _, l, r = min((1000 * a * n[lang] // (f[of, w[:k]] * f[of, w[k:]]), k, f[of, w[:k]], f[of, w[k:]]) for k in range(1, len(w)))
                scored.append((-s, -a, " ".join(w).encode(), l, r))
        out += [(lang, rank, phrase.decode(), -a, l, r, n[lang], -s) for rank, (s, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("how", [{}, {"bits": 16}, {"part_bytes": 40}, {"percent": 60}, {"longest": 2}])
def test_collocations(spark, how, monkeypatch):
    rng = random.Random(12)
    words = ["Alpha", "beta", "été", "ÉTÉ", "x", "a-b", "\x85", "new", "york", "数学", "\x00", "q'"]
    piece = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  "]) for _ in range(rng.randrange(12)))
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(piece() + rng.choice(".,;:!?\n\r\x0b\x0c") for _ in range(rng.randrange(12)))) for _ in range(150)]
    docs += [("en", "new york city hall square."), ("fr", None), ("fr", ""), ("fr", "seul"), ("it", " . ,")] + [("en", "new york city hall square. x x x x x x x x x")] * 9 + [(None, "alpha beta " * 300)]
    least, top = 8, 30
    got = collocations.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(3), least=least, top=top, **how)
    assert phrases(got) == plain_collocations(docs, how.get("longest", 5), least, top, how.get("percent", 100))


def test_sketch_that_is_full_changes_nothing(spark, monkeypatch):
    rng = random.Random(13)
    docs = [("en", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))) for _ in range(60)]
    full = lambda self, cells: np.ones(len(cells), dtype=bool)
    df = spark.createDataFrame(docs, "lang string, text string")
    before = phrases(collocations.collocations(df, least=8))
    monkeypatch.setattr(collocations.Sketch, "has", full)
    assert phrases(collocations.collocations(df, least=8)) == before == plain_collocations(docs, 5, 8, 2000)


def test_long_texts_are_cut_without_loss():
    rng = random.Random(14)
    text = "".join(rng.choice(["aa", "b", "cc", "dddd"]) + rng.choice([" ", "  ", ". ", "\n", "\t"]) for _ in range(400)).encode()
    known = collocations.WordHashes()
    count = lambda parts: Counter((k, h) for p in parts for ph in [collocations.Phrases(p, known)] for k in ph.at for h in ph.at[k][ph.new[k]].tolist())
    whole, cut = list(collocations.slices([("en", text)])), list(collocations.slices([("en", text)], size=50))
    assert len(whole) == 1 and len(cut) > 10 and count(whole) == count(cut)


def test_long_texts_are_scanned_without_loss(spark, monkeypatch):
    text = "Alpha beta gamma. alpha beta\nbeta  gamma alpha beta gamma " * 40
    monkeypatch.setattr(collocations.slices, "__defaults__", (60, 4))
    parts = list(collocations.slices([("en", text.encode())]))
    assert len(parts) > 10
    lists = {"en": ["alpha beta", "beta", "alpha beta gamma", "gamma alpha beta gamma alpha", "nowhere"]}
    got = Counter()
    docs = spark.createDataFrame([("en", text.encode())], "lang string, text binary")
    for r in collocations.count(docs, lists).collect():
        got[r["phrase"]] += r["f"]
    words = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.\n]", text.lower())]
    want = Counter({None: sum(map(len, words))})
    for phrase in lists["en"]:
        w = phrase.split()
        want[phrase] = sum(p[i : i + len(w)] == w for p in words for i in range(len(p)))
    assert got == +want


def test_collocations_of_empty_tables(spark):
    docs = spark.createDataFrame([("en", "a b " * 100, 1, "x")], "lang string, text string, phrase int, f string")
    assert phrases(collocations.collocations(docs, least=90)) == plain_collocations([("en", "a b " * 100)], 5, 90, 2000)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_exact_products(spark, monkeypatch):
    a, l, r, n = 10**12 + 7, 10**12 + 9, 3 * 10**12 + 1, 10**15 + 3  # 1000 * a * n passes 64 bits
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", l), ("en", "y", r), ("en", None, n)], "lang string, phrase string, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    assert phrases(collocations.collocations(counts)) == [("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))]


def test_collocations_over_the_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("lang", "text").collect()]
    assert phrases(queries.op12_collocations(spark, SF)) == plain_collocations(docs, 5, 100, 2000)


# --- 13: fingerprints ---


def plain_parse(text, dictionary=10**9):
    """The distinct phrases, as tuples of symbols."""
    symbols = [s for w in text.split(" ") for s in (w if len(w) > lz_fingerprint.LONGEST_SYMBOL else [w])]
    out, known, now = set(), set(), ()
    for s in symbols if text else ():
        now += (s,)
        if now not in known:
            out.add(now)
            if len(known) == dictionary:
                known = {now[-1:]}
            else:
                known.add(now)
            now = ()
    return out | ({now} if now else set())


def some_text(rng, n, words="abc defg hi j klm é".split(" ")):
    return " ".join(rng.choice([*words, "x" * 40 + rng.choice("yz")]) for _ in range(n))


def test_phrases_of_a_text():
    rng = random.Random(15)
    parser = lz_fingerprint.Parser(size=10**6)
    for n in (0, 1, 2, 5, 50, 500):
        text = some_text(rng, n)
        assert len(parser.fingerprint(text)) == len(plain_parse(text))
    other = lz_fingerprint.Parser(size=10**6)
    other.fingerprint("other words first " + text)
    assert np.array_equal(other.fingerprint(text), parser.fingerprint(text))  # whatever was read before


def test_likeness_is_that_of_the_phrase_sets():
    rng = random.Random(16)
    parser = lz_fingerprint.Parser()
    worst = 0
    for n in (5, 20, 40, 2000):
        for _ in range(20):
            a = some_text(rng, n, [f"w{k}" for k in range(60)])
            b = a[: len(a) * 3 // 4] + some_text(rng, n // 2, [f"w{k}" for k in range(60)])
            x, y = plain_parse(a), plain_parse(b)
            true, got = len(x & y) / len(x | y), lz_fingerprint.likeness(parser.fingerprint(a), parser.fingerprint(b))
            if len(x | y) <= lz_fingerprint.SIZE:
                assert got == true
            worst = max(worst, abs(true - got))
    assert worst < 0.15
    empty = parser.fingerprint("")
    assert lz_fingerprint.likeness(empty, empty) == 1 and lz_fingerprint.likeness(empty, parser.fingerprint("a")) == 0


def test_full_dictionary_and_slices():
    rng = random.Random(17)
    text = some_text(rng, 3000, [f"w{k}" for k in range(400)])
    small = lz_fingerprint.Parser(size=10**6, dictionary=50)
    assert len(small.fingerprint(text)) == len(plain_parse(text, 50)) < len(plain_parse(text))
    parts = list(lz_fingerprint.slices(text, 100))
    assert " ".join(parts) == text and max(map(len, parts)) <= 200
    assert "".join(lz_fingerprint.slices("y" * 1000, 100)) == "y" * 1000


def test_packed_fingerprints():
    values = np.sort(np.array([0, 5, 2**48 - 1, 2**40 + 3], dtype=np.uint64))
    assert np.array_equal(lz_fingerprint.unpacked(lz_fingerprint.packed(values)), values) and lz_fingerprint.packed(values[:0]) == ""


@pytest.mark.parametrize("parts", [1, 3, 50, None])
def test_neighbours(spark, parts):
    rng = random.Random(18)
    docs = [(i, some_text(rng, rng.randrange(40))) for i in rng.sample(range(-1000, 10**6), 60)]
    docs += [(77, "twice"), (77, "twice"), (77, "also 77"), (10**15, None), (-5000, ""), (5, "é" * 9), (None, "no place"), (None, None)]
    got = sorted(map(tuple, lz_fingerprint.edited_neighbours(spark.createDataFrame(docs, DOC).repartition(3), parts).collect()), key=str)
    parser = lz_fingerprint.Parser()
    mark = lambda t: parser.fingerprint(t)
    placed = sorted(((i, t or "") for i, t in docs if i is not None), key=lambda d: (-d[0], d[1].encode()))
    want = [(None, len(t or ""), None, lz_fingerprint.packed(mark(t or "")), None, None, None) for i, t in docs if i is None]
    for (i, own), (_, after) in zip(placed, placed[1:] + placed[:1], strict=True):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        want.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.packed(mark(own)), lz_fingerprint.packed(mark(edited)), lz_fingerprint.likeness(mark(own), mark(edited)), lz_fingerprint.likeness(mark(own), mark(after))))
    assert got == sorted(want, key=str)


def test_neighbours_of_few(spark):
    one = lz_fingerprint.edited_neighbours(spark.createDataFrame([(3, "abcdef")], DOC)).collect()
    assert [(r["doc_id"], r["near_next"], r["edited_sha256"]) for r in one] == [(3, 1.0, hashlib.sha256(b"abcabc").hexdigest())]
    assert lz_fingerprint.edited_neighbours(spark.createDataFrame([], DOC)).collect() == []
    assert [tuple(r)[:3] for r in lz_fingerprint.edited_neighbours(spark.createDataFrame([(None, "a")], DOC)).collect()] == [(None, 1, None)]


def test_fingerprint_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, None, "z"), (4, "d", None)], "doc_id long, text string, fingerprint string")
    made = lz_fingerprint.fingerprints(docs).cache()
    assert made.columns == ["doc_id", "fingerprint"]
    marks = {r["doc_id"]: r["fingerprint"] for r in made.collect()}
    assert marks[1] == marks[2] != marks[3] == ""
    pairs = made.selectExpr("doc_id", "fingerprint as f").crossJoin(made.where("doc_id = 1").selectExpr("fingerprint as g"))
    near = {r["doc_id"]: r["n"] for r in pairs.select("doc_id", lz_fingerprint.likeness_column(pairs.f, pairs.g).alias("n")).collect()}
    assert near == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_half_replaced_texts_stay_nearer_than_others(spark):
    got = lz_fingerprint.edited_neighbours(table(spark, "/root/testdata/sf0.01", "documents").where("n_chars > 300")).select("near_edited", "near_next").collect()
    assert np.mean([r[0] > r[1] for r in got]) > 0.97 and np.median([r[0] for r in got]) > 0.3 > 0.1 > np.median([r[1] for r in got])
