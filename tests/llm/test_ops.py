import hashlib
import json
import math
import random
import re
import struct
import sys
import time
import tracemalloc
import zlib
from html import unescape
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import brute
import corpus_pipeline
from facetgrid.llm import chat_format, components, decontaminate, html_extract, ngram_join, packing, quality, queries, sharding, suffix_dedup, token_count, url_filter
from facetgrid.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def docs_of(spark, sf=SF):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


# --- 1: decontamination ---

ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, ""), (4, None), (None, "zeta eta theta"), (5, "short item"), (6, "ÉTÉ 42")]
HITS = [
    (0, "x ONE, two-three four five six seven eight nine ten y short ITEM"), (1, None), (2, ""), (3, "one two three four five six seven eight nine"), (None, "zeta eta theta zeta"),
    (4, "two three four five six seven eight nine ten eleven twelve short item one"), (4, "short item"), (4, "short item"), (5, "ÉTÉ 42 été 42"), (6, "… ¡short item!"),
]


@pytest.mark.parametrize("limit", [1000, 0])
def test_windows(spark, limit):
    docs, items = spark.createDataFrame(HITS, DOC), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_hits(docs, items, max_broadcast=limit)
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in found.collect()}
    # An item without an id marks words but is not listed; only A-Z are lower-cased.
    assert got == {(0, 14): (12, ["1", "2", "5"]), (1, 0): (0, []), (2, 0): (0, []), (3, 9): (0, []), (None, 4): (3, []), (4, 14): (13, ["1", "2", "5"]), (4, 2): (2, ["2", "5"]), (5, 4): (2, ["6"]), (6, 3): (0, [])}
    assert found.count() == len(HITS)


def test_windows_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.choice((3, 5, 10, 14)))) for k in range(30)]
    docs = [(k, say(rng.randrange(0, 120)) + " " + rng.choice(items)[1]) for k in range(120)]
    found = decontaminate.find_hits(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    got = rows(found, "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
    assert got == brute.contaminated(docs, items)
    for r in found.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame(HITS, DOC).withColumn("doc_key", F.lit("kept"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontaminate.decontaminate(docs, items).collect()) == ["1", "2", "3", "6"]
    left = decontaminate.decontaminate(docs, items, "spans")
    assert left.columns == docs.columns and left.count() == len(HITS)
    assert decontaminate.find_hits(left, items).where("n_hit > 0").count() == 0
    assert left.where("doc_id = 0").first()["text"] == "x y "
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0 and decontaminate.decontaminate(docs, items.limit(0)).count() == len(HITS)


# --- 2: suffix dedup ---


def planted(rng):
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(6)]
    b = base
    out = [(None, None), (0, ""), (1, "x" * 49), (2, "x" * 49), (3, "x" * 300), (4, "x" * 120 + "y"), (5, b[0]), (6, b[0]), (6, b[0]), (7, b[0][:30] + b[1]), (None, b[1]), (8, b[2][100:160] + b[3] + b[2][90:200]), (9, b[2]), (10, b[3][17:66]), (11, b[3][17:67]), (12, b[3][17:68] + "zz" + b[3][200:249]), (13, "ab" * 100), (14, "ba" * 100), (-5, b[4]), (15, b[4][50:] + b[5]), (16, b[5] + b[4][:51])]
    for k in range(17, 60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, 300)
            parts += [rng.choice(base)[a : a + rng.randint(20, 200)], "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))]
        out.append((k, "".join(parts)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 700, "bucket_bytes": 1000}, {"chunk_bytes": 2000, "broadcast_mb": -1}, {"chunk_bytes": 700, "bucket_bytes": 1000, "hot_keys": 3}, {"hot_keys": 0}])
def test_repeats_against_brute_force(spark, sizes):
    docs = planted(random.Random(3))
    left = suffix_dedup.remove_repeats(spark.createDataFrame(docs, DOC).repartition(3), as_text=False, **sizes)
    assert rows(left, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) == brute.repeats(docs)


def test_hot_phrases_are_dealt(spark, monkeypatch):
    """A phrase of 46 bytes in every document, with other words around: no task holds them all."""
    rng = random.Random(6)
    phrase = "All rights are reserved by the publishers here."[:46]
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    docs = [(k, " ".join([*(word() for _ in range(8)), phrase, *(word() for _ in range(8))])) for k in range(4000)]
    docs += [(5000 + k, docs[k][1][: 40 + k]) for k in range(80)]
    runs, names = [], []
    cold, warm = suffix_dedup.without_hot, suffix_dedup.hot_covers
    monkeypatch.setattr(suffix_dedup, "without_hot", lambda *a: runs.append(cold(*a)) or runs[0])
    monkeypatch.setattr(suffix_dedup, "hot_covers", lambda *a: names.append(warm(*a)) or names[0])
    monkeypatch.setattr(suffix_dedup, "release", lambda *a: None)
    monkeypatch.setattr(suffix_dedup, "NAMES_AT_ONCE", 4096)
    left = suffix_dedup.remove_repeats(spark.createDataFrame(docs, DOC).repartition(4), as_text=False, chunk_bytes=20_000, bucket_bytes=20_000)
    assert rows(left, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) == brute.repeats(docs)
    assert max(r[0] for r in runs[0].groupBy("bucket").agg(F.sum(F.octet_length("lcp"))).select("sum(octet_length(lcp))").collect()) <= suffix_dedup.HOT_KEYS
    tops = np.concatenate([np.frombuffer(r["a"], "<u8") for r in names[0][1].select("a").collect()]) >> np.uint64(64 - 5)
    tasks = np.bincount(tops.astype(np.int64), minlength=32)
    assert len(tops) > 100_000 and tasks.max() < 1.5 * np.median(tasks)


def test_repeats_over_the_documents(spark):
    assert rows(queries.op2_suffix_dedup(spark, SF)) == brute.repeats(docs_of(spark))


def test_repeats_keep_columns_and_characters(spark):
    same = "é" * 60
    docs = spark.createDataFrame([(1, "a" + same, "x", [1]), (2, "zz" + same + "é", "y", None)], "doc_id int, text string, kept string, more array<int>")
    left = suffix_dedup.remove_repeats(docs)
    assert set(left.columns) == {"doc_id", "more", "n_bytes", "n_removed", "n_spans", "text"}
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert got == {1: "a" + same, 2: "zz"} or got[2].startswith("zz")
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_low_entropy_texts_take_little_memory():
    for text in (b"ab" * 4_000_000, b"a" * 4_000_000):
        row = {"ids": np.array([7]).tobytes(), "copies": bytes(1), "lengths": np.array([len(text)]).tobytes(), "data": text}
        chunk = suffix_dedup.Chunk(row)
        tracemalloc.start()
        key, own, heads = suffix_dedup.exchanged(chunk, 4)
        at = np.concatenate([a for a, *_ in chunk.occurrences(4)])
        run, which = suffix_dedup.distinct_keys(chunk.data, chunk.ends, np.zeros(len(at), np.int64), at)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(key) <= 4 and not own.any() and len(run) <= 150 and which.max() == len(run) - 1
        assert peak < 40 * len(text) + (64 << 20)


def test_slices_have_the_same_anchors(monkeypatch):
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choice("abc") * rng.randint(1, 40) for _ in range(400)).encode(), np.uint8)
    ends = np.array([40, 1000, 1049, len(data)])
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data, ends), strict=True)]
    monkeypatch.setattr(suffix_dedup, "SLICE", 97)
    cut = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data, ends), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_loser_tree():
    rng = random.Random(4)
    width = suffix_dedup.KEY
    for _ in range(30):
        runs = []
        for _ in range(rng.randint(1, 9)):
            keys = sorted({bytes(rng.choice(b"ab") for _ in range(4)) + bytes(rng.choice(b"ab") for _ in range(width - 5)) + b"z" for _ in range(rng.randint(0, 12))} | ({b"a" * (width - 1) + b"z"} if rng.random() < 0.5 else set()))
            matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
            lcp, rest = suffix_dedup.front_code(matrix)
            assert suffix_dedup.decode(lcp.tobytes(), suffix_dedup.pack_bytes(rest)) == keys
            runs.append((keys, lcp.tobytes()))
        order, prefix = suffix_dedup.merge_runs(runs)
        at, merged = [0] * len(runs), []
        for r in order:
            merged.append(runs[r][0][at[r]])
            at[r] += 1
        assert merged == sorted(k for keys, _ in runs for k in keys)
        common = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
        assert prefix == [0, *[common(a, b) for a, b in zip(merged, merged[1:], strict=False)]][: len(merged)]


# --- 3: quality ---


def test_measures_against_brute_force(spark):
    got = {r["doc_id"]: r for r in quality.measure(table(spark, SF, "documents").select("doc_id", "text")).withColumn("failed", quality.base_failed()).collect()}
    odd = ["", " \n\t", "a\n\na\n \na", "x " * 30, "a b c d e a b c d e f", "é É|#\x0b\x0c\x1c", "a b c d e"]
    for doc, text in docs_of(spark):
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["failed"]) == brute.measures(text)
    for text in odd:
        assert quality.counts(text.encode())[:5] == brute.measures(text)[:5]


def test_certified_cutoffs():
    rule = quality.RULES[0]
    empty = [(0, 0)] * (len(rule.grid) + 1)
    cells = list(empty)
    cells[0], cells[3], cells[-1] = (3000, 10), (0, 50), (0, 40)
    chosen = quality.choose({("s", rule.name): cells}, 1)
    assert chosen == {("s", rule.name): rule.grid[len(rule.grid) - 3]}
    few = [(60, 0), *empty[1:-1], (0, 40)]
    assert quality.choose({("s", rule.name): few}, 1) == {}
    costly = [(3000, 0), *empty[1:-1], (40, 50)]
    assert quality.choose({("s", rule.name): costly}, 1) == {}
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.3), (20, 20, 0.5)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact)


def test_false_rejections_stay_within_the_bound(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text", "lang"), table(spark, sf, "labels")
    measured = quality.measure(docs, keep_text=False).cache()
    judged = quality.judge(measured, quality.calibrate(measured, labels)).join(labels, "doc_id").where("not base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("not kept").count() <= 0.03 * good.count()
    assert bad.where("not kept").count() > 100
    measured.unpersist()


def test_small_strata_are_certified(spark):
    symbols, capitals = quality.RULES[:2]
    far = lambda good, bad: [(good, 0), *[(0, 0)] * 7, (0, bad)]
    # 312 good rows, the fewest of a language on sf0.1, four languages and all rules.
    histogram = {("es", r.name): [(312, 0)] + [(0, 0)] * len(r.grid) for r in quality.RULES} | {("es", symbols.name): far(312, 20)}
    assert quality.choose(histogram, 4) == {("es", symbols.name): 2.0}
    assert quality.choose({k: [(140, c[1]), *c[1:]] if c[0][0] == 312 else c for k, c in histogram.items()} | {("es", symbols.name): far(140, 20)}, 4) == {}
    # A rule that rejects many good rows from the start leaves the others their own walk.
    spoilt = {("s", symbols.name): [(2700, 0), *[(0, 0)] * 7, (300, 9)], ("s", capitals.name): [(3000, 0), *[(0, 0)] * 6, (0, 9)]}
    assert quality.choose(spoilt, 1) == {("s", capitals.name): capitals.grid[0]}
    # The union counts a row that two rules reject once.
    junk = " ".join("#" * k for k in range(1, 13))
    docs = [(k, f"these are ten words or some more of text {k}", "en") for k in range(396)] + [(k, junk, "en") for k in range(396, 490)]
    measured = quality.measure(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    cutoffs = quality.calibrate(measured, spark.createDataFrame([(k, int(k < 400)) for k in range(490)], "doc_id long, quality int"))
    assert cutoffs == {("en", symbols.name): 2.0, ("en", "punctuation"): 0.5}
    sf = "/root/testdata/sf0.1"
    found = quality.calibrate(quality.measure(table(spark, sf, "documents").select("doc_id", "text", "lang"), keep_text=False), table(spark, sf, "labels"))
    assert {lang for lang, name in found if name == symbols.name} == {"en", "de", "fr", "es"}


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, "x"), (1, "", "en", "y"), (1, "a b", "en", "z")], "doc_id long, text string, lang string, n_words string")
    labels = spark.createDataFrame([(1, None), (1, 1), (None, 0)], "doc_id long, quality int")
    measured = quality.measure(docs)
    judged = quality.judge(measured, quality.calibrate(measured, labels))
    assert judged.count() == 3 and judged.where("kept").count() == 0
    empty = quality.measure(docs.limit(0))
    assert quality.judge(empty, quality.calibrate(empty, labels)).count() == 0


# --- 4: sharding ---


def test_lookup_table():
    names = [f"s{k}" for k in range(10)]
    owner = sharding.lookup_table(names, 1009)
    counts = [owner.count(k) for k in range(10)]
    assert max(counts) - min(counts) <= 1
    # Brute force: the turns written out over full preference lists.
    prefer = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        at, skip = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        prefer.append([(at + k * skip) % 1009 for k in range(1009)])
    taken = {}
    while len(taken) < 1009:
        for k in range(10):
            if len(taken) < 1009:
                taken[next(s for s in prefer[k] if s not in taken)] = k
    assert owner == [taken[s] for s in range(1009)]
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(1 for a, b in zip(owner, fewer, strict=True) if a != b and a != 9)
    assert moved < 0.15 * 1009
    heavy = sharding.lookup_table(names, 1009, [2] + [1] * 9)
    assert heavy.count(0) == pytest.approx(2 * heavy.count(1), abs=3)
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placing(spark, tmp_path):
    got = queries.op4_sharding(spark, SF)
    owner = sharding.lookup_table(queries.SHARDS)
    assert got.count() == table(spark, SF, "documents").count()
    assert all(queries.SHARDS[owner[r["slot"]]] == r["shard"] for r in got.collect())
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, shard string")
    placed = sharding.place(odd, ["x", "y"], slots=7)
    assert placed.count() == 3 and placed.where("doc_id = 1").select("shard").distinct().count() == 1 and sharding.place(odd.limit(0), ["x"], slots=7).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), ["x", "y"], files_each=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


# --- 5: HTML ---


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


def learnt(*pages):
    whole = None
    for p in pages:
        own = html_extract.lift(html_extract.parse(p))
        whole = own if whole is None else html_extract.merge(whole, own)
    return whole


def test_pages_of_the_corpus(spark):
    html = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r for r in queries.op5_html_extract(spark, SF).collect()}
    assert got.keys() == html.keys()
    for k, source in html.items():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
        bare = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body))
        assert got[k]["text"] == " ".join(unescape(bare).split()) and got[k]["n_chars"] == len(got[k]["text"])


def test_main_text():
    article = '<nav><a>menu</a></nav><div class="cookie-notice">ok?</div><article><header><p>by x</p><h1>T</h1></header><p>a <b>b</b>c&amp;<br>d<p>e<div class="ad">buy</div><form><p>mail</p></form><script>var t="</p>";</script><section class="comments"><p>first!</p></section><p>same</p></article><aside>x</aside><footer>f</footer>'
    assert html_extract.main_text(page(article), None) == "T a bc& d e same"
    assert html_extract.main_text("", None) == "" and html_extract.main_text("plain < text", None) == "plain < text"
    assert html_extract.main_text(page("<article></article><p>x</p>"), None) == ""
    assert html_extract.main_text("<article><p>cut of", None) == "cut of" and html_extract.main_text('<article><p>a</p><p class="x', None) == "a"


def test_formulas_and_drawings_keep_their_text():
    html = "<html><body><article><p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> done <svg><title>icon</title><text>drawn</text></svg></p><xmp>as it stands</xmp></article></body></html>"
    assert html_extract.main_text(html, None) == "E = mc2 done drawn as it stands"


def test_wrappers_drop_what_all_pages_share():
    make = lambda text: page(f"<div class=top><p>Welcome to our site</p></div><div class=body><p>{text}</p><p>more of {text}</p></div>")
    pages = [make(t) for t in ("one", "two", "three")]
    wrapper = learnt(*pages)
    assert [html_extract.main_text(p, wrapper) for p in pages] == [f"{t} more of {t}" for t in ("one", "two", "three")]
    lists = [page("<ul>" + "".join(f"<li>{k}{n}</li>" for k in range(n)) + "</ul>" + ("<p>x</p>" if n == 2 else "")) for n in (1, 2, 5)]
    body = learnt(*lists)[5][0][5][1]
    items, extra = body[5][0], body[5][1]
    assert (items[0], items[5][0][0], items[5][0][2]) == ("ul", "li", True) and extra[:2] == ["p", True]


def test_wrapper_chooses_the_main_region():
    read = lambda pages: [html_extract.main_text(p, learnt(*pages)) for p in pages]
    words = ("one", "two", "three", "four")
    # A text that all pages have is left out of the article, too; one that some have stays.
    notes = [page(f"<article><h1>{w}</h1><p>{w} text</p><div>Read our terms</div>{'<div><p>some</p></div>' if len(w) > 3 else ''}</article>") for w in words]
    assert read(notes) == ["one one text", "two two text", "three three text some", "four four text some"]
    assert read(notes[:2]) == ["one one text Read our terms", "two two text Read our terms"]
    # An article that never differs is no main region where other texts do.
    cards = [page(f"<article><p>Our book</p></article><div><p>{w}</p></div>") for w in words]
    assert read(cards) == list(words)
    # Copies of one page have nothing that differs; repetitions on one page are one page.
    assert read([notes[0]] * 4) == ["one one text Read our terms"] * 4
    assert read([page("<ul><li>x</li><li>x</li><li>x</li></ul>")]) == ["x x x"]


def test_names_drop_no_part_of_the_text():
    for name in ("has-sidebar", "single no-sidebar", "comments-open", "fixed-header", "menu"):
        for tag in ("article", "main"):
            whole = f'<html class="{name}"><body class="{name}"><div class="{name}-page"><{tag} class="{name}"><p>text</p></{tag}></div></body></html>'
            assert html_extract.main_text(whole, None) == "text"
        assert html_extract.main_text(f'<body class="{name}"><p>text</p></body>', None) == "text"
    named = '<article><section id="discussion"><h2 id="social-effects">a</h2><p>b</p></section><p class="related-work">c</p><div class="post-header">d</div><div class="notice">e {}</div><h2 class="related">f</h2><div data-id="ads">g</div></article>'
    assert html_extract.main_text(page(named), None) == "a b c d e {} f g"
    assert html_extract.main_text(page('<article><p>a</p><div class="cookie-notice">x</div><div class="ads">x</div><section class="comments"><p>x</p></section></article>'), None) == "a"
    # What only some pages of a host have and share goes by an unsure name, and only by it.
    some = [page(f'<article><h1>t{k}</h1>' + ('<div class="notice">Members only</div><div class="fact">Same fact</div>' if k < 3 else "") + "</article>") for k in range(5)]
    wrapper = learnt(*some)
    assert [html_extract.main_text(p, wrapper) for p in some] == [f"t{k} Same fact" if k < 3 else f"t{k}" for k in range(5)]
    assert html_extract.main_text(page(named.format(1)), learnt(*[page(named.format(k)) for k in range(2)])) == "a b c d e 1 f g"
    assert html_extract.main_text(page('<div id="sidebar">x</div><p>a</p>'), None) == "a"


def test_shared_texts_are_known_at_every_size():
    notice = "All rights reserved. " * 20
    pages = [page(f"<div><p>{w}</p></div><div class=x>{notice}</div>") for w in ("one", "two", "three")]
    assert [html_extract.main_text(p, learnt(*pages)) for p in pages] == ["one", "two", "three"]
    kinds = ("p", "dl", "pre", "table")
    many = []
    for k in range(8):  # over 200 children, which differ in order and class
        rows = [f"<{kinds[(j * (k + 1)) % 4]} class=k{'abcdefgh'[(j + k) % 8]}>t{k}-{j}</{kinds[(j * (k + 1)) % 4]}>between{k}-{j}" for j in range(150)]
        many.append(page(f"<p class=top>Welcome</p>{''.join(rows)}<hr>Shared words<hr><p class=low>{notice}</p>"))
    whole = learnt(*many)
    halves = html_extract.merge(learnt(*many[:4]), learnt(*many[4:]))
    for wrapper in (whole, halves):
        for k, p in enumerate(many):
            assert html_extract.main_text(p, wrapper) == " ".join(x for j in range(150) for x in (f"t{k}-{j}", f"between{k}-{j}"))


def test_wrappers_decide():
    """Without names to go by, the wrapper alone tells the article from what all pages share."""
    make = lambda k: page(f"<div class=qa><div>Start</div><div>About us</div></div>{'<div class=qb>We use small files</div>' if k % 2 else ''}<div class=qc><p>story {k}</p><p>more {k}</p></div><div class=qd><p>Write to us</p></div>")
    pages = [make(k) for k in range(8)]
    wrapper = html_extract.load(html_extract.dump(learnt(*pages)))
    assert [html_extract.main_text(p, wrapper) for p in pages] == [f"story {k} more {k}" for k in range(8)]
    assert html_extract.main_text(pages[1], None) == "Start About us We use small files story 1 more 1 Write to us"


def test_text_mass_chooses_the_region():
    """Adverts and menus that differ on each page are told from the article by their mass, not by names."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    pages, want = [], []
    for _ in range(6):
        title, body = words(4), [words(30) for _ in range(rng.randint(1, 4))]
        menu = "".join(f"<li>{words(1)}</li>" for _ in range(5))
        pages.append(page(f"<div class=qa><ul>{menu}</ul></div><div class=qb>{words(8)}</div><h1>{title}</h1><div class=qc><div class=qd>{''.join(f'<p>{b}</p>' for b in body)}</div></div><div class=qe>{words(6)}</div>"))
        want.append(" ".join([title, *body]))
    assert [html_extract.main_text(p, learnt(*pages)) for p in pages] == want
    # Cards of other articles do not count as main text, a page of another layout of the host keeps its own.
    card = lambda: f"<article><p>{words(3)}</p></article>"
    cards = [page(f"<div class=qc><p>{w}</p><p>{w}</p></div><div class=qe>{card()}{card()}</div>") for w in (words(40), words(40), words(40))]
    other = [page(f"<article><h1>{w}</h1></article><div class=qe>{words(5)}</div>") for w in (words(50), words(50), words(50))]
    wrapper = learnt(*cards, *other)
    assert [html_extract.main_text(p, wrapper) for p in cards] == [re.sub("</?p>", " ", p.split("<div class=qc>")[1].split("</div>")[0]).replace("  ", " ").strip() for p in cards]
    assert [html_extract.main_text(p, wrapper) for p in other] == [p.split("<h1>")[1].split("</h1>")[0] for p in other]


def test_wrappers_find_the_articles_without_any_name(spark, monkeypatch):
    """On hosts with three pages the text is the same when no element, class or id is known by name."""
    hosts = {}
    for r in table(spark, SF, "pages").collect():
        hosts.setdefault((r["url"] or "").split("://")[-1].split("/")[0].lower(), []).append(r["html"] or "")
    hosts = [pages for pages in hosts.values() if len(pages) >= 3]
    read = lambda: [html_extract.main_text(p, w) for pages in hosts for w in [learnt(*pages)] for p in pages]
    usual = read()
    for name in ("MAIN_TAGS", "MAIN_WORDS", "BOILER_WORDS", "BOILER_TAGS"):
        monkeypatch.setattr(html_extract, name, frozenset())
    assert usual and sum(a == b for a, b in zip(usual, read(), strict=True)) >= 0.9 * len(usual)
    assert not any(html_extract.main_text(p, None) in usual for pages in hosts for p in pages)


def test_hot_hosts_are_split(spark):
    source = spark.createDataFrame([(k, f"http://{'hot' if k % 10 else f'h{k % 30}'}/p{k}", f"<div><p>t{k}</p><p>u</p></div><div>x{k % 7}</div>") for k in range(400)], "page_id long, url string, html string")
    assert rows(html_extract.extract(source, broadcast_mb=-1), "page_id", "text") == rows(html_extract.extract(source), "page_id", "text")


def test_deep_and_wide_pages():
    started = time.time()
    for source, want in (("<div>" * 100_000 + "x", "x"), ("<div>x</div>" * 100_000, " ".join("x" * 100_000)), ("</p>" * 100_000 + "x", "x")):
        wrapper = learnt(*[source.replace("x", f"x{k}") for k in range(3)])
        assert wrapper[3] == 3 and html_extract.main_text(source, html_extract.load(html_extract.dump(wrapper))) == want
    kinds = [f"<div class=k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>a{k}</div>" for k in range(17_000)]
    random.Random(1).shuffle(kinds)
    one, other = "".join(kinds), "".join(reversed(kinds))
    assert html_extract.main_text(one, learnt(one, other)) == " ".join(re.findall(r"a\d+", one))
    assert time.time() - started < 60


def test_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd#") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = html_extract.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert html_extract.align(list("pxpy"), list("xpy")) == [(1, 0), (2, 1), (3, 2)]


def test_extraction_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, "a"), (2, "no host", "<article><p>x", "b"), (2, "no host", "<article><p>x", "b"), (3, "http://h/", "<p>" + "y " * 200_000, "c")], "page_id long, url string, html string, text string")
    got = html_extract.extract(odd)
    assert set(got.columns) == {"page_id", "url", "text", "n_chars"}
    assert rows(got, "page_id", "n_chars") == [(1, 0), (2, 1), (2, 1), (3, 399_999)]
    assert html_extract.extract(odd.limit(0)).count() == 0


# --- 6: chat ---


def test_chat_round_trip(spark):
    said = [(1, 0, "system", "<|turn|>\\a\\0 </s>"), (1, 1, "user", "<<s>s> [INST]"), (1, 2, "assistant", "\\"), (2, 0, "user", None), (2, 1, "tool", ""), (None, 5, "user", "x"), (None, None, None, "y"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 1, "assistant", "late"), (4, 0, "user", "q<|end|>")]
    made = chat_format.format_conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1)))
    got = {r["conv_id"]: r for r in made.select("*", chat_format.parse(F.col("formatted")).alias("read"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    order = lambda c: sorted((t for t in said if t[0] == c), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
    for c, r in got.items():
        assert [tuple(t) for t in r["read"]] == [(t[2] or "", t[3] or "") for t in order(c)]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["loss"] == "".join(t[3] or "" for t in order(c) if t[2] == "assistant")
        inside = "".join(s["text"] for s in r["segments"][1::3])
        assert not any(x in inside for x in chat_format.Template().controls)
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, None: False, 3: False, 4: True}
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 7: Jaccard join ---


def near(rng):
    words = [f"w{k}" for k in range(300)]

    def edit(w, n):
        w = list(w)
        for _ in range(n):
            p, r = rng.randrange(len(w)), rng.random()
            if r < 0.4:
                w[p] = rng.choice(words)
            elif r < 0.7:
                w.insert(p, rng.choice(words))
            elif len(w) > 1:
                del w[p]
        return w

    out = [(None, None), (0, ""), (1, " \n"), (2, "a"), (3, "A"), (4, "a b"), (5, "a b c"), (6, "A B c"), (7, "a b c d"), (8, "a b c d"), (8, "a b c d"), (None, "a b c d"), (None, "zz yy xx ww vv")]
    k = 10
    for n in (5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 30, 40, 60, 100, 200, 400):
        for _ in range(5):
            first = [rng.choice(words) for _ in range(n)]
            for w in (first, *[edit(first, rng.randint(0, max(1, n // 25))) for _ in range(5)]):
                out.append((k, " ".join(w)))
                k += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("how", [{}, {"max_block": 4}, {"broadcast_rows": 0, "max_bytes": 2000}, {"k": 5, "percent": 80}])
def test_links_against_brute_force(spark, how):
    docs = near(random.Random(5))
    got = ngram_join.link(spark.createDataFrame(docs, DOC).repartition(3), **how)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute.linked(docs, how.get("k", 4), how.get("percent", 85))


def test_links_over_the_documents(spark):
    assert rows(queries.op7_ngram_join(spark, SF)) == brute.linked(docs_of(spark))


def test_one_of_each_component_stays(spark):
    docs = near(random.Random(6))
    left = ngram_join.keep_one(spark.createDataFrame(docs, DOC).withColumn("row_key", F.lit("x")))
    want = brute.linked(docs)
    kept = rows(left, "doc_id")
    single = {c for d, n, c in want if n and d == c and d is not None}
    assert sorted(d for (d,) in kept if d is not None and d not in (0, 1)) == sorted(single) and left.columns == ["doc_id", "text", "row_key"]
    assert ngram_join.keep_one(left.limit(0)).count() == 0 and ngram_join.link(left.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 9, 4096).astype(np.uint32)
    for n in (*range(1, 60), 90, 300, 1000, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            if rng.random() < 0.2:
                a = np.unique(a >> np.uint64(rng.integers(1, 9)))  # crowded on few counters
            most = (100 - percent) * 2 * n // (100 + percent)
            drop = rng.integers(0, most + 1)
            b = np.delete(a, rng.permutation(len(a))[: min(drop, len(a) - 1)])
            b = np.unique(np.concatenate((b, rng.integers(0, 1 << 63, most - drop).astype(np.uint64))))
            if ngram_join.overlap(a, b) * 100 >= percent * len(np.union1d(a, b)):
                assert np.intersect1d(ngram_join.prefix_keys(a, counts, percent)[0], ngram_join.prefix_keys(b, counts, percent)[0]).size


def test_shingles_are_those_of_the_words(monkeypatch):
    rng = random.Random(3)
    signs = ["a", "B", "é", "ſ", "K", "Z", "z", " ", "  ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "c d", "long" * 9]
    texts = [None, "", " ", "a", " A b ", *["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(400)]]
    for size, segment in ((1 << 20, 1 << 20), (40, 1 << 20), (1 << 20, 16), (300, 33)):
        monkeypatch.setattr(ngram_join, "SLICE_BYTES", size)
        monkeypatch.setattr(ngram_join, "SEGMENT", segment)
        for k in (1, 4, 5):
            found, names = [s for s in ngram_join.shingle_sets(pa.array(texts), k)], {}
            assert len(found) == len(texts)
            for s, t in zip(found, texts, strict=True):
                w = re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t))
                want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
                assert len(s) == len(want)
                names.setdefault(frozenset(want), set()).add(s.tobytes())
            assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)
    assert not list(ngram_join.shingles_of(pa.array([], pa.string())))


def test_shared_boilerplate_makes_no_runs(spark):
    longest = []
    for n in (500, 2000):
        rng = random.Random(n)
        say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
        boiler = " ".join(f"terms{k}" for k in range(14))
        docs = spark.createDataFrame([(k, f"{say(6)} {boiler} {say(rng.choice((6, 30)))}") for k in range(n)], DOC)
        counts = ngram_join.sketch(docs, 12, 4)
        assert counts.sum() == sum(len(r["text"].split()) - 3 for r in docs.collect()) and len(counts) == 4096
        runs = ngram_join.key_runs(ngram_join.scan(docs, counts, 4096, 4, 85), 4096, 1000)
        longest.append(max([0, *[r["count"] for r in runs.groupBy("run").count().collect()]]))
    assert max(longest) <= 3


def test_hot_keys_are_split(spark):
    big = spark.createDataFrame([(b"h", k) for k in range(2000)] + [(bytes([k % 200, 1]), k) for k in range(1000)] + [(None, 1)], "key binary, v long")
    small = big.where("key is not null").groupBy("key").agg(F.min("v").alias("low"))
    for how in ("inner", "left"):
        assert rows(components.split_join(big, small, "key", how)) == rows(big.join(small, "key", how))


def test_points_bound_the_overlap():
    rng = np.random.default_rng(12)
    for n in (5, 20, 96, 97, 400, 3000):
        for share in (0.5, 0.9, 0.99):
            base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            crowded = np.unique(base >> np.uint64(5))  # many elements in few ranges
            for a in (base, crowded):
                keep = a[rng.random(len(a)) < share]
                b = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, max(1, n // 8)).astype(np.uint64))))
                p, q = ngram_join.point_of(a), ngram_join.point_of(b)
                assert np.array_equal(ngram_join.unpack_point(ngram_join.pack_point(p)), p) and p.sum() == len(a)
                ranges = min(len(p), len(q)) - 1
                p, q = ngram_join.coarsened(p, ranges), ngram_join.coarsened(q, ranges)
                assert ngram_join.overlap(a, b) <= np.minimum(p, q).sum() and q.sum() == len(b)


def test_tree_loses_nothing():
    rng = np.random.default_rng(8)
    counts = rng.poisson(1.2, (700, 64))
    points = np.concatenate((np.minimum(counts, 3), (counts - np.minimum(counts, 3)).sum(axis=1, keepdims=True)), axis=1).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = ngram_join.RTree(points, leaf=8)
    for percent in (50, 70):
        for k in range(0, 700, 25):
            bound = np.minimum(points, points[k]).sum(axis=1)
            fits = (bound >= ngram_join.needed(sizes + sizes[k], percent)).nonzero()[0]
            assert sorted(tree.near(k, percent)) == fits.tolist()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(1, 60)]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {k: v for k, v in parent.items() if k in got} and set(parent) - set(got) <= alone


# --- 8: packing ---


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = docs_of(spark) + [(None, None), (-1, ""), (-2, "word " * 5000), (-2, "word " * 5000), (-3, "a<|endoftext|>b İΣς don't ¡x…")]
    whole = Tokenizer.from_file(path)
    pieces = packing.tokenize_pieces(spark.createDataFrame(docs, DOC).withColumn("piece", F.lit(9)), path)
    packed = packing.pack(pieces, group=100).collect()
    assert len(packed) == pieces.count()
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], {}).setdefault(r["piece"], r)
    for doc, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        parts = [by_doc[doc][k] for k in sorted(by_doc[doc])]
        assert b"".join(p["ids"] for p in parts) == struct.pack(f"<{len(ids)}I", *ids)
        assert [(p["start"], p["length"]) for p in parts] == [(k, min(2048, len(ids) - k)) for k in range(0, len(ids), 2048)]
    check_sequences(packed)
    assert packing.pack(packing.tokenize_pieces(spark.createDataFrame([], DOC), path)).count() == 0
    clash = packing.pack(spark.createDataFrame([(1, 0, 5, "x", 7), (1, 0, 5, "x", 7), (None, None, 9, None, None)], "doc_id long, piece int, length long, offset string, Sequence_id int"))
    assert clash.columns == ["doc_id", "piece", "length", "sequence_id", "offset"] and check_sequences(clash.collect()) == 1
    known = packing.chunk_ids(Path(path).read_bytes())
    assert max(map(len, known), default=0) <= packing.CACHED_CHUNK


def check_sequences(packed):
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def test_long_chunks_are_not_kept(spark):
    """What a worker keeps from task to task has no chunk above the limit, whichever document it came from."""
    docs = [(k, " ".join(f"{k}x{n}" + "ab" * 1000 for n in range(100)) + " tail") for k in range(100)] + [(100, "last one")]
    pieces = packing.tokenize_pieces(spark.createDataFrame(docs, DOC).coalesce(1), public_tokenizers.path("word_bpe_49k.json"))
    assert pieces.select("doc_id").distinct().count() == 101

    def longest(_):
        from facetgrid.llm import packing as there

        sizes = [max(map(len, known), default=0) for known in there._KNOWN.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n"])

    found = [r["n"] for r in spark.range(64, numPartitions=16).mapInArrow(longest, "n long").collect()]
    assert found and max(found) <= packing.CACHED_CHUNK


def test_packing_is_tight(spark):
    packed = queries.op8_packing(spark, "/root/testdata/sf0.1").collect()
    assert check_sequences(packed) <= 1.01 * sum(r["length"] for r in packed) / 2048
    assert all(0 <= r["ids_crc32"] < 1 << 32 for r in packed) and zlib.crc32(b"\0\0\0\0") == 558161692


def test_squares_rule():
    rng = random.Random(10)
    packer = packing.SquaresPacker(20)
    gaps: list[int] = []
    for _ in range(400):
        n = rng.randint(1, 20)
        before = {g: gaps.count(g) for g in range(1, 21)}
        cost = {}
        for g in [*{g for g in gaps if g >= n}, 20]:
            after = dict(before)
            if g in before and gaps.count(g) and g != 20:
                after[g] -= 1
            if g - n:
                after[g - n] += 1
            cost[g] = sum(v * v for v in after.values())
        _, offset = packer.place(n)
        assert cost[20 - offset] == min(cost.values())
        if offset:
            gaps.remove(20 - offset)
        if 20 - offset - n:
            gaps.append(20 - offset - n)


# --- 9: token counts ---


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(11)
    signs = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "a", "é", "1", "²", "<|endoftext|>", "'s", "'ll", "!", "…", "漢", "💥", "́", "_", "\x00", "The", "ing"]
    texts = [None, "", "ab" * 20_000, *["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(3000)]]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: r for r in token_count.count_tokens(docs, path).collect()}
    for k, text in enumerate(texts):
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((text or "").encode()), n > 1024)
    counted = {r["doc_id"]: r["n_tokens"] for r in queries.op9_token_count(spark, SF).collect()}
    assert counted == {d: len(whole.encode(t, add_special_tokens=False).ids) for d, t in docs_of(spark)}
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


def test_small_cache_counts_the_same():
    spec = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    tight, wide = token_count.Chunks(token_count.Words(spec, 1), entries=2), token_count.Chunks(token_count.Words(spec))
    for w in (b"one", b"two", b"three", b"one", b"lowest", b"two"):
        assert tight[w] == wide[w]


# --- 10: URLs ---


def test_urls_and_rules(spark):
    urls = [None, "", "nothing", "HTTPS://A.Example.ORG/en/1x?q#f", "x://example.org/es/", "x://notexample.org/es/", "x://m.example.org/fr/", "x://a.com/fr/2", "x://a.com/de/?x", "x://COM/de/", "x://a.com?/fr/", "x://org", "x://É.org:80/ä", "a://b://c/d", "x://h/a\nb"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(0))
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, url_filter.UrlModel((0.0,) * 8, -1.0, 4)).collect()}
    want = [("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/en/1x", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"), ("notexample.org", "/es/", "org/"), ("m.example.org", "/fr/", "org/"), ("a.com", "/fr/2", "com/fr/"), ("a.com", "/de/", "com/de/"), ("com", "/de/", "com/de/"), ("a.com", "", None), ("org", "", None), ("É.org:80", "/ä", None), ("b:", "//c/d", None), ("h", "/a\nb", None)]
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(urls))] == want
    verdicts = dict(url_filter.RULES)
    assert all(r["verdict"] == verdicts.get(r["rule"], "allow") for r in got.values())


def test_held_out_accuracy(spark):
    judged = queries.op10_url_filter(spark, "/root/testdata/sf0.1").where("rule is null")
    seeds = {u.split("://")[1].split("/")[0] for u, _ in url_filter.seed_urls()}
    judged = judged.where(~F.col("host").isin(*seeds))
    # In these tables the unwanted hosts have a hyphen; hosts of the seed table are left out.
    right = judged.where((F.instr("host", "-") > 0) == (F.col("verdict") == "block")).count()
    assert right >= 0.95 * judged.count()
    assert judged.where("verdict = 'block'").count() > 50


def test_fit_is_a_logistic_regression(spark):
    seeds = [("x://aaaa/bbbb", 1), ("x://aaaa/cccc", 1), ("x://dddd/eeee", 0), ("x://dddd/ffff", 0), (None, 1), ("x://gg/", None)]
    frame = spark.createDataFrame(seeds, "url string, label int")
    model = url_filter.fit(frame, buckets=512, steps=60)
    host, path = url_filter.split_url(F.col("url"))
    data = frame.where("url is not null and label is not null").select(url_filter.ngram_buckets(host, path, 4, 512).alias("b"), "label").collect()
    x = np.zeros((len(data), 512))
    for i, r in enumerate(data):
        x[i, r["b"]] = 1 / math.sqrt(len(r["b"]))
    y, w, c = np.array([r["label"] for r in data]), np.zeros(512), 0.0
    for _ in range(60):
        error = y - 1 / (1 + np.exp(-(x @ w + c)))
        w, c = w * (1 - 0.5 * 0.003) + 0.5 * x.T @ error, c + 0.5 * error.mean()
    assert np.allclose(model.weights, w) and model.intercept == pytest.approx(c)
    with pytest.raises(ValueError):
        url_filter.fit(frame, max_rows=3)


# --- pipeline ---


def test_pipeline(spark):
    final = corpus_pipeline.run(spark, SF).collect()
    assert len(corpus_pipeline.STAGES) == 5 and check_sequences(final)
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    frame, kept = table(spark, SF, "documents"), set(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in frame.collect()]
        frame = stage(spark, frame, SF).cache()
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
        now = {r["doc_id"]: r["text"] for r in frame.collect()}
        assert now.keys() <= kept
        if name == "quality_rules":
            assert {d for d, t in before if brute.measures(t)[5]}.isdisjoint(now)
        elif name == "near_duplicates":
            assert set(now) == {c for _, n, c in brute.linked(before, 5, 80) if n} | {d for d, n, _ in brute.linked(before, 5, 80) if not n}
        elif name == "repeated_passages":
            removed = {d: n - r for d, n, r, _, _ in brute.repeats(before)}
            assert all(len(t.encode()) - removed[d] <= 3 * 40 for d, t in now.items())
            assert {d for d, n in removed.items() if n} <= set(now)
        else:
            assert set(now) == {r[0] for r in brute.contaminated(before, items) if not r[5]}
        kept = set(now)
    assert {r["doc_id"] for r in final} == kept


def test_pipeline_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing names and empty tables go through every stage."""
    words = " ".join(f"word{k}" for k in range(40))
    odd = [(None, None, None), (None, words, None), (1, "", "en"), (1, "", "en"), (2, words, "en"), (2, words, "en"), (3, words + " more", "xx"), (4, "few words", "de"), (5, " ".join(f"other{k}" for k in range(30)), "en")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "length(text) as n_chars", "'a' as doc_key", "'b' as row_key", "'c' as n_words", "'d' as kept", "'e' as node")
    for frame, want in ((docs, [{None, 2, 3, 5}, {2, 5}, {2, 5}, {2, 5}]), (docs.limit(0), [set()] * 4)):
        for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
            frame = stage(spark, frame, SF)
            assert tuple(frame.columns) == corpus_pipeline.COLUMNS
            assert {r["doc_id"] for r in frame.collect()} == ids
        packed = corpus_pipeline.best_fit(spark, frame, SF).collect()
        assert {r["doc_id"] for r in packed} == ids


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
