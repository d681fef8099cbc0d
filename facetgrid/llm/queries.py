"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.llm import chat_format, collocations, decontaminate, html_extract, lexical_search, lz_fingerprint, ngram_join, packing, quality, sharding, suffix_dedup, token_count, url_filter
from facetgrid.llm.common import materialize, table

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in a benchmark item's 10-word window."""
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document left after passages of smaller doc_ids are removed."""
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), as_text=False)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of each document and the verdict of the certified cutoffs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = materialize(quality.measure(docs, keep_text=False), "measured")
    cutoffs = quality.calibrate(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents -> shard, by a broadcast permutation-filled lookup table."""
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)
    return placed.select("doc_id", "slot", "shard")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by wrappers inferred per host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_conversations(turns).select(
        "conv_id", "valid", chat_format.parse(F.col("formatted")).alias("read"), chat_format.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    nl = F.lit("\n")
    return made.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate component of each document."""
    linked = ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", "n_shingles", "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    small = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(small, rows=packing.estimated_pieces(docs))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL judged by rules, else by the fitted model."""
    model = url_filter.fit(url_filter.seed_table(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, model).select("page_id", "host", "path", "rule", "verdict")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=20)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of 2 to 5 words."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, held against half-replaced texts and next documents."""
    return lz_fingerprint.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of op3 by themselves, which SQL can state."""
    measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op10 by themselves, which SQL can state."""
    host, path = url_filter.split_url(F.col("url"))
    parts = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = url_filter.matched_rule(F.col("host"), F.col("path"), url_filter.RULES)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_html_extract": op5_html_extract,
    "op6_chat_format": op6_chat_format,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_token_count": op9_token_count,
    "op10_url_filter": op10_url_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_lz_fingerprint": op13_lz_fingerprint,
    "quality_base": quality_base,
    "url_rules": url_rules,
}


def _escaped_extra() -> str:
    """DuckDB: characters that escaping adds to t (all control strings shrink to two)."""
    controls = chat_format.Template().controls
    text = "replace(t, chr(92), chr(92) || '0')"
    for control in controls:
        text = f"replace({text}, '{control}', chr(1) || 'x')"
    return f"length({text})"


_T = chat_format.Template()
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PIECES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')"
_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[0]))
_FITS = [(f"(host = '{r[:r.index('/')]}' or suffix(host, '.{r[:r.index('/')]}')) and prefix(path, '{r[r.index('/'):]}')", r, says) for r, says in _RULES]
_WORD = r"[^\x20\x09-\x0D]"
_FLOOR = "(1000::hugeint * a * n) // (l::hugeint * r)"
ORACLE = {
    "quality_base": rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
g as (select doc_id, k, w[k:k + 4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d)),
again as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, g) as n from g) where n > 1),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + 5)) as p from again) group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{_WORD}') group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(w) < 10 or 100 * coalesce(r.n, 0) > 20 * len(w) as base_failed
from d left join l using (doc_id) left join r using (doc_id)""",
    "url_rules": rf"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages)
select page_id, host, path, case {' '.join(f"when {f} then '{r}'" for f, r, _ in _FITS)} end as rule, case {' '.join(f"when {f} then '{v}'" for f, _, v in _FITS)} end as rule_verdict from p""",
    "op11_lexical_search": f"""
with t as (select doc_id, {_WORDS} as w from documents), d as (select doc_id, w, len(w)::bigint as n from t where len(w) > 0),
c as (select count(*)::bigint as docs, sum(n)::bigint as length from d),
m as (select doc_id, 100 - 25 + (25 * n * docs) // length as m from d, c),
p as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(w) as term from d) group by all),
i as (select item_id, term, count(*)::bigint as times from (select item_id, unnest({_WORDS}) as term from benchmark) group by all),
f as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as weight from p, c where term in (select term from i) group by term, docs),
s as (select item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from i join f using (term) join p using (term) join m using (doc_id) group by all)
select item_id, rank, doc_id, score from (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from s where score > 0) where rank <= 20""",
    "op12_collocations": rf"""
with p as (select coalesce(lang, 'und') as lang, unnest({_PIECES}) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, s, array_to_string(w[k:k + s - 1], ' ') as g from (select lang, w, s, unnest(range(1, len(w) - s + 2)) as k from w, range(1, 6) as sizes(s))),
f as materialized (select lang, s, g, count(*)::bigint as a from g group by all), t as (select lang, sum(a)::bigint as n from f where s = 1 group by lang),
c as materialized (select lang, g, a, s, string_split(g, ' ') as w from f where s > 1 and a >= 100),
parts as (select lang, g, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:s], ' ') as rest from (select *, unnest(range(1, s)) as k from c)),
cuts as (select parts.*, n, x.a as l, y.a as r from parts join t using (lang) join f x on x.lang = parts.lang and x.g = first join f y on y.lang = parts.lang and y.g = rest),
best as (select *, ({_FLOOR})::bigint as score from cuts qualify row_number() over (partition by lang, g order by {_FLOOR}, k) = 1),
within as (select lang, array_to_string(w[k:k + size - 1], ' ') as g, max(a) as longer from (select *, unnest(range(1, s - size + 2)) as k from c, range(2, 5) as sizes(size) where size < s) group by all),
ranked as (select lang, g as phrase, a, l, r, n, score from best left join within using (lang, g) where longer is null or longer < a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked) where rank <= 2000""",
    "op2_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select doc_id, p, substr(h, 2 * p + 1, 100) as g from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as p from d)),
gone as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by g) as first from starts) where first < doc_id),
marked as (select doc_id, p, (p - lag(p, 1, -100) over (partition by doc_id order by p) > 50)::int as opens from gone),
runs as (select doc_id, min(p) as a, max(p) + 50 as b from (select doc_id, p, sum(opens) over (partition by doc_id order by p) as run from marked) group by doc_id, run),
cut as (select r.doc_id, a, b, substr(h, 2 * before + 1, 2 * (a - before)) as part from (select *, lag(b, 1, 0) over (partition by doc_id order by a) as before from runs) r join d using (doc_id)),
left_over as (select doc_id, sum(b - a) as removed, count(*) as spans, max(b) as last, string_agg(part, '' order by a) as kept from cut group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join left_over using (doc_id)""",
    "op7_ngram_join": r"""
with recursive d as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + least(len(w), 4) - 1], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) as k from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as doc, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.doc)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.root as component_id
from d left join n using (doc_id) join (select doc, min(root) as root from r group by doc) c on c.doc = d.doc_id""",
    "op1_decontaminate": f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
sized as (select *, least(len(w), 10) as l from i where len(w) > 0),
win as (select item_id, l, w[k:k+l-1] as g from (select *, unnest(range(1, len(w) - l + 2)) as k from sized)),
own as (select doc_id, l, k, w[k:k+l-1] as g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as k from d, (select distinct l from win))),
hit as (select distinct doc_id, item_id, k, l from own join win using (l, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + l)) as p from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list from (select distinct doc_id, item_id from hit) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op6_chat_format": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (select *, {_escaped_extra()} as e from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) as turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) as loss_sha256,
  sum({len(_T.start) + len(_T.middle) + len(_T.end)} + length(r) + e)::bigint as formatted_chars,
  regexp_full_match(string_agg(r, ',' order by turn, r, t), '(system,)?user,assistant(,user,assistant)*') as valid
from sized group by conv_id""",
}
