"""URL filter: host/path rules, and logistic regression on hashed character n-grams.

Native: DataFrame and SQL functions only.  The model is fitted in its dual form:
by the representer theorem the weights of an L2-regularised logistic regression
are a combination of the training rows, so gradient descent runs over one
coefficient per labelled URL and the rows' Gram matrix, inside one ``aggregate``
expression.  The weights, a table of ``buckets`` numbers whatever the size of
the input, go into the plan as one array literal.

Nulls and odd input: a null URL, or one without ``://``, has an empty host and
an empty path; it fits no rule and is judged by the model (which then has no
n-gram, so only its intercept speaks).  Repeated rows are judged one by one.  An
empty table gives an empty result.  Columns of the input are kept, and those
whose names clash with an output column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.llm.common import LOWER, UPPER

#: Topics of unwanted and of wanted sites.
UNWANTED = (
    "casino poker roulette jackpot blackjack gambling betting bets bookmaker lottery sweepstakes prizes winner "
    "viagra pills meds steroids adult porn xxx sexy nude escort camgirls hookup "
    "spam backlinks linkfarm clickbait ads adserver adtrack tracker tracking popup banner malware phishing "
    "warez torrent cracked keygen pirated replica counterfeit payday loans quickcash"
).split()
WANTED = (
    "library museum theatre university college school teacher science physics chemistry biology mathematics history "
    "geography philosophy language literature poetry novel author journal magazine newspaper weather climate ocean "
    "mountain forest garden flower farmer village city council government parliament justice court health hospital "
    "doctor nursing medicine kitchen cooking recipe baking bread coffee travel railway station airport harbour "
    "bicycle football tennis athletics swimming music orchestra painting sculpture photo cinema radio television "
    "software computer network database research engineer machine energy electric water nature animal bird "
    "fishing hiking camping family children parent wedding holiday christmas market finance insurance property "
    "house furniture carpentry fashion clothing shoes jewelry letter calendar archive foundation charity church "
    "temple heritage culture tradition festival community forum wiki encyclopedia dictionary translation other "
    "north south east west"
).split()
#: What both kinds of names are compounded with, and how URLs look around them.
SECOND = ("online", "best", "daily", "world", "center", "club")
SHAPES = ("https://www.{}.example.com/en/{}", "http://{}.example.net/de/{}.html", "https://m.{}.example.org/fr/{}/", "https://blog.{}.example.com/es/{}?page=2", "https://{}.example.net/en/{}#top")


def seed_urls() -> list[tuple[str, int]]:
    """The small labelled URL table (1: block): each topic alone, and every second one in a compound, so neither hyphens nor second words nor paths tell the kinds apart."""
    out = []
    for label, topics in ((1, UNWANTED), (0, WANTED)):
        for k, topic in enumerate(topics):
            second = SECOND[k % len(SECOND)]
            names = [topic] if k % 2 else [topic, f"{topic}-{second}" if k % 4 else f"{second}-{topic}"]
            out += [(SHAPES[(k + i) % len(SHAPES)].format(name, 37 * k % 1000 + i), label) for i, name in enumerate(names)]
    return out


#: Rule text (host and path prefix) and verdict.
RULES: list[tuple[str, str]] = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to ``/ ? #``, A-Z lower-cased; path up to ``? #``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    at = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(at(1), UPPER, LOWER), at(2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        cut = text.index("/")
        own, prefix = text[:cut], text[cut:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    intercept: float
    n: int


def ngram_buckets(host: Column, path: Column, n: int, buckets: int) -> Column:
    """Distinct hashed n-grams of the host (marked at both ends) and of the path."""

    def grams(text: Column, tag: str) -> Column:
        last = F.length(text) - (n - 1)
        cut = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(cut, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    marked = F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return F.array_distinct(F.concat(grams(marked, "h"), grams(path, "p")))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", n: int = 4, buckets: int = 4096,
        rate: float = 0.5, l2: float = 0.003, steps: int = 250, max_rows: int = 512) -> UrlModel:
    """Fit on a labelled URL table of at most ``max_rows`` rows (the documented bound).

    Rows over the bound are an error, not a silent sample.  Rows with a null URL
    or label are left out.  Each row's features are scaled to length 1.
    """
    host, path = split_url(F.col(url))
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), ngram_buckets(host, path, n, buckets).alias("b"))
    number = rows.limit(max_rows + 1).count()
    if number > max_rows:
        raise ValueError(f"more than {max_rows} labelled rows; raise max_rows or pass fewer")
    data = rows.agg(F.array_sort(F.collect_list(F.struct("b", "y"))).alias("d"))
    size = F.size("d")
    row = lambda k: F.col("d")[k]
    scale = lambda s: F.sqrt(F.greatest(F.size(s["b"]), F.lit(1)).cast("double"))
    gram = data.select(
        "d", size.alias("m"),
        F.transform("d", lambda s: F.transform("d", lambda t: F.size(F.array_intersect(s["b"], t["b"])) / (scale(s) * scale(t)))).alias("k"),
    )
    # An aggregate keeps the optimizer from computing the matrix anew in each step.
    gram = gram.agg(*[F.first(c).alias(c) for c in ("d", "m", "k")])
    zero = F.transform("d", lambda s: F.lit(0.0))

    def step(state: Column, _: Column) -> Column:
        def score(i: Column) -> Column:
            return state["c"] + F.aggregate(F.zip_with(state["a"], F.col("k")[i], lambda a, k: a * k), F.lit(0.0), lambda s, v: s + v)

        error = F.transform("d", lambda s, i: s["y"] - 1.0 / (1.0 + F.exp(-score(i))))
        return F.aggregate(
            F.array(error), state,
            lambda st, e: F.struct(
                F.zip_with(st["a"], e, lambda a, v: a * (1.0 - rate * l2) + rate * v).alias("a"),
                (st["c"] + rate * F.aggregate(e, F.lit(0.0), lambda s, v: s + v) / F.col("m")).alias("c"),
            ),
        )

    start = F.struct(zero.alias("a"), F.lit(0.0).alias("c"))
    fitted = gram.select("d", "m", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("s"))
    fitted = fitted.agg(*[F.first(c).alias(c) for c in ("d", "m", "s")])
    each = fitted.select(F.explode_outer(F.zip_with("d", "s.a", lambda t, a: F.struct(t["b"].alias("b"), (a / scale(t)).alias("w")))).alias("r"))
    # One more row carries the intercept, so that one small collect brings all.
    weights = each.select(F.explode("r.b").alias("b"), F.col("r.w").alias("w")).groupBy("b").agg(F.sum("w").alias("w"))
    extra = fitted.select(F.lit(-1).alias("b"), F.col("s.c").alias("w"))
    found = weights.unionByName(extra).collect()
    out = [0.0] * buckets
    intercept = 0.0
    for r in found:
        if r["b"] < 0:
            intercept = float(r["w"])
        else:
            out[r["b"]] = float(r["w"])
    return UrlModel(tuple(out), intercept, n)


def score(model: UrlModel, host: Column, path: Column) -> Column:
    """The probability that the URL should be blocked."""
    grams = ngram_buckets(host, path, model.n, len(model.weights))
    weights = F.array(*[F.lit(w) for w in model.weights])
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(weights, b))
    return 1.0 / (1.0 + F.exp(-(F.lit(model.intercept) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")))))


def filter_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]] = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, p_block and verdict (allow or block)."""
    host, path = split_url(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "p_block": score(model, F.col("host"), F.col("path"))})
    return judged.withColumn("verdict", F.coalesce(says, F.when(F.col("p_block") >= threshold, "block").otherwise("allow")))


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_urls(), "url string, label int")
