"""Incremental bookkeeping: selection, tombstones, breaker, tallies, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def targets(raw: DataFrame, code: str, order: str, pattern: str, update: str) -> DataFrame:
    """(cd, pattern, last_update, ord): first row of each code, pattern 4 by default."""
    rows = raw.where(F.trim(F.col(code)) != "")
    first = rows.groupBy(F.trim(F.col(code)).alias("cd")).agg(F.min_by(F.struct(F.col(pattern).alias("p"), F.col(update).alias("u")), order).alias("r"), F.min(order).alias("ord"))
    return first.select("cd", F.coalesce(F.nullif("r.p", F.lit("")), F.lit("4")).alias("pattern"), F.coalesce("r.u", F.lit("")).alias("last_update"), "ord")


def select_stale(wanted: DataFrame, saved: DataFrame, tombstones: DataFrame, only: DataFrame | None = None, force: bool = False, limit: int = 0, after: int = 2) -> DataFrame:
    """Rows of ``wanted`` (cd, last_update, ord) to be fetched.

    Left out: rows not in ``only``; rows saved (cd, last_update) at the same, not
    empty, time; rows with ``after`` failures (cd, last_update, fails) at the same
    time.  ``force`` takes all; ``limit`` 0 is no limit.
    """
    rows = wanted if only is None else wanted.join(only.select("cd").distinct(), "cd", "left_semi")
    if not force:
        same = saved.where("last_update <> ''").select("cd", "last_update").distinct()
        dead = tombstones.where(F.col("fails") >= after).select("cd", "last_update").distinct()
        rows = rows.join(same.unionByName(dead).distinct(), ["cd", "last_update"], "left_anti")
    return rows.orderBy("ord").limit(limit) if limit else rows


def merge_tombstones(state: DataFrame, failed: DataFrame, now_saved: DataFrame) -> DataFrame:
    """(cd, last_update, fails): one more failure, from 0 if the update changed; codes with a detail drop out."""
    new = failed.groupBy("cd").agg(F.max("last_update").alias("new_update"), F.count("*").alias("more"))
    both = state.join(new, "cd", "full_outer")
    kept = F.when(F.col("new_update").isNull() | (F.col("new_update") == F.col("last_update")), F.coalesce("fails", F.lit(0))).otherwise(0)
    merged = both.select("cd", F.coalesce("new_update", "last_update").alias("last_update"), (kept + F.coalesce("more", F.lit(0))).cast("int").alias("fails"))
    return merged.join(now_saved.select("cd").distinct(), "cd", "left_anti")


def breaker(outcomes: DataFrame, group: str, order: str, blocking: Column, n: int = 3) -> DataFrame:
    """(group, tripped_at): the ``order`` of the n-th of the first run of ``n`` blocking outcomes.

    A row ends such a run if it and the n-1 before it block, so no island needs
    to be numbered.
    """
    w = W.partitionBy(group).orderBy(order).rowsBetween(-(n - 1), 0)
    rows = outcomes.select(group, order, F.sum(blocking.cast("int")).over(w).alias("_run"))
    return rows.where(F.col("_run") == n).groupBy(group).agg(F.min(order).alias("tripped_at"))


def until_tripped(outcomes: DataFrame, group: str, order: str, blocking: Column, n: int = 3) -> DataFrame:
    """Outcomes up to the one that trips the breaker; all where it does not trip."""
    w = W.partitionBy(group).orderBy(order)
    run = F.sum(blocking.cast("int")).over(w.rowsBetween(-(n - 1), 0))
    rows = outcomes.withColumn("_run", run)
    tripped = F.coalesce(F.max((F.col("_run") == n).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_over", tripped).where("_over = 0").drop("_run", "_over")


def crawl_report(outcomes: DataFrame, group: str, order: str, n: int = 3, first: int = 8) -> DataFrame:
    """(group, fetched, skipped, no_detail, aborted, diagnostics) of outcomes (status, reason, fatal).

    A null status is a success; ``diagnostics`` has the first failures in full.
    """
    blocking = F.coalesce(is_blocking(F.col("status")), F.lit(False))
    seen = until_tripped(outcomes, group, order, blocking, n)
    failed = F.col("status").isNotNull() | F.col("fatal")
    at = F.row_number().over(W.partitionBy(group, failed).orderBy(order))
    rows = seen.select(group, order, failed.alias("failed"), "fatal", F.when(failed & (at <= first), F.struct(order, "reason")).alias("said"))
    report = rows.groupBy(group).agg(
        F.count(F.when(~F.col("failed"), 1)).alias("fetched"), F.count(F.when(F.col("failed"), 1)).alias("skipped"), F.count(F.when(F.col("fatal"), 1)).alias("no_detail"),
        F.transform(F.array_sort(F.collect_list("said")), lambda x: x["reason"]).alias("diagnostics"),
    )
    aborted = breaker(outcomes, group, order, blocking, n)
    return report.join(aborted, group, "left").withColumn("aborted", F.col("tripped_at").isNotNull()).drop("tripped_at")


def backoff_seconds(base: Column, attempt: Column, cap: float = 60.0) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(cap))


def is_blocking(status: Column) -> Column:
    return status.isin(403, 429) | status.between(500, 599)


def is_retriable(status: Column, transient: Column) -> Column:
    return transient | (status == 429) | status.between(500, 599)


def retry_after(header: Column) -> Column:
    return F.when(F.rlike(header, F.lit("^[0-9]+$")), header.try_cast("bigint"))


def classify_response(status: Column, body: Column, retry: Column) -> Column:
    """struct<outcome, detail>: http, fatal or ok with the token, of a JSON answer."""
    parsed = F.try_parse_json(body)
    token = F.try_variant_get(parsed, "$.guid", "string")
    message = F.try_variant_get(parsed, "$.errorMsg", "string")
    out = lambda kind, detail: F.struct(F.lit(kind).alias("outcome"), detail.alias("detail"))
    return (
        F.when(~status.between(200, 299), out("http", F.concat_ws(" ", F.lit("HTTP"), status.cast("string"), retry_after(retry).cast("string"))))
        .when(parsed.isNull(), out("fatal", F.lit("not JSON")))
        .when(F.coalesce(message, F.lit("")) != "", out("fatal", message))
        .when(F.coalesce(token, F.lit("")) == "", out("fatal", F.lit("no guid")))
        .otherwise(out("ok", token))
    )


def classify_html(status: Column, body: Column) -> Column:
    out = lambda kind, detail: F.struct(F.lit(kind).alias("outcome"), detail.alias("detail"))
    return F.when(~status.between(200, 299), out("http", F.concat(F.lit("HTTP "), status.cast("string")))).when(F.trim(F.coalesce(body, F.lit(""))) == "", out("fatal", F.lit("empty html"))).otherwise(out("ok", body))


def condensed(reason: Column) -> Column:
    """A reason without its prefix and details; failed saves are one reason."""
    plain = F.regexp_replace(reason, "^fatal: ", "")
    return F.when(F.startswith(reason, F.lit("save failed")), "save failed").when(F.startswith(reason, F.lit("fatal: ")), F.substring_index(plain, ":", 1)).otherwise(reason)


def failure_tally(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    return skipped.groupBy(condensed(F.col(reason)).alias("reason")).agg(F.count("*").alias("n"))


def top_reasons(tally: DataFrame, k: int = 3) -> DataFrame:
    """One row: ``N× reason`` of the ``k`` commonest, and how many kinds more."""
    top = tally.orderBy(F.desc("n"), "reason").limit(k)
    text = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason", "n"))).alias("t"))
    more = tally.agg(F.count("*").alias("kinds"))
    listed = F.array_join(F.transform("t", lambda r: F.concat(r["n"].cast("string"), F.lit("× "), r["reason"])), ", ")
    return text.join(more, how="cross").select(F.concat(listed, F.when(F.col("kinds") > k, F.concat(F.lit(", +"), (F.col("kinds") - k).cast("string"), F.lit(" more"))).otherwise("")).alias("summary"))


def verdict(report: DataFrame, reason: str = "reason", diagnostics: str = "diagnostics") -> DataFrame:
    """One row (skipped, hint) by what the reasons and diagnostics mention."""
    low = F.lower(F.coalesce(F.col(diagnostics), F.lit("")))
    said = lambda c, *words: F.bool_or(F.greatest(*[F.contains(c, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(c, F.lit(words[0])))
    seen = report.agg(F.count("*").alias("skipped"), said(low, "service method", "not found").alias("a"), said(F.col(reason), "HTTP 403", "HTTP 429").alias("b"), said(low, "no guid").alias("c"), said(low, "empty html").alias("d"))
    hint = F.when(F.col("a"), "the interface may have changed").when(F.col("b"), "blocked or limited: wait longer").when(F.col("c"), "no token: request is stale").when(F.col("d"), "empty page: session is stale")
    return seen.select("skipped", hint.alias("hint"))


def page_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(name, changed, stale): by digest against the last snapshot; pages gone are stale."""
    own = now.select("name", F.sha2("content", 256).alias("new"))
    last = before.select("name", F.sha2("content", 256).alias("old"))
    both = own.join(last, "name", "full_outer")
    return both.select("name", F.coalesce(F.col("new") != F.col("old"), F.col("new").isNotNull()).alias("changed"), F.col("new").isNull().alias("stale"))


def page_violations(pages: DataFrame, size: int) -> DataFrame:
    """Rows (page, problem) of pages (page, echoed, max_page, rows) that contradict the first."""
    first = pages.agg(F.min_by("max_page", "page").alias("first_max"))
    rows = pages.join(first, how="cross")
    problem = F.when(F.col("page") != F.col("echoed"), "page number").when(F.col("max_page") != F.col("first_max"), "page count").when((F.col("page") < F.col("first_max")) & (F.col("rows") != size), "page not full")
    return rows.select("page", problem.alias("problem")).where("problem is not null")


def page_name(page: Column, stem: str) -> Column:
    return F.when(page == 1, f"{stem}.json").otherwise(F.format_string(f"{stem}-%02d.json", page))


def change_set(diff: DataFrame, line: str = "line") -> DataFrame:
    """(path, action) of name-status lines: deletions, renames and copies as both, all else additions."""
    part = F.split(F.col(line), "\t")
    status = F.substring(part[0], 1, 1)
    entry = lambda path, action: F.struct(path.alias("path"), F.lit(action).alias("action"))
    last = F.element_at(part, -1)
    both = F.array(entry(F.get(part, 1), "delete"), entry(last, "add"))
    rows = F.when(status == "D", F.array(entry(last, "delete"))).when(status.isin("R", "C"), both).otherwise(F.array(entry(last, "add")))
    return diff.where(F.size(part) >= 2).select(F.explode(rows).alias("e")).select("e.*")
