"""The display specification of detail fields, as a small table, and what it orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.functions.present import is_related_label
from facetgrid.functions.text import has_value, utrim

#: Key, label, tier, group, render.
SPEC = (
    ("eval", "成績評価", 1, "", "eval-chart"),
    ("delivery", "授業実施方法", 1, "", "delivery-badge"),
    ("unit", "単位数", 1, "", "meta"),
    ("summary", "授業の概要", 1, "", "longtext"),
    ("aims", "授業の目的", 1, "授業内容", "longtext"),
    ("goals", "到達目標", 2, "授業内容", "checklist"),
    ("plan", "授業計画", 2, "授業内容", "plan-timeline"),
    ("textbooks", "教科書・参考書", 2, "授業内容", "textbooks"),
    ("prereq", "履修に求めるもの", 2, "授業内容", "longtext"),
    ("prep", "授業時間外の学習", 2, "授業内容", "prep"),
    ("officeHour", "オフィスアワー", 2, "授業内容", "office-table"),
    ("teachers", "担当教員", 3, "その他", "people"),
    ("keywords", "キーワード", 3, "その他", "keywords"),
    ("numbering", "ナンバリング", 3, "その他", "numbering"),
    ("sdgs", "SDGs", 3, "その他", "sdgs"),
)
CHIPS, FOLDED, LAST_GROUP = ("meta", "delivery-badge"), ("numbering",), "その他"


def spec_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(SPEC)], "ord int, key string, label string, tier int, group string, render string")


def sections(details: DataFrame) -> DataFrame:
    """(cd, ord, key, label, group, render, value): what a page of each record shows, in order.

    Fields by the specification, then further labelled texts, then the base
    fields; values as JSON.  No shuffle: each record unfolds where it is.
    """
    kinds = dict(details.dtypes)

    def entry(order: Column, key: Column, label: Column, group: str, render: Column, value: Column) -> Column:
        return F.struct(order.alias("ord"), key.alias("key"), label.alias("label"), F.lit(group).alias("group"), render.alias("render"), value.alias("value"))

    shown = []
    for k, (key, label, _, group, render) in enumerate(SPEC):
        if render in CHIPS or key in FOLDED or key not in kinds:
            continue
        kind = "string" if kinds[key] == "string" else "array" if kinds[key].startswith("array") else "struct"
        text = F.col(key) if kind == "string" else F.to_json(key)
        shown.append(F.when(has_value(F.col(key), kind), entry(F.lit(k), F.lit(key), F.lit(label), group, F.lit(render), text)))
    related = lambda e: is_related_label(e["label"])
    full = F.filter(F.coalesce("extra", F.array().cast(kinds["extra"])), lambda e: F.coalesce(utrim(e["text"]) != "", F.lit(False)))
    more = F.transform(full, lambda e, i: entry(i + len(SPEC), F.concat(F.lit("extra:"), e["label"]), F.when(related(e), "関連科目").otherwise(e["label"]), LAST_GROUP, F.when(related(e), "related").otherwise("longtext"), e["text"]))
    base = F.array(entry(F.size(full) + len(SPEC), F.lit("__base__"), F.lit("科目情報"), LAST_GROUP, F.lit("base"), F.lit("")))
    return details.select("cd", F.explode(F.concat(F.array_compact(F.array(*shown)), more, base)).alias("s")).select("cd", "s.*")


def render_markdown() -> str:
    rows = [f"| {tier} | {group} | `{key}` | {label} | `{render}` |" for key, label, tier, group, render in SPEC]
    return "\n".join(["| tier | group | key | label | render |", "|---|---|---|---|---|", *rows, ""])


def render_typescript() -> str:
    rows = [f"\t{{ key: '{key}', label: '{label}', tier: {tier}, group: '{group}', render: '{render}' }}," for key, label, tier, group, render in SPEC]
    return "\n".join(["export const FIELDS = [", *rows, "] as const", ""])


def is_current(text: str, wanted: str) -> bool:
    """Whether a generated file is up to date, whatever its line ends."""
    return text.replace("\r\n", "\n") == wanted
