"""Enrichment of detail records: width clean-up, then every derived field anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgrid.functions import rules
from facetgrid.functions.text import fold_alnum

#: The fields whose text is cleaned.
TEXTS = ("summary", "aims", "prereq", "prep", "textbooks")


def purify(details: DataFrame) -> DataFrame:
    """Full-width letters and digits to ASCII in prose; labels, items, names and delivery stay."""
    return details.withColumns({
        **{c: fold_alnum(c) for c in TEXTS},
        "goals": F.transform("goals", fold_alnum),
        "keywords": F.transform("keywords", fold_alnum),
        "plan": F.transform("plan", lambda p: F.struct(p["n"].alias("n"), fold_alnum(p["text"]).alias("text"), p["kind"].alias("kind"))),
        "extra": F.transform("extra", lambda e: F.struct(e["label"].alias("label"), fold_alnum(e["text"]).alias("text"))),
    })


def retyped(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["item"].alias("item"), r["weight"].alias("weight"), rules.assessment_type(r["item"]).alias("type")))


def enrich(details: DataFrame) -> DataFrame:
    """Kinds, mode, session kinds, textbook sections, study time and repaired keywords, derived from the texts."""
    clean = purify(details)
    d, e = F.col("delivery"), F.col("eval")
    return clean.withColumns({
        "eval": F.when(e.isNotNull(), F.struct(retyped(e["rows"]).alias("rows"), e["note"].alias("note"))),
        # A record of the media flag alone has no text to derive a mode from.
        "delivery": F.when(d.isNotNull(), F.struct(F.when(F.coalesce(d["raw"], F.lit("")) == "", d["mode"]).otherwise(rules.delivery_mode(d["raw"])).alias("mode"), d["raw"].alias("raw"), d["isMedia"].alias("isMedia"))),
        "plan": F.transform("plan", lambda p: F.struct(p["n"].alias("n"), p["text"].alias("text"), rules.plan_kind(p["text"], p["n"]).alias("kind"))),
        "textbookInfo": rules.textbook_info("textbooks"),
        "prepInfo": rules.prep_info("prep"),
        "keywords": rules.repair_keywords("keywords"),
    })
