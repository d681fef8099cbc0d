"""Chat formatting: a role state machine and a declarative template.

Native: DataFrame and SQL functions only.  A conversation becomes one row with
an array of ``(text, loss)`` segments, the formatted text (their concatenation)
and a verdict on the turn order.  One conversation is one output row by nature,
so its turns meet in one task; different conversations are spread by their id.

Texts are escaped so that no control string of the template survives inside
them, and ``parse`` reads roles, texts and loss text back exactly.  The escape
sign doubles as ``\\0``; the k-th control string becomes ``\\`` and a letter.

Nulls and odd input: a null text or role is an empty string; turns with equal
numbers are ordered by role, then text; null turn numbers come last; repeated
rows are turns of their own; a null conv_id is one conversation.  Roles outside
the machine are formatted all the same, without loss, and make the conversation
invalid.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles bear loss, and which role may follow which."""

    start: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Control strings of common chat formats, escaped inside texts too.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    #: (state, role) -> state; the machine starts in "start".
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    accepting: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.foreign)

    @property
    def codes(self) -> list[tuple[str, str]]:
        if len(self.controls) > 26 or any(ESCAPE in c or not c for c in self.controls):
            raise ValueError("at most 26 control strings, none empty or with the escape sign")
        return [(c, ESCAPE + chr(ord("a") + k)) for k, c in enumerate(self.controls)]


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for control, code in template.codes:
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for control, code in reversed(template.codes):
        out = F.replace(out, F.lit(code), F.lit(control))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = blank("role"), blank("text")
    rows = turns.select("conv_id", F.struct(
        F.col("turn").isNull().alias("last"), "turn", role.alias("role"), text.alias("text"),
    ).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    names = F.create_map(*[F.lit(x) for (state, by), to in template.moves.items() for x in (f"{state}\n{by}", to)])
    ends = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(names, F.concat(s, F.lit("\n"), t["role"])), F.lit("error")))

    def pieces(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        part = lambda c, flag: F.struct(c.alias("text"), flag.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.start), escape(t["role"], template), F.lit(template.middle)), F.lit(False)),
            part(escape(t["text"], template), loss),
            part(F.lit(template.end), F.lit(False)),
        )

    made = whole.select("conv_id", F.size("turns").alias("n_turns"), ends.isin(*template.accepting).alias("valid"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    bodies = F.slice(F.split(formatted, f"\\Q{template.start}\\E", -1), F.lit(2), F.length(formatted) + 1)

    def turn(body: Column) -> Column:
        own = F.substring(body, F.lit(1), F.length(body) - len(template.end))
        at = F.split(own, f"\\Q{template.middle}\\E", 2)
        return F.struct(unescape(at[0], template).alias("role"), unescape(at[1], template).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    marked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(marked, lambda s: unescape(s["text"], template)), "")
