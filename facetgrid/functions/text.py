"""String functions of the catalogue, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
OTHER = "その他"
WEEKDAYS = "月火水木金土日"
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
SPACE = r"\p{IsWhite_Space}"

_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
FOLD_FROM = "　" + _WIDE + _UPPER
FOLD_TO = " " + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE).lower() + _UPPER.lower()
_WIDE_ALNUM = "".join(c for c in _WIDE if chr(ord(c) - 0xFEE0).isalnum())
_ALNUM = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE_ALNUM)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def fold(c: Column | str) -> Column:
    """Full-width ASCII and the ideographic space to ASCII, A-Z to a-z, one to one; nothing else."""
    return F.translate(col(c), FOLD_FROM, FOLD_TO)


def fold_text(s: str) -> str:
    """``fold`` of a Python string, for queries."""
    return s.translate(str.maketrans(FOLD_FROM, FOLD_TO))


def utrim(c: Column | str) -> Column:
    """Trim all Unicode white space, unlike ``trim``."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def none_if_blank(c: Column | str) -> Column:
    return F.nullif(utrim(c), F.lit(""))


def or_other(c: Column | str) -> Column:
    return F.coalesce(none_if_blank(c), F.lit(OTHER))


def haystack(name: Column, sub: Column, instructor: Column, code: Column, department: Column, *extra: Column) -> Column:
    """Folded, space-joined: required parts stay when empty, a null subtitle and empty extras do not."""
    required = lambda c: F.coalesce(c, F.lit(""))
    parts = [required(name), sub, required(instructor), required(code), required(department), *[F.nullif(e, F.lit("")) for e in extra]]
    return fold(F.concat_ws(" ", *parts))


def fold_digits(c: Column | str) -> Column:
    return F.translate(col(c), FULL_DIGITS, DIGITS)


def fold_alnum(c: Column | str) -> Column:
    """Full-width letters and digits to ASCII, case kept, punctuation left."""
    return F.translate(col(c), _WIDE_ALNUM, _ALNUM)


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\r?\n", -1)


def normalize_lines(c: Column | str) -> Column:
    """White space collapsed within lines, empty lines dropped, line breaks kept."""
    each = F.transform(lines(c), lambda s: F.regexp_replace(utrim(s), f"{SPACE}+", " "))
    return F.array_join(F.filter(each, lambda s: s != ""), "\n")


def session_number(c: Column | str) -> Column:
    return F.regexp_extract(fold_digits(c), "^第([0-9]+)", 1).try_cast("bigint")


def parse_credits(c: Column | str) -> Column:
    """The number before any unit; null if there is none or it has two points."""
    return F.regexp_extract(utrim(c), "^[0-9.]*", 0).try_cast("float")


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def weekday_index(c: Column | str) -> Column:
    """0 (Monday) to 6, null for anything else."""
    at = F.instr(F.lit(WEEKDAYS), col(c))
    return F.when((F.length(col(c)) == 1) & (at > 0), at - 1)


def quoted(literal: str) -> str:
    """A regular expression that matches the literal."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def characters(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit("(?s)."), F.lit(0))


def head_bytes(c: Column | str, n: int = 1200) -> Column:
    """The first ``n`` bytes, cut back to a whole character, and the total if there is more."""
    raw = F.encode(col(c), "UTF-8")
    size = F.octet_length(raw)
    inner = lambda k: F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("int").between(128, 191)
    # A character has at most three bytes after its first.
    cut = F.when(~inner(n + 1), n).when(~inner(n), n - 1).when(~inner(n - 1), n - 2).otherwise(n - 3)
    head = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(size <= n, col(c)).otherwise(F.concat(head, F.lit("… ("), size.cast("string"), F.lit(" bytes)")))


def redact(c: Column | str, secret: str, mark: str = "[TOKEN]") -> Column:
    return F.replace(col(c), F.lit(secret), F.lit(mark)) if secret else col(c)


def has_value(c: Column, kind: str) -> Column:
    """Whether a value of that kind (string, array, struct, other) is there and not empty."""
    if kind == "string":
        return F.coalesce(utrim(c) != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()
