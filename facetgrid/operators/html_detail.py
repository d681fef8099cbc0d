"""Detail pages to nested records: the one place where rows go through Python.

Pages come in Arrow batches; each is read into a small tree with the standard
library's tokenizer, supplying the end tags that tables and paragraphs imply.
Nothing in a page makes it fail: what is not found stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgrid.functions import rules
from facetgrid.functions.text import DIGITS, FULL_DIGITS, normalize_lines

# Labels of the page.
REDUNDANT = ("年度", "授業コード", "授業科目", "開講責任部署", "講義区分", "時間割", "講義開講時期", "履修開始年次")
SIMPLE = (("単位数", "unit"), ("授業の概要", "summary"), ("授業の目的", "aims"), ("求めるもの", "prereq"), ("PREREQUISITES", "prereq"), ("授業時間外", "prep"), ("PREPARATION", "prep"), ("教科書", "textbooks"))
PLAN_CLASS, VALUE_CLASS, MOBILE_CLASS = "tbl_status_jugyo", "selectGroupTable", "is-hidden-tablet"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = re.compile(r"<br\s*/?>|</(?:p|div|li|tr|h[1-6])>", re.I)
ENDED_BY = {"tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "p": ("p",)}
#: The ampersand last: what it forms is text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
ASCII = str.maketrans(FULL_DIGITS, DIGITS)

RECORD = (
    "cd string, unit string, delivery struct<mode:string,raw:string,isMedia:boolean>, eval struct<rows:array<struct<item:string,weight:bigint,type:string>>,note:string>, "
    "summary string, aims string, goals array<string>, plan array<struct<n:bigint,text:string,kind:string>>, textbooks string, prereq string, prep string, "
    "officeHour array<struct<name:string,day:string,time:string,place:string>>, keywords array<string>, teachers array<string>, numbering array<string>, sdgs array<string>, extra array<struct<label:string,text:string>>"
)
_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())


def _structs(**fields: pa.DataType) -> pa.ListType:
    return pa.list_(pa.struct(fields))


#: ``RECORD`` for Arrow.
ARROW = pa.schema({
    "cd": _TEXT, "unit": _TEXT, "delivery": pa.struct({"mode": _TEXT, "raw": _TEXT, "isMedia": pa.bool_()}), "eval": pa.struct({"rows": _structs(item=_TEXT, weight=pa.int64(), type=_TEXT), "note": _TEXT}),
    "summary": _TEXT, "aims": _TEXT, "goals": _TEXTS, "plan": _structs(n=pa.int64(), text=_TEXT, kind=_TEXT), "textbooks": _TEXT, "prereq": _TEXT, "prep": _TEXT,
    "officeHour": _structs(name=_TEXT, day=_TEXT, time=_TEXT, place=_TEXT), "keywords": _TEXTS, "teachers": _TEXTS, "numbering": _TEXTS, "sdgs": _TEXTS, "extra": _structs(label=_TEXT, text=_TEXT),
})
#: Text and a tag without attributes, which needs no search for any, and elements whose content is not markup.
BARE = re.compile("([^<]*+)<(/?)([a-z][a-z0-9]*)>")
OPAQUE = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


class Node:
    __slots__ = ("children", "classes", "name", "parent")

    def __init__(self, name: str, classes: str = "", parent: Node | None = None) -> None:
        self.name, self.classes, self.parent = name, classes, parent
        self.children: list[Node | str] = []

    def all(self, *names: str) -> Iterator[Node]:
        todo = self.children[::-1]
        while todo:
            child = todo.pop()
            if isinstance(child, Node):
                if child.name in names:
                    yield child
                todo += child.children[::-1]

    def above(self, name: str) -> Node | None:
        node = self.parent
        while node is not None and node.name != name:
            node = node.parent
        return node


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def updatepos(self, i: int, j: int) -> int:  # nobody asks for lines
        return j

    def _bare(self, i: int) -> int:
        """Tags without attributes from ``i`` on, with the text before each; where they end."""
        raw = self.rawdata
        while found := BARE.match(raw, i):
            text, end, tag = found.groups()
            if tag in OPAQUE:
                break
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if end:
                self.handle_endtag(tag)
            else:
                self.lasttag = tag
                self.handle_starttag(tag, ())
            i = found.end()
        return i

    def parse_starttag(self, i: int) -> int:
        at = self._bare(i)
        return at if at > i else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        at = i if self.cdata_elem else self._bare(i)
        return at if at > i else super().parse_endtag(i)

    def _close(self, names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None and node.name not in stop:
            if node.name in names:
                self.at = node.parent
                if node.name == names[-1]:
                    return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> None:
        if tag in ENDED_BY:
            self._close(ENDED_BY[tag], ("table", "ul", "ol"))
        node = Node(tag, dict(attrs).get("class") or "" if attrs else "", self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, dict(attrs).get("class") or "", self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.name == tag:
                self.at = node.parent
                return
            if node.name == "table":  # nothing inside a table closes what is around it
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def own_text(node: Node) -> str:
    """Text without that of nested tables, but for value wrappers."""
    if len(node.children) == 1 and isinstance(node.children[0], str):
        return node.children[0]
    out, todo = [], node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.name != "table":
            todo += child.children[::-1]
        elif VALUE_CLASS in child.classes:
            todo += [" ", *child.children[::-1]]
    return "".join(out)


def normalize(text: str) -> str:
    if "\n" not in text:
        return " ".join(text.split())
    kept = (" ".join(line.split()) for line in text.replace("\r\n", "\n").split("\n"))
    return "\n".join(line for line in kept if line)


class Cell:
    def __init__(self, node: Node) -> None:
        self.head = node.name == "th"
        self.raw = own_text(node)
        self.text = normalize(self.raw)


def rows_of(table: Node) -> list[list[Cell]]:
    """All rows below, nested ones too; a cell belongs to its nearest row."""
    rows: list[list[Cell]] = []
    todo: list[tuple[Node, list[Cell] | None]] = [(table, None)]
    while todo:
        node, row = todo.pop()
        if node.name == "tr":
            rows.append(row := [])
        elif row is not None and node.name in ("td", "th"):
            row.append(Cell(node))
        for c in node.children[::-1]:
            if not isinstance(c, str):
                todo.append((c, row))
    return rows


def first_number(text: str) -> int | None:
    found = re.search(r"\d+", text.translate(ASCII))
    n = int(found[0]) if found else None
    return n if n is not None and n < 1 << 63 else None


class Record(dict):
    """A record under construction; classified fields are left to ``operators.detail.enrich``."""

    LISTS = ("goals", "plan", "officeHour", "keywords", "teachers", "numbering", "sdgs", "extra")

    def __init__(self, cd: str) -> None:
        super().__init__({"cd": cd, **{f: None for f in ("unit", "delivery", "eval", "summary", "aims", "textbooks", "prereq", "prep")}, **{f: [] for f in self.LISTS}})

    def table(self, classes: str, rows: list[list[Cell]]) -> None:
        heads = [c.text for r in rows for c in r if c.head]
        says = lambda word: any(word in h for h in heads)
        if PLAN_CLASS in classes:
            self.plan(rows)
        elif says("ナンバリングコード"):
            self["numbering"] = [c.text for r in rows for c in r if not c.head and c.text]
        elif says("氏名") and says("所属"):
            named = (next((c.text for c in r if not c.head and c.text), None) for r in rows)
            self["teachers"] += [n for n in named if n]
        elif says("到達目標"):
            self.goals(rows)
        elif says("比重") or says("配分"):
            self.weights(rows)
        elif says("曜日") and (says("場所") or says("時間")):
            self.hours(rows)
        else:
            for r in rows:
                self.route(r)

    def plan(self, rows: list[list[Cell]]) -> None:
        for r in rows:
            full = [c.text for c in r if c.text]
            found = re.match("第([0-9]+)", full[0].translate(ASCII)) if full else None
            if found and int(found[1]) < 1 << 63:
                text = re.sub("^(?:授業概要)+", "", " ".join(full[1:])).strip()
                if text:
                    self["plan"].append({"n": int(found[1]), "text": text, "kind": None})

    def goals(self, rows: list[list[Cell]]) -> None:
        for r in rows:
            text = next((c.text for c in r if not c.head and c.text), None)
            if text and any(re.fullmatch("[0-9]+", c.text.translate(ASCII)) for c in r):
                self["goals"].append(text)

    def weights(self, rows: list[list[Cell]]) -> None:
        found = []
        for r in rows:
            item = next((c.text for c in r if c.head), None)
            value = next((c.text for c in r if not c.head), None)
            if item is not None and value is not None and "比重" not in item and "配分" not in item:
                found.append({"item": item, "weight": first_number(value), "type": None})
        if found:
            self["eval"] = {"rows": found, "note": None}

    def hours(self, rows: list[list[Cell]]) -> None:
        for r in rows:
            texts = [c.text for c in r]
            if any(c.head and ("曜日" in c.text or "場所" in c.text) for c in r) or not any(texts):
                continue
            name, day, time, place = [*texts, "", "", "", ""][:4]
            self["officeHour"].append({"name": name, "day": day, "time": time, "place": place})

    def route(self, r: list[Cell]) -> None:
        label = next((c.text for c in r if c.head), None)
        if label is None:
            return
        cells = [c for c in r if not c.head]
        value = " / ".join(c.text for c in cells if c.text)
        delivery = self["delivery"] or {"mode": "", "raw": "", "isMedia": False}
        if "単位数" not in label and "メディア授業科目" in label:
            self["delivery"] = delivery | {"isMedia": bool(value)}
        elif "単位数" not in label and "授業実施方法" in label:
            self["delivery"] = delivery | {"raw": value, "mode": "unknown"}
        elif "キーワード" in label and not any(w in label for w, _ in SIMPLE[:3]):
            self["keywords"] = ["\n".join(c.raw for c in cells if c.raw.strip())]
        elif field := next((f for w, f in SIMPLE if w in label), None):
            self[field] = value or self[field]
        elif "SDGs" in label:
            self["sdgs"] = [value]
        elif value and not any(w in label for w in REDUNDANT):
            self["extra"].append({"label": label, "text": value})


def extract_one(cd: str, html: str | None) -> Record:
    tree = Tree()
    tree.feed(BREAKS.sub("\n", html or ""))
    tree.close()
    record = Record(cd)
    for table in tree.root.all("table"):
        if table.above("table") is None and MOBILE_CLASS not in table.classes:
            record.table(table.classes, rows_of(table))
    return record


def extract_details(pages: DataFrame, code: str = "cd", html: str = "html") -> DataFrame:
    """Detail records of pages; splitting and classifying stay in column expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_pylist([extract_one(c, h) for c, h in zip(*[x.to_pylist() for x in part.columns], strict=True)], schema=ARROW)

    rows = pages.select(F.col(code).cast("string").alias("cd"), F.col(html).alias("html")).mapInArrow(run, RECORD)
    joined = lambda c: F.array_join(c, "\n")
    return rows.withColumns({
        "keywords": rules.split_keywords(joined("keywords")),
        "sdgs": rules.goal_numbers(joined("sdgs")),
        "eval": F.when(F.col("eval").isNotNull(), F.struct(F.transform("eval.rows", lambda r: F.struct(r["item"].alias("item"), r["weight"].alias("weight"), rules.assessment_type(r["item"]).alias("type"))).alias("rows"), F.col("eval.note").alias("note"))),
        "delivery": F.when(F.col("delivery").isNotNull(), F.struct(F.when(F.col("delivery.mode") == "unknown", rules.delivery_mode("delivery.raw")).otherwise(F.col("delivery.mode")).alias("mode"), F.col("delivery.raw").alias("raw"), F.col("delivery.isMedia").alias("isMedia"))),
    })


def block_text(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """(keep..., text): page text with block ends and breaks as line ends, scripts, styles and tags removed; all in the JVM."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    lined = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>", "\n")
    plain = F.regexp_replace(lined, r"(?s)<[^>]*>", "")
    for sign, text in ENTITIES:
        plain = F.replace(plain, F.lit(sign), F.lit(text))
    return pages.select(*keep, normalize_lines(plain).alias("text"))
