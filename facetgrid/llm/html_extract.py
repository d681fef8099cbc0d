"""Main text of web pages by wrappers inferred per host.

A page becomes a well-formed tree of block elements and text slots (inline tags
melt into the text, implied end tags are supplied).  Pages of one host are
aligned one after another into a wrapper, a union-free regular expression in
tree form: adjacent repetitions fold into one repeated group, elements that some
pages lack become optional, texts that differ become slots, and texts that are
always the same stay constant (long ones by length and digest); a repeated group
keeps the texts that every page has in it.  Children are
aligned in near-linear time: elements that stand once in both lists, then the k-th
of a kind with the k-th, from the front or the back, each time a longest ascending
run of the pairs.  Nothing recurses, so pages may nest as deep as they like, and
nothing of a wrapper is left out: it has a node for each kind of element that some
page of the host has at a place.  Wrappers of parts of a host are aligned like
pages, so each task folds the pages it has and only partial wrappers move; a hot
host's parts are merged in two steps.  All pages take part.

Extraction aligns a page with its host's wrapper, which decides on the main region
by text mass (the characters of its slots over all pages): from the root down, the
element that holds at least half of its parent's mass, as long as it is no repeated
group, no paragraph, and its parent is no running text (paragraphs or headings that
differ).  Headings passed on the way belong to the text.  Boilerplate (menus, headers, footers, sidebars,
notices, adverts, forms, comments, by element or by whole words of class, role or
id) has no mass.  Article and main elements only refine this choice: one around the
region is taken whole; those within it are taken instead of it if they hold half of
its mass; one elsewhere counts if its pages have at least half as much text in it
as the region's pages in theirs, or if the wrapper does not know it.  Of a main region boilerplate is
left out and what is a single constant of all pages that have the region, at least three.  In it an id, or a word that may
as well name a part of the text, tells of boilerplate only where at least three of
the host's pages share all texts of the element.  Names of html, body, article,
main and headings never do.
Where the page has no such region, the main text is what lies outside boilerplate
and is no constant of three pages or more.  A host of fewer than three pages, or
whose texts outside boilerplate are all constant (copies of one page), says
nothing; its pages are read by elements and classes alone, nothing but boilerplate
left out.

Nulls and odd input: a null or empty page gives an empty text; a null URL is the
host ""; broken markup (unclosed, stray or cut tags) is read as browsers do in
the common cases, else as text; a very long page is one row like any other.
Repeated rows are read each; an empty table gives an empty result; columns whose
names clash with an output column are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgrid.llm.common import materialize
from facetgrid.llm.components import split_join
from facetgrid.llm.url_filter import split_url

#: Element kinds.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li listing main menu nav ol p pre section summary table tbody td tfoot th thead tr ul select option button label textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|object|title|textarea|canvas|noframes"
BOILER_TAGS = frozenset("head nav header footer aside form menu button select option label fieldset dialog textarea".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal comment comments reply replies discussion disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing social related newsletter subscribe subscription login signup pagination pager widget".split())
#: Words that name parts of texts as well: within a main region they need the host's support.
UNSURE_WORDS = frozenset("banner consent discussion header menu modal notice notices promotion related replies reply social sponsor widget".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Their classes tell of the page's theme.
WHOLE = frozenset(("html", "body", *MAIN_TAGS))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are parts of running text, so never a main region of their own.
PARTS = frozenset((*HEADINGS, *"p li dt dd pre listing blockquote figcaption caption summary tr td th thead tbody tfoot hgroup".split()))
#: Elements around the whole page.
AROUND = frozenset(("", "html", "body"))
MAIN_WORDS = frozenset(("articlebody", "article-body", "entry-content", "post-content", "main-content"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^>\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
CLASS = re.compile(r"(?<![-\w])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Texts longer than LONG are told apart by length and digest; SURE pages make a constant.
LONG, SURE = 24, 3
#: What a wrapper's node opens.
HEADING, REGION = 1, 2


def signature(name: str, attributes: str) -> str:
    """Element name and the words of its class, role, itemprop and (after #) id."""
    if name in WHOLE or not attributes:
        return name
    found = ((m[1].lower() == "id", w) for m in CLASS.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split())
    return ".".join([name, *sorted({f"#{w}" if by_id else w for by_id, w in found if not any(c.isdigit() for c in w)})])


def is_named(word: str) -> bool:
    """A boilerplate word, or a compound of nothing else."""
    return word in BOILER_WORDS or word not in MAIN_WORDS and BOILER_WORDS.issuperset(re.split(r"[-_]", word))


def is_boiler(sig: str, inside: bool = False) -> bool:
    """``inside``: whether the name alone is enough within a main region."""
    name, *words = sig.split(".")
    if name in BOILER_TAGS or name in WHOLE or name in HEADINGS:
        return name in BOILER_TAGS
    if inside:
        return any(w not in UNSURE_WORDS and is_named(w) for w in words)
    return any(is_named(w.removeprefix("#")) for w in words)


def is_main(sig: str) -> bool:
    name, *words = sig.split(".")
    return name in MAIN_TAGS or not MAIN_WORDS.isdisjoint(w.removeprefix("#") for w in words)


def parse(page: str) -> list:
    """[signature, children] of the root; a text leaf is a string."""
    root: list = ["", []]
    stack, names = [root], [""]
    places: dict[str, list[int]] = {}  # where on the stack the open elements of a name are
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                stack[-1][1].append(text)
            buffer.clear()

    def close(k: int) -> None:
        flush()
        for name in names[k:]:
            places[name].pop()
        del stack[k:], names[k:]

    def nearest(*of: str) -> int:
        return max((places[n][-1] for n in of if places.get(n)), default=0)

    last = 0
    for m in TOKEN.finditer(page):
        if m.start() > last:
            buffer.append(page[last : m.start()])
        last = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            at = nearest(name)
            if at:
                close(at)
            elif name in BLOCKS:
                flush()
            continue
        sig = signature(name, m[4])
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img"):
                buffer.append(" ")
            continue
        if name not in BLOCKS and not is_boiler(sig, inside=True):
            continue
        if name in BLOCKS:
            at = nearest("p", "table", "td", "th", "button")
            if at and names[at] == "p":
                close(at)
        if name in CLOSES:
            stop = nearest(*STOPS[name])
            inner = [k for n in CLOSES[name] for k in (places.get(n) or ())[-1:] if k > stop]
            if inner and name == "tr":  # a row ends the row before it and all its cells
                close(min(places[n][bisect_right(places[n], stop)] for n in CLOSES[name] if places.get(n) and places[n][-1] > stop))
            elif inner:
                close(max(inner))
        flush()
        node = [sig, []]
        stack[-1][1].append(node)
        if not m[4].endswith("/") or name in BLOCKS:
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
            names.append(name)
    if last < len(page):
        buffer.append(page[last:])
    flush()
    return root


# A wrapper node is [signature, optional, repeated, pages, constants, children, seen, mass]:
# a text has signature "#", the set of its constants (see ``key``), which is empty
# if it is a slot and has several if it is repeated, and its characters over all pages
# as mass; ``seen`` has what ``prepare`` found.


def key(text: str) -> str:
    """A text as constants hold it: a long one by length and digest."""
    return text if len(text) <= LONG else f"{len(text)}\n{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def lift(page: list) -> list:
    """A page's tree as the wrapper of that page alone, repetitions folded."""
    top = [page[0], False, False, 1, None, [], None, 0]
    below = [(page, top)]
    for node, own in below:  # parents first
        for c in node[1]:
            if isinstance(c, str):
                own[5].append(["#", False, False, 1, {key(c)}, [], None, len(c)])
            else:
                child = [c[0], False, False, 1, None, [], None, 0]
                own[5].append(child)
                below.append((c, child))
    for _, own in reversed(below):
        if len(own[5]) > 1:
            own[5] = fold(own[5])
    return top


def folding(signatures: list[str]) -> list[list]:
    """Adjacent repetitions of one to three siblings as [signature, positions, repeated], one for each sibling of the group."""
    units = [[s, [k], False] for k, s in enumerate(signatures)]
    for width in (1, 2, 3):
        out: list[list] = []
        k, n = 0, len(units)
        while k < n:
            group, following = units[k : k + width], k + width
            if len(group) == width and any(u[0] != "#" for u in group):
                while following + width <= n and all(units[following + i][0] == group[i][0] for i in range(width)):
                    for i in range(width):
                        group[i][1] += units[following + i][1]
                    following += width
            if following > k + width:
                for u in group:
                    u[2] = True
                out += group
                k = following
            else:
                out.append(units[k])
                k += 1
        units = out
    return units


def fold(children: list) -> list:
    """Fold adjacent repetitions into one repeated group."""
    out = []
    for _, at, repeated in folding([c[0] for c in children]):
        whole = united([children[k] for k in at], one_page=True)
        whole[2] = whole[2] or repeated
        out.append(whole)
    return out


def united(nodes: list, one_page: bool = False) -> list:
    """All merged, neighbours first, so that each takes part in few merges."""
    while len(nodes) > 1:
        nodes = [merge(*nodes[k : k + 2], one_page) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0]


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, in order of their first numbers, whose second numbers ascend."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        if k:
            before[n] = ends[k - 1]
        tops[k : k + 1], ends[k : k + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions with equal signatures, ascending in both, in near-linear time."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < len(a) - low and tail < len(b) - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    high_a, high_b = len(a) - tail, len(b) - tail
    pairs = [(k, k) for k in range(low)]
    if low < high_a and low < high_b:
        once: list[dict[str, int]] = [{}, {}]
        for places, own, high in zip(once, (a, b), (high_a, high_b), strict=True):
            for k in range(low, high):
                places[own[k]] = -1 if own[k] in places else k
        i, j = low, low
        fixed = ascending([(k, once[1].get(s, -1)) for s, k in once[0].items() if k >= 0 and once[1].get(s, -1) >= 0])
        for u, v in [*fixed, (high_a, high_b)]:
            pairs += counted(a, b, i, u, j, v)
            if u < high_a:
                pairs.append((u, v))
            i, j = u + 1, v + 1
    return pairs + [(high_a + t, high_b + t) for t in range(tail)]


def counted(a: list[str], b: list[str], i: int, u: int, j: int, v: int) -> list[tuple[int, int]]:
    """The k-th of a signature in ``a[i:u]`` with the k-th in ``b[j:v]``, counted from the front or the back, whichever gives more."""
    if i >= u or j >= v:
        return []
    in_a: dict[str, list[int]] = {}
    in_b: dict[str, list[int]] = {}
    for k in range(i, u):
        in_a.setdefault(a[k], []).append(k)
    for k in range(j, v):
        in_b.setdefault(b[k], []).append(k)
    both = [(in_a[s], in_b[s]) for s in in_a if s in in_b]
    front = ascending(sorted(p for x, y in both for p in zip(x, y, strict=False)))
    if all(len(x) == len(y) for x, y in both):
        return front
    back = ascending(sorted(p for x, y in both for p in zip(reversed(x), reversed(y), strict=False)))
    return back if len(back) > len(front) else front


def merge(a: list, b: list, one_page: bool = False) -> list:
    """Align two wrappers of one signature, into ``a``; what only one has becomes optional.

    ``one_page``: both are of the same pages, which count once.
    """
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x[1], x[2], x[6] = x[1] or y[1], x[2] or y[2], None
        x[3] = max(x[3], y[3]) if one_page else x[3] + y[3]
        x[7] += y[7]
        if x[0] == "#" and x[4] != y[4]:
            if one_page:
                x[2] = True
                x[4] |= y[4]
            else:
                x[4] &= y[4]
        own, other = x[5], y[5]
        if not own and not other:
            continue
        children = []
        i = j = 0
        for u, v in [*align([c[0] for c in own], [c[0] for c in other]), (len(own), len(other))]:
            for c in [*own[i:u], *other[j:v]]:
                c[1] = True
                children.append(c)
            if u < len(own):
                todo.append((own[u], other[v]))
                children.append(own[u])
            i, j = u + 1, v + 1
        x[5] = children
    return a


def dump(wrapper: list) -> str:
    """A wrapper as text: its nodes, parents first, each with its number of children."""
    flat, stack = [], [wrapper]
    while stack:
        node = stack.pop()
        flat.append([node[0], int(node[1]) + 2 * int(node[2]), node[3], sorted(node[4] or ()), len(node[5]), node[7]])
        stack += reversed(node[5])
    return json.dumps(flat, ensure_ascii=False)


def load(text: str) -> list:
    top: list = ["", False, False, 0, None, [], None, 0]
    open_nodes = [(top, 1)]
    for sig, flags, pages, constants, n, mass in json.loads(text):
        while not open_nodes[-1][1]:
            open_nodes.pop()
        parent, left = open_nodes.pop()
        open_nodes.append((parent, left - 1))
        node = [sig, bool(flags & 1), bool(flags & 2), pages, set(constants) if sig == "#" else None, [], None, mass]
        parent[5].append(node)
        open_nodes.append((node, n))
    return top[5][0]


def shared(text: str, known: list | None, pages: int) -> bool:
    """Whether the text is a constant of at least so many pages (and of SURE); with ``pages`` (a main region's) a single one."""
    return known is not None and known[3] >= max(pages, SURE) and not (pages and known[2]) and bool(known[4]) and key(text) in known[4]


def prepare(wrapper: list) -> None:
    """What each node says.

    Whether texts outside boilerplate differ, or too few pages have them to tell,
    outside and inside a main region; and whether it opens one: ``REGION``, or
    ``HEADING`` for a heading that belongs to the region.
    """
    nodes = [wrapper]
    for node in nodes:
        nodes += node[5]
    mass: dict[int, int] = {}  # characters of slots outside boilerplate
    named: dict[int, int] = {}  # and those within article or main elements
    for node in reversed(nodes):
        if node[0] == "#":
            differs = node[2] or not node[4] or node[3] < SURE
            node[6] = (differs, differs, 0)
            known = sum(int(k.partition("\n")[0]) if "\n" in k else len(k) for k in node[4]) if node[3] >= SURE else 0
            mass[id(node)], named[id(node)] = max(0, node[7] - known * node[3]), 0
        else:
            main = is_main(node[0])
            node[6] = (*(not is_boiler(node[0], bool(i)) and any(c[6][i or main] for c in node[5]) for i in (0, 1)), 0)
            mass[id(node)] = 0 if is_boiler(node[0]) else sum(mass[id(c)] for c in node[5])
            named[id(node)] = mass[id(node)] if main else min(mass[id(node)], sum(named[id(c)] for c in node[5]))
    path, titles = heaviest(wrapper, mass)
    region = path[-1]
    around = next((n for n in path if is_main(n[0])), None)
    if around is None and region[0] not in AROUND and 2 * named[id(region)] < mass[id(region)]:
        around = region
        for node in titles:
            node[6] = (*node[6][:2], HEADING)
    if around is not None:
        around[6] = (*around[6][:2], REGION)
    own = mass[id(region)] / max(1, region[3])
    on_path = {id(n) for n in path}
    todo = [(wrapper, False)]
    for node, within in todo:  # article and main elements on the way to the region, in it, or as full as it
        if is_main(node[0]) and node[6][0] and (within or id(node) in on_path or 2 * mass[id(node)] >= own * node[3]):
            node[6] = (*node[6][:2], REGION)
        todo += [(c, within or node is region) for c in node[5] if c[0] != "#"]


def heaviest(wrapper: list, mass: dict[int, int]) -> tuple[list[list], list[list]]:
    """(nodes from the root to the element that holds most of the mass, headings passed on the way)."""
    path, titles, node = [wrapper], [], wrapper
    while True:
        filled = [c for c in node[5] if c[0] != "#" and mass[id(c)]]
        kinds = [c[0].split(".")[0] for c in filled]
        if not filled or node[0] not in AROUND and any(k == "p" or k in HEADINGS for k in kinds):
            return path, titles
        best = max(range(len(filled)), key=lambda k: mass[id(filled[k])])
        if filled[best][2] or kinds[best] in PARTS or 2 * mass[id(filled[best])] < mass[id(node)]:
            return path, titles
        titles += [c for c, k in zip(filled[:best], kinds, strict=False) if k in HEADINGS]
        node = filled[best]
        path.append(node)


def varies(wrapper: list) -> bool:
    if wrapper[6] is None:
        prepare(wrapper)
    return wrapper[6][0]


class Paired:
    """A page's elements with the wrapper's nodes for them and what follows from both."""

    def __init__(self, page: list, wrapper: list | None) -> None:
        self.page = page
        self.known: dict[int, list] = {}  # for each element, those of its children
        order = [(page, wrapper)]
        for node, own in order:  # parents first
            children = self.known[id(node)] = matched(node, own)
            order += [(c, k) for c, k in zip(node[1], children, strict=True) if not isinstance(c, str)]
        self.all_shared: dict[int, bool] = {}
        self.has_main: dict[int, bool] = {}
        for node, _ in reversed(order):
            pairs = list(zip(node[1], self.known[id(node)], strict=True))
            self.all_shared[id(node)] = all(shared(c, k, 0) if isinstance(c, str) else self.all_shared[id(c)] for c, k in pairs)
            self.has_main[id(node)] = any(not isinstance(c, str) and not is_boiler(c[0]) and (opens_main(c[0], k) == REGION or self.has_main[id(c)]) for c, k in pairs)

    def left_out(self, node: list, region: int) -> bool:
        """Whether an element is boilerplate: within a main region by a sure name, or by any name if the host's pages share its texts."""
        return is_boiler(node[0], inside=region > 0) or region > 0 and is_boiler(node[0]) and self.all_shared[id(node)]

    def children(self, node: list, inside: bool, region: int) -> list:
        return [(c, k, inside, region) for c, k in zip(reversed(node[1]), reversed(self.known[id(node)]), strict=True)]

    def texts(self) -> Iterator[str]:
        """Texts in page order, without the host's constants, from main regions or, where there is none, from all.

        ``region``: in a main region, the pages that have it (1 if unknown).
        """
        todo: list = self.children(self.page, not self.has_main[id(self.page)], 0)
        while todo:
            child, known, inside, region = todo.pop()
            if isinstance(child, str):
                if inside and not shared(child, known, region):
                    yield child
            elif not self.left_out(child, region):
                opens = not inside and self.has_main[id(self.page)] and opens_main(child[0], known) > 0
                todo += self.children(child, inside or opens, (known[3] if known else 1) if opens else region)
            elif region and child[0].split(".")[0] == "header":
                yield from headings(child)


def opens_main(sig: str, known: list | None) -> int:
    if known is None:
        return REGION if is_main(sig) else 0
    varies(known)
    return known[6][2]


def matched(page: list, wrapper: list | None) -> list:
    """The wrapper's child for each of the page's children (None if it has none)."""
    out: list = [None] * len(page[1])
    if wrapper is None or not out or not wrapper[5]:
        return out
    if len(out) == len(wrapper[5]) == 1:
        sig = "#" if isinstance(page[1][0], str) else page[1][0][0]
        return [wrapper[5][0]] if sig == wrapper[5][0][0] else out
    units = folding(["#" if isinstance(c, str) else c[0] for c in page[1]])
    own = [c[0] for c in wrapper[5]]
    pairs = dict(align([u[0] for u in units], own))
    places: dict[str, list[int]] = {}
    if len(pairs) < len(units):
        for k, s in enumerate(own):
            places.setdefault(s, []).append(k)
    at = 0
    for n, (sig, members, _) in enumerate(units):
        j = pairs.get(n)
        if j is None and sig in places:  # the next of its kind, else the last before
            k = bisect_left(places[sig], at)
            j = places[sig][k if k < len(places[sig]) else k - 1]
        elif j is not None:
            at = j
        if j is not None:
            for m in members:
                out[m] = wrapper[5][j]
    return out


def headings(node: list) -> Iterator[str]:
    """An article's own header keeps its headings."""
    todo = [(c, False) for c in reversed(node[1])]
    while todo:
        child, inside = todo.pop()
        if isinstance(child, str):
            if inside:
                yield child
        elif not is_boiler(child[0], inside=True):
            todo += [(c, inside or child[0].split(".")[0] in HEADINGS) for c in reversed(child[1])]


def main_text(page: str, wrapper: list | None) -> str:
    host = wrapper if wrapper is not None and wrapper[3] >= SURE and varies(wrapper) else None
    return " ".join(Paired(parse(page), host).texts())


def learn_wrappers(pages: DataFrame, flush_at: int = 20_000, salts: int = 256) -> DataFrame:
    """(host, wrapper): one wrapper for each host, from all its pages.

    ``flush_at``: hosts a task holds at once before it hands on what it has.
    """
    schema = "host string, salt int, wrapper string"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[int, list]]] = {}  # wrappers of 2**rank pages, each rank once
        context = TaskContext.get()
        salt = (context.partitionId() if context else 0) % salts

        def out() -> pd.DataFrame:
            return pd.DataFrame({"host": list(held), "salt": salt, "wrapper": [dump(united([w for _, w in ranked])) for ranked in held.values()]})

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                rank, new, own = 0, lift(parse(page or "")), held.setdefault(host, [])
                while own and own[-1][0] == rank:
                    rank, new = rank + 1, merge(own.pop()[1], new)
                own.append((rank, new))
                if len(held) >= flush_at:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def joined(group: pd.DataFrame, *, last: bool = False) -> pd.DataFrame:
        whole = united([load(w) for w in sorted(group["wrapper"])])
        whole = "" if last and whole[3] < SURE else dump(whole)  # too few pages say nothing
        return pd.DataFrame({"host": [group["host"].iloc[0]], "salt": [int(group["salt"].iloc[0])], "wrapper": [whole]})

    rows = pages.select(split_url(F.col("url"))[0].alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    parts = rows.mapInPandas(partial, schema)
    salted = parts.groupBy("host", "salt").applyInPandas(lambda group: joined(group), schema)
    return salted.groupBy("host").applyInPandas(lambda group: joined(group, last=True), schema).where("wrapper <> ''").select("host", "wrapper")


def extract(pages: DataFrame, wrappers: DataFrame | None = None, broadcast_mb: int = 32) -> DataFrame:
    """``pages`` without html, with text and n_chars.

    Wrappers are broadcast up to ``broadcast_mb``; above it the join on the host
    is a shuffle join, in which the rows of hot hosts stay where they are.
    """
    wrappers = materialize(learn_wrappers(pages), "wrappers") if wrappers is None else wrappers
    mb = (wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) / 2**20
    side = wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    kept = [f for f in pages.schema.fields if f.name.lower() not in ("html", "text", "n_chars", "_host", "_wrapper")]
    rows = pages.select(*[F.col(f"`{f.name}`") for f in kept], "html").withColumn("_host", split_url(F.col("url"))[0])
    joined = rows.join(F.broadcast(side), "_host", "left") if mb <= broadcast_mb else split_join(rows, side, "_host", "left")
    out = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list | None] = {None: None}
        for batch in batches:
            found = []
            codes = pc.dictionary_encode(batch.column(batch.num_columns - 1))
            names = codes.dictionary.to_pylist()
            for page, k in zip(batch.column(batch.num_columns - 2), codes.indices.to_pylist(), strict=True):
                name = None if k is None else names[k]
                if name not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[name] = load(name)
                found.append(main_text(page.as_py() or "", known[name]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.string())], names=out.names)

    read = joined.select(*[F.col(f"`{f.name}`") for f in kept], "html", "_wrapper").mapInArrow(run, out)
    return read.withColumn("n_chars", F.length("text").cast("long"))
