"""HTML extraction by wrappers: union-free regular expressions over same-host pages.

Every page becomes a stream of structural tokens and text slots, read as a tree. A
wrapper is a concatenation of items: a text slot, an element with a body, or a group,
each of them once, optional, or repeated. The pages of a host are aligned into it one
after the other: where tokens disagree, what one side lacks becomes optional, and what
follows itself becomes a repeated group. Alignment is done within tasks first, then
over the distinct partial wrappers of a host, so a host with a third of all pages is
folded everywhere at once.

Each page is then matched against its host's wrapper, which tells for every text of the
page the wrapper's slot that made it; where a part of a page is not generated by the
wrapper, its texts' slots are told by the elements above them. Slots are summed over
the host's pages: texts, characters, characters in links, and the least and greatest
hash of a text. A slot is main text unless its elements name page furniture: by their tags,
or by ids, classes and roles that are furniture words or compounds of such and neutral words
only (so ``site-footer``, not ``has-sidebar``). Names never make furniture of html, body and
main, nor of what holds the page's only article or all of its text. If the
host has slots in an article or main element, only those count; otherwise those that
aren't mostly links, nor the same text on every page (unless all are: copies of one
page). A page that none of its host's main slots has text on is judged by itself.

Defined cases: null html and pages without text give an empty text; a null url, or
one without ``://``, is of the host ''; unclosed and misplaced tags are closed or
ignored as browsers do; what is nested deeper than DEPTH levels belongs to the element
at that depth, with its texts in order; character references without a semicolon are decoded where
HTML does so; a tag cut off at the end is dropped; repeated rows are extracted alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w:.-])(id|class|role|hidden|style)(?![\w:.-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Kinds of elements, and words in ids, classes and roles that name page furniture.
RAW = frozenset("script style noscript template iframe svg math object embed canvas audio video textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu fieldset head title".split())
#: Elements that are never furniture by their names, as they hold a page or its article.
CONTAINERS = frozenset("html body main".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond "
    "disqus share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar byline meta tags "
    "contentinfo complementary form skip dialog".split()
)
#: Words that compounds of furniture words may hold besides: place, form and number, but no content.
NEUTRAL_WORDS = frozenset(
    "site page main global primary secondary top bottom left right inner outer upper lower sticky fixed mobile desktop "
    "container wrapper wrap box block area section region bar list item items link links button buttons slot unit content-box "
    "widgets menus posts articles stories news wall policy icons text title count thread".split()
)
#: Those of the furniture words that name parts of the article itself where they stand in it.
ARTICLE_WORDS = frozenset("meta search tags byline results".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("main article articlebody post-content entry-content article-body story-body".split())
CLOSES = {
    "p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
#: Elements that an implied end tag does not reach out of.
SCOPES = frozenset("ul ol dl table article section main aside nav header footer div form body html td th blockquote".split())

MANY = 2  # most: 1 once, 2 repeated


def _furniture_name(name: str, inside: bool) -> bool:
    """Whether an id, a class or a role names page furniture: a furniture word, or a compound of such and neutral words only."""
    words = FURNITURE_WORDS - ARTICLE_WORDS if inside else FURNITURE_WORDS
    parts = [w for w in re.split(r"[-_\d]+", name) if w]
    return name in words or any(w in words for w in parts) and all(w in words or w in NEUTRAL_WORDS for w in parts)


def _key(tag: str, attrs: str, inside: bool = False) -> tuple[str, bool, bool]:
    """What an element is aligned by, whether it is furniture, and whether its names alone say so; inside: of an article."""
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attrs)} if attrs.strip(" /\t\n\r") else {}
    names = f"{found.get('id', '')} {found.get('class', '')} {found.get('role', '')}".lower().split()
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    by_tag = hidden or tag in FURNITURE_TAGS or tag == "header" and not inside
    by_name = tag not in CONTAINERS and any(_furniture_name(n, inside) for n in names)
    words = {w for n in names for w in (n, *re.split(r"[-_\d]+", n))}
    kind = "!" if by_tag or by_name else "*" if tag in MAIN_TAGS or not words.isdisjoint(MAIN_WORDS) else ""
    shown = ".".join(sorted({re.sub(r"\d+", "0", n) for n in names}))
    return kind + tag + ("." + shown if shown else ""), by_tag or by_name, by_name and not by_tag


#: Levels of the tree: what is nested deeper is read as part of the element at that depth, with its texts in order.
DEPTH = 100


class Node:
    __slots__ = ("key", "tag", "kids", "named", "inside", "depth")

    def __init__(self, key: str, tag: str, named: bool = False, above: Node | None = None):
        self.key, self.tag, self.kids, self.named = key, tag, [], named
        self.inside = bool(above and above.inside) or key[:1] == "*"
        self.depth = above.depth + 1 if above else 0
        if above is None:
            return
        # below DEPTH only furniture, and articles outside of others, are elements of their own
        if self.depth > DEPTH and not (key[:1] == "!" and above.key[:1] != "!" or key[:1] == "*" and not above.inside):
            self.kids = above.kids
            self.key = above.key
        else:
            above.kids.append(self)


def _relieved(root: Node) -> Node:
    """Furniture by name is none if it holds the page's only article, or all of the page's text: there the marked element with most of it loses its mark."""
    for _ in range(DEPTH):
        free, marked = [0, 0], {}  # characters outside furniture: all, and in articles; marked elements: (in articles, all)
        walk: list[tuple[Node, Node | None, bool, bool]] = [(root, None, False, False)]
        while walk:
            node, mark, hard, main = walk.pop()
            for kid in node.kids:
                if isinstance(kid, Node):
                    bad = kid.key[:1] == "!"
                    walk.append((kid, kid if bad and kid.named and mark is None else mark, hard or bad and not kid.named, main or kid.key[:1] == "*"))
                elif not hard:
                    if mark is None:
                        free[0] += len(kid[0])
                        free[1] += len(kid[0]) * main
                    else:
                        at = marked.setdefault(id(mark), [0, 0, mark])
                        at[0] += len(kid[0]) * main
                        at[1] += len(kid[0])
        best = max(marked.values(), key=lambda x: x[:2], default=None)
        if best is None or free[1] or free[0] and not best[0]:
            break
        best[2].key, best[2].named = best[2].key[1:], False
    return root


def parse(html: str | None) -> Node:
    """Tree of structural elements; kids are nodes or (text, characters in links)."""
    root = Node("", "")
    stack = [root]
    run: list[str] = []
    links = 0
    in_link = False
    html = html or ""

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1].kids.append((text, min(links, len(text))))
            run.clear()
        links = 0

    def put(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw)
            run.append(text)
            if in_link:
                links += len(text)

    at = 0
    find = TOKEN.search
    while m := find(html, at):
        put(html[at : m.start()])
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:].removesuffix("]]>"))
            continue
        end = m[0][1] == "/"
        if tag in RAW:
            if not end and not m[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
            run.append(" ")
            continue
        if tag == "br" or tag == "wbr":
            run.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        attrs = (m[2] if m[1] else m[4]) or ""
        if tag in INLINE:
            if tag == "a":
                in_link = not end
            if end:
                # an inline element that was furniture was put on the stack
                if len(stack) > 1 and stack[-1].tag == tag:
                    flush()
                    stack.pop()
                continue
            key, bad, named = _key(tag, attrs, stack[-1].inside)
            if not bad:
                continue
            flush()
            stack.append(Node(key, tag, named, stack[-1]))
            continue
        flush()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        in_link = False
        # a block ends an open paragraph; items end items of their own list
        closes = CLOSES.get(tag, frozenset())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes or stack[k].tag == "p":
                del stack[k:]
                continue
            if stack[k].tag in SCOPES and stack[k].tag not in closes:
                break
        key, _, named = _key(tag, attrs, stack[-1].inside)
        stack.append(Node(key, tag, named, stack[-1]))
    put(html[at:])
    flush()
    return _relieved(root)


# Items: ["#", least, most], [key, least, most, body], or ["()", least, most, body] for a group.


def _label(item: list) -> str:
    return item[0] if item[0] != "()" else "(" + " ".join(_label(x) for x in item[3]) + ")"


def _joined(a: list, b: list, least: int, most: int) -> list:
    out = [a[0], least, most]
    if len(a) > 3:
        out.append(align(a[3], b[3]))
    return out


def collapse(items: list[list]) -> list[list]:
    """What follows itself becomes a repeated item, or a repeated group of up to four items."""
    out: list[list] = []
    for item in items:
        if out and _label(out[-1]) == _label(item):
            out[-1] = _joined(out[-1], item, max(out[-1][1], item[1]), MANY)
        else:
            out.append(item)
    for width in (2, 3, 4):
        k = 0
        while k + 2 * width <= len(out):
            labels = [_label(x) for x in out[k : k + 2 * width]]
            if labels[:width] == labels[width:] and "(" not in "".join(labels):
                body = align(out[k : k + width], out[k + width : k + 2 * width])
                at = k + 2 * width
                while [_label(x) for x in out[at : at + width]] == labels[:width]:
                    body = align(body, out[at : at + width])
                    at += width
                out[k:at] = [["()", 1, MANY, body]]
            k += 1
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """One body for both: common items in order, the others optional."""
    if a == b:
        return a
    x, y = [_label(i) for i in a], [_label(i) for i in b]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(_joined(a[i], b[j], min(a[i][1], b[j][1]), max(a[i][2], b[j][2])))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], 0, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 0, *b[j][2:]])
            j += 1
    return collapse(out)


def skeleton(node: Node) -> list[list]:
    """The wrapper of one page, below node."""
    return collapse([["#", 1, 1] if isinstance(k, tuple) else [k.key, 1, 1, skeleton(k)] for k in node.kids])


def expression(body: list[list]) -> str:
    """A wrapper as a regular expression, to be read by people."""
    sign = {(0, 1): "?", (0, 2): "*", (1, 2): "+", (1, 1): ""}
    out = []
    for i in body:
        inner = "#TEXT" if i[0] == "#" else f"({expression(i[3])})" if i[0] == "()" else f"<{i[0].lstrip('!*')}>{expression(i[3])}</>"
        quant = sign[i[1], i[2]]
        out.append(f"({inner}){quant}" if quant and i[0] != "()" else inner + quant)
    return " ".join(out)


def matches(body: list[list], kids: list) -> bool:
    """Whether a wrapper's body generates a page's children."""

    def one(item: list, k: int) -> set[int]:
        if item[0] == "()":
            return run(item[3], k)
        if k >= len(kids):
            return set()
        kid = kids[k]
        if item[0] == "#":
            return {k + 1} if isinstance(kid, tuple) else set()
        return {k + 1} if not isinstance(kid, tuple) and kid.key == item[0] and matches(item[3], kid.kids) else set()

    def run(items: list[list], k: int) -> set[int]:
        at = {k}
        for item in items:
            new = set(at) if item[1] == 0 else set()
            front = {e for s in at for e in one(item, s)}
            new |= front
            while item[2] == MANY and front:
                front = {e for s in front for e in one(item, s)} - new
                new |= front
            at = new
        return at

    return len(kids) in run(body, 0)


class Slot:
    """A text slot of a wrapper: its number, and what its elements say: 0 furniture, 1 nothing, 2 in an article or main element."""

    __slots__ = ("number", "kind")

    def __init__(self, number: int, kind: int):
        self.number, self.kind = number, kind


def numbered(body: list[list], path: str = "", first: list[int] | None = None) -> list[tuple]:
    """(label, least, most, Slot or body) of a wrapper's items, with slots numbered in order."""
    first = first if first is not None else [0]
    out = []
    for item in body:
        if item[0] == "#":
            first[0] += 1
            out.append(("#", item[1], item[2], Slot(first[0] - 1, kind_of(path))))
        else:
            out.append((item[0], item[1], item[2], numbered(item[3], path if item[0] == "()" else f"{path}/{item[0]}", first)))
    return out


def kind_of(path: str) -> int:
    return 0 if "/!" in path else 2 if "/*" in path else 1


def _ends(item: tuple, kids: list, k: int, once: bool = False) -> dict[int, int]:
    """Where occurrences of an item that begin at k may end, with the place of each one's last begin."""
    if item[0] == "()":
        step = lambda at: _run(item[3], kids, at)[-1]
    elif item[0] == "#":
        step = lambda at: (at + 1,) if at < len(kids) and isinstance(kids[at], tuple) else ()
    else:
        step = lambda at: (at + 1,) if at < len(kids) and not isinstance(kids[at], tuple) and kids[at].key == item[0] else ()
    out: dict[int, int] = {}
    front = [k]
    while front:
        new = []
        for at in front:
            for e in step(at):
                if e > at and e not in out:
                    out[e] = at
                    new.append(e)
        front = new if item[2] == MANY and not once else []
    return out


def _run(items: list[tuple], kids: list, k: int) -> list[dict[int, int]]:
    """For every prefix of the items, where it may end if it begins at k, with where its last item then begins."""
    layers: list[dict[int, int]] = [{k: k}]
    for item in items:
        new: dict[int, int] = {}
        for at in layers[-1]:
            for e in _ends(item, kids, at):
                new.setdefault(e, at)
            if not item[1]:
                new.setdefault(at, at)
        layers.append(new)
    return layers


def matched(items: list[tuple], kids: list, path: str = "") -> Iterator[tuple[int, int, str, int]]:
    """(slot, kind, text, characters in links) of a page's texts in order, by the wrapper's items that generate them."""
    layers = _run(items, kids, 0)
    if len(kids) not in layers[-1]:
        yield from loose(kids, path)
        return
    spans, e = [], len(kids)
    for k in range(len(items), 0, -1):
        spans.append((items[k - 1], layers[k][e], e))
        e = layers[k][e]
    for item, lo, hi in reversed(spans):
        if item[0] == "()":
            ends, cuts = _ends(item, kids, lo), [hi]
            while cuts[-1] != lo:
                cuts.append(ends[cuts[-1]])
            for a, b in zip(cuts[:0:-1], cuts[-2::-1]):
                yield from matched(item[3], kids[a:b], path)
            continue
        for kid in kids[lo:hi]:
            if item[0] == "#":
                yield item[3].number, item[3].kind, kid[0], kid[1]
            else:
                yield from matched(item[3], kid.kids, f"{path}/{kid.key}")


def loose(kids: list, path: str) -> Iterator[tuple[int, int, str, int]]:
    """The same for what the wrapper doesn't generate: slots are negative and told by the elements above."""
    for kid in kids:
        if isinstance(kid, tuple):
            yield -1 - zlib.crc32(path.encode("utf-8", "surrogatepass")) % (1 << 30), kind_of(path), kid[0], kid[1]
        else:
            yield from loose(kid.kids, f"{path}/{kid.key}")


def _host(url: str | None) -> str:
    m = re.match(r".*?://([^/?#]*)", url or "", re.S)
    return m[1].translate(_AZ) if m else ""


_AZ = {i: i + 32 for i in range(65, 91)}


def _partials(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers of the hosts in a task."""
    wrappers: dict[str, list] = {}
    for pdf in parts:
        for url, html in zip(pdf["url"], pdf["html"]):
            host, own = _host(url), skeleton(parse(html))
            wrappers[host] = align(wrappers[host], own) if host in wrappers else own
    yield pd.DataFrame([(h, json.dumps(w, separators=(",", ":"))) for h, w in wrappers.items()], columns=["host", "wrapper"])


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper for each host and part, from rows sorted by them."""
    last, wrapper = None, []
    for pdf in parts:
        for host, part, text in zip(pdf["host"], pdf["part"], pdf["wrapper"]):
            if (host, part) != last:
                if last:
                    yield pd.DataFrame([(last[0], json.dumps(wrapper, separators=(",", ":")))], columns=["host", "wrapper"])
                last, wrapper = (host, part), json.loads(text)
            else:
                wrapper = align(wrapper, json.loads(text))
    if last:
        yield pd.DataFrame([(last[0], json.dumps(wrapper, separators=(",", ":")))], columns=["host", "wrapper"])


#: Parts in which a host's partial wrappers are folded before these are folded into one.
PARTS = 64


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): a row for each host of pages (url, html)."""
    found = pages.select("url", "html").mapInPandas(_partials, "host string, wrapper string")
    for part in (F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)), F.lit(0).cast("long")):
        split = found.distinct().withColumn("part", part)
        found = split.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInPandas(_fold, "host string, wrapper string")
    return found


_SLOTS = "slot array<int>, kind array<int>, text array<string>, links array<int>"


def slots_of(wrapper: pd.Series, html: pd.Series) -> pd.DataFrame:
    """Slot, kind, text and characters in links of every text of a page, by its host's wrapper."""
    known: dict[str, list[tuple]] = {}
    out = []
    for w, page in zip(wrapper, html):
        if w not in known:
            known[w] = numbered(json.loads(w))
        found = list(matched(known[w], parse(page).kids))
        out.append(tuple(map(list, zip(*found))) if found else ([], [], [], []))
    return pd.DataFrame({"slot": [x[0] for x in out], "kind": [x[1] for x in out], "text": [x[2] for x in out], "links": [x[3] for x in out]})


def host_column(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def main_slots(matches: DataFrame) -> DataFrame:
    """host, main (slots of main text) from the sums of every host's slots."""
    each = matches.select("host", F.explode("slots").alias("s")).select("host", "s.*", F.xxhash64("s.text").alias("h"), F.length("s.text").alias("size"))
    sums = each.where("kind > 0").groupBy("host", "slot").agg(
        F.max("kind").alias("kind"), F.count(F.lit(1)).alias("texts"), F.sum("size").alias("chars"), F.sum("links").alias("links"), (F.min("h") == F.max("h")).alias("same")
    )
    own = Window.partitionBy("host")
    pool = sums.withColumn("most", F.max("kind").over(own)).where((F.col("kind") == 2) | (F.col("most") == 1) & (2 * F.col("links") < F.col("chars")))
    fixed = (F.col("kind") == 1) & F.col("same") & (F.col("texts") >= 3)
    return pool.groupBy("host").agg(F.collect_list(F.when(~fixed, F.col("slot"))).alias("free"), F.collect_list("slot").alias("all")).select(
        "host", F.when(F.size("free") > 0, F.col("free")).otherwise(F.col("all")).alias("main")
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with text and n_chars instead of html; columns of pages named text or n_chars give way to them."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    wrappers = stored(infer_wrappers(pages), "wrappers")
    rows = pages.select(F.struct(*kept).alias("row"), host_column(F.col("url")).alias("host"), F.col("html").alias("page"))
    placed = rows.join(checked_broadcast(wrappers), "host", "left").withColumn("found", F.pandas_udf(slots_of, _SLOTS)(F.coalesce("wrapper", F.lit("[]")), "page"))
    slots = F.arrays_zip("found.slot", "found.kind", "found.text", "found.links")
    matches = stored(placed.select("host", "row", slots.alias("slots")), "matches")
    main = stored(main_slots(matches.select("host", "slots")), "main")
    s = matches.join(checked_broadcast(main), "host", "left")
    by_host = F.filter("slots", lambda x: F.array_contains("main", x["slot"]))
    inside, plain = F.filter("slots", lambda x: x["kind"] == 2), F.filter("slots", lambda x: (x["kind"] == 1) & (2 * x["links"] < F.length(x["text"])))
    own = F.when(F.size(inside) > 0, inside).otherwise(plain)
    chosen = F.when(F.size(F.coalesce(by_host, F.array())) > 0, by_host).otherwise(own)
    out = s.select("row", F.array_join(F.transform(chosen, lambda x: x["text"]), " ").alias("text"))
    return out.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
