"""Main text of web pages through wrappers: union-free regular expressions inferred from pages of one host."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of all wrappers that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Distinct pages that must agree on a text before it counts as the host's own, outside and inside articles; least words of a text that tells pages apart.
SUPPORT, MAIN_SUPPORT, TELLING_WORDS = 3, 5, 8
#: Inside an article the host's own blocks go only while they are at most one part in so many of its text.
MAIN_SHARE = 5
#: Hosts that a task holds before it hands on their wrappers; elements nested deeper than DEPTH are seen as their ancestor's.
HOSTS, DEPTH, SALTS = 5000, 100, 32

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msup msub msqrt svg text tspan g object canvas".split()
)
CONTAINERS = set("div section article main header footer aside nav table tbody td ul ol body *".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end an open one of the same kind.
TURNS = {"li": "item", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option"}
MAIN = {"article", "main"}
#: Elements whose content is not the article.
ASIDE = set("head title nav footer aside form button dialog menu input select option legend fieldset".split()) | RAW
#: Words that name what is not the article, and words that say nothing, in classes, ids and roles. A name counts if it has one of the first and else only the second.
NOTES = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert alerts popup modal overlay newsletter subscribe subscription signup sidebar menu menus nav navbar navigation navi breadcrumb breadcrumbs footer pagination "
    "pager comment comments respond reply replies disqus share sharing social related recommended recommendations widget widgets toolbar login search complementary contentinfo".split()
)
NEUTRAL = set("area bar block bottom box buttons container content entry form group holder inner item items left links list main outer page panel post row section site the thread top right wrap wrapper zone".split())


class Node:
    """An element: ``aside`` by its tag, ``noted`` if only its class, id or role says so."""

    __slots__ = ("label", "name", "children", "aside", "main", "noted")

    def __init__(self, label: str, name: str, aside: bool, main: bool, noted: bool = False):
        self.label, self.name, self.children, self.aside, self.main, self.noted = label, name, [], aside, main, noted


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """(words of class, id and role, whether one of these names what is not the article, whether the element is hidden)."""
    words: set[str] = set()
    noted = hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.lower().split():
                parts = set(_WORDS.findall(token))
                words |= parts
                noted |= bool(parts & NOTES) and parts <= NOTES | NEUTRAL
        hidden |= name == "hidden" or name == "style" and bool(_HIDDEN.search(value))
    return words, noted, hidden


def parse(html: str) -> tuple[Node, bool]:
    """(tree, whether it has an article or main element): texts are strings, character references decoded."""
    root = Node("", "", False, False)
    open_, has_main = [root], False
    position, end = 0, len(html)
    while position < end:
        found = _TAG.search(html, position)
        upto = found.start() if found else end
        if upto > position:
            open_[-1].children.append(unescape(html[position:upto]))
        if not found:
            break
        position = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            for at in range(len(open_) - 1, 0, -1):
                if open_[at].name == name:
                    # what an inline element holds open does not close its blocks
                    if name not in INLINE or all(x.name in INLINE for x in open_[at:]):
                        del open_[at:]
                    break
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, position)
            position = closing.end() if closing else end
            continue
        if name == "p" or name not in INLINE:
            for at in range(len(open_) - 1, 0, -1):
                if open_[at].name == "p" or open_[at].name in HEADINGS or (name in TURNS and TURNS.get(open_[at].name) == TURNS[name]):
                    del open_[at:]
                    break
                if open_[at].name not in INLINE:
                    break
        above = open_[-1]
        attributes = found[3]
        words, noted, hidden = _names(attributes) if attributes else (set(), False, False)
        main = above.main or name in MAIN or "main" in words and name == "div"
        has_main |= name in MAIN
        aside = above.aside or name in ASIDE or (name == "header" and not above.main) or hidden
        node = Node(f"{name}.{'.'.join(sorted(words))}" if words else name, name, aside, main, noted)
        above.children.append(node)
        if name not in VOID and not attributes.endswith("/"):
            if len(open_) >= DEPTH:
                # deeper elements are read as part of their ancestor, or not at all if they are aside
                above.children.pop()
                if not aside or above.aside:
                    node.children = above.children
            if len(open_) < 10 * DEPTH:
                open_.append(node)
    _settle(root)
    return root, has_main


def _settle(root: Node) -> None:
    """What a class calls a note is one, unless it holds an article or main element or more than half of the page's text."""
    order, left = [], [root]
    while left:
        node = left.pop()
        order.append(node)
        left += [c for c in node.children if not isinstance(c, str)]
    size: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for node in reversed(order):
        below = [c for c in node.children if not isinstance(c, str)]
        own = 0 if node.aside else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        size[id(node)] = own + sum(size.get(id(c), 0) for c in below)
        holds[id(node)] = node.name in MAIN or any(holds.get(id(c), False) for c in below)
    whole = size[id(root)]
    for node in order:
        if node.noted and not node.aside and not holds[id(node)] and 2 * size[id(node)] <= whole:
            node.aside = True
        if node.aside:
            for c in node.children:
                if not isinstance(c, str):
                    c.aside = True


# ---- wrappers: [label, optional, repeated, items] for elements, ["#", optional, repeated, digest or None, pages] for texts,
# ---- ["*", optional, True, items] for repeated groups of several


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split())) >> 1


def content_key(root: Node) -> int:
    """One number for pages with the same content: that of their longer texts (if there are none, of all texts) outside asides."""
    texts, left = set(), [root]
    while left:
        node = left.pop()
        for child in node.children:
            if not isinstance(child, str):
                left.append(child)
            elif not node.aside and child.strip():
                texts.add(" ".join(child.split()))
    telling = [t for t in texts if t.count(" ") + 1 >= TELLING_WORDS] or texts
    return xxhash.xxh3_64_intdigest("\n".join(sorted(telling))) >> 1


def wrapper_of(node: Node) -> list:
    """The wrapper of one page: its elements, with adjacent repetitions folded into repeated groups."""
    items = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                items.append(["#", False, False, _digest(child), 1])
        else:
            items.append([child.label, False, False, wrapper_of(child)])
    return folded(items)


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "*" or [x[0] for x in a[3]] == [x[0] for x in b[3]])


def _alike(a: list, b: list) -> bool:
    """Whether neighbours repeat each other: containers must hold the same kinds of things for that."""
    if not _same(a, b):
        return False
    return a[0] == "#" or a[0].split(".")[0] not in CONTAINERS or {x[0] for x in a[3]} == {x[0] for x in b[3]}


def folded(items: list) -> list:
    """Tandem repeats of one to three items become one repeated item or group."""
    for width in (1, 2, 3):
        out: list = []
        i = 0
        while i < len(items):
            group = items[i : i + width]
            j = i + width
            while len(group) == width and j + width <= len(items) and all(_alike(x, y) for x, y in zip(group, items[j : j + width], strict=True)):
                group = [merged_item(x, y) for x, y in zip(group, items[j : j + width], strict=True)]
                j += width
            if j > i + width:
                if width == 1:
                    group[0][2] = True
                    out += group
                else:
                    out.append(["*", False, True, group])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merged_item(a: list, b: list) -> list:
    """One item for both: texts that differ become a slot, elements merge their content."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else None, a[4] + b[4]]
    return [a[0], a[1] or b[1], a[2] or b[2], merged(a[3], b[3])]


def merged(a: list, b: list) -> list:
    """Aligns two item lists; where they mismatch, what one lacks is optional, and new repetitions are folded.

    Each item of ``b`` takes the first later item of ``a`` that is like it; a's items
    jumped over are optional, and so are b's that find none.
    """
    places: dict[str, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x[0], []).append(i)
    out, at = [], 0
    for y in b:
        own = places.get(y[0], ())
        found = next((own[k] for k in range(bisect_left(own, at), len(own)) if _same(a[own[k]], y)), None)
        if found is None:
            # more of what was just matched is a repetition
            if out and _alike(out[-1], y):
                out[-1] = merged_item(out[-1], y)
                out[-1][2] = True
            else:
                out.append([y[0], True, *y[2:]])
            continue
        out += [[x[0], True, *x[2:]] for x in a[at:found]]
        out.append(merged_item(a[found], y))
        at = found + 1
    out += [[x[0], True, *x[2:]] for x in a[at:]]
    return folded(out)


def expression(items: list) -> str:
    """The wrapper as a regular expression over tags and #PCDATA."""
    out = []
    for x in items:
        inner = "#PCDATA" if x[0] == "#" and x[3] is None else "#text" if x[0] == "#" else expression(x[3]) if x[0] == "*" else f"<{x[0]}>{expression(x[3])}</{x[0].split('.')[0]}>"
        out.append(f"({inner})+" if x[2] and not x[1] else f"({inner})*" if x[2] else f"({inner})?" if x[1] else inner)
    return "".join(out)


def _slots(items: list) -> bool:
    return any(x[0] == "#" and x[3] is None or x[0] != "#" and _slots(x[3]) for x in items)


def _flat(items: list) -> list:
    """Groups opened; what an optional group holds is optional."""
    return [[y[0], y[1] or x[1], *y[2:]] if x[0] == "*" else y for x in items for y in (_flat(x[3]) if x[0] == "*" else [x])]


def main_text(html: str, wrapper: list | None) -> str:
    """The article's blocks, one a line.

    The page is read along its host's wrapper. Texts in regions that are not the
    article are left out; if the page has an article or main element, only that
    counts. A text is the host's own if all distinct pages have it in one place:
    neither the place nor what it stands in is optional or repeated. That takes a
    wrapper with slots and SUPPORT pages. Such texts go outside of articles. Inside,
    blocks go that consist of nothing else, on MAIN_SUPPORT pages, unless they are
    headings or more than one part in MAIN_SHARE of the article: then the pages are
    versions of one article.
    """
    root, has_main = parse(html)
    # a block's texts, and whether anything of it is the article's own
    blocks: list[tuple[list[str], list[bool]]] = [([], [])]
    templated = bool(wrapper) and _slots(wrapper)

    def walk(node: Node, items: list | None, everywhere: bool = True, heading: bool = False) -> None:
        items, at = _flat(items) if items else [], 0
        places: dict[str, list[int]] = {}
        for i, x in enumerate(items):
            places.setdefault(x[0], []).append(i)
        for child in node.children:
            label = "#" if isinstance(child, str) else child.label
            item, own = None, places.get(label) if label != "#" or child.strip() else None
            if own:
                # the next place of the kind, or again the first one
                i = own[k] if (k := bisect_left(own, at)) < len(own) else own[0]
                item, at = items[i], i if items[i][2] else i + 1
            if label == "#":
                if node.aside or has_main and not node.main:
                    continue
                constant = item is not None and templated and everywhere and not item[1] and not item[2] and item[3] is not None and item[3] == _digest(child)
                if node.main:
                    blocks[-1][0].append(child)
                    if child.strip():
                        blocks[-1][1].append(heading or not constant or item[4] < MAIN_SUPPORT)
                elif not constant or item[4] < SUPPORT:
                    blocks[-1][0].append(child)
                    blocks[-1][1].append(True)
            elif child.name == "br":
                blocks[-1][0].append(" ")
            else:
                block = child.name not in INLINE
                if block:
                    blocks.append(([], []))
                walk(child, item[3] if item else None, everywhere and item is not None and not item[1] and not item[2], heading or child.name in HEADINGS)
                if block:
                    blocks.append(([], []))

    walk(root, wrapper)
    lines = [(" ".join("".join(parts).split()), any(own)) for parts, own in blocks]
    hosts = sum(len(x) for x, own in lines if not own)
    few = MAIN_SHARE * hosts <= sum(len(x) for x, _ in lines)
    return "\n".join(x for x, own in lines if x and (own or not few))


# ---- Spark ----


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper): every distinct page of every host aligned into its host's wrapper, a JSON text.

    Of a host's pages with one ``content_key`` one counts. Tasks merge the pages they
    get by host; these wrappers are merged in two rounds, so a host with most of
    the pages is spread over many groups.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for html in batch.column(1):
                root = parse(html.as_py() or "")[0]
                keys.append(content_key(root))
                texts.append(json.dumps(wrapper_of(root)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["host", "key", "wrapper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = json.loads(text.as_py())
                held[host] = merged(held[host], own) if host in held else own
                if len(held) > HOSTS:
                    yield out()
                    held = {}
        if held:
            yield out()

    def join(key, table):
        texts = sorted(table.column("wrapper").to_pylist())
        own = json.loads(texts[0])
        for text in texts[1:]:
            own = merged(own, json.loads(text))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(own)], pa.string())})

    each = pages.select(host_of("url").alias("host"), "html").mapInArrow(single, "host string, key long, wrapper string")
    # in a fixed order, as what a wrapper becomes depends on it
    distinct = each.groupBy("host", "key").agg(F.min("wrapper").alias("wrapper")).sortWithinPartitions("host", "key")
    local = distinct.select("host", "wrapper").mapInArrow(run, "host string, wrapper string")
    local = local.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    return local.groupBy("host", "salt").applyInArrow(join, "host string, wrapper string").groupBy("host").applyInArrow(join, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, ...) with text and n_chars.

    Null html is empty; null urls and those without a host share the host ''; a
    page with no main text has an empty text; a very long page is read whole, its
    elements deeper than DEPTH as part of their ancestor; wrappers are broadcast
    only while all of them take at most BROADCAST_BYTES; rows appear as often as
    they came, and copies count once in their host's wrapper; an empty table gives
    an empty result; columns named text or n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    # kept, not written: a row a host in many small files is dearer than inferring a lost part again
    wrappers = infer(pages).persist(StorageLevel.MEMORY_AND_DISK)
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    rows, known = pages.select(*keep).withColumn("__own", host_of("url")), None
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
        wrappers.unpersist()
        rows = rows.withColumn("__wrapper", F.lit(None).cast("string"))
    else:
        side = wrappers.withColumnsRenamed({"host": "__host", "wrapper": "__wrapper"})
        rows = rows.join(side, rows["__own"] == side["__host"], "left").drop("__host")
    html_at = keep.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, list] = {}
        for batch in batches:
            texts = []
            for html, host, wrapper in zip(batch.column(html_at), batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1), strict=True):
                if host not in read:
                    if len(read) > 1000:
                        read.clear()
                    text = wrapper.as_py() if known is None else known.value.get(host)
                    read[host] = json.loads(text) if text else None
                texts.append(main_text(html.as_py() or "", read[host]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.select(*keep, "__own", "__wrapper").mapInArrow(run, pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
