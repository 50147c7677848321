"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page is read as a tree of block elements (named by tag and the words of class, id and role) and text slots. A run of
equal elements, and a block of siblings that repeats, is one repeated group. The trees of a host's pages are aligned one
after another, level by level: equal elements stay, a mismatch that is one more turn of a repeated group joins it, any
other mismatch makes an optional group; a text that is the same on all pages stays template text, one that differs
becomes a slot. Groups follow one another and are never alternatives, so the expression is union-free.

Every page is then matched against its host's wrapper, and read with what the wrapper knows of each of its elements: how
much prose it holds on the host's pages, how much of that lies in links, and whether it is the same on all pages.
Starting at the root, the reader goes down to the element that holds most of the slots' prose, and stops where a heading
or the prose of several elements stands; names such as ``article`` or ``nav`` only weigh that prose. Inside, furniture
(by element or marking word) and blocks that are the same on three pages or more, where the rest differs, are left out.
Elements that the wrapper does not know are read by what the page itself says of them.

Wrappers grow in the tasks that read the pages, then meet by (host, salt) and by host, so what meets in one task is one
wrapper a task, whatever share of the pages a host has. A level of over ``LEVEL`` groups is generalised: rare elements
lose their marking words, and equal ones join. Elements nested deeper than ``DEPTH`` count as part of their ancestor.

Null html gives an empty text; null urls share the host ''. Repeated rows are extracted one by one; other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sized_join, trimmed, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names by their part in a page.
RAW = frozenset("script style textarea title template noscript iframe svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog head fieldset".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Elements that hold a block of text; the reader does not go down into one, and template text is not judged inside.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th caption figcaption address summary".split())
#: Words of a class, id or role that mark furniture.
MARKED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

DEPTH, LEVEL, TURNS = 60, 128, 8
#: Pages on which a text must be the same to be template text.
SAME = 3
#: Hosts that a task holds before it gives its wrappers away.
HOSTS = 500
#: Bytes of wrappers that may be broadcast.
BROADCAST_BYTES = 32 << 20


def tokens(html: str) -> Iterator[tuple[str, str]]:
    """(kind, value): open tags ``name.words``, close tags ``name``, and text, raw elements left out."""
    at, raw = 0, None
    for m in TOKEN.finditer(html):
        if raw:
            if not (m[1] == "/" and m[2] and m[2].lower() == raw):
                continue
            raw = None
        elif m.start() > at:
            yield "text", html[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name
            continue
        marks = {w for a in ATTRIBUTE.finditer(m[3] or "") for w in re.split(r"[^a-z0-9]+", (a[2] or a[3] or a[4] or "").lower()) if w} if m[3] else ()
        yield "open", ".".join([name, *sorted(w for w in marks if not w.isdigit())])
        if name in RAW:
            raw = name
    if not raw and at < len(html):
        yield "text", html[at:]


class Item:
    """An element, a text slot (key ``#``) or a repeated block of siblings (key in brackets), on one page or many.

    ``n``: pages; ``chars`` and ``links``: code points of its text and of those in links, over all pages; ``digest``:
    of its text, 0 once texts differ. ``into``: the item it has joined; ``peer``: its place in the wrapper.
    """

    __slots__ = ("chars", "digest", "into", "keep", "key", "kids", "links", "n", "optional", "peer", "repeated")

    def __init__(self, key: str, kids=(), n: int = 1, chars: int = 0, links: int = 0, digest: int = 0, optional: bool = False, repeated: bool = False):
        self.key, self.kids, self.n, self.chars, self.links, self.digest = key, list(kids), n, chars, links, digest
        self.optional, self.repeated, self.into, self.peer, self.keep = optional, repeated, None, None, False

    @property
    def name(self) -> str:
        return self.key.split(".", 1)[0]

    def root(self) -> Item:
        at = self
        while at.into is not None:
            at = at.into
        return at

    def expression(self) -> str:
        inner = " ".join(x.expression() for x in self.kids)
        text = inner if self.key.startswith("(") else self.key + (f"<{inner}>" if inner else "")
        return (f"({text})" if self.optional or self.repeated else text) + "+" * self.repeated + "?" * self.optional

    def dump(self) -> list:
        return [self.key, self.n, self.chars, self.links, self.digest, int(self.optional), int(self.repeated), [x.dump() for x in self.kids]]

    @classmethod
    def load(cls, x: list) -> Item:
        return cls(x[0], [cls.load(k) for k in x[7]], *x[1:5], bool(x[5]), bool(x[6]))


def parse(html: str) -> tuple[Item, list[tuple[Item, str]]]:
    """The page's tree, and its text blocks in order with their slots; optional end tags are filled in."""
    top = Item("")
    stack: list[tuple[str, Item]] = [("", top)]
    held: Counter[str] = Counter()
    blocks: list[tuple[Item, str]] = []
    pieces: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            slot = Item("#", chars=len(text), links=min(linked, len(text)), digest=1 + zlib.crc32(text.encode("utf-8", "replace")) + (len(text) << 32))
            stack[-1][1].kids.append(slot)
            blocks.append((slot, text))
        linked = 0

    def pop() -> str:
        name = stack[-1][0]
        if name not in INLINE:
            close_block()
        stack.pop()
        held[name] -= 1
        return name

    for kind, value in tokens(html):
        if kind == "text":
            pieces.append(value)
            linked += len(value.strip()) if held["a"] else 0
            continue
        name = value.split(".", 1)[0]
        if kind == "close":
            if held[name] > 0:
                while pop() != name:
                    pass
            elif name not in INLINE:
                close_block()
            continue
        shut = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        while len(stack) > 1 and (stack[-1][0] in shut or (stack[-1][0] in INLINE and any(held[x] > 0 for x in shut))):
            pop()
        if name in ("br", "img"):
            pieces.append(" ")
        if name not in INLINE:
            close_block()
        if name in VOID:
            continue
        owner = stack[-1][1]
        if name not in INLINE and len(stack) <= DEPTH:
            owner = Item(value)
            stack[-1][1].kids.append(owner)
        stack.append((name, owner))
        held[name] += 1
    close_block()
    settle(top)
    return top, blocks


def settle(item: Item) -> None:
    """Sums and digests from the leaves up, then repeated groups."""
    for kid in item.kids:
        settle(kid)
    if item.key != "#":
        item.chars, item.links = sum(x.chars for x in item.kids), sum(x.links for x in item.kids)
        item.digest = hash(tuple(x.digest for x in item.kids)) or 1
        item.kids = fold(item.kids)


def absorb(a: Item, b: Item, same_page: bool, turn: bool = True) -> None:
    """``b`` joins ``a``: one more ``turn`` on the same page (or a part of one), or the same place on other pages."""
    b.into = a
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated or (same_page and turn)
    if same_page:
        a.digest = hash((a.digest, b.digest)) or 1
    else:
        a.n, a.digest = a.n + b.n, a.digest if a.digest == b.digest else 0
    a.kids = merge(a.kids, b.kids, same_page)


def fold(kids: list[Item]) -> list[Item]:
    """Runs of equal elements, then blocks of siblings that follow themselves, as repeated groups."""
    out: list[Item] = []
    for kid in kids:
        if out and out[-1].key == kid.key:
            absorb(out[-1], kid, True)
        else:
            out.append(kid)
    size = 2
    while size <= TURNS and 2 * size <= len(out):
        keys, at, folded = [x.key for x in out], 0, []
        while at < len(out):
            block, times = keys[at : at + size], 1
            while len(block) == size and keys[at + times * size : at + (times + 1) * size] == block:
                times += 1
            folded.append(group(out[at : at + times * size], size) if times > 1 else out[at])
            at += times * size if times > 1 else 1
        out, size = folded, size + 1
    return narrow(out)


def group(items: list[Item], size: int) -> Item:
    """One repeated group from the turns of a block of ``size`` siblings."""
    for k in range(size, len(items)):
        absorb(items[k % size], items[k], True)
    first = items[:size]
    return Item("(" + " ".join(x.key for x in first) + ")", first, max(x.n for x in first), sum(x.chars for x in first), sum(x.links for x in first), hash(tuple(x.digest for x in first)) or 1, False, True)


def regrouped(items: list[Item], like: list[Item]) -> list[Item]:
    """``items`` with each single turn of a repeated group that ``like`` has made a group of its own."""
    for x in like:
        if not x.key.startswith("(") or any(y.key == x.key for y in items):
            continue
        keys, block = [y.key for y in items], [y.key for y in x.kids]
        for at in range(len(keys) - len(block) + 1):
            if keys[at : at + len(block)] == block:
                items = [*items[:at], group(items[at : at + len(block)], len(block)), *items[at + len(block) :]]
                break
    return items


def merge(a: list[Item], b: list[Item], same_page: bool) -> list[Item]:
    """The level that covers both: what only one of them has becomes optional."""
    if [x.key for x in a] != [x.key for x in b]:
        a, b = regrouped(a, b), regrouped(b, a)
    out: list[Item] = []
    for op, i, j, k, m in opcodes(a, b):
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                absorb(x, y, same_page, False)
                out.append(x)
        else:
            for x in (*a[i:j], *b[k:m]):
                x.optional = True
                out.append(x)
    return narrow(out)


def opcodes(a: list[Item], b: list[Item]) -> list[tuple]:
    left, right = [x.key for x in a], [x.key for x in b]
    if left == right:
        return [("equal", 0, len(a), 0, len(b))]
    return SequenceMatcher(None, left, right, autojunk=False).get_opcodes()


def narrow(items: list[Item]) -> list[Item]:
    """A level of over ``LEVEL`` groups, generalised: words of elements seen once go, and equal ones join."""
    if len(items) <= LEVEL:
        return items
    out: dict[str, Item] = {}
    for x in sorted(items, key=lambda x: -x.n):
        key = x.key if len(out) < LEVEL // 2 and (x.n > 1 or x.key == x.name) else x.name if x.name in FURNITURE | BLOCKS | {"#", "div", "section", "article", "main", "ul", "ol", "table"} else "*"
        if key in out:
            out[key].optional = True
            absorb(out[key], x, True)
        else:
            x.key = key
            out[key] = x
    return list(out.values())


def match(page: list[Item], wrapper: list[Item]) -> None:
    """Give each of the page's items its place in the wrapper, level by level."""
    page_ = regrouped(page, wrapper)
    loose = {x.key: x for x in wrapper}
    for op, i, j, k, m in opcodes(page_, wrapper):
        pairs = zip(page_[i:j], wrapper[k:m], strict=True) if op == "equal" else ((x, loose.get(x.key) or loose.get(x.name) or loose.get("*")) for x in page_[i:j])
        for x, y in pairs:
            if y is not None:
                x.peer = y
                match(x.kids, y.kids)


def marked(item: Item) -> bool:
    """Whether an element's name or words say furniture; a header with a heading is the head of an article."""
    name, *marks = item.key.split(".")
    if name == "header" and not MARKED.intersection(marks):
        return not any(x.name in HEADINGS for x in below(item))
    return name in FURNITURE or (name not in ("html", "body", "article", "main") and bool(MARKED.intersection(marks)))


def below(item: Item) -> Iterator[Item]:
    for x in item.kids:
        yield x
        yield from below(x)


def same(item: Item) -> bool:
    """Whether the item's text is template text of its host."""
    known = item.peer or item
    return known.n >= SAME and known.digest != 0


def weigh(item: Item, weights: dict[int, float], template: bool) -> float:
    """Prose that differs from page to page, by the wrapper; names weigh it."""
    known = item.peer or item
    if item.key == "#":
        out = 0.0 if template and same(item) else (known.chars - 0.9 * known.links) / known.n
    else:
        out = sum(weigh(x, weights, template) for x in item.kids)
        out *= 8.0 if item.name in ("article", "main") else 1 / 16 if marked(item) else 1.0
    weights[id(item)] = out
    return out


def judge(page: Item, wrapper: Item | None) -> None:
    """Mark the slots of the page that are main text (``keep``)."""
    if wrapper is not None:
        page.peer = wrapper
        match(page.kids, wrapper.kids)
    weights: dict[int, float] = {}
    template = weigh(page, weights, True) > 0
    if not template and weigh(page, weights, False) <= 0:
        return
    at = page
    while at.name != "article":
        whole = sum(weights[id(x)] for x in at.kids)
        best = max((x for x in at.kids if x.key != "#" and x.name not in BLOCKS), key=lambda x: weights[id(x)], default=None)
        if best is None or weights[id(best)] < 0.5 * whole or (at.name == "main" and best.name != "article"):
            break
        if any(x.name in HEADINGS and not (template and same(x)) and weights[id(x)] > 0 for x in at.kids) and best.name not in ("article", "main"):
            break
        at = best
    _keep(at, template and not same(at))


def _keep(item: Item, template: bool) -> None:
    for x in item.kids:
        if x.key == "#":
            x.keep = True
        elif not marked(x) and not (template and x.name not in BLOCKS and same(x)):
            _keep(x, template and x.name not in BLOCKS)


def extract(html: str, wrapper: Item | None) -> str:
    """Blocks of the page's main text, one a line."""
    page, blocks = parse(html)
    judge(page, wrapper)
    return "\n".join(text for slot, text in blocks if slot.root().keep)


def host(column: str):
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, size): each host's expression as JSON, and its pages."""
    schema = "host string, wrapper string, size long"
    dumped = lambda x: json.dumps(x.dump(), ensure_ascii=False, separators=(",", ":"))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Item] = {}

        def given() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(found), pa.string()), pa.array([dumped(x) for x in found.values()], pa.string()), pa.array([x.n for x in found.values()], pa.int64())], ["host", "wrapper", "size"])
            found.clear()
            return out

        for batch in batches:
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(html or "")[0]
                if name in found:
                    absorb(found[name], page, False)
                else:
                    found[name] = page
            if len(found) > HOSTS:
                yield given()
        yield given()

    def join(key: tuple, part: pa.Table) -> pa.Table:
        first, *more = (Item.load(json.loads(x)) for x in sorted(part.column("wrapper").to_pylist()))
        for x in more:
            absorb(first, x, False)
        return pa.table({"host": [key[0].as_py()], "wrapper": [dumped(first)], "size": [first.n]})

    own = pages.select("host", "html").mapInArrow(trimmed(infer), schema)
    part = own.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64))).groupBy("host", "salt").applyInArrow(join, schema)
    return part.groupBy("host").applyInArrow(join, schema)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    named = pages.select("page_id", "url", "html", host("url").alias("host"))
    found = written(wrappers(named), "wrappers")
    size = found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    known = found.select("host", "wrapper")
    # Few wrappers are broadcast; of more, only those of hosts with many pages, and the other pages move to their host's.
    both = named.join(F.broadcast(known), "host", "left") if size <= BROADCAST_BYTES else sized_join(named, found, ["host"], "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, Item | None] = (None, None)
        held: dict[str, Item] = {}
        for batch in batches:
            out = []
            for html, wrapper in zip(*(batch.column(k).to_pylist() for k in ("html", "wrapper")), strict=True):
                if wrapper != last[0]:
                    if wrapper is not None and wrapper not in held:
                        if len(held) > HOSTS:
                            held.clear()
                        held[wrapper] = Item.load(json.loads(wrapper))
                    last = wrapper, held.get(wrapper)
                out.append(extract(html or "", last[1]))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "wrapper").mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return extract_pages(table(spark, sf_dir, "pages"))
