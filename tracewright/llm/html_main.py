"""Main text of web pages by consensus of a host's pages.

Each page is read once, into blocks of text with their paths: tags with their classes, digits left out. It scores its
containers and votes for the path of the best one, and names the paths that might be furniture, by one word of a class.
Spark adds both up by host. A page's text is then its blocks under any of the host's winning paths, without what recurs
as furniture on the host; where these hold little of the page's own best container, that container's blocks as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_batches

#: A path that gets this share of a host's votes wins, so a host has ten winning paths at most; a path that might be
#: furniture is, if so many pages and this share of them have it.
LEAST_SHARE, LEAST_PAGES = 0.1, 2
#: The share of its best container's text that a page must have under the winning paths to go by them alone.
HELD = 0.5
#: Winning paths are broadcast up to so many characters; beyond, the pages are joined to them by shuffle.
MOST_BROADCAST = 20_000_000
#: Steps of a path, classes of a step and characters of a class that tell paths apart; texts are never cut.
STEPS, CLASSES, CLASS_CHARS = 64, 8, 64
#: Blocks of fewer characters, menu items for instance, say little about a container: a quarter of their length.
TELLING = 25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg canvas video audio textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
OPEN_TEXT = HEADING | {"p"}
CONTAINER = frozenset("article body div main section td".split())
#: What ends an open element of the same group where its end tag is left out.
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_MAIN = frozenset("nav aside footer form button select option label input dialog menu head".split())
NOT_MAIN_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NOT_MAIN_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead topbar toolbar comment comments "
    "commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login search form hidden skip paywall pagination pager response responses thread toc announcement disclaimer warning adsense adslot adunit teaser teasers".split()
)
HEADER_WORD = frozenset("header heading".split())
#: Words that say nothing beside one of the above: a class of these and those only is furniture wherever it stands.
PLAIN_WORD = frozenset(
    "site page post article entry content main top bottom left right center side inner outer bar box block list item items link links slot unit zone area "
    "section wrap wrapper container holder panel region row col column group set text user users reader readers blog global primary secondary sticky fixed "
    "small large mobile desktop js id new more all our the by".split()
)


class Element:
    """off: no main text; doubt: the path of the outermost element that might be furniture; heads: only headings are text."""

    __slots__ = ("tag", "parent", "path", "depth", "off", "doubt", "heads", "heading", "score")

    def __init__(self, tag: str, parent: Element | None, path: str, depth: int, off: bool, doubt: str | None, heads: bool):
        self.tag, self.parent, self.path, self.depth, self.off, self.doubt, self.heads = tag, parent, path, depth, off, doubt, heads
        self.heading = tag in HEADING or (parent is not None and parent.heading)
        self.score = 0.0


def _class_parts(of: dict[str, str]) -> Iterator[list[str]]:
    for name in f"{of.get('class', '')} {of.get('id', '')}".split():
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if parts and parts[0] not in ("no", "has", "with", "without"):
            yield parts


def judge(tag: str, of: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether an element isn't main text, whether it might not be, and whether of it only headings are."""
    if tag in NOT_MAIN or of.get("role", "").lower() in NOT_MAIN_ROLE or "hidden" in of or of.get("aria-hidden") == "true":
        return True, False, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", of.get("style", ""), re.I):
        return True, False, False
    if tag == "article":
        return bool(re.search(r"\bcomment|\brelated\b|\bteaser\b", of.get("class", ""), re.I)), False, False
    off, doubt, heads = False, False, tag == "header"
    if tag not in ("html", "body", "main"):
        for parts in _class_parts(of):
            if any(p in NOT_MAIN_WORD for p in parts) and all(p in NOT_MAIN_WORD or p in PLAIN_WORD for p in parts):
                off = True
            doubt |= parts[0] in NOT_MAIN_WORD or parts[-1] in NOT_MAIN_WORD
            heads |= parts[-1] in HEADER_WORD and tag not in HEADING
    return off, doubt and not off, heads


def _step(tag: str, of: dict[str, str]) -> str:
    names = sorted({re.sub(r"[\d>]+", "", c)[:CLASS_CHARS] for c in of.get("class", "").split()} - {""})[:CLASSES]
    return ".".join([f">{tag}", *names])


def blocks(html: str) -> list[tuple[str, Element, int]]:
    """The blocks of a page in order: text, innermost element, characters of it that are link text."""
    root = Element("body", None, "", 0, False, None, False)  # also the container of a page that names none
    stack, out, text, links = [root], [], [], 0
    holder = root
    still = Counter()  # open elements of each tag, so that none is searched for that isn't there

    def flush() -> None:
        nonlocal links
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append((whole, holder, links))
            text.clear()
        links = 0

    def close(upto: int) -> None:
        still.subtract(e.tag for e in stack[upto:])
        del stack[upto:]

    at, n, in_link = 0, len(html), 0
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not text:
                holder = stack[-1]
            text.append(html[at:lt])
            if in_link:
                links += lt - at
        if lt == n:
            break
        m = TOKEN.match(html, lt)
        if not m:
            if not text:
                holder = stack[-1]
            text.append("<")
            at = lt + 1
            continue
        at = max(m.end(), lt + 1)
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if still[tag] else 0
            if tag in BLOCK:
                flush()
            if tag == "a":
                in_link = max(0, in_link - 1)
            if k and not (tag not in BLOCK and any(x.tag in BLOCK for x in stack[k + 1 :])):
                close(k)
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            text.append(" " if tag != "wbr" else "")
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("html", "body", "head"):
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in OPEN_TEXT), 0) if any(still[t] for t in OPEN_TEXT) else 0
                if k and not any(x.tag in ("td", "th", "div", "article", "section", "li") for x in stack[k + 1 :]) and (stack[k].tag == "p" or tag in HEADING):
                    close(k)
            if tag in SIBLING and any(still[t] for t in SIBLING[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SIBLING[tag]:
                        close(i)
                        break
                    if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tr", "div", "article"):
                        break
            if tag == "body":
                k = next((i for i, x in enumerate(stack) if x.tag == "head"), 0)
                if k:
                    close(k)
        if tag in VOID:
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        of = {}
        if m[3].strip():
            for a in ATTRIBUTE.finditer(m[3]):
                of.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        off, doubt, heads = judge(tag, of)
        up = stack[-1]
        path, depth = (up.path + _step(tag, of), up.depth + 1) if tag in BLOCK and up.depth < STEPS else (up.path, up.depth)
        if tag == "a":
            in_link += 1
        stack.append(Element(tag, up, path, depth, up.off or off, up.doubt or (path if doubt else None), up.heads or heads))
        still[tag] += 1
    flush()
    return out


def _container(e: Element) -> Element | None:
    while e is not None and e.tag not in CONTAINER:
        e = e.parent
    return e


def _kept(e: Element) -> bool:
    return not e.off and (e.heading or not e.heads)


def best_container(found: list[tuple[str, Element, int]]) -> Element | None:
    """The container with the most text that isn't links, its own or, at half weight, one level down."""
    seen: dict[int, Element] = {}
    for text, e, links in found:
        if e.off or e.doubt is not None or e.heads:
            continue
        weight, share = len(text) * max(0.0, 1 - links / len(text)) * (1 if len(text) >= TELLING else 0.25), 1.0
        c = _container(e)
        for _ in range(3):
            if c is None:
                break
            c.score += weight * share
            seen[id(c)] = c
            c, share = _container(c.parent) if c.parent else None, share / 2
    if not seen:
        return None
    best = e = max(seen.values(), key=lambda x: x.score)
    while e is not None:
        if e.tag in ("article", "main"):
            return e
        e = e.parent
    return best


PAGE = "page_id long, url string, host string, vote string, doubts array<string>, blocks array<struct<text:string,path:string,doubt:string,own:boolean>>"


def read_page(html: str) -> tuple[str | None, list[str], list[dict]]:
    """A page's vote, the paths that might be furniture, and its blocks that may be text: own tells those in its best container."""
    found = blocks(html)
    best = best_container(found)
    inside: dict[int, bool] = {}

    def own(e: Element | None) -> bool:
        chain = []
        while e is not None and e is not best and id(e) not in inside:
            chain.append(e)
            e = e.parent
        got = e is not None and (e is best or inside[id(e)])
        inside.update((id(x), got) for x in chain)
        return got

    out = [{"text": t, "path": e.path, "doubt": e.doubt, "own": own(e)} for t, e, _ in found if _kept(e)]
    return best.path if best is not None else None, sorted({e.doubt for _, e, _ in found if e.doubt is not None}), out


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct([("text", pa.string()), ("path", pa.string()), ("doubt", pa.string()), ("own", pa.bool_())])
    for batch in batches:
        pages = [read_page(x.as_py() or "") for x in batch.column(3)]
        votes, doubts, found = zip(*pages, strict=True) if pages else ((), (), ())
        columns = [pa.array(votes, pa.string()), pa.array(doubts, pa.list_(pa.string())), pa.array(found, pa.list_(block))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["page_id", "url", "host", "vote", "doubts", "blocks"])


def read_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What `read_page` tells of every page, with its id, URL and host."""
    small_batches(pages.sparkSession)
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return named.mapInArrow(_page_batches, PAGE)


def consensus(read: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(host, paths, furniture): the paths that won at least the share `least` of a host's votes, and those that might be
    furniture and stand on as large a share of its pages, two at least."""
    said = read.select("host", F.explode(F.concat(F.array(F.struct(F.lit("page").alias("kind"), F.lit("").alias("path"))), F.transform("doubts", lambda d: F.struct(F.lit("doubt").alias("kind"), d.alias("path"))), F.when(F.col("vote").isNotNull(), F.array(F.struct(F.lit("vote").alias("kind"), F.col("vote").alias("path")))).otherwise(F.array().cast("array<struct<kind:string,path:string>>")))).alias("x"))
    counted = cut(said.groupBy("host", "x.kind", "x.path").agg(F.count("*").alias("n")))
    kind = F.col("kind")
    total = counted.groupBy("host").agg(F.sum(F.when(kind == "page", F.col("n"))).alias("pages"), F.sum(F.when(kind == "vote", F.col("n"))).alias("votes"))
    won = (kind == "vote") & (F.col("n") >= F.col("votes") * least)
    stale = (kind == "doubt") & (F.col("n") >= F.col("pages") * least) & (F.col("n") >= LEAST_PAGES)
    held = counted.join(total, "host").where(won | stale)
    listed = lambda k: F.sort_array(F.collect_list(F.when(kind == k, F.col("path"))))
    return held.groupBy("host").agg(listed("vote").alias("paths"), listed("doubt").alias("furniture"))


def chosen_text(blocks: Column, paths: Column, furniture: Column) -> Column:
    """The text of a page's blocks: those under a winning path, and the page's own where these are few; without furniture."""
    kept = F.filter(blocks, lambda b: b["doubt"].isNull() | ~F.array_contains(furniture, F.coalesce(b["doubt"], F.lit(""))))
    marked = F.transform(kept, lambda b: F.struct(b["text"].alias("text"), b["own"].alias("own"), F.exists(paths, lambda p: F.startswith(F.concat(b["path"], F.lit(">")), F.concat(p, F.lit(">")))).alias("won")))
    chars = lambda bs, which: F.aggregate(bs, F.lit(0).cast("long"), lambda n, b: n + F.when(b[which], F.length(b["text"])).otherwise(0))

    def choose(bs: Column) -> Column:
        enough = chars(bs, "won") >= F.lit(HELD) * chars(bs, "own")
        return F.array_join(F.transform(F.filter(bs, lambda b: b["won"] | (b["own"] & ~enough)), lambda b: b["text"]), "\n\n")

    return F.element_at(F.transform(F.array(marked), choose), 1)  # an array of one, so that it is worked out once


def host_of(url):
    """Lower-case host of a URL; empty for null and for what isn't one."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null and empty html, and pages without main text, give an empty text. A null or broken URL belongs to the host "".
    Paths with as many votes win alike. Repeated rows and null ids stay; other columns aren't read. An empty table gives
    an empty one. What pages are read into, their texts mostly, is written to the shared folder, so they are read once.
    """
    read = cut(read_pages(pages, id_col, url_col, html_col))
    won = cut(consensus(read))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    size = won.agg(F.coalesce(F.sum(F.length("host") + chars("paths") + chars("furniture") + 16), F.lit(0))).first()[0]
    joined = read.join(F.broadcast(won) if size <= MOST_BROADCAST else won, "host", "left")
    none = F.array().cast("array<string>")
    text = chosen_text(F.col("blocks"), F.coalesce("paths", none), F.coalesce("furniture", none))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
