"""Main text of web pages by host-wide consensus on the path of the main container.

Each page's containers are scored by the text of their own blocks outside links
and boilerplate; where the page's title stands in a box beside the best one, the
container of both takes its place. The page votes for the generalised tag-class
path of that container. Spark sums the votes per host and path, the leading path of each host wins,
and every page of the host is read again from the elements on that path. A page
without such an element, or with no text in it, falls back on its own best
container.

The winners (one row a host) are broadcast while there are at most
``BROADCAST_HOSTS`` of them; beyond that they are joined by a shuffle on the
host, where adaptive execution splits hosts with very many pages.

Defined cases: null html is empty and gives empty text; a null or odd url puts
the page under the empty host; of paths with equal votes the last by code point wins; broken markup is read to its end (open elements
end there, stray end tags are skipped); equal rows give equal rows; no pages
give no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

BROADCAST_HOSTS = 200_000
RUNNER_UP = 0.25
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|select|object|canvas|audio|video"
BLOCK = frozenset(
    "address article aside blockquote body center details dd dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SPLITS = BLOCK - {"td", "th"}
# Parts of a page that are not its article: tags, and names of class, id and role: as a whole or as their last word
# (site-footer), those in FIRST_WORDS also as their first (ad-slot); a header-image or a notice-of-award is none.
DROP_TAGS = frozenset("nav footer aside form button menu dialog head".split())
#: Parts of forms, which an article may hold as well.
FORM_TAGS = frozenset("label fieldset".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu sidebar aside breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies ad ads adv advert adverts"
    " advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup"
    " share sharing social related recommended recommendations widget search login pagination pager toolbar masthead footer header form alert complementary contentinfo".split()
)
FIRST_WORDS = frozenset(
    "ad ads advert adverts sidebar comment comments nav navbar menu footer cookie cookies gdpr share sharing social related recommended newsletter breadcrumb breadcrumbs"
    " sponsor sponsored promo promotion popup modal disqus subscribe".split()
)
KEEP_WORDS = frozenset("article content main post entry story body text page".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
STRONG = {"article": 1.6, "main": 1.4, "body": 0.5}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:\s+(?:[^>\"'=\s]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|[\"'=]))*\s*/?)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "path", "parent", "dropped", "inside_article", "score", "blocks")

    def __init__(self, tag: str, path: str, parent: Element | None, dropped: bool, inside_article: bool):
        self.tag, self.path, self.parent, self.dropped, self.inside_article = tag, path, parent, dropped, inside_article
        self.score = 0.0
        self.blocks: list[tuple[int, str, str]] = []  # place, text and kind: h1, heading, text or links


def _names(attr: str) -> tuple[str, set[str], bool]:
    """Generalised class of an element, the words of its class, id and role, and whether a name says that it is no part of an article."""
    shown, words, boilerplate = "", set(), False
    for name, *values in _ATTR.findall(attr):
        value = next((v for v in values if v), "").lower()
        for one in value.split():
            parts = [w for w in _SPLIT.split(one) if w]
            words.update(parts)
            boilerplate |= bool(parts) and (parts[-1] in DROP_WORDS or parts[0] in FIRST_WORDS)
        if name.lower() == "class":
            shown = ".".join(sorted({_DIGITS.sub("#", c) for c in value.split()}))
    return shown, words, boilerplate


def read(page: str) -> list[Element]:
    """Container elements of a page, each with the text blocks under it, in page order."""
    heading = frozenset(("h1", "h2", "h3"))
    root = Element("html", "", None, False, False)
    stack, found = [root], []
    parts: list[str] = []
    linked = plain = 0
    order = 0
    at = 0

    def flush() -> None:
        nonlocal parts, linked, plain, order
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            top = stack[-1]
            if text and not top.dropped:
                order += 1
                gain = max(0.0, plain - 2.0 * linked)
                share, e, kind = 1.0, top, "links" if 2 * linked > plain else "text"
                while e is not None:
                    if e.tag in heading and kind == "text":
                        kind = "h1" if e.tag == "h1" else "heading"
                    if e.tag in CONTAINERS or e is root:
                        e.blocks.append((order, text, kind))
                        e.score += gain * share
                        share *= 0.6
                    e = e.parent
        parts, linked, plain = [], 0, 0

    def push_text(text: str) -> None:
        nonlocal linked, plain
        if text:
            parts.append(text)
            n = len(text)
            if links:
                linked += n
            else:
                plain += n

    links = 0
    for m in _TOKEN.finditer(page):
        push_text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in SPLITS:
                flush()
            elif tag in BLOCK:
                parts.append(" ")
            if tag == "a":
                links = max(0, links - 1)
            inline = tag not in BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if k < len(stack) - 1 and not inline:
                        links = 0
                    del stack[k:]
                    break
                if inline and stack[k].tag in BLOCK:
                    break
            continue
        if tag in SPLITS:
            flush()
        elif tag in BLOCK or tag == "br":
            parts.append(" ")
        if tag in VOID or tag == "html":
            continue
        if tag in BLOCK:
            # A block ends an open paragraph; an item, row or cell ends its like.
            ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th") else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    links = 0
                    break
                if stack[k].tag in BLOCK and stack[k].tag != "p":
                    break
        if tag == "a":
            links += 1
        above = stack[-1]
        attr = m["attr"] or ""
        shown, words, boilerplate = _names(attr) if "=" in attr else ("", set(), False)
        dropped = above.dropped or tag in DROP_TAGS or (tag == "header" or tag in FORM_TAGS) and not above.inside_article
        if not dropped and boilerplate and tag not in ("body", "html"):
            dropped = not (tag in ("article", "main") or words & KEEP_WORDS and not words & {"comment", "comments", "sidebar", "footer", "ad", "ads", "related"})
        dropped = dropped or "hidden" in attr.lower().split() or 'aria-hidden="true"' in attr.lower()
        e = Element(tag, f"{above.path}>{tag}{'.' + shown if shown else ''}" if tag in CONTAINERS else above.path, above, dropped, above.inside_article or tag in ("article", "main"))
        if tag in CONTAINERS:
            e.score = 0.0
            found.append(e)
        stack.append(e)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)
        push_text(rest[: cut.start()] if cut else rest)
    flush()
    out = [e for e in found if e.blocks] or ([root] if root.blocks else [])
    for e in out:
        e.score *= STRONG.get(e.tag, 1.0)
    return out


def titled(e: Element) -> Element:
    """e, or the nearest container around it that holds the title which e lacks.

    What such a container adds must read like the head of an article: no links, and less text than e has; the body itself
    takes over only if it adds nothing but headings.
    """
    if any(kind == "h1" for *_, kind in e.blocks):
        return e
    own, size, around = {n for n, *_ in e.blocks}, sum(len(t) for _, t, _ in e.blocks), e.parent
    while around is not None:
        if around.blocks:
            more = [(t, kind) for n, t, kind in around.blocks if n not in own]
            if any(kind == "links" for _, kind in more) or sum(len(t) for t, _ in more) > size:
                return e
            if any(kind == "h1" for _, kind in more):
                bare = all(kind in ("h1", "heading") for _, kind in more)
                return around if bare or around.tag not in ("body", "html") else e
        around = around.parent
    return e


def ranked(elements: list[Element]) -> list[Element]:
    """Containers by descending score, the first one with its title."""
    out = sorted(elements, key=lambda e: -e.score)
    if out and (top := titled(out[0])) is not out[0]:
        top.score = out[0].score
        out = [top, *(e for e in out if e is not top)]
    return out


def text_at(elements: list[Element], path: str | None) -> str:
    """Blocks under the elements on this path, or under the page's own best container if there are none."""
    blocks = {n: t for e in elements if path is not None and e.path == path for n, t, _ in e.blocks}
    if not blocks:
        blocks = {n: t for e in ranked(elements)[:1] for n, t, _ in e.blocks}
    return "\n\n".join(t for _, t in sorted(blocks.items()))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> host, path, votes: 1 for a page's best container, less for the next."""

    def run(batches):
        for batch in batches:
            hosts, paths, weights = [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = ranked(read(page.as_py() or ""))[:2]
                for k, e in enumerate(first):
                    if e.score > 0:
                        hosts.append(h)
                        paths.append(e.path)
                        weights.append(RUNNER_UP * e.score / first[0].score if k else 1.0)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.float64())], ["host", "path", "weight"])

    cast = pages.select("host", "html").mapInArrow(run, "host string, path string, weight double")
    return cast.groupBy("host", "path").agg(F.round(F.sum("weight"), 6).alias("votes"))


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, path (the host's winner), text."""
    source = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host(F.col("url")).alias("host"))
    winners = votes(source).groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))
    winners = materialise(winners, "host-paths")
    small = winners.count() <= broadcast_hosts
    joined = source.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "path", "html")

    def run(batches):
        for batch in batches:
            texts = [text_at(read(page.as_py() or ""), path) for path, page in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["page_id", "url", "path", "text"])

    kind = dict(source.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, path string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
