"""Main text of web pages by consensus host paths.

A page is cut into blocks of text; every container (article, main, section, div, table cell, body) above them is scored by
how much of the page's text it holds, how little of that is links, and what its tag and class promise. Containers are
named by generalised paths, tag and class of each container from the body down with digits folded. Scores are summed by
host and path in Spark, each host's best path wins, and pages are extracted again below the winning path; a page that
lacks it falls back to its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and
comments are left out wherever they stand.

Votes are summed inside each task before they are shuffled, and a host's winner is one short row. Winners are broadcast where
their number is below a bound; beyond it the pages of each host are dealt out to parts, so no host's pages meet in one task.

Defined results: null or empty html gives an empty text, and so does html without text outside such parts; a url without
host votes with the host ''; repeated rows give repeated results; ties go to the path that sorts first.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.cluster import cut, ddl, stored

# HTML's elements by kind.
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = CONTAINERS | frozenset("address blockquote caption center dd details dialog dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li ol p pre search summary table tbody tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("head nav header footer aside form script style noscript iframe textarea title template button select option svg canvas object audio video menu dialog search".split()) | RAW
# Dropped elements that stand in a line of text and don't end it.
INLINE = frozenset("script style noscript iframe template button select option svg canvas object audio video textarea".split())
# An open element of the first kind ends where one of the second begins.
ENDED_BY = {"p": BLOCKS | {"form", "nav", "header", "footer", "aside", "menu"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
STOPS = frozenset("article main section div table td th body ul ol dl blockquote aside nav header footer form figure details".split())
# Words that name other parts of a page, and words that name its text, in classes and ids.
OTHER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer disqus dropdown footer footnav gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommendations recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
TEXT_PARTS = frozenset("article body content entry main post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
WORD = re.compile(r"[A-Za-z]+")
DIGITS = re.compile(r"\d+")


#: Hosts whose paths are broadcast at most; parts that a host's pages are dealt out to beyond that.
BROADCAST_HOSTS, PARTS = 100_000, 64
#: Containers that a path names one by one; those further up stand in it as one digest, so paths of deep pages stay short.
NAMED = 32


class Container:
    __slots__ = ("chars", "depth", "links", "path", "tag", "up", "words")

    def __init__(self, tag: str, shape: str, up: Container | None, words: set[str]):
        self.tag, self.up, self.words, self.chars, self.links = tag, up, words, 0, 0
        self.depth = up.depth + 1 if up else 0
        above = up.path if up else ""
        if self.depth and self.depth % NAMED == 0:
            above = hashlib.blake2b(above.encode(), digest_size=12).hexdigest()
        self.path = f"{above}>{shape}" if up else shape


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _elsewhere(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element holds another part of the page than its text."""
    if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main", "p", "td", "b", "i", "em", "strong", "span", "a"):
        return tag in ("p", "span", "td") and any(name in OTHER_PARTS for name in attributes.get("class", "").lower().split())
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = [w.lower() for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
        if words and words[0] not in ("has", "with", "no", "without") and OTHER_PARTS.intersection(words):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, Container]]:
    """The page's blocks of text outside other parts: text, characters in links, innermost container."""
    root = Container("body", "body", None, set())
    # Of each open element: tag, whether it or one above is another part, its container, whether it is a link.
    stack: list[tuple[str, bool, Container, bool]] = [("", False, root, False)]
    out: list[tuple[str, int, Container]] = []
    pending: list[str] = []
    opened: Counter[str] = Counter()  # open elements by tag, so that a stray end costs no search
    linked, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                out.append((text, min(linked, len(text)), stack[-1][2]))
            pending.clear()
        linked = 0

    def close(k: int) -> None:
        opened.subtract(entry[0] for entry in stack[k:])
        del stack[k:]

    while at < size:
        tag = TAG.search(page, at)
        stop = tag.start() if tag else size
        if stop > at and not stack[-1][1]:
            pending.append(entities.unescape(page[at:stop]))
            if stack[-1][3]:
                linked += stop - at
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            if name in BLOCKS or name in DROPPED - INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if name not in STOPS and stack[k][0] in STOPS and name not in BLOCKS:
                    break  # a stray end of an inline element ends nothing further out
            continue
        raw = tag[3] or tag[6] or ""
        if name in BLOCKS or name in DROPPED - INLINE:
            flush()
        elif name == "br":
            pending.append(" ")
        for k in range(len(stack) - 1, 0, -1):
            if name in ENDED_BY.get(stack[k][0], ()):
                close(k)
                break
            if stack[k][0] in STOPS:
                break
        if name in VOID or (raw.endswith("/") and name not in BLOCKS and name not in DROPPED):
            continue
        attributes = _attributes(raw) if raw else {}
        _, gone, container, link = stack[-1]
        gone = gone or _elsewhere(name, attributes)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in CONTAINERS and not gone and name != "body":
            shape = DIGITS.sub("#", ".".join([name, *sorted(attributes.get("class", "").split())]))
            container = Container(name, shape, container, {w.lower() for w in WORD.findall(attributes.get("class", "") + " " + attributes.get("id", ""))})
        stack.append((name, gone, container, link or name == "a"))
        opened[name] += 1
    flush()
    return out


def scores(found: list[tuple[str, int, Container]]) -> dict[str, float]:
    """The score of each path on one page, its best container counting."""
    total, seen = sum(len(t) for t, _, _ in found), {}
    for text, links, container in found:
        container.chars += len(text)
        container.links += links
        while container and id(container) not in seen:
            seen[id(container)] = container
            container = container.up
    # From the innermost out, each gives to the one above it what it holds.
    for c in sorted(seen.values(), key=lambda c: -c.depth):
        if c.up:
            c.up.chars += c.chars
            c.up.links += c.links
    out: dict[str, float] = defaultdict(float)
    for c in seen.values():
        promise = {"article": 0.4, "main": 0.2}.get(c.tag, 0.0) + (0.15 if TEXT_PARTS & c.words else 0.0)
        score = c.chars / total * (1 + promise) - 0.5 * c.links / max(c.chars, 1) + 0.001 * min(c.depth, 20)
        out[c.path] = max(out.get(c.path, 0.0), score)
    return out


def _best(votes: dict[str, float]) -> str | None:
    return min(votes, key=lambda p: (-votes[p], p), default=None)


def main_text(page: str, winner: str | None = None) -> str:
    """The blocks below the containers of the winning path, or else below the page's own best."""
    found = blocks(page)

    def below(path: str | None) -> list[str]:
        known: dict[int, bool] = {}

        def inside(c: Container | None) -> bool:
            above: list[Container] = []
            while c and id(c) not in known and c.path != path:
                above.append(c)
                c = c.up
            here = c is not None and known.get(id(c), True)
            known.update((id(x), here) for x in above)
            return here

        return [t for t, _, c in found if path and inside(c)]

    return "\n".join(below(winner) or below(_best(scores(found))))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``host``, ``path``, ``score`` (summed over its pages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = defaultdict(float)
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, score in scores(blocks(page or "")).items():
                    sums[name, path] += round(score * (1 << 20))  # whole numbers: their sum doesn't depend on the order
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([int(x) for x in sums.values()], pa.int64())], ["host", "path", "score"])

    rows = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "host string, path string, score long").groupBy("host", "path").agg(F.sum("score").alias("score"))


def winners(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``host`` and its winning ``path``."""
    ranked = votes(pages, html, url).select("host", F.struct((-F.col("score")).alias("score"), "path").alias("rank"))
    return ranked.groupBy("host").agg(F.min("rank").getField("path").alias("path"))


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``key``, ``url`` and ``text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "html"):
                text = [main_text(h or "", p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(text, pa.string())], [key, "url", "text"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    won = stored(winners(pages, html, url), "host-paths")
    if won.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(won), "host", "left")
    else:
        # A host's pages are dealt out, and its path goes to each part.
        won = won.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = rows.withColumn("part", F.pmod(F.xxhash64("key", "url"), F.lit(PARTS)).cast("int")).join(won, ["host", "part"], "left")
    joined = joined.select("key", "url", "html", "path")
    return joined.mapInArrow(run, f"`{key}` {ddl(pages, key)}, url string, text string")
