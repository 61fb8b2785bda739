"""Main text of web pages: hosts vote on the paths of content and of chrome, pages are read again by the winners."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held
from .urlfilter import host_path

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|</[^a-zA-Z][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
NAME = re.compile(r"[a-z]+")

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template svg math canvas object embed applet audio video picture map iframe nav footer aside form button select option datalist textarea dialog menu head title noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("body article section main div ul ol dl table td center blockquote figure".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words in a class, id or role that mark what is not the article.
NEGATIVE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner sidebar sidenav rail widget widgets ad ads adv advert adverts advertisement advertising advertorial "
    "adsense promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "related recommended recommendations share sharing social pagination pager toolbar search login register hidden complementary contentinfo footer header topbar bottombar aside form".split()
)
ADVERTS = frozenset("ad ads advert adverts advertisement sponsored promo".split())
#: These mark reader comments, even on an article or in one.
READERS = frozenset("comment comments commentlist disqus reply replies response responses respond discussion".split())
POSITIVE = frozenset("article content main post entry story text body page".split())


def _marks(attributes: str) -> tuple[frozenset, str, bool]:
    """Words of class, id and role; the class as a path shows it (first class, digits as N); hidden or not."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    words = NAME.findall(names)
    words = frozenset(w for i, w in enumerate(words) if not (i and words[i - 1] in ("has", "with", "no", "without")))
    first = re.sub(r"\d+", "N", " ".join(sorted(found.get("class", "").lower().split())[:2]))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower()) is not None
    return words, first, hidden


class Node:
    """An open element. container: the nearest element that holds blocks of its own on the paths that hosts vote on."""

    __slots__ = ("tag", "path", "parent", "container", "order", "depth", "dropped", "soft", "positive", "titled", "article", "heading", "head", "link", "own", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.path = parent.path if parent else ""
        self.container = parent.container if parent else self
        self.order = self.depth = self.soft = self.own = self.linked = 0
        self.dropped = self.positive = self.titled = self.article = self.heading = self.head = self.link = False

    @property
    def above(self) -> Node | None:
        """The container around a container."""
        return self.parent.container if self.parent else None


def _enter(tag: str, attributes: str, parent: Node) -> Node:
    words, label, hidden = _marks(attributes) if attributes.strip() else (frozenset(), "", False)
    node = Node(tag, parent)
    node.article, node.heading, node.link = parent.article or tag in ("article", "main"), parent.heading or tag in HEADINGS, parent.link or tag == "a"
    node.head = parent.head or tag == "header"
    node.dropped = parent.dropped or hidden or tag in DROPPED or tag == "header" and not parent.article
    node.positive = bool(words & POSITIVE)
    adverts = bool(words & ADVERTS)
    if words and not node.dropped and tag not in ("html", "body"):
        if words & READERS and not (node.positive and not words & {"comment", "comments", "reply", "replies"}):
            node.soft = 2
        elif tag in ("article", "main"):
            node.soft = int(adverts)
        elif tag in INLINE:
            node.dropped = adverts
        else:
            node.soft = int(bool(words & NEGATIVE) and not (parent.article and words & {"header"} and not words - {"header"} & NEGATIVE))
        if node.soft and tag in INLINE:
            node.dropped, node.soft = True, 0
    if tag in CONTAINERS or node.soft:
        above = parent.path if len(parent.path) < 300 else f"#{zlib.crc32(parent.path.encode()):08x}"
        node.path = f"{above}/{tag}.{label}" if label else f"{above}/{tag}"
        node.container, node.depth = node, parent.container.depth + 1
    if tag == "h1":
        node.container.titled = True
    return node


def _totals(containers: list[Node], own: list[float]) -> list[float]:
    """Sums over subtrees; containers come in page order, so a child always stands behind what is around it."""
    total = list(own)
    for k in range(len(containers) - 1, 0, -1):
        total[containers[k].above.order] += total[k]
    return total


def _gains(containers: list[Node]) -> list[float]:
    """Own score of each container: text outside links less twice that in links, one and a half times in an article."""
    return [max(0.0, n.own - 3.0 * n.linked) * (1.5 if n.article else 1.0) for n in containers]


def _settle(containers: list[Node]) -> None:
    """Drops elements whose class names chrome or readers' comments, unless the page's text is in them.

    Such an element stays if an unmarked article or main in it has half of the page's score, if it has all of the score
    outside comments, or if it has nine tenths of that and is titled (h1) or named after content; one named after comments
    only if it is named after content too.
    """
    total = _totals(containers, _gains(containers))
    article = [total[n.order] if n.tag in ("article", "main") and not n.soft else 0.0 for n in containers]
    for k in range(len(containers) - 1, 0, -1):
        n = containers[k]
        article[n.above.order] = max(article[n.above.order], article[k])
        n.above.titled |= n.titled
    spoken = [False] * len(containers)
    whole = total[0]
    for n in containers[1:]:
        spoken[n.order] = spoken[n.above.order] or n.soft == 2 and not n.positive
        if spoken[n.order] and not spoken[n.above.order]:
            whole -= total[n.order]
    for n in containers[1:]:
        most = total[n.order] >= (0.9 if n.titled or n.positive else 1.0) * whole
        stays = whole > 0 and (n.soft < 2 or n.positive) and (most or article[n.order] >= 0.5 * whole)
        n.dropped = n.above.dropped or bool(n.soft) and not stays


def read(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(container, text) of each block outside dropped elements, in page order, and all containers, dropped ones marked.

    Missing end tags are made up as browsers do for paragraphs, list items and table cells; an end tag without a start is
    ignored; what is still open at the end is closed there.
    """
    top = Node("", None)
    here, blocks, containers = top, [], [top]
    stack, open_ = [top], Counter()
    buffer: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            links = len(" ".join(entities.unescape("".join(linked)).split()))
            buffer.clear()
            linked.clear()
            if text:
                blocks.append((here.container, text))
                here.container.own += len(text)
                here.container.linked += min(links, len(text))

    def text(part: str) -> None:
        if part and not here.dropped:
            if here.heading or not here.head:
                buffer.append(part)
                if here.link:
                    linked.append(part)

    def close(k: int) -> None:
        nonlocal here
        if any(n.tag not in INLINE for n in stack[k:]):
            flush()
        open_.subtract(n.tag for n in stack[k:])
        del stack[k:]
        here = stack[-1]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(entities.unescape(m[0][9:].removesuffix("]]>")).replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                buffer.append(" ")
            elif open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag in CONTAINERS:
                        break
            continue
        if tag in VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or tag in ("dt", "dd") and stack[k].tag in ("dt", "dd") or tag in ("td", "th") and stack[k].tag in ("td", "th"):
                    close(k)
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    break
        if tag not in INLINE:
            flush()
        if m[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        here = _enter(tag, m[3], here)
        stack.append(here)
        open_[tag] += 1
        if here.container is here:
            here.order = len(containers)
            containers.append(here)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            close(len(stack) - 1)
    flush()
    _settle(containers)
    return [(n, t) for n, t in blocks if not n.dropped], containers


@dataclass(frozen=True)
class Page:
    """A page's blocks and containers, with scores that leave out dropped containers and those the host calls chrome."""

    blocks: list[tuple[Node, str]]
    containers: list[Node]
    gains: list[float]
    totals: list[float]
    core: Node | None
    best: Node | None


def _judged(page: str, chrome: frozenset[str] = frozenset()) -> Page:
    """The core is the deepest container, latest on equal depth, whose subtree has four fifths of the page's score.

    The choice (best) is the outermost article or main around the core; without one, the deepest container that has the
    whole score. So what stands beside the core is not lost.
    """
    blocks, containers = read(page)
    gains = [0.0 if n.dropped or n.path in chrome else g for n, g in zip(containers, _gains(containers), strict=True)]
    totals = _totals(containers, gains)
    blocks = [(n, t) for n, t in blocks if n.path not in chrome]
    if not totals[0]:
        return Page(blocks, containers, gains, totals, None, None)
    deepest = lambda share: max((n for n in containers if totals[n.order] >= share * totals[0]), key=lambda n: (n.depth, n.order))
    core = best = deepest(0.8)
    if core.article:
        up: Node | None = core
        while up is not None:
            if up.tag in ("article", "main"):
                best = up.container
            up = up.parent
    else:
        best = deepest(1 - 1e-9)
    return Page(blocks, containers, gains, totals, core, best)


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def votes(page: str | None) -> list[tuple[str, int, int | None, int]]:
    """(path, won, own, whole) of the paths on a page: whether it is the page's choice, digests of the text in it and of the page.

    The empty path stands for the page itself. A container that has all of its score from one inside it says nothing new
    and is left out, so a page names about as many paths as it has containers with text, however deep they are nested.
    """
    if not page:
        return []
    seen = _judged(page)
    whole = _digest("\n".join(t for _, t in seen.blocks))
    texts: dict[str, list[str]] = {}
    for n, t in seen.blocks:
        texts.setdefault(n.path, []).append(t)
    inner = [0.0] * len(seen.containers)
    for n in seen.containers[1:]:
        inner[n.above.order] = max(inner[n.above.order], seen.totals[n.order])
    paths = {n.path for n in seen.containers if n.path and (n.path in texts or seen.totals[n.order] > inner[n.order])}
    best = seen.best.path if seen.best else ""
    out = [(p, int(p == best), _digest("\n".join(texts[p])) if p in texts else None, whole) for p in paths | ({best} - {""})]
    return [("", 0, None, whole), *out]


def extract(page: str | None, marks: dict[str, str] | None = None) -> str:
    """The blocks below the container that page and host agree on, in page order, joined by spaces.

    marks: path -> 'w' (pages that have it mostly choose it), 'c' (chrome: the same text on most pages) or 'l' (other paths
    that the host knows). Blocks of chrome are left out. If the page's own choice is a path that its host knows and mostly
    does not choose, the winning path with the most score on the page is read instead; a path that the host does not know
    is the page's own business. Outside articles, containers of mostly links are left out, but for those in the core.
    """
    if not page:
        return ""
    marks = marks or {}
    seen = _judged(page, frozenset(p for p, kind in marks.items() if kind == "c"))
    won = [n for n in seen.containers if marks.get(n.path) == "w" and not n.dropped]
    if seen.best is None:
        path = next((n.path for n in won), None)
    elif marks.get(seen.best.path) == "l" and any(seen.totals[n.order] for n in won):
        path = max(won, key=lambda n: (seen.totals[n.order], -n.order)).path
    else:
        path = seen.best.path
    inside, core = [False] * len(seen.containers), [False] * len(seen.containers)
    for n in seen.containers:
        up = n.above
        inside[n.order] = path is None or n.path == path or up is not None and inside[up.order]
        core[n.order] = n is seen.core or up is not None and core[up.order] and seen.core.tag not in ("", "body")
    text = lambda n: n.article or seen.gains[n.order] or not n.linked or core[n.order] or seen.core is None
    return " ".join(t for n, t in seen.blocks if inside[n.order] and text(n))


def consensus(votes: DataFrame, held: Held, least_share: float = 0.01, distinct: float = 0.2) -> DataFrame:
    """(host, marks) from the votes (host, path, won, own, whole) of all pages of all hosts.

    A path is marked if two pages and least_share of its host's pages have it, so a host has at most as many marks as its
    pages have paths on average, by least_share. It wins if half of the pages that have it choose it. Else it is chrome if
    at least five different pages have it and the texts in it are at most `distinct` as many as those pages: pages that are
    copies of each other count once, so a copied article is no chrome. Distinct counts are HyperLogLog estimates.
    """
    known = votes.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"), F.count("own").alias("n_own"),
        F.approx_count_distinct("own").alias("texts"), F.approx_count_distinct("whole").alias("pages"),
    )
    known = held.put(known, "known")  # read twice below; a page is not to be scored twice for that
    hosts = known.filter("path = ''").select(F.col("host").alias("_host"), F.col("n").alias("all"))
    known = known.filter("path <> '' and n >= 2").join(hosts, F.col("host") == F.col("_host")).filter(F.col("n") >= F.col("all") * least_share)
    chrome = (F.col("pages") >= 5) & (F.col("n_own") >= 0.8 * F.col("n")) & (F.col("texts") <= distinct * F.col("pages"))
    kind = F.when(F.col("won") * 2 >= F.col("n"), "w").when(chrome, "c").otherwise("l")
    return known.select("host", "path", kind.alias("kind")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "kind"))).alias("marks"))


def main_text(pages: DataFrame, least_share: float = 0.01) -> DataFrame:
    """page_id, url, text, n_chars, host, one row a page, from its whole html.

    First every page scores its containers and names its choice and its other paths; per host these votes tell the paths
    that hold content, those that repeat the same text, and the rest (consensus). Then every page is read again by its
    host's marks (extract). Null or empty html: empty text, no vote. Null urls vote as one host, the empty one. Ties go to
    the deeper, then the later container; repeated rows are treated alike; other columns are ignored; an empty table gives
    an empty result. Only votes are shuffled, summed up before; marks are broadcast when they are few and joined by host
    otherwise. Work on a page grows with its length, however deep its elements are nested.
    """
    held = Held(pages.sparkSession, "html")

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(h, *v) for h, page in zip(pdf["host"], pdf["html"], strict=True) for v in votes(page)]
            host, path, won, own, whole = zip(*got, strict=True) if got else [()] * 5
            yield pd.DataFrame({"host": list(host), "path": list(path), "won": list(won), "own": pd.array(list(own), "Int64"), "whole": list(whole)})

    rows = pages.select("page_id", "url", "html", host_path(F.col("url"))[0].alias("host"))
    marks = consensus(rows.select("host", "html").mapInPandas(voted, "host string, path string, won int, own long, whole long"), held, least_share)
    marks = held.put(marks.withColumnRenamed("host", "_host"), "marks")
    size = marks.agg(F.sum(F.length(F.to_json("marks")) + F.length("_host"))).first()[0] or 0
    if size <= 8_000_000:
        marks = F.broadcast(marks)
    rows = rows.join(marks, F.col("host") == F.col("_host"), "left")

    @F.pandas_udf("string")
    def extracted(html: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([extract(h, None if m is None else dict(m)) for h, m in zip(html, marks, strict=True)], dtype=object)

    out = rows.select("page_id", "url", extracted("html", "marks").alias("text"), "host")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")
