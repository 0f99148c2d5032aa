"""Main text of web pages by container paths on which the pages of a host agree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, ship, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|textarea|title|iframe|object|canvas|audio|video|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BESIDE = 80
BLANKS = re.compile(r"\s+")
WORD_BORDER = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button dialog menu head fieldset label".split())
STRUCTURE = frozenset("html body main article section div td center".split())
LEAVES = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr th figure figcaption address details summary header hgroup".split()
)
BLOCKS = STRUCTURE | LEAVES | DROPPED | {"hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open element on the left ends where one on the right starts.
CLOSED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    **{h: HEADINGS for h in HEADINGS},
}
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager comment comments disqus "
    "respond reply replies discussion footer header masthead topbar toolbar search skip paywall teaser outbrain taboola".split()
)
NEUTRAL = frozenset(
    "box block area section list wrapper wrap container site page top bottom left right main inner outer global user reader readers article post "
    "entry story body slot unit google text item items link links bar panel group primary secondary region module form thread the a of and "
    "js is sticky fixed col column row media buttons button icons icon content div el id".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())


def boilerplate_name(name: str) -> bool:
    """Whether a class or id consists of words for page furniture and neutral words alone."""
    words = [w for w in WORD_BORDER.split(CAMEL.sub("-", name).lower()) if w]
    return any(w in BOILER for w in words) and all(w in BOILER or w in NEUTRAL for w in words)


@dataclass
class Node:
    tag: str
    path: str
    dropped: bool
    in_article: bool
    mark: int = 0


@dataclass
class Page:
    """Blocks in page order: container path, whether inside page furniture, text, characters within links."""

    blocks: list[tuple[str, str, int]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Blocks of text outside page furniture, with the generalised tag-class path of their container."""
    page, stack, buffer = Page(), [Node("", "", False, False)], []
    links, anchors, at = 0, 0, 0
    names: dict[str, tuple[str, bool]] = {}

    def flush() -> None:
        nonlocal links
        if buffer:
            raw = "".join(buffer)
            text = BLANKS.sub(" ", unescape(raw) if "&" in raw else raw).strip()
            if text and not stack[-1].dropped:
                page.blocks.append((stack[-1].path, text, links))
            buffer.clear()
        links = 0

    def close_span() -> None:
        """An inline element that is furniture takes its own text out of the block around it."""
        node = stack.pop()
        if node.dropped and not stack[-1].dropped:
            del buffer[node.mark :]

    def close_spans() -> None:
        while stack[-1].tag == "span":
            close_span()

    def described(tag: str, rest: str) -> tuple[str, bool]:
        """Generalised name of an element and whether its attributes mark it as furniture."""
        given = {}
        for name, value in ATTRIBUTE.findall(rest):
            given.setdefault(name.lower(), value.strip("\"'"))
        classes = unescape(given.get("class", "")).split()
        ident = given.get("id", "")
        out = any(map(boilerplate_name, classes)) or (ident != "" and boilerplate_name(ident))
        out = out or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
        out = out or "display:none" in given.get("style", "").replace(" ", "").lower()
        kept = sorted({re.sub(r"\d+", "", c) for c in classes} - {""})
        return ".".join([tag, *kept]), out

    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            buffer.append(piece)
            if anchors:
                links += len(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), m[2], m[4]
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in BLOCKS and tag != "span":
            continue
        block = tag in BLOCKS
        if closing:
            if not block:
                if stack[-1].tag == "span":
                    close_span()
                continue
            close_spans()
            flush()
            anchors = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if block:
            close_spans()
            flush()
            anchors = 0
            while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
                stack.pop()
        if tag in VOID or rest.endswith("/") and tag == "span":
            continue
        parent = stack[-1]
        if rest:
            key = f"{tag} {rest}"
            if key not in names:
                names[key] = described(tag, rest)
            name, furniture = names[key]
        else:
            name, furniture = tag, False
        if tag in ("html", "body", "main", "article"):
            furniture = furniture and tag == "article"
        dropped = parent.dropped or furniture or tag in DROPPED
        if tag == "header" and not parent.in_article:
            dropped = True
        if not block:
            stack.append(Node(tag, parent.path, dropped, parent.in_article, len(buffer)))
            continue
        path = f"{parent.path}/{name}" if tag in STRUCTURE else parent.path
        stack.append(Node(tag, path, dropped, parent.in_article or tag in ("article", "main")))
    if at < len(html):
        buffer.append(html[at:])
    close_spans()
    flush()
    return page


def scores(page: Page) -> dict[str, float]:
    """Score of each container: the unlinked text of its own blocks, half of that for its parent."""
    out: dict[str, float] = {}
    for path, text, linked in page.blocks:
        own = max(0, len(text) - 2 * linked) + 10 * text.count(",")
        out[path] = out.get(path, 0.0) + own
        parent = path.rpartition("/")[0]
        if parent:
            out[parent] = out.get(parent, 0.0) + own / 2
    return out


def widened(page: Page, path: str) -> str:
    """The widest ancestor of a container that holds further text of its quality beside it; furniture is not in ``page``.

    Text beside it counts if at most a third of it is linked and its blocks are ``BESIDE`` characters long on average
    or a quarter as long as those of the container. An article is only widened to further articles.
    """
    parts = path.split("/")
    within = any(part.partition(".")[0] == "article" for part in parts)
    size = blocks = 0
    beside: dict[tuple[int, str], list[int]] = {}
    for p, text, linked in page.blocks:
        names = p.split("/")
        depth = next((i for i, (a, b) in enumerate(zip(names, parts)) if a != b), min(len(names), len(parts)))
        if depth == len(parts):
            size, blocks = size + len(text), blocks + 1
        elif not within or any(n.partition(".")[0] == "article" for n in names[depth:]):
            found = beside.setdefault((depth, names[depth] if depth < len(names) else ""), [0, 0, 0])
            found[0] += len(text)
            found[1] += linked
            found[2] += 1
    enough = min(BESIDE, size / max(1, blocks) / 4)
    depths = [d for (d, _), (n, linked, count) in beside.items() if 3 * linked <= n and n >= enough * count]
    return "/".join(parts[: min(depths, default=len(parts))])


def best_path(page: Page) -> tuple[str, float]:
    """The best container; within an article, the outermost article. Both are widened to text of like quality beside them."""
    ranked = scores(page)
    if not ranked:
        return "", 0.0
    path = min(ranked, key=lambda p: (-ranked[p], p))
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part.partition(".")[0] == "article":
            return widened(page, "/".join(parts[: i + 1])), ranked[path]
    return widened(page, path), ranked[path]


def under(place: str, path: str) -> bool:
    return place == path or place.startswith(path + "/") or not path


def text_under(page: Page, path: str) -> str:
    return "\n\n".join(text for p, text, _ in page.blocks if under(p, path))


def main_text(html: str, agreed: str | None) -> str:
    """The text under the path the host agreed on, if that has all but a twentieth of the page's own best text; else the latter."""
    page = parse(html)
    own = best_path(page)[0]
    if agreed:
        mine = [(p, len(text)) for p, text, _ in page.blocks if under(p, own)]
        if mine and 20 * sum(n for p, n in mine if not under(p, agreed)) <= sum(n for _, n in mine):
            return text_under(page, agreed)
    return text_under(page, own)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path``: per host the path with most votes, then the highest total score.

    Each page casts one vote; votes are summed before the shuffle, so a host of any size is a few rows.
    """

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [best_path(parse(h)) if isinstance(h, str) else ("", 0.0) for h in b["html"]]
            yield pd.DataFrame({"host": b["host"], "path": [p for p, _ in found], "score": [s for _, s in found]})

    votes = (
        pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInPandas(vote, "host string, path string, score double")
        .where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    )
    first = W.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return votes.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("host", "path")


def extract(pages: DataFrame, url: str = "url", html: str = "html", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """Add the main text and its code points to every page.

    Null and empty pages, and pages without a container, give the empty text; a null or odd URL belongs to the host
    ``''``. Repeated rows stay; other columns pass through, those named as the results are replaced. The agreed paths
    are written as a table, so Spark broadcasts them while small and else joins by host, splitting hot hosts.
    """
    bound_batches(pages.sparkSession)
    agreed = written(winning_paths(pages, url, html), "paths")

    @F.pandas_udf("string")
    def body(htmls: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, p if isinstance(p, str) else None) if isinstance(h, str) else "" for h, p in zip(htmls, paths)], dtype=object)

    kept = pages.drop(text_col, count_col)
    joined = kept.withColumn("__host", host_of(F.col(url))).join(
        agreed.select(F.col("host").alias("__h"), F.col("path").alias("__path")), F.col("__host") == F.col("__h"), "left"
    )
    out = joined.withColumn("__text", body(F.col(html), F.col("__path")))
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("__text").alias(text_col), F.length("__text").cast("bigint").alias(count_col))


ship(__name__)
