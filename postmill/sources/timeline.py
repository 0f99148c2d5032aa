"""Timeline HTML pages to tweets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import ship

SITE = "https://nitter.net"
# Icon class, statistic, and whether thousands separators are removed.
STATS = {
    "icon-comment": ("replies", False),
    "icon-retweet": ("retweets", False),
    "icon-quote": ("quotes", False),
    "icon-heart": ("likes", True),
    "icon-play": ("plays", True),
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
COLUMNS = ["page_no", "pos", "user", "path", "title", "replying", "content", "stats", "next_cursor"]
RAW = ("page_no bigint, pos int, user string, path string, title string, replying string, content string, "
       "stats map<string,string>, next_cursor string")


class _Page(HTMLParser):
    """Collects timeline items; ``stack`` holds the classes of the open elements."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[tuple[str, set[str]]] = []
        self.items: list[dict] = []
        self.cursor: str | None = None

    def inside(self, name: str) -> bool:
        return any(name in classes for _, classes in self.stack)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        classes = set((given.get("class") or "").split())
        href = given.get("href")
        if tag == "a" and href and "cursor=" in href:
            found = re.search(r"cursor=([^&#]+)", href)
            self.cursor = unquote(found.group(1)) if found else None
        if "timeline-item" in classes and self.inside("timeline"):
            self.items.append({"path": None, "title": None, "replying": "", "content": "", "stats": {}, "body": False})
        if self.items and self.inside("timeline-item"):
            item = self.items[-1]
            if "tweet-body" in classes:
                item["body"] = True
            if tag == "a" and "tweet-link" in classes and item["path"] is None:
                item["path"] = href
            if tag == "a" and self.inside("tweet-date") and item["title"] is None:
                item["title"] = given.get("title")
            if "tweet-stat" in classes and self.inside("tweet-stats"):
                item["stat"], item["text"] = None, ""
            if tag == "span" and self.inside("icon-container"):
                item["stat"] = next((n for c, (n, _) in STATS.items() if c in classes), item.get("stat"))
        if tag not in VOID:
            self.stack.append((tag, classes))

    def handle_endtag(self, tag: str) -> None:
        if all(name != tag for name, _ in self.stack):
            return  # a stray end tag closes nothing
        while self.stack:
            name, classes = self.stack.pop()
            if "tweet-stat" in classes and self.items and self.items[-1].get("stat"):
                item = self.items[-1]
                item["stats"][item["stat"]] = item["text"].strip()
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.items or not self.inside("tweet-body"):
            return
        item = self.items[-1]
        for name, key in (("replying-to", "replying"), ("tweet-content", "content"), ("tweet-stat", "text")):
            if self.inside(name):
                item[key] = item.get(key, "") + data


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page_no, user, html in zip(batch["page_no"], batch["user"], batch["html"]):
            page = _Page()
            page.feed(html or "")
            page.close()
            for pos, item in enumerate(i for i in page.items if i["body"]):
                rows.append((page_no, pos, user, item["path"], item["title"], item["replying"], item["content"],
                             item["stats"], page.cursor))
        yield pd.DataFrame(rows, columns=COLUMNS)


def extract_timeline_pages(pages: DataFrame) -> DataFrame:
    """Tweets of (page_no, user, html); items without a readable date are skipped.

    Only the walk through the HTML is Python; dates, ids and counters are columns.
    """
    raw = pages.select("page_no", "user", "html").mapInPandas(_parse, RAW)
    clean = F.trim(F.regexp_replace("title", r"\s*·\s*", " "))
    ts = F.try_to_timestamp(
        F.regexp_replace(clean, r"\s*UTC$", ""), F.lit("MMM d, yyyy h:mm a")
    )

    def count(name: str, commas: bool):
        text = F.col("stats")[name]
        digits = F.replace(text, F.lit(","), F.lit("")) if commas else text
        return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")).alias(name)

    tweets = raw.withColumn("ts", ts).where("ts IS NOT NULL")
    tweet_id = F.regexp_extract("path", r"status/(\d+)", 1)
    return tweets.select(
        "page_no", "pos", F.when(tweet_id != "", tweet_id).alias("id"), F.concat(F.lit(SITE), F.col("path")).alias("url"),
        "user", "ts", F.regexp_replace(F.trim("replying"), r"(?i)^Replying to\s*", "").alias("replying_to"),
        F.trim("content").alias("content"), F.struct(*[count(n, c) for n, c in STATS.values()]).alias("stats"), "next_cursor",
    )


ship(__name__)
