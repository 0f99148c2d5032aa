"""WARC archives, their capture runs, and the merge of runs into one ordered index."""

from __future__ import annotations

import base64
import hashlib
import json
import tempfile
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, new_folder, ship, written

RECORDS_PER_ARCHIVE = 2_000
RUN_CAPTURES = 100_000
CHUNK_CAPTURES = 500
RANGES = 64
PER_RANGE = 20


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query, without scheme, port, fragment and case of the host."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digests(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Digest and size of every payload, computed where the page is read."""

    @F.pandas_udf("payload_digest string, payload_bytes bigint")
    def digest(texts: pd.Series) -> pd.DataFrame:
        data = [t.encode() if isinstance(t, str) else b"" for t in texts]
        return pd.DataFrame({"payload_digest": [payload_digest(d) for d in data], "payload_bytes": [len(d) for d in data]})

    return pages.withColumn("__d", digest(F.col(f"`{payload}`")))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html",
                   captured_at: Column | None = None) -> None:
    """One record per page in WARC files of at most ``RECORDS_PER_ARCHIVE`` records, written by Spark's text sink.

    Of pages with equal payloads of at least ``min_bytes`` the one with the least key is a response, the
    others are revisits of it, without payload; pages of one key and payload are alike. Shorter payloads are
    all responses. A null payload is the empty one, a null URL an empty target. Empty tables write no record.
    """
    bound_batches(pages.sparkSession)
    at = captured_at if captured_at is not None else F.timestamp_seconds(F.lit(0))
    rows = digests(pages, key, payload).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "__d.payload_digest", "__d.payload_bytes",
    )
    # Copies alone need the join: a digest of one page is a response wherever it is.
    first = (
        digests(pages, key, payload).select(F.col(f"`{key}`").alias("key"), "__d.payload_digest", "__d.payload_bytes")
        .where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("again")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    linked = rows.join(first, F.col("payload_digest") == F.col("again"), "left").withColumn(
        "refers", F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    )
    revisit = F.col("refers").isNotNull()

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    record = F.concat(
        F.lit("WARC/1.1"), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(">"))),
        header("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit(""))), header("WARC-Date", F.col("date")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.coalesce(header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">"))), F.lit("")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")), F.lit("\r\nContent-Type: text/html"),
        header("Content-Length", F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")), F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n"),
    )
    linked.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_ARCHIVE
    ).text(folder)


def records_of(archive: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, headers and payload of each record of an uncompressed archive."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, view[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def captures_of(path: str, content: bytes) -> Iterator[tuple]:
    """Index entries of one archive: the sort key ``(url key, time, page)`` first. Payloads are checked against their digests."""
    for offset, h, payload in records_of(zlib.decompress(content, wbits=47) if content[:2] == b"\x1f\x8b" else content):
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and payload_digest(payload) != digest:
            raise ValueError(f"{path}: payload at {offset} does not match its digest")
        page, refers = (h.get(n, "").removeprefix("<urn:page:").removesuffix(">") for n in ("WARC-Record-ID", "WARC-Refers-To"))
        page_no = int(page) if page else None
        yield (url_key(h["WARC-Target-URI"]), h["WARC-Date"], -1 if page_no is None else page_no, h["WARC-Target-URI"], page_no, h["WARC-Type"],
               digest, int(h["X-Payload-Length"]), int(refers) if refers else None, path, offset)


def capture_runs(archives: DataFrame) -> DataFrame:
    """Locally sorted runs: each task sorts up to ``RUN_CAPTURES`` captures and cuts the run into chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                held += captures_of(path.rsplit("/", 1)[-1], bytes(content))
                if len(held) >= RUN_CAPTURES:
                    yield _chunks(held)
                    held = []
        if held:
            yield _chunks(held)

    return archives.select("path", "content").mapInPandas(run, "run string, seq int, low string, high string, n int, entries binary")


def _chunks(captures: list[tuple]) -> pd.DataFrame:
    captures.sort(key=lambda c: c[:3])
    name = f"{captures[0][9]}:{captures[0][10]}:{captures[0][0]}"
    parts = [captures[i : i + CHUNK_CAPTURES] for i in range(0, len(captures), CHUNK_CAPTURES)]
    return pd.DataFrame({
        "run": name, "seq": range(len(parts)), "low": [sort_text(p[0]) for p in parts], "high": [sort_text(p[-1]) for p in parts],
        "n": [len(p) for p in parts], "entries": [zlib.compress(json.dumps(p).encode(), 3) for p in parts],
    })


def sort_text(capture: tuple | list) -> str:
    """The sort key as one text whose order by code points is that of ``(url key, time, page)``."""
    return f"{capture[0]}\x00{capture[1]}\x00{capture[2] + (1 << 63):020d}"


class LoserTree:
    """Merge of k sorted streams: inner nodes hold the losers, the winner moves up in log k comparisons."""

    def __init__(self, streams: list[Iterator], key: Callable) -> None:
        self.streams, self.key, self.k = streams, key, max(1, len(streams))
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(len(streams)):
            self._advance(i)
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.streams[i], None) if i < len(self.streams) else None
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        if ka is None or kb is None:
            return kb is None and (ka is not None or a < b)
        return (ka, a) < (kb, b)

    def __iter__(self) -> Iterator:
        while self.keys[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merge_runs(runs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Captures in one global order: key range, then place in it.

    Range borders are quantiles of ``ranges * PER_RANGE`` chunk borders, chosen by hash. A chunk goes to every
    range it touches. The task of a range spools its chunks to a scratch file, then merges the runs with one
    decoded chunk per run in memory, whatever the length of the range. One URL may span ranges, as time and
    page are part of the key. An empty index has no rows.
    """
    picked = runs.select("low").orderBy(F.xxhash64("low"), "low").limit(ranges * PER_RANGE).collect()
    lows = sorted(r["low"] for r in picked)
    borders = sorted({lows[len(lows) * i // ranges] for i in range(1, ranges)}) if lows else []

    @F.pandas_udf("array<int>")
    def touched(low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([np.arange(bisect_left(borders, a), bisect_left(borders, b) + 1) for a, b in zip(low, high)])

    dealt = runs.withColumn("range", F.explode(touched("low", "high"))).repartition(ranges, "range").sortWithinPartitions("range", "run", "seq")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryFile() as spool:
            places: dict[int, dict[str, list[tuple[int, int]]]] = {}
            for b in batches:
                for rng, run, data in zip(b["range"], b["run"], b["entries"]):
                    places.setdefault(int(rng), {}).setdefault(run, []).append((spool.tell(), len(data)))
                    spool.write(data)

            def stream(chunks: list[tuple[int, int]], low: str, high: str | None) -> Iterator[list]:
                for at, size in chunks:
                    spool.seek(at)
                    for capture in json.loads(zlib.decompress(spool.read(size))):
                        text = sort_text(capture)
                        if text > low and (high is None or text <= high):
                            yield capture

            for rng, by_run in places.items():
                low, high = borders[rng - 1] if rng else "", borders[rng] if rng < len(borders) else None
                rows: list[list] = []
                place = 0
                for capture in LoserTree([stream(c, low, high) for c in by_run.values()], lambda c: (c[0], c[1], c[2])):
                    rows.append([rng, place, *capture])
                    place += 1
                    if len(rows) == 5_000:
                        yield _index_frame(rows)
                        rows = []
                if rows:
                    yield _index_frame(rows)

    return dealt.select("range", "run", "entries").mapInPandas(
        merge, "range int, place bigint, url_key string, captured_at string, url string, page_id bigint, record_type string, "
        "payload_digest string, payload_bytes bigint, refers_to bigint, archive string, record_offset bigint"
    )


def _index_frame(rows: list[list]) -> pd.DataFrame:
    names = ["range", "place", "url_key", "captured_at", "order", "url", "page_id", "record_type", "payload_digest", "payload_bytes",
             "refers_to", "archive", "record_offset"]
    columns = dict(zip(names, zip(*rows)))
    del columns["order"]
    return pd.DataFrame(columns | {c: pd.array(columns[c], dtype="Int64") for c in ("page_id", "refers_to")})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives as rows, one file each; their size is bounded when they are written."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def capture_index(spark: SparkSession, folder: str, ranges: int = RANGES) -> DataFrame:
    """The globally ordered capture index of all archives in ``folder``."""
    return merge_runs(written(capture_runs(read_archives(spark, folder)), "runs"), ranges)


def archive_and_index(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", **options: object) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and return their merged index."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, min_bytes, key, **options)
    return capture_index(pages.sparkSession, folder)


ship(__name__)
