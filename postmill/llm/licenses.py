"""License scans by diagonal voting: word grams joined to template positions vote for offsets, spans are then verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from postmill.llm.common import bound_batches, ship, written

GRAM = 3
VOTES = 4
SLACK = 6
COVER = 0.75
BLOCK = 1 << 18
BROADCAST_GRAMS = 200_000  # 16 bytes and the gram's words each: some 20 MB

# Phrases that name a license wherever their words stand consecutively.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Notices as their licenses publish them; words may differ in a text.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied."""),
    ("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither
        the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("cc-by-nc", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."""),
    ("cc-by", """This work is licensed under the Creative Commons Attribution 4.0 International License."""),
]

SPACE = np.ones(256, dtype=bool)
SPACE[0x30:0x3A] = SPACE[0x61:0x7B] = SPACE[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the hash base and of its inverse modulo ``2 ** 64``, as many as were asked for."""

    def __init__(self) -> None:
        self.forth = self.back = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.forth):
            grown = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                row = np.full(n, base, dtype=np.uint64)
                row[0] = 1
                grown.append(np.multiply.accumulate(row))
            self.forth, self.back = grown
        return self.forth[:n], self.back[:n]


def word_hashes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of ``data`` (A-Z as a-z) and where each word starts, in blocks that end between words."""
    raw = np.frombuffer(data, dtype=np.uint8)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not SPACE[LOWER[raw[end - 1]]]:
            gap = np.flatnonzero(SPACE[LOWER[raw[end : end + BLOCK]]])
            end = end + int(gap[0]) + 1 if len(gap) else min(len(raw), end + BLOCK)
        low = LOWER[raw[at:end]]
        inside = np.zeros(len(low) + 2, dtype=np.int8)
        inside[1:-1] = ~SPACE[low]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        forth, back = powers.upto(len(low) + 1)
        # Prefix sums of byte * base ** place: the difference over a word, moved to place 0, is its polynomial hash.
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * forth[:-1], dtype=np.uint64, out=sums[1:])
        h = (sums[e] - sums[s]) * back[s]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each run of ``k`` words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x94D049BB133111EB) + words[i : i + n]
    return out.view(np.int64)


def words_of(text: str) -> list[str]:
    """Words of a template; the small sibling of ``word_hashes``."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return bytes(np.where(SPACE[LOWER[data]], 0x20, LOWER[data]).astype(np.uint8)).decode().split(" ") if len(data) else []


def grams_column(k: int):
    """A column function: digest and number of words of a text, its gram hashes and where its words start.

    The hashes follow one number that stands for the text itself; the starts end with the length in bytes.
    """

    def grams(texts: pd.Series) -> pd.DataFrame:
        powers, rows = Powers(), []
        for t in texts:
            data = (t or "").encode()
            h, s = word_hashes(data, powers)
            own = np.zeros(max(0, len(h) - k + 1) + 1, dtype=np.int64)
            own[1:] = gram_hashes(h, k)
            rows.append((hashlib.blake2b(data, digest_size=16).digest(), len(h), own, np.append(s, len(data)).astype(np.int32)))
        return pd.DataFrame(rows, columns=["digest", "n_words", "hashes", "starts"])

    return pandas_udf(grams, "digest binary, n_words bigint, hashes array<bigint>, starts array<int>")


def template_rows(templates: list[tuple[str, str, bool]], k: int) -> list[tuple]:
    """Every gram of every template: ``(template, label, exact, words, place, hash, gram)``."""
    rows = []
    for t, (label, text, exact) in enumerate(templates):
        words = [w for w in words_of(text) if w]
        if len(words) < k:
            raise ValueError(f"template {t} ({label}) has fewer than {k} words")
        hashes = gram_hashes(word_hashes(text.encode(), Powers())[0], k).tolist()
        rows += [(t, label, exact, len(words), p, h, " ".join(words[p : p + k])) for p, h in enumerate(hashes)]
    return rows


def _plain(piece: Column) -> Column:
    """The words of a piece of text, lower-cased in A-Z, one blank between them."""
    low = F.translate(piece, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def votes(docs: DataFrame, templates: list[tuple[str, str, bool]], k: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rolling grams of all texts joined to the templates' grams, and a row for each text, as a written table.

    ``key, digest, n_words, template, label, exact, words, place, at``: the gram at word ``at`` of the text is, word by word, the one
    at ``place`` of the template; ``template`` is null and ``at`` -1 in the row of the text itself.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = template_rows(templates, k)
    known = spark.createDataFrame(rows, "template int, label string, exact boolean, words int, place int, h bigint, gram string")
    known = F.broadcast(known) if len(rows) <= BROADCAST_GRAMS else known
    read = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("g", grams_column(k)("body"))
    each = read.select("key", "body", "g.digest", "g.n_words", "g.starts", F.posexplode("g.hashes").alias("nth", "hash"))
    joined = each.join(known, (F.col("hash") == F.col("h")) & (F.col("nth") > 0), "left").where("template IS NOT NULL OR nth = 0")
    first, end = F.get("starts", F.col("nth") - 1), F.get("starts", F.col("nth") - 1 + k)
    said = _plain(F.substring(F.encode("body", "UTF-8"), first + 1, end - first).cast("string"))
    same = F.when(F.col("nth") > 0, said == F.col("gram")).otherwise(True)
    return written(
        joined.where(same).select("key", "digest", "n_words", "template", "label", "exact", "words", "place", (F.col("nth") - 1).alias("at")), "votes"
    )


def license_spans(voted: DataFrame, k: int = GRAM, least_votes: int = VOTES, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """Verified spans of each text: ``digest, template, label, exact, first_word, end_word, score``.

    An exact template needs every gram of one diagonal, and each such diagonal is a span. Otherwise diagonals of at least
    ``least_votes`` grams (all, of a shorter template) and those within ``slack`` words of one, be their votes fewer, become
    one span with their neighbours; it holds when the template's words it covers are at least ``cover`` of the template and of the span itself.
    """
    hit = voted.where("template IS NOT NULL").withColumn("diagonal", F.col("at") - F.col("place"))
    # Copies of a text repeat its votes; they are one vote, combined before the shuffle.
    hit = hit.groupBy("digest", "template", "label", "exact", "words", "diagonal", "place").agg(F.first("at").alias("at"))
    own = W.partitionBy("digest", "template", "diagonal")
    hit = hit.withColumn("votes", F.count(F.lit(1)).over(own)).withColumn("grams", F.col("words") - (k - 1))
    exact = hit.where("exact AND votes = grams AND place = 0").select(
        "digest", "template", "label", "exact", F.col("at").alias("first_word"), (F.col("at") + F.col("words")).alias("end_word"), F.lit(1.0).alias("score")
    )
    along = W.partitionBy("digest", "template").orderBy("diagonal", "place")
    near = F.least(F.lit(slack), F.floor(F.col("words") / 2))
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > near).cast("int"), F.lit(1))
    beside = W.partitionBy("digest", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    loose = hit.where(~F.col("exact")).withColumn("strong", F.max("votes").over(beside))
    loose = loose.where(F.col("strong") >= F.least(F.lit(least_votes), F.col("grams"))).withColumn("apart", apart)
    merged = loose.withColumn("span", F.sum("apart").over(along))
    keys = ["digest", "template", "label", "exact", "words", "span"]
    covered = merged.select(*keys, "at", F.explode(F.sequence(F.col("place"), F.col("place") + (k - 1))).alias("word"))
    covered = covered.groupBy(*keys, "word").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    spans = covered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("first_word"), (F.max("high") + k).alias("end_word"))
    spans = spans.withColumn("score", F.col("n") / F.greatest("words", F.col("end_word") - F.col("first_word"))).where(F.col("score") >= cover)
    return exact.unionByName(spans.select(*exact.columns))


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, k: int = GRAM,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` what its text says of licenses: ``key, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Words are runs of digits, letters and all code points from U+0080, A-Z as a-z. ``phrases`` are found wherever their words stand
    consecutively (``n_base`` places, least and greatest first word), ``notices`` also with words changed, added or left out;
    both are ``(label, text)`` of ``k`` words at least. Labels are distinct, sorted and joined by commas; ``score`` is the best span's, 1 for a phrase, 0
    for none. Spark explodes every word gram of every text and joins it to the templates' grams (broadcast only up to
    ``BROADCAST_GRAMS``), so nothing but votes is shuffled; texts are told apart by digest, so copies vote once. A null text
    is an empty one; null keys, repeated rows and rows of one key each have their row; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    templates = [(label, t, True) for label, t in phrases] + [(label, t, False) for label, t in notices]
    voted = votes(docs, templates, k, key, text)
    base = F.when(F.col("exact"), F.col("first_word"))
    # Distinct labels of a text: as many as the templates have.
    per = license_spans(voted, k).groupBy("digest").agg(
        F.count_if("exact").alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base"), F.collect_set("label").alias("all"), F.max("score").alias("score"),
    )
    salts = 16
    copies = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = voted.where("at = -1").select(F.col("key").cast(kind), "digest", "n_words", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"))
    return rows.join(copies, ["digest", "salt"], "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort("base"), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort("all"), ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


ship(__name__)
