"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, once, ship

BITS = 13
DIMS = 1 << BITS
GRAMS = (1, 2, 3)
CLUSTERS = 4
SAMPLE = 400  # texts per language from which centroids are formed; document frequencies cover all labelled rows
SLOTS = 1 << 30
BLOCK = 64  # texts whose vectors are made at once
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def letters() -> np.ndarray:
    """Per code point, itself if it is a letter, else the blank."""
    return once(("letters",), lambda: np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32))


def has_letter(text: object) -> bool:
    return isinstance(text, str) and any(c.isalpha() for c in text)


def gram_counts(texts: list[object]) -> np.ndarray:
    """Hashed counts of 1- to 3-grams of each whole text, letters lower-cased, all else one blank."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        codes = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        codes = np.concatenate([np.array([32], np.uint32), codes, np.array([32], np.uint32)])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        row = np.zeros(DIMS, dtype=np.int64)
        for n in GRAMS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
            for j in range(n):
                h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint32(FACTORS[j])
                h ^= h >> np.uint32(15)
            row += np.bincount(h >> np.uint32(32 - BITS), minlength=DIMS)
        out[i] = row
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; a row without n-grams stays zero."""
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


@dataclass(frozen=True)
class Centroids:
    """A fitted classifier: its size depends on the number of languages alone."""

    idf: np.ndarray
    langs: list[str]
    vectors: np.ndarray
    floors: np.ndarray

    def classify(self, texts: list[object]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is too far from its centroid, per text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sims = np.zeros((len(texts), len(self.langs)), dtype=np.float64)
        for s in range(0, len(texts), BLOCK):
            sims[s : s + BLOCK] = weighted(gram_counts(texts[s : s + BLOCK]), self.idf) @ self.vectors.T
        best = sims.argmax(axis=1)
        score = np.clip(sims[np.arange(len(texts)), best], 0.0, 1.0)
        blank = np.array([not has_letter(t) for t in texts], dtype=bool)
        far = score < self.floors[best]
        langs = ["und" if b else self.langs[k] for k, b in zip(best, blank)]
        return langs, np.where(blank, 0.0, score), blank | far


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from mutually distant rows; returns centroids and labels."""
    centre = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ centre))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    labels = np.zeros(len(vectors), dtype=int)
    for _ in range(rounds):
        labels = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[labels == j].sum(axis=0) if (labels == j).any() else centroids[j] for j in range(len(centroids))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = sums / np.where(norm == 0, 1, norm)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, sample: int = SAMPLE,
        clusters: int = CLUSTERS, leniency: float = 0.25) -> Centroids:
    """Fit on the rows with a language; rows whose text is null or has no letter teach nothing.

    Document frequencies are counted over all rows. Centroids come from ``sample`` texts of each language
    at most, those least by the hash of ``order``; each language is clustered in a task of its own.
    A text is rejected if its cosine is below ``leniency`` times the least that its centroid's own sample has.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), (order if order is not None else F.xxhash64(text)).alias("ord")
    )

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for b in batches:
            texts = [t for t in b["text"] if has_letter(t)]
            n += len(texts)
            for s in range(0, len(texts), BLOCK):
                total += (gram_counts(texts[s : s + BLOCK]) > 0).sum(axis=0)
        dims = np.flatnonzero(total)
        yield pd.DataFrame({"dim": np.append(dims, DIMS), "df": np.append(total[dims], n)})

    counted = rows.select("text").mapInPandas(frequencies, "dim bigint, df bigint").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMS + 1)
    for r in counted:  # at most DIMS + 1 rows
        df[r["dim"]] = r["df"]
    idf = (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf.sort_values("ord")["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "vector": [], "floor": []})
        vectors = weighted(gram_counts(texts), idf)
        found, labels = cluster(vectors, clusters)
        sims = (vectors @ found.T).max(axis=1)
        floors = [float(sims[labels == j].min()) * leniency if (labels == j).any() else 0.0 for j in range(len(found))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "vector": list(found.astype(np.float32)), "floor": floors})

    # About four times the sample passes a hash threshold first, so what a language's task reads does not grow with the table.
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    spark = labelled.sparkSession
    # As an Arrow table it needs no Python workers of another kind, which would stay in the executors' memory.
    shares = spark.createDataFrame(pa.table({
        "lang": pa.array([r["lang"] for r in per_lang], pa.string()),
        "share": pa.array([min(SLOTS, 4 * sample * SLOTS // r["n"] + 1) for r in per_lang], pa.int64()),
    }))
    thinned = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("ord"), F.lit(SLOTS)) < F.col("share")).drop("share")
    first = W.partitionBy("lang").orderBy(F.xxhash64("ord", F.lit(1)), "ord", "text")
    chosen = thinned.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= sample)
    model = chosen.drop("rn").groupBy("lang").applyInPandas(centroids, "lang string, vector array<float>, floor double").collect()
    model = sorted(model, key=lambda r: (r["lang"], r["floor"]))  # languages times clusters
    vectors = np.array([r["vector"] for r in model], dtype=np.float32).reshape(len(model), DIMS)
    return Centroids(idf, [r["lang"] for r in model], vectors, np.array([r["floor"] for r in model]))


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` to every row.

    ``und`` with score 0, rejected, if the text is null or has no letter, or if nothing was learned. All
    other columns pass through untouched; columns named as the results are replaced. No shuffle.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = model.classify(list(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    out = docs.drop("lang_pred", "score", "rejected")
    # Declared nondeterministic, or a filter on a result would predict once for itself and once for the columns.
    return out.withColumn("__p", predict.asNondeterministic()(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in out.columns], "__p.lang_pred", "__p.score", "__p.rejected"
    )


ship(__name__)
