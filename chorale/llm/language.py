"""Language identification by nearest centroids.

A text becomes a vector of its n-grams (2 to 4 bytes of its lower-cased letters, other characters as
one blank), hashed, weighted by term and inverse document frequency and brought to length 1. Every
language has several centroids, from spherical k-means over its training vectors. A text gets the
language of the centroid with the largest cosine; `rejected` tells that this cosine is below what
`quantile` of the language's own training texts reach.

Centroids are fitted on the texts of at most `per_language` ids of each language (400 by default, the smallest hashes), of
those that the caller marks as training rows; document frequencies are counted over all training rows, and texts are
read whole.

Edge cases: a null text or one without a letter is `und` with a score of 0; so is every text if there
is no training row. Training rows without language, id or letter don't count. Repeated rows get equal
results; an empty table gives an empty result; columns other than doc_id, text and (in training) lang
are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import stored

WIDTH, PER_LANGUAGE, CENTROIDS, QUANTILE = 4_096, 400, 4, 0.005
SIZES = (2, 3, 4)
UNKNOWN = "und"
# Picked ids (and their languages) up to this many are broadcast.
BROADCAST_ROWS = 1_000_000
_OTHER = re.compile(r"[\W\d_]+")
# Code points a pass of the n-gram count holds at once; counts of blocks add up.
_BLOCK = 1 << 20


def counts_of(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None if it has no letter."""
    letters = "" if text is None else _OTHER.sub(" ", text.lower()).strip()
    if not letters:
        return None
    raw = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(WIDTH, np.int64)
    for begin in range(0, len(raw), _BLOCK):
        part = raw[begin:begin + _BLOCK + max(SIZES) - 1]
        for size in SIZES:
            # An n-gram belongs to the block in which it begins.
            n = min(_BLOCK, len(part) - size + 1)
            if n <= 0:
                continue
            gram = part[:n].copy()
            for k in range(1, size):
                gram = gram * np.uint32(257) + part[k:n + k]
            gram = (gram + np.uint32(size)) * np.uint32(0x9E3779B1) >> np.uint32(20)
            out += np.bincount(gram, minlength=WIDTH)
    return out


def vector_of(counts: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * inverse
    return x / (np.linalg.norm(x) or 1.0)


def centroids(x: np.ndarray, number: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from the row farthest from those taken before."""
    at = [0]
    while len(at) < min(number, len(x)):
        nearest = (x @ x[at].T).max(axis=1)
        at.append(int(nearest.argmin()))
    middle = x[at].copy()
    for _ in range(rounds):
        own = (x @ middle.T).argmax(axis=1)
        for k in range(len(middle)):
            if (own == k).any():
                mean = x[own == k].mean(axis=0)
                middle[k] = mean / (np.linalg.norm(mean) or 1.0)
    return middle


@dataclass
class Model:
    inverse: np.ndarray
    middles: np.ndarray
    langs: list[str]
    least: dict[str, float]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = counts_of(text) if self.langs else None
        if counts is None:
            return UNKNOWN, 0.0, True
        cosine = self.middles @ vector_of(counts, self.inverse)
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.langs[best], score, score < self.least[self.langs[best]]


def fit(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE, number: int = CENTROIDS,
        quantile: float = QUANTILE) -> Model:
    """docs: doc_id, text, lang. One task fits one language from at most `per_language` ids; how many documents have an
    n-gram is counted over all training rows."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Ranked within buckets of a language first, so no task sees more than 64 * per_language ids of one.
    own = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))).orderBy(*order)
    train = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"),
                        training.alias("trains")).filter("trains and doc_id is not null and lang is not null")
    picked = (train.select("doc_id", "lang").distinct()
              .withColumn("n", F.row_number().over(own)).filter(F.col("n") <= per_language)
              .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
              .filter(F.col("n") <= per_language).select("doc_id", "lang"))
    picked = stored(picked, "picked")
    # At most `per_language` rows a language; counted, as nothing bounds the number of languages.
    few = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    texts = train.select("doc_id", "lang", "text").join(few, ["doc_id", "lang"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [(lang, c.astype(np.int32).tobytes()) for lang, t in zip(batch["lang"], batch["text"], strict=True)
                   if (c := counts_of(t)) is not None]
            yield pd.DataFrame(own, columns=["lang", "counts"])
    rows = stored(texts.mapInPandas(count, "lang string, counts binary"), "languages")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                if (c := counts_of(text)) is not None:
                    total, n = total + (c > 0), n + 1
        yield pd.DataFrame({"gram": np.arange(-1, WIDTH), "docs": np.append(n, total)})
    # WIDTH + 1 rows, the first one the number of documents.
    parts = train.select("text").mapInPandas(spread, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    found = {r["gram"]: r["docs"] for r in parts.collect()}
    if not found.get(-1):
        return Model(np.zeros(WIDTH), np.zeros((0, WIDTH)), [], {})
    inverse = np.log((1 + found[-1]) / (1 + np.array([found[k] for k in range(WIDTH)]))) + 0.1

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(sorted((vector_of(np.frombuffer(c, np.int32), inverse) for c in group["counts"]), key=lambda v: v.tobytes()))
        middle = centroids(x, number)
        least = float(np.quantile((x @ middle.T).max(axis=1), quantile))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "least": least,
                             "middle": [m.astype(np.float32).tobytes() for m in middle]})
    fitted = rows.groupBy("lang").applyInPandas(cluster, "lang string, least double, middle binary").collect()
    fitted.sort(key=lambda r: (r["lang"], bytes(r["middle"])))
    return Model(inverse, np.stack([np.frombuffer(r["middle"], np.float32) for r in fitted]).astype(float),
                 [r["lang"] for r in fitted], {r["lang"]: r["least"] for r in fitted})


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([model.predict(t) for t in batch["text"]], columns=["lang_pred", "score", "rejected"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id long, lang_pred string, score double, rejected boolean")
