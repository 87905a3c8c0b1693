"""Ranked lexical search by norm buckets: the best documents of each query item, by exact integer scores.

Terms are runs of ASCII digits and letters (A-Z lower-cased) and characters beyond ASCII. A document is the vector of
its impacts x = (10 ** 9 * tf) div (1000 * tf + 8 * m) over the terms that queries ask for, a query the vector of its
weights w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), times the repeats; their inner product is the score. N
documents have a term, df the one at hand; m = 25 + (75 * n * N) div L for a document of n terms, L all terms of all.

Both sides of a coordinate are scaled by the root of its weight, which leaves products as they are and makes lengths say
more. Documents are ordered by length, the longest first, in ranges and, within a range, in buckets. A query takes the
buckets in that order with the score of its `top`-th best so far as threshold (it starts from what the longest
`head` of all documents give). Where query length times document length stays below the threshold, all later documents are out
(Cauchy-Schwarz). In the buckets left, the query's `focus` largest coordinates say in which range a document's share of
its own length must lie to reach the threshold at all. Survivors are scored in 64-bit integers. Bounds are only used
with a slack above rounding, and ties survive, so the result is exact.

Queries are the stated set: they go over the documents in blocks of `block_chars` characters, so neither the driver nor
a task holds more than one block; each gathers its best ones per range, and only those meet.

Edge cases: null and empty texts and texts without a term are no documents and no queries; very long texts are read
whole; a null doc_id ranks behind all others of its score, a null item_id is an item; rows that repeat an item's id and
text are one item, other texts of that id are items of their own; repeated document rows are documents of their own; an
empty table on either side gives an empty result; columns other than ids and texts are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import running_sums, stored

TOP, BUCKET, HEAD, FOCUS = 10, 2_048, 1 / 64, 5
BLOCK_CHARS = 1_000_000
SLACK = 1e-9
# Bytes beyond ASCII belong to characters beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    return [] if text is None else TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def query_blocks(queries: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their terms, in lists of about `block_chars` characters; one list at a time is on the driver."""
    rows = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    numbered = running_sums(rows.withColumn("chars", F.length("text")), [F.col("item_id"), F.col("text")], {"upto": "chars"})
    numbered = stored(numbered.withColumn("block", F.floor(F.col("upto") / block_chars)), "items")
    for (block,) in numbered.select("block").distinct().orderBy("block").toLocalIterator():
        found = numbered.filter(F.col("block") == block).orderBy("item_id", "text").select("item_id", "text").collect()
        items = [(i, Counter(terms_of(t))) for i, t in found]
        items = [x for x in items if x[1]]
        if items:
            yield items


def _vectors(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms and counts of the documents that hold a term of `place`; of the others one row a batch with
    their number (docs) and all their terms (n)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, docs_, rest = [], 0, 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = terms_of(text)
                counts = Counter(place[t] for t in words if t in place)
                if counts:
                    own = np.array(sorted(counts.items()), "<u4")
                    out.append((doc, 1, len(words), own.T.tobytes()))
                elif words:
                    docs_, rest = docs_ + 1, rest + len(words)
            if docs_:
                out.append((None, docs_, rest, None))
            frame = pd.DataFrame(out, columns=["doc_id", "docs", "n", "vector"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInPandas(run, "doc_id long, docs long, n long, vector binary")


def _document_counts(vectors: DataFrame, width: int) -> np.ndarray:
    """Documents with each term: at most `width` rows reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(width, np.int64)
        for batch in batches:
            for vector in batch["vector"]:
                found[np.frombuffer(vector, "<u4", len(vector) // 8)] += 1
        at = np.flatnonzero(found)
        yield pd.DataFrame({"term": at, "df": found[at]})
    rows = vectors.filter("vector is not null").select("vector").mapInPandas(run, "term long, df long")
    out = np.zeros(width, np.int64)
    for term, df in rows.groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[term] = df
    return out


def impacts(counts: np.ndarray, n: int, docs: int, terms: int) -> np.ndarray:
    m = 25 + 75 * n * docs // terms
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _lengths(vectors: DataFrame, docs: int, terms: int, weights: np.ndarray) -> DataFrame:
    """doc_id, length, vector (terms and impacts) of the documents that can have a score."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, n, vector in zip(batch["doc_id"], batch["n"], batch["vector"], strict=True):
                own = np.frombuffer(vector, "<u4").reshape(2, -1)
                x = impacts(own[1].astype(np.int64), int(n), docs, terms)
                length = math.sqrt(float((x.astype(float) ** 2 * weights[own[0]]).sum()))
                if length > 0:
                    out.append((doc, length, own[0].tobytes() + x.astype("<u4").tobytes()))
            frame = pd.DataFrame(out, columns=["doc_id", "length", "vector"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))
    return vectors.filter("vector is not null").select("doc_id", "n", "vector").mapInPandas(
        run, "doc_id long, length double, vector binary")


class Bucket:
    """Documents of similar length, the longest first, with their entries by term."""

    def __init__(self, rows: pd.DataFrame, root: np.ndarray):
        self.ids, self.length = rows["doc_id"], rows["length"].to_numpy()
        sizes = np.array([len(v) // 8 for v in rows["vector"]])
        flat = np.concatenate([np.frombuffer(v, "<u4").reshape(2, -1) for v in rows["vector"]], axis=1)
        row = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(flat[0], kind="stable")
        self.term, self.row, self.x = flat[0][order], row[order], flat[1][order].astype(np.int64)
        # A coordinate's share of its document's length.
        self.share = self.x * root[self.term] / self.length[self.row]

    def entries(self, term: int) -> slice:
        return slice(np.searchsorted(self.term, term), np.searchsorted(self.term, term, "right"))

    def survivors(self, query: Query, least: int, focus: int) -> np.ndarray:
        """Whether a document may reach the score `least`."""
        alive = self.length * query.length * (1 + SLACK) >= least
        if least <= 0 or not alive.any():
            return alive
        # The cosine that the longest document of the bucket would need.
        cosine = min(1.0, least / (query.length * self.length[0]))
        for term, q in query.focus[:focus]:
            # Between the angles of query and coordinate less and plus the angle allowed between query and document.
            spread = math.sqrt((1 - cosine ** 2) * max(0.0, 1 - q ** 2)) + SLACK
            low, high = cosine * q - spread, cosine * q + spread if cosine > q else math.inf
            at = self.entries(term)
            inside = (self.share[at] >= low) & (self.share[at] <= high)
            if low > 0:  # a document without the term is outside as well
                fits = np.zeros(len(alive), bool)
                fits[self.row[at][inside]] = True
                alive &= fits
            else:
                alive[self.row[at][~inside]] = False
        return alive

    def scores(self, query: Query, alive: np.ndarray) -> np.ndarray:
        out = np.zeros(len(alive), np.int64)
        for term, weight in query.weights:
            at = self.entries(term)
            row = self.row[at]
            keep = alive[row]
            out[row[keep]] += weight * self.x[at][keep]
        return out


class Query:
    def __init__(self, counts: Counter, place: dict[bytes, int], weights: np.ndarray):
        own = [(place[t], n, int(weights[place[t]])) for t, n in counts.items()]
        self.weights = [(t, n * w) for t, n, w in own if w > 0]
        self.length = math.sqrt(sum(n * n * w for _, n, w in own if w > 0))
        self.focus = sorted(((t, n * math.sqrt(w) / self.length) for t, n, w in own if w > 0), key=lambda x: -x[1])
        self.least = 1  # scores of 0 don't count


def _best(rows: pd.DataFrame, more: pd.DataFrame, top: int) -> pd.DataFrame:
    both = pd.concat([rows, more]) if len(rows) else more
    return both.sort_values(["score", "doc_id"], ascending=[False, True], na_position="last", kind="stable").iloc[:top]


def _search(ranked: DataFrame, items: list[tuple[int | None, Counter]], place: dict[bytes, int], weights: np.ndarray,
            least: list[int], top: int, bucket: int, focus: int) -> DataFrame:
    """item (its place in the list), doc_id, score: the best documents of each range of `ranked`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, best = np.sqrt(weights), {}
        open_ = {k: Query(counts, place, weights) for k, (_, counts) in enumerate(items)}
        open_ = {k: q for k, q in open_.items() if q.weights}
        for k, q in open_.items():
            q.least = max(q.least, least[k])
        for batch in batches:
            for begin in range(0, len(batch), bucket):
                part = batch.iloc[begin:begin + bucket]
                # Rows come by falling length: what a query can't reach now it never can.
                longest = float(part["length"].iloc[0]) if len(part) else 0.0
                open_ = {k: q for k, q in open_.items() if q.length * longest * (1 + SLACK) >= q.least}
                if not open_ or not len(part):
                    break
                own = Bucket(part, root)
                for k, q in open_.items():
                    alive = own.survivors(q, q.least, focus)
                    if not alive.any():
                        continue
                    scores = own.scores(q, alive)
                    at = np.flatnonzero(scores >= q.least)
                    if not len(at):
                        continue
                    best[k] = _best(best.get(k, pd.DataFrame()), pd.DataFrame(
                        {"doc_id": own.ids.iloc[at].astype("Int64").array, "score": scores[at]}), top)
                    if len(best[k]) == top:
                        q.least = max(q.least, int(best[k]["score"].iloc[-1]))
        for k, found in best.items():
            yield found.assign(item=k)[["item", "doc_id", "score"]]
    return ranked.select("doc_id", "length", "vector").mapInPandas(run, "item int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, bucket: int = BUCKET, head: float = HEAD, focus: int = FOCUS,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents with a score above 0 of each item, ties by smaller doc_id."""
    schema, out = "item_id long, rank int, doc_id long, score long", None
    for items in query_blocks(queries, block_chars):
        place = {t: k for k, t in enumerate(sorted({t for _, counts in items for t in counts}))}
        vectors = stored(_vectors(docs, place), "vectors")
        number, terms = vectors.agg(F.sum("docs"), F.sum("n")).first()
        if not number:
            continue
        df = _document_counts(vectors, len(place))
        weights = np.floor(1000 * np.array([math.log((2 * number + 2) / (2 * int(d) + 1)) for d in df]))
        weights = np.maximum(weights, 0).astype(np.int64)  # a term of no weight is no coordinate
        lengths = stored(_lengths(vectors, number, terms, weights), "lengths")
        # About that share of the documents; any threshold that was really reached is right.
        cut = lengths.agg(F.percentile_approx("length", 1 - head)).first()[0]
        longest = lengths.filter(F.col("length") >= F.lit(cut)).sortWithinPartitions(F.desc("length"))
        first = _search(longest, items, place, weights, [0] * len(items), top, bucket, focus)
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
        least = [0] * len(items)
        for item, score in first.filter(F.col("n") == top).select("item", "score").collect():  # one row an item
            least[item] = score
        ranked = lengths.repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length"))
        found = _search(ranked, items, place, weights, least, top, bucket, focus)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
        # One row an item of this block.
        names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
