"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. Vectors get one more component that brings all of them to the
length of the longest, so the largest inner product with a query is the smallest angle. Each tree
splits by hyperplanes halfway between two vectors of a bounded sample, at the sample's median. Every
vector is put into one leaf of every tree. A query walks all trees with one shared priority queue, the
widest margin first, until the leaves it took hold `share` times as many vectors as there are, counted
once for each leaf, and all vectors of these leaves are scored exactly, in double precision. The share is
the price of recall: on near-isotropic vectors of 64 components eight trees reach 0.95 of the true 20
nearest only at 1.1, which is two thirds of all vectors; clustered vectors need far less.

Few candidates leave the tasks. The sample's vectors in the leaves that a query takes are candidates of it, so none
below the best of these can be in its result: a query goes out with the score of its `top` + 1st as a bound.
The leaves of a tree are dealt into `CELLS` cells, and a task gives a query's best of a cell, not of each leaf. So a
query makes at most `top` + 1 rows for each cell of each tree, however many vectors and leaves there are.

Equal vectors are one class, indexed once with its smallest `top` + 1 ids: no other member can be among
a query's `top` nearest, as ties go to smaller ids.

Edge cases: vectors that are null, zero, hold a null or non-finite component or don't have the most
common length take no part, as query or candidate; a null id takes no part; a repeated row is the same
candidate; a table of one leaf is looked at as a whole; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import groups_of, stored

TOP, TREES, SHARE, SAMPLE, LEAF_ROWS = 20, 8, 1.1, 20_000, 1_024
# Queries of a leaf that one task scores.
BLOCK_QUERIES = 20_000
# Cells of a tree: runs of leaves, a power of two.
CELLS = 4
# Queries that meet the sample at once, and candidates that a task holds before it keeps the best only.
ROUTE_ROWS, HELD_ROWS = 64, 1_000_000


@dataclass
class Forest:
    """Complete binary trees: hyperplanes in heap order, and the sampled share of each leaf."""

    normals: np.ndarray  # trees, nodes, dimensions + 1
    cuts: np.ndarray  # trees, nodes
    shares: np.ndarray  # trees, leaves
    levels: int
    longest: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest ** 2 - (x ** 2).sum(axis=1), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree: rows, trees."""
        up, out = self.lifted(x), []
        for normal, cut in zip(self.normals, self.cuts, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                side = np.einsum("ij,ij->i", up, normal[node]) > cut[node]
                node = 2 * node + 1 + side
            out.append(node - (1 << self.levels) + 1)
        return np.stack(out, axis=1)

    def probes(self, query: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold the wanted share of all vectors."""
        direction = np.append(query * (self.longest / np.linalg.norm(query)), 0.0)
        inner, margins = (1 << self.levels) - 1, self.normals @ direction - self.cuts
        queue, out, held = [(-np.inf, t, 0) for t in range(len(self.normals))], [], 0.0
        while queue and held < wanted:
            worst, tree, node = heapq.heappop(queue)
            if node >= inner:
                out.append((tree, node - inner))
                held += self.shares[tree, node - inner]
                continue
            margin = margins[tree, node]
            # The smallest margin on the way decides; the queue gives the largest of these.
            heapq.heappush(queue, (max(worst, -margin), tree, 2 * node + 2))
            heapq.heappush(queue, (max(worst, margin), tree, 2 * node + 1))
        return out


def grow(sample: np.ndarray, longest: float, levels: int, trees: int, seed: int = 5) -> Forest:
    random, nodes = np.random.default_rng(seed), (1 << levels) - 1
    forest = Forest(np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)),
                    np.zeros((trees, 1 << levels)), levels, longest)
    up = forest.lifted(sample)
    for tree in range(trees):
        members = {0: np.arange(len(up))}
        for node in range(nodes):
            own = members.pop(node)
            if len(own) > 1:
                a, b = up[random.choice(own, 2, replace=False)]
                normal = a - b
            else:
                normal = random.normal(size=up.shape[1])
            normal /= np.linalg.norm(normal) or 1.0
            along = up[own] @ normal
            cut = np.median(along) if len(own) else 0.0
            forest.normals[tree, node], forest.cuts[tree, node] = normal, cut
            members[2 * node + 1], members[2 * node + 2] = own[along <= cut], own[along > cut]
        forest.shares[tree] = [len(members[nodes + k]) / max(1, len(up)) for k in range(1 << levels)]
    return forest


def best_of(asks: np.ndarray, classes: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The `most` highest of each query, equal scores by ascending class."""
    order = np.lexsort((classes, -scores, asks))
    asks, classes, scores = asks[order], classes[order], scores[order]
    starts = np.flatnonzero(np.append(True, asks[1:] != asks[:-1])[:len(asks)])
    place = np.arange(len(asks)) - np.repeat(starts, np.diff(np.append(starts, len(asks))))
    kept = place < most
    return asks[kept], classes[kept], scores[kept]


def usable(vector: Column, size: int | None = None) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    good = vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good if size is None else good & (F.size(vector) == size), F.lit(False))


def candidates(classes: DataFrame, asked: DataFrame, forest: Forest, points: np.ndarray, wanted: float, top: int = TOP,
               blocks: int = 1, held_rows: int = HELD_ROWS) -> DataFrame:
    """(ask, class, score): the `top` + 1 best of each query in the leaves it takes, a few of them once for each tree.

    classes: class and embedding, all different; asked: ask and embedding; points: vectors of `classes`, as drawn.
    """
    trees, levels, longest = len(forest.normals), forest.levels, forest.longest
    spots, width = forest.leaves(points), max(1, (1 << levels) // CELLS)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["embedding"].to_list())
            leaf, raw = forest.leaves(x), [v.tobytes() for v in x]
            for tree in range(trees):
                yield pd.DataFrame({"tree": np.int32(tree), "leaf": leaf[:, tree].astype(np.int32), "asks": False,
                                    "id": batch["class"], "vector": raw, "bound": -np.inf})

    def bounds(x: np.ndarray, ways: list[np.ndarray]) -> np.ndarray:
        """For each query a score that `top` + 1 vectors of its leaves reach, as far as the sample tells."""
        if len(points) <= top:
            return np.full(len(x), -np.inf)
        taken, seen = np.zeros((len(x), trees, 1 << levels), bool), np.zeros((len(x), len(points)), bool)
        for k, at in enumerate(ways):
            taken[k, at[:, 0], at[:, 1]] = True
        for tree in range(trees):
            seen |= taken[:, tree, spots[:, tree]]
        scores = np.where(seen, x @ points.T, -np.inf)
        # Less what two matrix products may differ by.
        slack = 1e-9 * longest * np.linalg.norm(x, axis=1)
        return np.partition(scores, -top - 1, axis=1)[:, -top - 1] - slack

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), ROUTE_ROWS):
                chunk = batch.iloc[begin:begin + ROUTE_ROWS]
                x = np.stack(chunk["embedding"].to_list())
                ways = [np.array(forest.probes(v, wanted), np.int32).reshape(-1, 2) for v in x]
                for i, v, at, low in zip(chunk["ask"], x, ways, bounds(x, ways), strict=True):
                    yield pd.DataFrame({"tree": at[:, 0], "leaf": at[:, 1], "asks": True, "id": i, "vector": v.tobytes(),
                                        "bound": low})

    kind = "tree int, leaf int, asks boolean, id long, vector binary, bound double"
    base = classes.select("class", "embedding").mapInPandas(index, kind)
    asks_of = asked.repartition(classes.sparkSession.sparkContext.defaultParallelism, "ask").mapInPandas(route, kind)
    both = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).unionByName(
        asks_of.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))

    def score(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
        """(asks, classes, scores) within one leaf: the best of each query, none below its bound."""
        asks_ = group["asks"].to_numpy()
        if not asks_.any() or asks_.all():
            return
        wide = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(len(group), -1)
        ids = group["id"].to_numpy()
        base, base_ids = wide[~asks_], ids[~asks_]
        step = max(1, 4_000_000 // len(base))
        asking, ask_ids, low = wide[asks_], ids[asks_], group["bound"].to_numpy()[asks_]
        for begin in range(0, len(asking), step):
            scores = asking[begin:begin + step] @ base.T
            ask, at = np.nonzero(~(scores < low[begin:begin + step, None]))
            yield best_of(ask_ids[begin:begin + step][ask], base_ids[at], scores[ask, at], top + 1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best of each query in each cell; leaf by leaf, with `held_rows` candidates and the best so far at most."""
        cell, held, rows_held, full = None, [], 0, held_rows

        def best() -> tuple[np.ndarray, ...]:
            return best_of(*(np.concatenate(x) for x in zip(*held, strict=True)), top + 1)

        def named() -> Iterator[pd.DataFrame]:
            if held:
                yield pd.DataFrame(dict(zip(("ask", "class", "score"), best(), strict=True)))
        for group in groups_of(batches, ["block", "tree", "cell", "leaf"]):
            own = tuple(group[["block", "tree", "cell"]].iloc[0])
            if own != cell:
                yield from named()
                cell, held, rows_held, full = own, [], 0, held_rows
            for found in score(group):
                held.append(found)
                rows_held += len(found[0])
                if rows_held > full:
                    held = [best()]
                    rows_held = len(held[0][0])
                    full = rows_held + held_rows
        yield from named()

    keys = ["block", "tree", "cell"]
    dealt = both.withColumn("cell", F.floor(F.col("leaf") / width).cast("int")).repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "leaf").mapInPandas(search, "ask long, class long, score double")


def nearest(vectors: DataFrame, asks: Column, top: int = TOP, trees: int = TREES, share: float = SHARE, least: int = 0,
            sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block_queries: int = BLOCK_QUERIES, held_rows: int = HELD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of each row for which `asks` holds.

    vectors: vec_id and embedding. The forest is fitted on at most `sample` vectors (the smallest
    hashes); leaves hold about `leaf_rows` vectors while the sample can tell so many leaves apart. `share` holds for
    tables of any size; `least` asks for that many vectors a tree at least (none by default). The queries of a leaf are
    dealt into blocks of about `block_queries`, and its vectors go to each.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(
        usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    common = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == common["n"]).withColumn(
        "embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    # dense_rank: repeated rows are one candidate; the group limit acts before the shuffle.
    first = rows.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= top + 1)
    classes = stored(first.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
                     .withColumn("class", F.element_at("ids", 1)), "vectors")
    total, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate(
        "embedding", F.lit(0.0), lambda s, x: s + x * x)))).first()
    drawn = classes.select("class", "embedding").orderBy(F.xxhash64("class"), "class").limit(sample).toPandas()
    points = np.stack(drawn["embedding"].to_list())
    deepest = max(0, int(np.log2(len(points) / 8)))
    levels = min(deepest, max(0, int(np.ceil(np.log2(total / leaf_rows)))))
    forest = grow(points, longest, levels, trees)
    wanted = max(share, trees * least / total)
    queries = stored(rows.filter(asks).select("vec_id", F.xxhash64("embedding").alias("hash"), "embedding").distinct(),
                     "queries")
    asked = stored(queries.groupBy("embedding").agg(F.min("vec_id").alias("ask")), "asked")
    # A leaf is asked by about share / trees of all queries.
    blocks = max(1, int(np.ceil(asked.count() * wanted / trees / block_queries)))
    found = candidates(classes, asked, forest, points, wanted, top, blocks, held_rows)
    # The same pair may differ in the last digit from one matrix product to another.
    found = found.groupBy("ask", "class").agg(F.max("score").alias("score"))
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "class")
    found = stored(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top + 1).drop("n"), "found")
    exact = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    wide = (found.join(classes.select("class", "ids", F.col("embedding").alias("x")), "class")
            .join(asked.select("ask", F.col("embedding").alias("y")), "ask")
            .select("ask", exact.alias("score"), F.explode("ids").alias("vec_id")))
    near = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    wide = stored(wide.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= top + 1)
                  .groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near")), "near")
    named = stored(queries.join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "ask"), "named")
    # A query's own row is among its nearest at most once.
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return named.join(wide, "ask").select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
