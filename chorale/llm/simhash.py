"""SimHash near-duplicates by anchor-point covering.

A covering code is a set of anchors such that every bit string lies within the covering radius of
one. The code here is the perfect Golay code of 23 bits (radius 3, 4,096 words), times a repetition
code for the bits left over in a part. A fingerprint is cut into parts; in each part it has one home
anchor and is replicated to every anchor within covering radius plus threshold. Two fingerprints
that differ by at most the threshold in a part therefore meet at the home anchor of either, and are
compared there in full.

With 64 bits in two parts of 32 and a threshold of 2 a part, any two fingerprints at 4 bits or fewer
meet: one of their halves differs by at most 2.

Edge cases: null and empty texts and texts of blanks have fingerprint zero and are linked like any
other; repeated rows are rows of their own; a null doc_id takes part but never names a component; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import by_groups, components, forest, stored, words_of
from chorale.llm.paragraphs import jaccard_links, shingles

GOLAY_BITS, GOLAY_RADIUS = 23, 3
GOLAY_POLYNOMIAL = 0xAE3
# Rows of one side of a comparison task; larger anchors are split into a grid of tasks.
ROWS_PER_TASK = 20_000
# Wanted ids (with a hash or few each) up to this many are broadcast.
BROADCAST_ROWS = 500_000
# Shingle sets of one exact comparison task.
GROUP_ROWS = 1_000


@dataclass(frozen=True)
class Covering:
    """`parts` bit ranges of 23 + `extra` bits, each searched up to `threshold` differing bits."""

    parts: int
    extra: int
    threshold: int

    @property
    def bits(self) -> int:
        return GOLAY_BITS + self.extra


HALVES = Covering(parts=2, extra=9, threshold=2)
EIGHTS = Covering(parts=8, extra=0, threshold=1)
ELEVENS = Covering(parts=11, extra=0, threshold=1)


@lru_cache
def _remainders() -> np.ndarray:
    """Remainder by the generator polynomial, for each value of the upper 12 of 23 bits."""
    out = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY_POLYNOMIAL << (bit - 11)), out)
    return out


def _syndrome(word: np.ndarray) -> np.ndarray:
    return _remainders()[word >> 11] ^ (word & 0x7FF)


@lru_cache
def _cosets(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to radius + threshold: start of each syndrome's run, patterns, excess."""
    words, weights = [], []
    for weight in range(GOLAY_RADIUS + threshold + 1):
        for ones in combinations(range(GOLAY_BITS), weight):
            words.append(sum(1 << b for b in ones))
            weights.append(weight)
    word, excess = np.array(words), np.maximum(np.array(weights) - GOLAY_RADIUS, 0)
    syndrome = _syndrome(word)
    order = np.lexsort((excess, syndrome))
    start = np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))
    return start, word[order], excess[order]


def anchors_of(values: np.ndarray, covering: Covering) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one part's values: row index, anchor and whether it is the row's home, for each replica."""
    start, pattern, excess = _cosets(covering.threshold)
    golay, rest = values >> covering.extra, values & ((1 << covering.extra) - 1)
    syndrome = _syndrome(golay)
    count = start[syndrome + 1] - start[syndrome]
    row = np.repeat(np.arange(len(values)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[syndrome[row]]
    word, cost = (golay[row] ^ pattern[at]) >> 11, excess[at]
    if not covering.extra:
        return row, word, cost == 0
    ones = np.bitwise_count(rest)
    major = (ones * 2 > covering.extra).astype(np.int64)
    # Distance to the other repetition word, above the radius of the repetition code.
    flip = np.maximum(ones, covering.extra - ones).astype(np.int64) - covering.extra // 2
    other = cost + flip[row] <= covering.threshold
    return (np.concatenate([row, row[other]]),
            np.concatenate([word * 2 + major[row], (word * 2 + 1 - major[row])[other]]),
            np.concatenate([cost == 0, np.zeros(other.sum(), bool)]))


def _parts(blob: np.ndarray, covering: Covering) -> list[np.ndarray]:
    """Values of each part of bit strings given as rows of bytes."""
    bits = np.unpackbits(blob, axis=1, bitorder="little").astype(np.int64)
    weight = 1 << np.arange(covering.bits, dtype=np.int64)
    return [bits[:, k * covering.bits:(k + 1) * covering.bits] @ weight for k in range(covering.parts)]


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `size` words, repeats included; a shorter text is one shingle, none gives none."""
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(begin[:1 - size].tolist(), end[size - 1:].tolist(), strict=True)
    return np.fromiter((digest(whole[a:b], seed) for a, b in pairs), np.uint64, len(words) - size + 1)


def majority(digests: np.ndarray) -> bytes:
    """Bits set in over half of the rows of bytes; no row gives zero bits. Long inputs go by blocks."""
    width, total = digests.shape[1] * 8, np.zeros(digests.shape[1] * 8, np.int64)
    for k in range(0, len(digests), 255 * 64):
        bits = np.unpackbits(digests[k:k + 255 * 64], axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        # Sums of 255 bits fit a byte.
        total += bits[:full].reshape(-1, 255, width).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(digests), bitorder="little").tobytes()


def fingerprint(text: str | None, shingle: int) -> bytes:
    hashes = shingle_hashes(words_of(text), shingle)
    return majority(hashes.view(np.uint8).reshape(-1, 8))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint) with the 64-bit fingerprint as a signed long; whole texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = b"".join(fingerprint(t, shingle) for t in batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": np.frombuffer(prints, np.int64)})
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id long, fingerprint long")


def links(nodes: DataFrame, covering: Covering, most: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Edges (a, b) that connect all pairs of nodes at `most` differing bits or fewer.

    nodes: node (unique long), seek (bytes that are cut into the covering's parts), bits (bytes that
    are compared). Within a task only a spanning forest is emitted, so a group of n close
    fingerprints makes n - 1 edges and not n squared. A large anchor is split into a grid of tasks,
    each with a block of its homes and a block of its replicas: every pair still meets in one.
    """
    codes = 1 << (12 + bool(covering.extra))

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 2_000):
                chunk = batch.iloc[begin:begin + 2_000]
                node, bits = chunk["node"].to_numpy(), chunk["bits"].to_numpy()
                for k, values in enumerate(_parts(_bytes(chunk["seek"]), covering)):
                    row, anchor, home = anchors_of(values, covering)
                    yield pd.DataFrame({"anchor": (anchor + k * codes).astype(np.int32), "home": home,
                                        "node": node[row], "bits": bits[row]})

    copies = nodes.select("node", "seek", "bits").mapInPandas(
        replicate, "anchor int, home boolean, node long, bits binary")
    # At most parts times the number of code words: tens of thousands of rows at any input size.
    load = copies.groupBy("anchor").agg(
        F.ceil(F.count("*") / rows_per_task).cast("int").alias("columns"),
        F.ceil(F.count_if("home") / rows_per_task).cast("int").alias("lines"))
    load = stored(load.filter("columns > 1"), "anchors")
    dealt = copies.join(F.broadcast(load), "anchor", "left").fillna(1, ["columns", "lines"])
    slot = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    # A home is compared with every block of replicas, a replica with every block of homes.
    cells = F.concat(
        F.when(F.col("home"), F.transform(all_of(F.col("columns")), lambda c: F.struct(
            slot(F.col("lines")).alias("line"), c.alias("column"), F.lit(True).alias("asks"))))
        .otherwise(F.array().cast("array<struct<line:int,column:int,asks:boolean>>")),
        F.transform(all_of(F.col("lines")), lambda r: F.struct(
            r.alias("line"), slot(F.col("columns")).alias("column"), F.lit(False).alias("asks"))))
    tasks = dealt.select("anchor", F.explode(cells).alias("cell"), "node", "bits").select(
        "anchor", "cell.line", "cell.column", "cell.asks", "node", "bits")

    def compare(group: pd.DataFrame) -> pd.DataFrame | None:
        # By node, so that the forests of different anchors name the same smallest nodes.
        group = group.sort_values("node", kind="stable")
        asks = group["asks"].to_numpy()
        if not asks.any():
            return None
        bits = _bytes(group["bits"]).view(np.uint64)
        node = group["node"].to_numpy()
        ask, member = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(member):
            return None
        linked, step = [], max(1, 2_000_000 // len(member))
        for begin in range(0, len(ask), step):
            own = ask[begin:begin + step]
            apart = sum(np.bitwise_count(bits[own, None, w] ^ bits[None, member, w]).astype(np.int32)
                        for w in range(bits.shape[1]))
            near = apart <= most
            near &= node[own, None] != node[None, member]
            for k in np.flatnonzero(near.any(axis=1)):
                linked.append((own[k], member[near[k]]))
            if sum(len(x[1]) for x in linked) > 5_000_000:
                linked = _thinned(linked, node)
        edges = forest(linked, node)
        return pd.DataFrame(edges, columns=["a", "b"]) if edges else None

    return by_groups(tasks, ["anchor", "line", "column"], compare, "a long, b long")


def _thinned(linked, node):
    """The same connections, as a forest over positions."""
    kept = forest(linked, np.arange(len(node)))
    return [(a, np.array([b])) for a, b in kept]


def near_links(prints: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at `most` (at most 4 with the two halves used here) differing bits.

    prints: `fingerprint`, every value once.
    """
    if most > (HALVES.threshold + 1) * HALVES.parts - 1:
        raise ValueError("the covering reaches 5 differing bits")
    raw = F.unhex(F.lpad(F.hex("fingerprint"), 16, "0"))
    return links(prints.select(F.col("fingerprint").alias("node"), raw.alias("seek"), raw.alias("bits")), HALVES, most)


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable
    over links of `most` differing bits.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    low = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "distinct")
    return labelled(rows, low, components(near_links(low, most)), "fingerprint")


def labelled(rows: DataFrame, low: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Rows with their component's smallest doc_id; low: the smallest doc_id of each node.

    Joined sides are plain stored tables, so Spark may split a node or component with very many rows.
    """
    tree = stored(low.join(roots.withColumnRenamed("node", key), key, "left")
                  .withColumn("root", F.coalesce("root", key)), "trees")
    smallest = stored(tree.groupBy("root").agg(F.min("low").alias("component_id")), "smallest")
    named = stored(tree.join(smallest, "root").select(key, "component_id"), "components")
    return rows.join(named, key).select("doc_id", key, "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text without words has none."""
    words = words_of(text)
    return np.unique(shingles(words, shingle)) if words else np.empty(0, np.uint64)


def node_of(own: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 5)).astype(np.int64)


def wide_print(own: np.ndarray) -> bytes:
    """256 bits over a shingle set: each hash is spread to four words, then the majority of each bit."""
    deep = np.empty((len(own), 4), np.uint64)
    for k in range(4):
        mixed = own + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        deep[:, k] = mixed ^ (mixed >> np.uint64(31))
    return majority(deep.view(np.uint8).reshape(-1, 32))


def document_prints(docs: DataFrame, shingle: int = 5, narrow: int = 4) -> DataFrame:
    """(doc_id, fingerprint, node, bits): the 64-bit fingerprint over shingles of `narrow` words, the identity of the set
    of shingles of `shingle` words and its 256 bits, which find candidates only.

    At a similarity of 0.8 about 15 % of the 256 bits differ, wherever the edits are. With 11 parts of 23 bits and a
    threshold of 1, pairs beyond the threshold often meet as well.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            prints = b"".join(fingerprint(t, narrow) for t in batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": np.frombuffer(prints, np.int64),
                                "node": [node_of(x) for x in sets], "bits": [wide_print(x) for x in sets]})
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id long, fingerprint long, node long, bits binary")


def bits_at(similarity: float, bits: int = 256, slack: float = 3) -> int:
    """Differing bits expected at a Jaccard similarity, plus `slack` standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + slack * np.sqrt(bits * share * (1 - share)))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(unit, shingles) of the wanted nodes. wanted: node and the doc_id of a row that has it, or null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text, nodes in zip(batch["text"], batch["nodes"], strict=True):
                own = shingle_set(text, shingle)
                # A doc_id may stand for several texts.
                if nodes is None or node_of(own) in nodes:
                    found.append((node_of(own), own.tobytes()))
            yield pd.DataFrame(found, columns=["unit", "shingles"])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    by_id = stored(wanted.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_list("node").alias("nodes")), "wanted")
    # Ids and hashes; few of them are sent to the texts, so that no text moves.
    few = F.broadcast(by_id) if by_id.count() <= BROADCAST_ROWS else by_id
    rows = texts.join(few, "doc_id").select("text", "nodes").unionByName(
        texts.filter("doc_id is null").select("text", F.lit(None).cast("array<long>").alias("nodes")))
    return rows.mapInPandas(run, "unit long, shingles binary").dropDuplicates(["unit"])


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) that connect shingle sets of `similarity` or more. nodes: node, bits and its smallest doc_id `low`.

    Pairs close by their bits only make candidate groups. Within one, sets are compared exactly.
    """
    near = stored(components(links(nodes.withColumn("seek", F.col("bits")), ELEVENS, bits_at(similarity))), "near")
    members = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    members = stored(members.join(nodes.select("node", F.col("low").alias("doc_id")), "node"), "members")
    sets = stored(_sets(docs, members.select("node", "doc_id"), shingle), "sets")
    asked = members.select(F.col("root").alias("value"), F.col("node").alias("unit")).join(sets, "unit")
    return jaccard_links(asked, similarity, GROUP_ROWS)


def _nodes(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("bits").alias("bits")), "distinct")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id): documents grouped by links of `similarity` or more of their shingle sets."""
    rows = stored(document_prints(docs, shingle), "prints")
    nodes = _nodes(rows)
    roots = components(similar_links(docs, nodes, shingle, similarity))
    return labelled(rows.select("doc_id", "node"), nodes.select("node", "low"), roots, "node")


def near_copies(docs: DataFrame, narrow: int = 4, most: int = 4, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id): documents grouped by the links of `near_duplicates` and those of `similar_documents`.

    Fingerprints of shingles of `narrow` words link at `most` differing bits, all such pairs. Near copies that differ in
    more bits are linked by the exact similarity of their sets. A component is reached over links of either kind.
    """
    rows = stored(document_prints(docs, shingle, narrow), "prints")
    nodes = _nodes(rows)
    prints = stored(rows.select("fingerprint", "node").distinct(), "fingerprints")
    roots = components(near_links(prints.select("fingerprint").distinct(), most))
    # The nodes of one component of fingerprints hang on its smallest node.
    held = stored(prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        F.coalesce("root", "fingerprint").alias("root"), "node").distinct(), "held")
    hubs = held.groupBy("root").agg(F.min("node").alias("a"))
    linked = held.join(hubs, "root").select("a", F.col("node").alias("b")).filter("a <> b")
    both = components(linked.unionByName(similar_links(docs, nodes, shingle, similarity)))
    return labelled(rows.select("doc_id", "node"), nodes.select("node", "low"), both, "node")


def one_of_each(docs: DataFrame, narrow: int = 4, most: int = 4, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group: the row with the smallest doc_id; of repeated rows with that id, one.

    Rows with a null doc_id are kept: nothing tells them apart from others in a report.
    """
    groups = near_copies(docs, narrow, most, shingle, similarity)
    keep = stored(groups.filter("doc_id = component_id").select("doc_id").distinct(), "kept")
    # The whole row as one column, so that no name of its columns can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    text = F.col("row.text").cast("string")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(text), text)
    kept = rows.join(keep, "doc_id", "left_semi").withColumn("n", F.row_number().over(first)).filter("n = 1")
    return kept.select("row.*").unionByName(docs.filter("doc_id is null"))
