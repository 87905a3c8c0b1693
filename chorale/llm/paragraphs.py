"""Substring dedup: paragraphs that repeat, exactly or nearly, within and across documents.

A paragraph is a line of a text. Paragraphs of `min_words` words or more get MinHash values over their
five-word shingles (lower-cased ASCII letters, runs of blanks as one), cut into bands. Paragraphs
whose values agree in a band are compared by the exact Jaccard similarity of their shingle sets; pairs
at `similarity` or more are linked, and components of links are classes. A class's first paragraph
(smallest doc_id, then place) stays, its other paragraphs are removals.

A passage may also sit in the middle of paragraphs that differ otherwise, or be wrapped into other lines. The
words of a whole text, line feeds or not, are therefore cut where they say so themselves: before a word whose
three-word hash is the smallest among its `REACH` neighbours on either side. The cuts inside a passage are the
same wherever it stands. Pieces between cuts that repeat word for word are classes as well, unless they lie
wholly in paragraphs that go. A piece goes with the line feeds inside it; its paragraph is that of its first word.

8 bands of 3 values find a pair at 0.8 with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997, at 0.9 with
0.99996. Equal paragraphs are one node, so a passage with very many copies is compared once. A large
bucket is split into a grid of tasks, and a task emits a spanning forest, not all pairs.

Edge cases: null and empty texts have no paragraph; shorter paragraphs are only searched for pieces; texts of
`REACH` words or fewer have no piece; repeated rows are copies of each other, and of rows that share a
doc_id and place either may be the one that stays; rows with a null doc_id take no part; an empty
table gives an empty result; other columns are kept by `without_repeats` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import by_groups, components, stored

SHINGLE, MIN_WORDS, SIMILARITY = 5, 10, 0.8
BANDS, ROWS = 8, 3
# Pieces have more than REACH words, 2 * REACH + 1 on average.
REACH = 6
# The paragraph number of the row that holds the pieces of a text.
WHOLE_TEXT = -1
BUCKET_ROWS = 1_000
_SEEDS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def paragraphs_of(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(number, start, end, words) of each paragraph that is long enough; places in characters."""
    at = 0
    for number, line in enumerate(text.split("\n")):
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= min_words:
            yield number, at, at + len(line), words
        at += len(line) + 1


def unit_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 7)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, in order, repeats included: a mix of the hashes of their words."""
    return _runs(hashes_of(words), size)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _runs(own: np.ndarray, size: int) -> np.ndarray:
    n = max(1, len(own) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(own))):
        out = (out ^ own[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First characters of the words and the characters behind them."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = np.ones(len(raw) + 2, np.int8)
    blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    begins, ends = turns[::2], turns[1::2]
    if len(raw) == len(text):
        return begins, ends
    # From bytes to characters: bytes that continue a character don't count.
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return before[begins], before[ends]


def pieces_of(text: str, own: np.ndarray, line: np.ndarray) -> tuple[list[int], list[int], list[np.ndarray], list[int]]:
    """own, line: hash and line number of each word. Starts, ends (in characters), line numbers and hashes of a text's pieces."""
    if len(own) <= REACH:
        return [], [], [], []
    triple = _runs(own, 3)
    edge = np.full(REACH, np.iinfo(np.uint64).max)
    wide, n = np.concatenate([edge, triple, edge]), len(triple)
    before, behind = wide[:n], wide[REACH + 1:REACH + 1 + n]
    for k in range(1, REACH):
        before, behind = np.minimum(before, wide[k:k + n]), np.minimum(behind, wide[REACH + 1 + k:REACH + 1 + k + n])
    # Strictly less than those before it, so a run of one word has no cut.
    cuts = np.flatnonzero((triple < before) & (triple <= behind))
    bounds = [0, *cuts[cuts > 0].tolist(), len(own)]
    begins, ends = word_places(text)
    kept = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > REACH]
    return ([int(begins[a]) for a, _ in kept], [int(ends[b - 1]) for _, b in kept],
            [line[a:b][np.append(True, line[a + 1:b] != line[a:b - 1])] for a, b in kept],
            [xxhash.xxh64_intdigest(own[a:b].tobytes(), 11) for a, b in kept])


def minhashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima for each run of `flat` that begins at `starts`."""
    out = np.empty((len(starts), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        mixed = flat * seed
        mixed ^= mixed >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
    return out


def bands_of(values: np.ndarray) -> np.ndarray:
    """One value a band; bands differ in their seeds, so equal values of different bands don't meet."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB), (len(values), 1))
    for r in range(ROWS):
        out = (out ^ values[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _units(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each paragraph, and one for each text with its pieces."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                rows, flat, starts, whole, at = [], [], [], [], 0
                part = batch.iloc[begin:begin + 500]
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    every, counts = [], []
                    for number, start, end, words in paragraphs_of(text, 0):
                        hashes = hashes_of(words)
                        every.append(hashes)
                        counts.append(len(words))
                        if len(words) < min_words:
                            continue
                        own = _runs(hashes, SHINGLE)
                        rows.append((doc, number, start, end, unit_of(words)))
                        flat.append(own)
                        starts.append(at)
                        at += len(own)
                    pieces = pieces_of(text, np.concatenate(every), np.repeat(np.arange(len(counts)), counts))
                    if pieces[0]:
                        whole.append((doc, *pieces))
                if rows:
                    out = pd.DataFrame(rows, columns=["doc_id", "paragraph", "start", "end", "unit"])
                    out["unit"] = out["unit"].to_numpy(np.uint64).view(np.int64)
                    out["bands"] = list(bands_of(minhashes(np.concatenate(flat), np.array(starts))))
                    yield out.assign(piece_starts=None, piece_ends=None, piece_lines=None, pieces=None)[_COLUMNS]
                if whole:
                    yield pd.DataFrame({
                        "doc_id": [w[0] for w in whole], "paragraph": WHOLE_TEXT, "start": 0, "end": 0, "unit": 0,
                        "piece_starts": [w[1] for w in whole], "piece_ends": [w[2] for w in whole],
                        "piece_lines": [[x.tolist() for x in w[3]] for w in whole],
                        "pieces": [np.array(w[4], np.uint64).view(np.int64) for w in whole], "bands": None})[_COLUMNS]
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(
        "doc_id is not null and text is not null")
    return narrow.mapInPandas(run, "doc_id long, paragraph int, start int, end int, unit long, piece_starts array<int>, "
                                   "piece_ends array<int>, piece_lines array<array<int>>, pieces array<long>, bands array<long>")


_COLUMNS = ["doc_id", "paragraph", "start", "end", "unit", "piece_starts", "piece_ends", "piece_lines", "pieces", "bands"]


def _sets(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(unit, shingles) for the wanted units; wanted: doc_id and the units to take from that document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text, units in zip(batch["text"], batch["units"], strict=True):
                left = {int(u) & (1 << 64) - 1 for u in units}
                for _, _, _, words in paragraphs_of(text, min_words):
                    unit = unit_of(words)
                    if unit in left:
                        left.discard(unit)
                        found.append((np.uint64(unit).astype(np.int64), np.unique(shingles(words)).tobytes()))
            yield pd.DataFrame(found, columns=["unit", "shingles"])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    return texts.join(wanted, "doc_id").select("text", "units").mapInPandas(run, "unit long, shingles binary")


class Near:
    """Finds which of some sets of hashes are similar to a given one, through an index of their hashes."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sets, self.size, self.similarity = sets, np.array(list(map(len, sets)), np.int64), similarity
        self._index(np.arange(len(sets)))

    def _index(self, rows: np.ndarray) -> None:
        flat = np.concatenate([self.sets[k] for k in rows]) if len(rows) else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.rows = flat[order], np.repeat(rows, self.size[rows])[order], len(rows)

    def rows_near(self, own: np.ndarray, left: np.ndarray, shrinking: bool = False) -> np.ndarray:
        """Those of `left` that are similar to the set `own`. `shrinking`: later calls ask for a part of `left` only."""
        if shrinking and len(left) * 2 < self.rows:
            self._index(left)
        begin = np.searchsorted(self.flat, own, "left")
        count = np.searchsorted(self.flat, own, "right") - begin
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        common = np.bincount(self.owner[at], minlength=len(self.sets))[left]
        near = common >= self.similarity * (self.size[left] + len(own) - common) - 1e-9
        # Two empty sets have nothing in common and are no similar texts.
        return left[near & (common > 0)]


# Below this many sets a comparison of all pairs is cheaper than an index; the labels are the same.
FEW = 6


def _labels(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first one of its component."""
    label = np.arange(len(sets))
    if len(sets) <= FEW:
        for b in range(1, len(sets)):
            for a in range(b):
                if label[a] == label[b]:
                    continue
                small, large = sorted((len(sets[a]), len(sets[b])))
                if small < similarity * large - 1e-9 or not small:
                    continue
                # Both are sorted and without repeats.
                both = np.concatenate([sets[a], sets[b]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common and common >= similarity * (small + large - common) - 1e-9:
                    low, high = sorted((label[a], label[b]))
                    label[label == high] = low
        return label
    near, left = Near(sets, similarity), label.copy()
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            found = near.rows_near(sets[queue.pop()], left, True)
            label[found] = first
            queue += found.tolist()
            left = np.setdiff1d(left, found, assume_unique=True)
    return label


def _sets_of(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _different(members: DataFrame) -> DataFrame:
    """Of values with the same units (near copies agree in most bands) the rows of one."""
    both = [F.bit_xor(F.xxhash64("unit", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    same = members.groupBy("value").agg(F.count("*").alias("n"), F.min("unit").alias("a"), F.max("unit").alias("b"), *both)
    one = same.groupBy("n", "a", "b", "x1", "x2").agg(F.min("value").alias("value")).select("value")
    return members.join(one, "value", "left_semi")


def jaccard_links(members: DataFrame, similarity: float, bucket_rows: int) -> DataFrame:
    """Edges (a, b) that connect all units of one value at `similarity` or more. members: value, unit, shingles.

    A bucket of more than `bucket_rows` units is dealt into blocks of that size, and edges grow with its units, not
    with their pairs: (1) each block links its own units and labels them by the smallest unit of their component;
    (2) the labels of a bucket's first block are held against all units of its other blocks; (3) only units outside
    the largest component found so far are held against the whole bucket, and only links between different
    components are emitted. A bucket of close copies ends after (2); one of strangers is compared in full.
    """
    large = stored(members.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
                   .select("value", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks")), "buckets")
    cut = members.join(large, "value", "left").fillna(1, ["blocks"])
    block = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    homes = cut.select("value", "blocks", block.alias("block"), "unit", "shingles")

    def inside(group: pd.DataFrame) -> pd.DataFrame | None:
        unit, first = np.unique(group["unit"].to_numpy(), return_index=True)
        split = group["blocks"].iloc[0] > 1
        if len(unit) < 2 and not split:
            return None
        raw = group["shingles"].to_numpy()
        label = _labels([np.frombuffer(raw[k], np.uint64) for k in first], similarity)
        kept = np.full(len(unit), True) if split else label != np.arange(len(unit))
        if not kept.any():
            return None
        return pd.DataFrame({"value": group["value"].iloc[0], "block": group["block"].iloc[0],
                             "unit": unit[kept], "label": unit[label[kept]]})

    near = stored(by_groups(homes, ["value", "block"], inside, "value long, block int, unit long, label long"), "near")
    edges = near.filter("unit <> label").select(F.col("unit").alias("a"), F.col("label").alias("b"))
    if large.isEmpty():
        return edges

    def across(group: pd.DataFrame) -> pd.DataFrame | None:
        """Links between askers and members of other labels; only those that join what nothing has joined yet."""
        asks = group["asks"].to_numpy()
        if not asks.any() or asks.all():
            return None
        askers = group[asks].sort_values("unit", kind="stable")
        rows = group[~asks]
        names, codes = np.unique(group["label"].to_numpy(), return_inverse=True)
        tree, out = np.arange(len(names)), []
        of_member, of_asker = codes[~asks], codes[asks][np.argsort(group["unit"].to_numpy()[asks], kind="stable")]
        index = Near(_sets_of(rows["shingles"]), similarity)
        for own, shingles_ in zip(of_asker, askers["shingles"], strict=True):
            other = np.flatnonzero(tree[of_member] != tree[own])
            if not len(other):
                continue
            found = index.rows_near(np.frombuffer(shingles_, np.uint64), other)
            for k in np.unique(tree[of_member[found]]):
                out.append((group["value"].iloc[0], names[own], names[k]))
            tree[np.isin(tree, tree[of_member[found]])] = tree[own]
        return pd.DataFrame(out, columns=["value", "a", "b"]) if out else None

    kind = "value long, a long, b long"
    split = homes.join(near.withColumnRenamed("block", "__block"), ["value", "unit"]).filter("blocks > 1").drop("__block")
    every = stored(split.dropDuplicates(["value", "unit"]), "blocks")
    # (2) At most `bucket_rows` rows a block, so as many rows in all as there are units.
    pivots = every.filter("block = 0 and unit = label").withColumn(
        "block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    both = every.filter("block > 0").withColumn("asks", F.lit(False)).unionByName(pivots.withColumn("asks", F.lit(True)))
    joined = stored(by_groups(both.drop("blocks"), ["value", "block"], across, kind), "joined")
    # (3) A label that met a pivot counts as that pivot's component; the largest one asks nothing more.
    pivot = joined.groupBy("value", F.col("b").alias("label")).agg(F.min("a").alias("pivot"))
    named = stored(near.join(large, "value").join(pivot, ["value", "label"], "left").select(
        "value", "unit", F.coalesce("pivot", "label").alias("label")), "named")
    counts = named.groupBy("value", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("value").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    lines = stored(largest.select("value", F.col("top.label").alias("top"),
                                  F.ceil((F.col("all") - F.col("top.n")) / bucket_rows).cast("int").alias("lines"))
                   .filter("lines > 0"), "open")
    again = every.drop("label").join(named, ["value", "unit"]).join(lines, "value")
    asking = again.filter("label <> top").withColumn("line", F.pmod(F.xxhash64("unit", F.lit(1)), F.col("lines")).cast("int"))
    asked = again.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)))
    cells = asked.withColumn("asks", F.lit(False)).unionByName(
        asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True)))
    rest = by_groups(cells.select("value", "line", "block", "asks", "unit", "label", "shingles"),
                     ["value", "line", "block"], across, kind)
    return edges.unionByName(joined.select("a", "b")).unionByName(rest.select("a", "b"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of `passages` whose class stands within single paragraphs everywhere."""
    return passages(docs, min_words, similarity, bucket_rows).filter("not across").drop("across")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
             bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every paragraph of a class of two or more, and every repeated piece that doesn't lie in removed ones: doc_id,
    paragraph, start, end, whole (false for a piece), class_doc_id, class_paragraph (the one that stays), copies
    (size of the class), removed, across (a piece of the class crosses a line feed).
    """
    both = stored(_units(docs, min_words), "paragraphs")
    units, texts = both.filter(F.col("paragraph") != WHOLE_TEXT), both.filter(F.col("paragraph") == WHOLE_TEXT)
    banded = units.select("unit", F.explode("bands").alias("value"))
    shared = stored(banded.groupBy("value").agg(F.min("unit").alias("a"), F.max("unit").alias("b"))
                    .filter("a < b").select("value"), "shared")
    members = stored(_different(stored(banded.join(shared, "value").select("value", "unit").distinct(), "banded")), "members")
    asked = members.select("unit").distinct()
    wanted = (units.select("unit", "doc_id").join(asked, "unit").groupBy("unit").agg(F.min("doc_id").alias("doc_id"))
              .groupBy("doc_id").agg(F.collect_list("unit").alias("units")))
    sets = stored(_sets(docs, stored(wanted, "wanted"), min_words).dropDuplicates(["unit"]), "sets")
    roots = stored(components(jaccard_links(members.join(sets, "unit"), similarity, bucket_rows)), "roots")
    placed = units.select("doc_id", "paragraph", "start", "end", "unit")
    named = stored(placed.join(roots.withColumnRenamed("node", "unit"), "unit", "left")
                   .withColumn("class", F.coalesce("root", "unit")).drop("unit", "root"), "classes")
    first = F.min(F.struct("doc_id", "paragraph"))
    classes = stored(named.groupBy("class").agg(F.count("*").alias("copies"), first.alias("first"))
                     .filter("copies > 1"), "repeated")
    here = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph"))
    lines = stored(named.join(classes, "class").select(
        "doc_id", "paragraph", "start", "end", F.lit(True).alias("whole"), F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.paragraph").alias("class_paragraph"), "copies", (~here).alias("removed"),
        F.lit(False).alias("across")), "lines")
    return lines.unionByName(_repeated_pieces(texts, lines))


def _repeated_pieces(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """Pieces that stand in two places or more, except those wholly in paragraphs which `lines` removes."""
    gone = lines.filter("removed").groupBy("doc_id").agg(F.collect_set("paragraph").alias("gone"))
    zipped = F.arrays_zip("piece_starts", "piece_ends", "piece_lines", "pieces")
    stays = lambda p: F.size(F.array_except(p["piece_lines"], "gone")) > 0
    left = texts.join(gone, "doc_id", "left").select("doc_id", F.explode(
        F.when(F.col("gone").isNull(), zipped).otherwise(F.filter(zipped, stays))).alias("p"))
    pieces = stored(left.select(
        "doc_id", F.col("p.piece_lines")[0].alias("paragraph"), F.col("p.piece_starts").alias("start"),
        F.col("p.piece_ends").alias("end"), F.col("p.pieces").alias("piece"),
        (F.size("p.piece_lines") > 1).alias("across")), "pieces")
    first = F.min(F.struct("doc_id", "paragraph", "start"))
    classes = stored(pieces.groupBy("piece").agg(F.count("*").alias("copies"), first.alias("first"), F.max("across").alias("across"))
                     .filter("copies > 1"), "repeated-pieces")
    here = F.struct("doc_id", "paragraph", "start") == F.col("first")
    return pieces.drop("across").join(classes, "piece").select(
        "doc_id", "paragraph", "start", "end", F.lit(False).alias("whole"), F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.paragraph").alias("class_paragraph"), "copies", (~here).alias("removed"), "across")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with their removed paragraphs and pieces cut out; nothing else of a row changes."""
    # A paragraph goes with its line feed. A piece may reach into a paragraph that goes.
    span = F.struct("start", (F.col("end") + F.col("whole").cast("int")).alias("end"))
    spans = found.filter("removed").groupBy("doc_id").agg(F.array_sort(F.collect_set(span)).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    whole = F.col("row.text").cast("string")
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate("gone", begin, lambda a, s: F.struct(
        F.concat(a["kept"], F.substring(whole, a["at"] + 1, s["start"] - a["at"])).alias("kept"),
        F.greatest(a["at"], s["end"]).alias("at")))
    rest = F.concat(cut["kept"], F.substring(whole, cut["at"] + 1, F.length(whole)))
    # Without its last paragraph a text doesn't end in the line feed before it.
    kept = F.when(cut["at"] > F.length(whole), F.regexp_replace(rest, "\n$", "")).otherwise(rest)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return rows.join(spans, "doc_id", "left").select(
        *[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
