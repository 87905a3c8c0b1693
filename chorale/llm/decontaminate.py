"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: whatever the k edits are, one
piece stays whole. All pieces are looked up at once in every document (an automaton over the pieces,
one pass over the text), and each hit is verified around its place with Myers' bit-parallel distance.

Texts are compared lower-cased with runs of white space as one space. The budget is one edit for each
`chars_per_edit` characters of an item. Items are the stated query set: they go over the documents in
blocks of bounded size, so neither the driver nor a task holds more than one block of items.

Edge cases: null and empty documents hold nothing; null items and items shorter than `min_chars`
(white space alone included) take no part; repeated items are looked up once each and reported by id;
ties between places go to the first one; an empty table on either side gives no hits; other columns
are kept by `decontaminate` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import running_sums, stored

CHARS_PER_EDIT = 16
MIN_CHARS = 16
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def ends(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Smallest edit distance of `pattern` to a part of `text` and the first end of such a part, if within budget.

    Myers' recurrence with the columns of the dynamic program as bits of one integer.
    """
    m, masks = len(pattern), {}
    for k, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << k
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = every, 0, m, (budget + 1, 0)
    for at, char in enumerate(text, 1):
        same = masks.get(char, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (every & ~(diagonal | up)), up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best[0]:
                best = (score, at)
        rise, fall = rise << 1, fall << 1
        same |= down
        up, down = (fall | ~(same | rise)) & every, rise & same & every
    return best if best[0] <= budget else None


def find(pattern: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest part of `text`, the first of equals."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    found = ends(pattern, text, budget)
    if found is None:
        return None
    distance, end = found
    begin = max(0, end - len(pattern) - distance)
    back = ends(pattern[::-1], text[begin:end][::-1], distance)
    return distance, end - (back[1] if back else end - begin), end


class Matcher:
    """The pieces of a block of items as one automaton."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items, pieces = [(i, t, len(t) // chars_per_edit) for i, t in items], {}
        for n, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[begin:end], []).append((n, begin))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) for each item found, at its closest place."""
        if not text:
            return
        text, spans = normal(text), {}
        for last, (size, places) in self.automaton.iter(text):
            for n, begin in places:
                _, item, budget = self.items[n]
                start = last + 1 - size - begin
                low, high = max(0, start - budget), start + len(item) + budget
                own = spans.setdefault(n, [])
                # Hits come in order of their ends, so their windows nearly do: overlapping ones are merged.
                if own and low <= own[-1][1]:
                    own[-1] = (min(low, own[-1][0]), max(high, own[-1][1]))
                else:
                    own.append((low, high))
        for n, windows in spans.items():
            item, pattern, budget = self.items[n]
            best = None
            for low, high in windows:
                found = find(pattern, text[low:high], budget)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], found[1] + low, found[2] + low)
                    if not found[0]:
                        break
            if best:
                yield (item, *best)


_CACHE: dict[int, Matcher] = {}


def _matcher(items: list[tuple[int, str]], chars_per_edit: int) -> Matcher:
    """One automaton at a time is kept in a worker."""
    key = hash((tuple(items), chars_per_edit))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Matcher(items, chars_per_edit)
    return _CACHE[key]


def item_blocks(benchmark: DataFrame, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    """The items, normalised, in lists of about `block_chars` characters; one list at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    numbered = running_sums(items.withColumn("chars", F.length("text")), [F.col("item_id"), F.col("text")], {"upto": "chars"})
    numbered = stored(numbered.withColumn("block", F.floor(F.col("upto") / block_chars)), "items")
    for (block,) in numbered.select("block").distinct().orderBy("block").toLocalIterator():
        rows = numbered.filter(F.col("block") == block).select("item_id", "text").collect()
        texts = [(i, normal(t)) for i, t in rows if i is not None]
        yield [(i, t) for i, t in texts if len(t) >= max(1, min_chars)]


def contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT,
                 min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): places are in the normalised text."""
    schema = "doc_id long, item_id long, distance int, start int, end int"
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in item_blocks(benchmark, min_chars, block_chars):
        def run(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            matcher = _matcher(items, chars_per_edit)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for hit in matcher.hits(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"]).astype(
                    {"doc_id": "Int64", "item_id": "Int64"})
        found = narrow.mapInPandas(run, schema) if items else None
        out = found if out is None else out if found is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _clean(items: list[tuple[int, str]], chars_per_edit: int):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        matcher = _matcher(items, chars_per_edit)
        return pd.Series([next(matcher.hits(t), None) is None for t in texts], dtype=bool)
    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT,
                  min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows whose text holds no item; decided row by row, without moving a text."""
    for items in item_blocks(benchmark, min_chars, block_chars):
        if items:
            docs = docs.filter(_clean(items, chars_per_edit)(F.col("text").cast("string")))
    return docs
