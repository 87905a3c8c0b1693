"""Language-model scoring by an interpolated modified Kneser-Ney model of word n-grams.

Tokens are the words of a text, A-Z lower-cased, and one end mark a text; a begin mark stands before the first
word as context only. The model is counted in Spark. A task turns some millions of tokens at a time into sorted
arrays of distinct n-grams with their counts and sends one packed row to each shard; a shard merges what it gets.
The highest order keeps raw counts. A lower order counts different left neighbours, n-grams at the begin of a text
(which have none) their occurrences. Each order has three discounts from its counts of counts; what they take is
given to the next lower order, below the words to all V known tokens and one unknown one alike.

Shards are ranges of a 64-bit key, so a shard's file is one sorted array of keys and one of counts, in a folder that
all workers share. Workers memory-map the files, and ask for the sorted distinct keys of some millions of tokens at a
time. A key begins with bits of its context, so the n-grams of a context lie together; those of contexts that consist
of frequent words alone (as the empty one) are spread over all shards by the whole n-gram instead. Frequent means more
than a quarter of a shard's share of all tokens, so there are at most 4 such words a shard.

`shards` follows the bytes of the training texts, one for each `shard_bytes`; nothing is pruned, and no table of the
model passes through the driver (it gets sums and one number a shard). Counts beyond 2 ** 24 are kept to 24 bits.

Edge cases: a null text is an empty one; an empty or blank text has one token, its end; repeated rows count as often as
they appear; a null `trains` doesn't train; without training rows every token has the probability 1 / (V + 1) = 1;
an order without enough counts of counts takes the discounts 0.5, 1 and 1.5; an empty table gives an empty result;
other columns than doc_id and text are never read, but by the `trains` expression.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import by_groups, stored, words_of
from chorale.session import work_dir

ORDER = 2
SHARD_BYTES = 32_000_000
# Tokens a task holds at once.
CHUNK = 2_000_000
# No word holds a line feed.
BEGIN, END = xxhash.xxh3_64_intdigest(b"\n\n"), xxhash.xxh3_64_intdigest(b"\n")
BEGIN_ID, UNKNOWN_ID = 0, (1 << 32) - 1
_CONTEXT_BITS = np.uint64(0xFFFFFF0000000000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def gram_keys(context: np.ndarray, word: np.ndarray, spread: np.ndarray) -> np.ndarray:
    whole = _mix(context ^ _mix(word.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return np.where(spread, whole, (context & _CONTEXT_BITS) | (whole >> np.uint64(24)))


@dataclass
class Texts:
    """Some texts as one array: the hashes of begin mark, words and end mark of each."""

    hashes: np.ndarray
    place: np.ndarray  # in its text; the begin mark has 0
    starts: np.ndarray


def texts_of(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[tuple[list[int | None], Texts]]:
    """doc_ids and texts, by about `chunk` tokens."""
    ids, parts, size = [], [], 0

    def whole() -> tuple[list, Texts]:
        lengths = np.array(list(map(len, parts)))
        starts = np.cumsum(lengths) - lengths
        return ids, Texts(np.concatenate(parts), np.arange(lengths.sum()) - np.repeat(starts, lengths), starts)

    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            words = words_of(text)
            ids.append(None if pd.isna(doc) else int(doc))
            parts.append(np.fromiter(chain((BEGIN,), map(xxhash.xxh3_64_intdigest, words), (END,)),
                                     np.uint64, len(words) + 2))
            size += len(words) + 2
            if size >= chunk:
                yield whole()
                ids, parts, size = [], [], 0
    if parts:
        yield whole()


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpack(payloads: pd.Series, dtypes: list[str]) -> list[np.ndarray]:
    """The columns of several packed rows, one after the other."""
    width, parts = sum(np.dtype(t).itemsize for t in dtypes), [[] for _ in dtypes]
    for payload in payloads:
        raw, at = zstandard.ZstdDecompressor().decompress(payload), 0
        n = len(raw) // width
        for k, t in enumerate(dtypes):
            parts[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of the first of each, and the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    return own[first], order[first], np.add.reduceat(counts[order], first) if len(own) else counts


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Shards of sorted keys and where their keys lie."""
    if not len(keys):
        return
    of = _shard(keys, shards)
    bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for begin, end in zip(bounds, [*bounds[1:], len(of)], strict=True):
        yield int(of[begin]), slice(begin, end)


@dataclass
class Arrays:
    """Sorted keys with values, one file a shard, memory-mapped when first asked."""

    folder: str
    name: str
    dtypes: tuple[str, ...]
    shards: int
    opened: dict = field(default_factory=dict, repr=False)

    def path(self, shard: int) -> str:
        return f"{self.folder}/{self.name}-{shard}"

    def write(self, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        """A task that runs again replaces the file by the same one."""
        os.makedirs(self.folder, exist_ok=True)
        draft = f"{self.path(shard)}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            for column, t in zip((keys, *values), ("<u8", *self.dtypes), strict=True):
                column.astype(t).tofile(out)
        os.replace(draft, self.path(shard))

    def _open(self, shard: int) -> list[np.ndarray]:
        if shard not in self.opened:
            types = ("<u8", *self.dtypes)
            if not os.path.exists(self.path(shard)):
                self.opened[shard] = [np.empty(0, t) for t in types]
            else:
                raw = np.memmap(self.path(shard), np.uint8, "r")
                n, at, columns = len(raw) // sum(np.dtype(t).itemsize for t in types), 0, []
                for t in types:
                    size = n * np.dtype(t).itemsize
                    columns.append(raw[at:at + size].view(t))
                    at += size
                self.opened[shard] = columns
        return self.opened[shard]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places (-1: absent) and values (0: absent) of sorted distinct keys."""
        places, values = np.full(len(keys), -1, np.int64), [np.zeros(len(keys), t) for t in self.dtypes]
        for shard, part in _by_shard(keys, self.shards):
            known, *columns = self._open(shard)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            there = known[at] == keys[part]
            places[part] = np.where(there, at, -1)
            for out, column in zip(values, columns, strict=True):
                out[part] = np.where(there, column[at], 0)
        return places, values

    def look_up(self, keys: np.ndarray) -> list[np.ndarray]:
        """Values of keys in any order, repeats included."""
        distinct, back = np.unique(keys, return_inverse=True)
        return [v[back] for v in self.find(distinct)[1]]


@dataclass
class Model:
    """A fitted model: what the driver keeps of it and where its arrays lie."""

    folder: str
    order: int
    shards: int
    tokens: int  # N
    words: int  # V
    offsets: np.ndarray  # words in earlier shards of the vocabulary
    frequent: np.ndarray  # ids, in order, the begin mark first
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    kept: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}  # open files stay where they are

    def arrays(self, name: str, *dtypes: str) -> Arrays:
        return self.kept.setdefault(name, Arrays(self.folder, name, dtypes, self.shards))

    def vocabulary(self) -> Arrays:
        return self.arrays("words", "<i8")

    def grams(self, order: int) -> Arrays:
        return self.arrays(f"grams{order}", "<f4")

    def contexts(self, order: int) -> Arrays:
        return self.arrays(f"contexts{order}", "<f8", "<f8")

    def ids_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and training counts of sorted distinct hashes."""
        places, (counts,) = self.vocabulary().find(hashes)
        ids = np.where(places < 0, UNKNOWN_ID, places + self.offsets[_shard(hashes, self.shards)] + 1)
        return np.where(hashes == np.uint64(BEGIN), BEGIN_ID, ids).astype(np.uint64), counts

    def contexts_of(self, ids: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the order - 1 tokens before each token, and whether all of these are frequent."""
        own, spread = np.full(len(ids), order, np.uint64), np.ones(len(ids), bool)
        for back in range(order - 1, 0, -1):
            before = np.concatenate([np.zeros(back, np.uint64), ids])[:len(ids)]
            own = _mix((own + before + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            # The begin mark is the first of the frequent ids.
            at = np.searchsorted(self.frequent, before, "right") - 1
            spread &= self.frequent[at] == before
        return own, spread

    def score(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known tokens, base score and score."""
        distinct, back = np.unique(texts.hashes, return_inverse=True)
        own_ids, own_counts = self.ids_of(distinct)
        ids, own = own_ids[back], texts.place > 0
        count = own_counts[back]
        base = np.log10((count + 1) / (self.tokens + (self.words + 1)))
        # One row for each different word is enough for the lowest order.
        nothing = np.full(len(own_ids), 1, np.uint64)
        known = self._share(1, nothing, np.ones(len(own_ids), bool), own_ids, np.full(len(own_ids), 1 / (self.words + 1)))
        chance = known[back]
        for order in range(2, self.order + 1):
            there = np.flatnonzero(texts.place >= order - 1)
            context, spread = self.contexts_of(ids, order)
            chance[there] = self._share(order, context[there], spread[there], ids[there], chance[there])
        score = np.log10(chance)
        sums = lambda x: np.add.reduceat(np.where(own, x, 0), texts.starts)
        return sums(np.ones(len(ids), np.int64)), sums((count > 0).astype(np.int64)), sums(base), sums(score)

    def _share(self, order: int, context: np.ndarray, spread: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probability of words behind their contexts; `lower`: that of the next lower order."""
        (count,) = self.grams(order).look_up(gram_keys(context, word, spread))
        total, rest = self.contexts(order).look_up(context)
        discounts = np.array([0.0, *self.discounts.get(order, (0.0, 0.0, 0.0))])
        taken = np.maximum(count.astype(float) - discounts[np.minimum(count, 3).astype(int)], 0)
        return np.where(total > 0, (taken + rest * lower) / np.where(total > 0, total, 1), lower)


def discounts_of(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Three discounts from the numbers of n-grams with the counts 1 to 4."""
    if all(n):
        share = n[0] / (n[0] + 2 * n[1])
        found = tuple(k - (k + 1) * share * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < d <= k for k, d in zip((1, 2, 3), found, strict=True)):
            return found
    return 0.5, 1.0, 1.5


def _types(order: int) -> list[str]:
    """Columns of packed n-grams: contexts from the longest to that of one word, which of them are spread, word, count."""
    return ["<u8"] * (order - 1) + ["<u1", "<u4", "<u4"]


def _rows(kind: str, order: int, keys: np.ndarray, shards: int, columns: list[np.ndarray]) -> list[tuple]:
    return [(kind, order, shard, _pack(*[c[part] for c in columns])) for shard, part in _by_shard(keys, shards)]


_ROW = "kind string, level int, shard int, payload binary"
_EMPTY = np.uint64(1)  # the context of the lowest order


def _counted(grams: list[np.ndarray], order: int, shards: int) -> list[tuple]:
    """Packed rows of equal n-grams summed, dealt by their keys."""
    *contexts, flags, words, counts = grams
    context = contexts[0] if contexts else np.full(len(words), _EMPTY)
    spread = (flags & 1).astype(bool) if contexts else np.ones(len(words), bool)
    keys, first, sums = _summed(gram_keys(context, words, spread), counts)
    return _rows("grams", order, keys, shards, [*[c[first] for c in contexts], flags[first], words[first], sums.astype("<u4")])


def _local(folder: str) -> str:
    path = folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder
    if "://" in path:
        raise ValueError(f"{folder} can't be memory-mapped: give a folder that every worker has mounted")
    return path


def fit(docs: DataFrame, trains: Column, order: int = ORDER, shard_bytes: int = SHARD_BYTES, chunk: int = CHUNK,
        folder: str | None = None) -> Model:
    """The model of the texts for which `trains` holds. folder: where its arrays go, a path on all workers."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = docs.sparkSession
    folder = _local(folder or work_dir(spark, "ngrams"))
    texts = docs.filter(trains).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    model = Model(folder, order, shards, 0, 0, np.zeros(shards, np.int64), np.array([BEGIN_ID], np.uint64))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in texts_of(batches, chunk):
            keys, counts = np.unique(part.hashes[part.place > 0], return_counts=True)
            yield pd.DataFrame(_rows("words", 0, keys, shards, [keys, counts.astype("<u4")]), columns=_ROW_NAMES)

    def keep_words(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        keys, counts = _unpack(group["payload"], ["<u8", "<u4"])
        keys, _, sums = _summed(keys, counts.astype(np.int64))
        model.vocabulary().write(shard, keys, sums)
        return pd.DataFrame({"shard": [shard], "words": [len(keys)], "tokens": [int(sums.sum())]})

    kept = stored(by_groups(texts.mapInPandas(words, _ROW), ["shard"], keep_words, "shard int, words long, tokens long"), "words")
    sizes = np.zeros(shards, np.int64)
    for shard, n, tokens in kept.collect():  # one row a shard
        sizes[shard], model.tokens = n, model.tokens + tokens
    model.words, model.offsets = int(sizes.sum()), np.cumsum(sizes) - sizes
    if model.words >= UNKNOWN_ID - 1:
        raise ValueError("ids of words have 32 bits")
    limit = model.tokens / (4 * shards)

    def frequent(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        counts = model.vocabulary()._open(shard)[1]
        return pd.DataFrame({"id": np.flatnonzero(counts > limit) + model.offsets[shard] + 1})

    # At most 4 words a shard.
    often = by_groups(kept.select("shard"), ["shard"], frequent, "id long").collect()
    model.frequent = np.array(sorted([BEGIN_ID, *[r[0] for r in often]]), np.uint64)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in texts_of(batches, chunk):
            distinct, back = np.unique(part.hashes, return_inverse=True)
            ids = model.ids_of(distinct)[0][back]
            found = {k: model.contexts_of(ids, k) for k in range(2, order + 1)}
            out = []
            for k in range(2, order + 1):
                # A shorter n-gram is counted where it begins its text, as no longer one holds it.
                at = np.flatnonzero(part.place >= k - 1 if k == order else part.place == k - 1)
                flags = np.zeros(len(at), "<u1")
                for bit, j in enumerate(range(k, 1, -1)):
                    flags |= found[j][1][at].astype("<u1") << bit
                own = [*[found[j][0][at] for j in range(k, 1, -1)], flags, ids[at].astype("<u4"), np.ones(len(at), "<u4")]
                out += _counted(own, k, shards)
            yield pd.DataFrame(out, columns=_ROW_NAMES)

    def merge(group: pd.DataFrame, top: int) -> pd.DataFrame:
        level, shard = int(group["level"].iloc[0]), int(group["shard"].iloc[0])
        if level < top:  # handed on to its own level
            return group[_ROW_NAMES]
        *contexts, flags, word, counts = _unpack(group["payload"], _types(level))
        context = contexts[0] if contexts else np.full(len(word), _EMPTY)
        spread = (flags & 1).astype(bool) if contexts else np.ones(len(word), bool)
        keys, first, sums = _summed(gram_keys(context, word, spread), counts.astype(np.int64))
        model.grams(level).write(shard, keys, sums)
        own, at = context[first], np.argsort(context[first], kind="stable")
        own, ordered = own[at], sums[at]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        stats = [np.add.reduceat(x.astype("<i8"), begin) for x in (ordered, ordered == 1, ordered == 2, ordered >= 3)]
        out = _rows("contexts", level, own[begin], shards, [own[begin], *stats])
        out.append(("counts", level, shard, _pack(np.array([(sums == k).sum() for k in (1, 2, 3, 4)], "<i8"))))
        if level > 1:
            # Each different n-gram is one left neighbour of its end.
            less = [*[c[first] for c in contexts[1:]], flags[first] >> 1, word[first], np.ones(len(first), "<u4")]
            out += _counted(less, level - 1, shards)
        return pd.DataFrame(out, columns=_ROW_NAMES)

    tables: dict[int, DataFrame] = {}
    for level in range(order, 0, -1):
        if level == order:
            rows = texts.mapInPandas(grams, _ROW)
        else:
            above = [tables[order]] if level + 1 == order else [tables[order], tables[level + 1]]
            rows = above[0] if len(above) == 1 else above[0].unionByName(above[1])
            rows = rows.filter((F.col("kind") == "grams") & (F.col("level") == level))
        tables[level] = stored(by_groups(rows, ["level", "shard"], lambda g, top=level: merge(g, top), _ROW), f"level{level}")
        # One row a shard.
        seen = [np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r[0])), "<i8") for r in
                tables[level].filter(f"kind = 'counts' and level = {level}").select("payload").collect()]
        model.discounts[level] = discounts_of(tuple(int(x) for x in sum(seen, np.zeros(4, np.int64))))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        level, shard = int(group["level"].iloc[0]), int(group["shard"].iloc[0])
        keys, *stats = _unpack(group["payload"], ["<u8"] + ["<i8"] * 4)
        order_ = np.argsort(keys, kind="stable")
        own = keys[order_]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total, *ones = [np.add.reduceat(s[order_], begin) for s in stats]
        rest = sum(d * n for d, n in zip(model.discounts[level], ones, strict=True))
        model.contexts(level).write(shard, own[begin], total, rest)
        return pd.DataFrame({"level": [level], "shard": [shard], "contexts": [len(begin)]})

    contexts = None
    for table in tables.values():
        own = table.filter("kind = 'contexts'")
        contexts = own if contexts is None else contexts.unionByName(own)
    stored(by_groups(contexts, ["level", "shard"], join, "level int, shard int, contexts long"), "contexts")
    return model


_ROW_NAMES = ["kind", "level", "shard", "payload"]


def scored(docs: DataFrame, model: Model, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in texts_of(batches, chunk):
            tokens, known, base, score = model.score(texts)
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": tokens, "n_known": known,
                                "train_tokens": model.tokens, "base_score": base, "score": score,
                                "perplexity": 10 ** np.minimum(-score / tokens, 300)})
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
