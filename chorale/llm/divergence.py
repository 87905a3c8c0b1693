"""Source divergence audit: how far the sources of a language lie apart by their words, and by which words.

Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language keeps its V terms that stand
in `min_docs` of its documents or more. In a group (a language's source) or the whole language a kept term with `count`
occurrences has the share p = 1 + floor(10 ** 9 * (count + 2) / (N + 2 * V)), N being the sum of the counts, and two
shares differ by f = floor((p - q) ** 2 / (p + q)). The divergence of two sources is the sum of f over all kept terms.

The work is a cube: group blocks by group blocks by term blocks. Term blocks are ranges of a hash; documents are
counted per task and sent once, packed, to their term blocks, which decide what is kept and cut each group's counts into
slices. A slice is replicated to the cells of its group block; a cell (group block, group block, term block) holds the
slices of two group blocks for one term block and gives a partial divergence for each pair of its groups. The partial
values are summed along the term axis. A cell sees at most 2 * `group_rows` groups and the terms of one block, whatever
the size of a source: a source with a third of all documents is one slice a term block like any other.

All numbers are integers; counts up to 9 * 10 ** 15 are exact.

Edge cases: null text, language and source are empty strings; a group without a kept term has p from a count of 0 for
each; a language without kept terms has divergences 0 and no terms; a language with one source has no pair; repeated
rows are documents of their own; ties go to the smaller item by its UTF-8 bytes; very long texts are read whole; an
empty table gives an empty result; columns other than text, lang and source are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import by_groups, stored

MIN_DOCS, TOP = 10, 10
BLOCK_BYTES = 32_000_000
GROUP_ROWS = 64
# Different (document, term) pairs a task holds at once.
CHUNK = 4_000_000
# Bytes beyond ASCII belong to characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
# No document has a term here: the block that gives every pair its first 0.
NO_TERMS = -1


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (counts + 2) / total), by long division in steps of a thousand."""
    rest, out = counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _raw(payload: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload)


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    return [own[first], *[np.add.reduceat(v[order], first) if len(own) else v for v in values]]


def _counted(docs: DataFrame, blocks: int, chunk: int) -> DataFrame:
    """Packed counts of a task's documents for each term block: names of groups, terms, and (term, group, n, docs)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, groups, parts, size = {}, {}, [], 0

        def flush() -> pd.DataFrame:
            own = np.concatenate([p[0] for p in parts])
            group = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])
            keys, n, docs_ = _summed(own << 32 | group, np.concatenate([p[1] for p in parts]), np.ones(len(own), np.int64))
            names, at = list(terms), keys >> 32
            block = np.fromiter(((xxhash.xxh3_64_intdigest(t, 3) >> 32) * blocks >> 32 for t in names), np.int64, len(names))
            order = np.argsort(block[at], kind="stable")
            of, out = block[at][order], []
            bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for begin, end in zip(bounds, [*bounds[1:], len(of)], strict=True):
                rows = order[begin:end]
                used, local = np.unique(at[rows], return_inverse=True)
                out.append((int(of[begin]), [g[0] for g in groups], [g[1] for g in groups],
                            zstandard.ZstdCompressor(level=1).compress(b"\n".join(names[k] for k in used)),
                            _pack(*[x.astype("<u4") for x in (local, keys[rows] & 0xFFFFFFFF, n[rows], docs_[rows])])))
            return pd.DataFrame(out, columns=["block", "langs", "sources", "terms", "cells"])

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                counts = Counter(terms_of(text))
                if not counts:
                    continue
                own = np.fromiter((terms.setdefault(t, len(terms)) for t in counts), np.int64, len(counts))
                parts.append((own, np.fromiter(counts.values(), np.int64, len(counts)),
                              groups.setdefault((lang, source), len(groups))))
                size += len(counts)
                if size >= chunk:
                    yield flush()
                    terms, groups, parts, size = {}, {}, [], 0
        if parts:
            yield flush()
    return docs.mapInPandas(run, "block int, langs array<string>, sources array<string>, terms binary, cells binary")


_SLICE = "lang string, block int, source string, n long, kept long, payload binary"
_NAMES = ["lang", "block", "source", "n", "kept", "payload"]


def _slices(counted: DataFrame, min_docs: int) -> DataFrame:
    """Of each term block and language: its kept terms in byte order (source is null), and each group's counts of them."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame | None:
        terms, groups, parts = {}, {}, []
        for langs, sources, names, cells in zip(rows["langs"], rows["sources"], rows["terms"], rows["cells"], strict=True):
            term = np.array([terms.setdefault(t, len(terms)) for t in _raw(names).split(b"\n")], np.int64)
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
            own = np.frombuffer(_raw(cells), "<u4").reshape(4, -1).astype(np.int64)
            parts.append((term[own[0]], group[own[1]], own[2], own[3]))
        term, group, n, docs_ = (np.concatenate([p[k] for p in parts]) for k in range(4))
        langs = sorted({g[0] for g in groups})
        lang_of = np.array([langs.index(g[0]) for g in groups], np.int64)
        keys, n, docs_ = _summed(group << 32 | term, n, docs_)
        group, term = keys >> 32, keys & 0xFFFFFFFF
        names, of, out, block = np.array(list(terms), object), list(groups), [], int(rows["block"].iloc[0])
        for number, lang in enumerate(langs):
            here = np.flatnonzero(lang_of[group] == number)
            found, held = _summed(term[here], docs_[here])
            kept = found[held >= min_docs]
            if not len(kept):
                continue
            kept = kept[np.argsort(names[kept], kind="stable")]
            place = np.full(len(names), -1, np.int64)
            place[kept] = np.arange(len(kept))
            here = here[place[term[here]] >= 0]
            out.append((lang, block, None, 0, len(kept), zstandard.ZstdCompressor(level=1).compress(b"\n".join(names[kept]))))
            # Keys are in the order of groups.
            first = np.flatnonzero(np.append(True, group[here][1:] != group[here][:-1])) if len(here) else []
            for begin, end in zip(first, [*first[1:], len(here)], strict=False):
                own = here[begin:end]
                out.append((lang, block, of[group[own[0]]][1], int(n[own].sum()), len(kept),
                            _pack(place[term[own]].astype("<u4"), n[own].astype("<i8"))))
        return pd.DataFrame(out, columns=_NAMES) if out else None
    return by_groups(counted, ["block"], merge, _SLICE)


def _counts(payload: bytes | None, kept: int) -> np.ndarray:
    """A slice as one count for each kept term of its block."""
    out = np.zeros(kept, np.int64)
    if payload is not None:
        raw = _raw(payload)
        n = len(raw) // 12
        out[np.frombuffer(raw, "<u4", n)] = np.frombuffer(raw, "<i8", n, 4 * n)
    return out


def _pairs(groups: DataFrame, slices: DataFrame, group_rows: int) -> DataFrame:
    """lang, a, b, value of each two sources a < b of a language."""
    blocks = slices.filter("source is null").select("lang", "block", "kept").unionByName(
        groups.select("lang").distinct().select("lang", F.lit(NO_TERMS).alias("block"), F.lit(0).cast("long").alias("kept")))
    counts = slices.filter("source is not null").select("lang", "block", "source", "payload")
    # A slice of every group for every term block: a term that a group lacks has a share as well.
    every = stored(groups.join(blocks, "lang").join(counts, ["lang", "block", "source"], "left"), "slices")
    parts = F.ceil(F.col("sources") / group_rows).cast("int")
    own = F.pmod(F.xxhash64("source"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(
        F.least(own, k).alias("low"), F.greatest(own, k).alias("high")))
    rows = every.select("lang", "block", F.explode(cells).alias("cell"), own.alias("own"), "source", "total", "kept", "payload")
    rows = rows.select("lang", "block", "cell.low", "cell.high", "own", "source", "total", "kept", "payload")

    def cell(rows: pd.DataFrame) -> pd.DataFrame | None:
        if len(rows) < 2:
            return None
        rows = rows.sort_values("source", key=lambda s: s.map(lambda x: x.encode("utf-8", "surrogatepass")), kind="stable")
        lang, low, high = rows["lang"].iloc[0], rows["low"].iloc[0], rows["high"].iloc[0]
        names, of, kept = rows["source"].to_numpy(), rows["own"].to_numpy(), int(rows["kept"].iloc[0])
        table = np.stack([shares(_counts(p, kept), t) if kept else np.empty(0, np.int64)
                          for p, t in zip(rows["payload"], rows["total"], strict=True)])
        out = []
        for k in range(len(names) - 1):
            # A cell of two blocks leaves the pairs within one to that block's own cell.
            others = np.arange(k + 1, len(names))
            others = others if low == high else others[of[others] != of[k]]
            if len(others):
                value = apart(table[k], table[others]).sum(axis=1)
                out.append(pd.DataFrame({"lang": lang, "a": names[k], "b": names[others], "value": value}))
        return pd.concat(out) if out else None

    partial = by_groups(rows, ["lang", "block", "low", "high"], cell, "lang string, a string, b string, value long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _terms(groups: DataFrame, slices: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value: at least the `top` terms of each group, and no more than that of each term block."""
    rows = slices.join(groups.select("lang", "source", "total"), ["lang", "source"], "left").join(
        groups.select("lang", "lang_total").distinct(), "lang").select(
        "lang", "block", "source", "total", "lang_total", "kept", "payload")

    def best(rows: pd.DataFrame) -> pd.DataFrame | None:
        is_names = rows["source"].isna().to_numpy()
        names = _raw(rows["payload"][is_names].iloc[0]).split(b"\n")
        rows, out, kept = rows[~is_names], [], len(names)
        whole = sum((_counts(p, kept) for p in rows["payload"]), np.zeros(kept, np.int64))
        q = shares(whole, int(rows["lang_total"].iloc[0]))
        for source, total, payload in zip(rows["source"], rows["total"], rows["payload"], strict=True):
            counts = _counts(payload, kept)
            p = shares(counts, int(total))
            more = np.flatnonzero((counts > 0) & (p > q))
            value = apart(p[more], q[more])
            # Terms are in byte order, so a stable sort leaves ties in it.
            order = np.argsort(-value, kind="stable")[:top]
            out += [(rows["lang"].iloc[0], source, names[k].decode("utf-8", "surrogatepass"), int(v))
                    for k, v in zip(more[order], value[order], strict=True)]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"]) if out else None

    return by_groups(rows, ["lang", "block"], best, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, group_rows: int = GROUP_ROWS,
          block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: each source's distance to every other source of its
    language, and its `top` terms over the language's share."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = stored(_slices(_counted(plain, max(1, -(-size // block_bytes)), chunk), min_docs), "counts")
    names = plain.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    words = slices.filter("source is null").groupBy("lang").agg(F.sum("kept").alias("v"))
    n = slices.filter("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = names.join(n, ["lang", "source"], "left").join(words, "lang", "left").fillna(0, ["n", "v"])
    of = stored(groups.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count("*").alias("sources")), "languages")
    groups = stored(groups.join(of, "lang").select(
        "lang", "source", "sources", (F.col("n") + 2 * F.col("v")).alias("total"),
        (F.col("all_n") + 2 * F.col("v")).alias("lang_total")), "groups")
    pairs = stored(_pairs(groups, slices, group_rows), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).cast("int").alias("rank")
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank).unionByName(
        _terms(groups, slices, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
        .filter(F.col("rank") <= top))
