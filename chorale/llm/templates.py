"""Line dedup by a log-template tree.

A line's tokens that hold a digit are variable and masked. The tree has a fixed depth: the number of
tokens, then the leading tokens. In a leaf, lines are gathered into templates: a line joins the
template with which it shares the largest part of its constant tokens in place (of the template's or its own,
whichever are more), if at least `alike` of them, and positions that differ become variable too. A template found in `min_docs` documents or more recurs, and its lines are
dropped from all of them (the first line of a template isn't kept: it is boilerplate). A masked line that
stands as it is in `min_copies` documents or more is dropped likewise, whatever its template gathers.

Only leaves with `min_docs` rows or more can have a recurring template, and only those are gathered; of the
others, those with a repeated masked line are read. Equal masked lines are one row. A large leaf is gathered in slices, whose templates are then gathered
themselves.

Edge cases: null and empty texts have no line; blank lines are never dropped and not counted; a line
counts once for a document however often it appears there; repeated rows with one doc_id are one
document; rows with a null doc_id are one document; ties between templates go to the earlier one, and
lines are taken by falling count, then by text; an empty table gives an empty result; other columns are
kept by `without_templates` and never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import by_groups, stored

DEPTH, ALIKE, MIN_DOCS, MIN_COPIES = 3, 0.6, 10, 2
SLICE_ROWS = 50_000
# Wanted lines (two hashes and a count each) up to this many are broadcast, else both sides are shuffled.
BROADCAST_ROWS = 1_000_000
VARIABLE = "<*>"
# Blanks at the ends of a line and between tokens are not part of them.
_ENDS = " \t\r\x0b\x0c"


def _masked(line: Column) -> Column:
    plain = F.regexp_replace(F.trim(line, F.lit(_ENDS)), "[\\t\\r\\x0B\\f ]+", " ")
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ 0-9]*[0-9][^ ]*", VARIABLE)).otherwise(plain)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, masked and leaf of the distinct masked lines of each document."""
    masked = F.array_distinct(F.transform(F.split(F.col("text").cast("string"), "\n"), _masked))
    rows = docs.select(F.col("doc_id").cast("long"), F.explode(masked).alias("masked")).filter("masked <> ''")
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit("")))
    return rows.withColumn("leaf", F.xxhash64(tokens, F.substring_index("masked", " ", depth)))


def gather(lines: list[str], alike: float = ALIKE) -> list[str]:
    """The template of each line, all of one number of tokens, in the order given.

    Templates are found through the tokens they have in place: a line of m constant tokens that must share c of them
    shares one of any m - c + 1, so only templates with one of its m - c + 1 rarest tokens are looked at.
    """
    ids: dict[str, int] = {VARIABLE: 0}
    rows = np.array([[ids.setdefault(t, len(ids)) for t in line.split(" ")] for line in lines])
    width, owner, size = rows.shape[1], [], 0
    table, held = np.empty((16, width), rows.dtype), [{} for _ in range(width)]
    for row in rows:
        constant = np.flatnonzero(row).tolist()
        places = sorted((held[k].get(row[k], ()) for k in constant), key=len)
        needed = math.ceil(alike * len(constant) - 1e-9)
        near = set().union(*places[:len(constant) - needed + 1])
        best = -1
        if near:
            found = np.array(sorted(near))
            known = table[found]
            # Only constant positions say that a line belongs; a template doesn't wear down to its leading tokens,
            # since the constants of the line must be met as well.
            same = ((known == row) & (known != 0)).sum(axis=1)
            fit = same / np.maximum(np.maximum((known != 0).sum(axis=1), len(constant)), 1)
            at = int(fit.argmax())
            if fit[at] >= alike - 1e-9:
                best = int(found[at])
        if best < 0:
            if size == len(table):
                table = np.concatenate([table, np.empty_like(table)])
            table[size], best, size = row, size, size + 1
            for k in constant:
                held[k].setdefault(row[k], []).append(best)
        else:
            # Entries of positions that become variable stay behind; the comparison passes over them.
            table[best][table[best] != row] = 0
        owner.append(best)
    names = np.array(list(ids), dtype=object)
    texts = [" ".join(names[t]) for t in table[:size]]
    return [texts[k] for k in owner]


def _gathered(rows: DataFrame, keys: list[str], alike: float) -> DataFrame:
    """rows: keys, masked, n. Adds the template of each row."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "masked"], ascending=[False, True], kind="stable")
        out = group.copy()
        out["template"] = None
        # A leaf is a hash; lines with other numbers of tokens that share it are kept apart.
        counts = group["masked"].str.count(" ")
        for count in counts.unique():
            own = (counts == count).to_numpy()
            out.loc[own, "template"] = gather(group["masked"][own].tolist(), alike)
        return out[["leaf", "masked", "template", "n"]]
    return by_groups(rows, keys, run, "leaf long, masked string, template string, n long")


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """leaf, line, masked, n and gathers of the wanted lines: each text once."""
    # Hashes and counts; their number decides how they meet the lines.
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = lines.select("leaf", F.xxhash64("masked").alias("line"), "masked").join(wanted, ["leaf", "line"])
    return found.groupBy("leaf", "line").agg(*[F.first(c).alias(c) for c in ("masked", "n", "gathers")])


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, alike: float = ALIKE,
              slice_rows: int = SLICE_ROWS, min_copies: int = MIN_COPIES) -> DataFrame:
    """doc_id, line (hash of the masked line), template, template_id and docs (how many have it) of every line of a
    recurring template, and of every repeated masked line, which is its own template.

    Documents and lines meet as hashes; a text is fetched once for each line that is gathered or repeated.
    """
    lines = _lines(docs, depth)
    placed = stored(lines.select("doc_id", "leaf", F.xxhash64("masked").alias("line")), "lines")
    copies = stored(placed.groupBy("leaf", "line").agg(F.count("*").alias("n")), "counts")
    leaves = copies.groupBy("leaf").agg((F.sum("n") >= min_docs).alias("gathers"), F.max("n").alias("most")).filter(
        F.col("gathers") | (F.col("most") >= min_copies)).select("leaf", "gathers")
    wanted = stored(copies.join(leaves, "leaf").filter(F.col("gathers") | (F.col("n") >= min_copies)), "wanted")
    every = stored(_texts(lines, wanted), "texts")
    counted = every.filter("gathers").select("leaf", "masked", "n")
    # Large leaves: fewer than rows / slice_rows of them.
    large = stored(counted.groupBy("leaf").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
                   .filter("slices > 1"), "large")
    sliced = (counted.join(large, "leaf", "left").fillna(1, ["slices"])
              .withColumn("slice", F.pmod(F.xxhash64("masked"), F.col("slices")).cast("int")))
    local = stored(_gathered(sliced.select("leaf", "slice", "masked", "n"), ["leaf", "slice"], alike), "local")
    # What the slices of a large leaf found is gathered once more; other leaves are done.
    parts = (local.join(large.select("leaf"), "leaf", "left_semi").groupBy("leaf", "template")
             .agg(F.sum("n").alias("n")).withColumnRenamed("template", "masked"))
    whole = _gathered(parts, ["leaf"], alike).select("leaf", F.col("masked").alias("template"),
                                                      F.col("template").alias("wide"))
    final = stored(local.join(whole, ["leaf", "template"], "left").select(
        "leaf", F.xxhash64("masked").alias("line"), F.coalesce("wide", "template").alias("template"))
        .withColumn("template_id", F.xxhash64("leaf", "template")), "templates")
    member = stored(placed.join(final.select("leaf", "line", "template_id"), ["leaf", "line"]).select(
        "doc_id", "line", "template_id").distinct(), "members")
    often = stored(member.select("template_id", "doc_id").distinct().groupBy("template_id")
                   .agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs), "recurring")
    # Repeated lines that no recurring template holds.
    held = final.join(often, "template_id", "left_semi").select("leaf", "line")
    alone = wanted.filter(F.col("n") >= min_copies).select("leaf", "line").join(held, ["leaf", "line"], "left_anti")
    exact = stored(placed.join(alone, ["leaf", "line"]).select("doc_id", "leaf", "line").distinct(), "copies")
    repeated = exact.groupBy("leaf", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_copies)
    names = final.groupBy("template_id").agg(F.first("template").alias("template"))
    own = every.select("leaf", "line", F.col("masked").alias("template"))
    return member.join(often, "template_id").join(names, "template_id", "left").select(
        "doc_id", "line", "template", "template_id", "docs").unionByName(
        exact.join(repeated, ["leaf", "line"]).join(own, ["leaf", "line"], "left").select(
            "doc_id", "line", "template", F.xxhash64("leaf", "line").alias("template_id"), "docs"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, dropped (number of different masked lines), lines (their hashes, sorted) and templates."""
    return found.groupBy("doc_id").agg(
        F.count_distinct("line").alias("dropped"), F.array_sort(F.collect_set("line")).alias("lines"),
        F.count_distinct("template_id").alias("templates"))


def without_templates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the lines of recurring templates; nothing else of a row changes."""
    gone = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda line: ~F.array_contains(
        "gone", F.xxhash64(_masked(line)))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return rows.join(gone, F.col("id").eqNullSafe(F.col("doc")), "left").select(
        *[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
