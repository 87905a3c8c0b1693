"""Mixing sources to target weights by weighted fair queueing.

Every document, in a seeded shuffle of its source, gets a virtual finish time: the words of its source
up to and including it, divided by the source's target. The stream of all documents in the order of
finish times serves every source in proportion to its target. It is truncated at the total budget. A
source short of its target starts over, up to `epochs` times, in the same shuffled order.

Edge cases: reruns agree whatever the order of the rows, repeated ids included; a null or blank text has size 0, is never taken; a null source is a source of its own, last
in order; repeated rows are documents of their own; an empty table gives an empty result; a total of no
words gives targets 0. Other columns are never read, except by `mixed`, which keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import running_sums, stored, word_count

EPOCHS = 3
# Bins of virtual time: so many a unit, and so many units; later items share the last bin.
BINS, UNITS = 1_024, 64
# Keys of rows that are alike (ids and hashes) up to this many are broadcast.
BROADCAST_ROWS = 1_000_000


def sized(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Narrow rows: doc_id, source, size, and the place in the shuffle (for rows of one id, size and text decide)."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"),
                       key.alias("key"), F.xxhash64(F.col("text").cast("string")).alias("mark"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """source, place, source_size, before (words of earlier sources), weight, target.

    Water filling in closed form: with sources ordered by cap / weight, a source is held at its cap
    if the water level that would just reach the cap holds less than the total. Integers decide.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    per = running_sums(per.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()],
                       {"place": "one", "through": "source_size"}).drop("one")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = (per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
           .withColumn("before", F.col("through") - F.col("source_size")).drop("through"))
    filled = running_sums(per.withColumn("ratio", F.col("cap") / F.col("weight")),
                          [F.col("ratio"), F.col("place")], {"caps": "cap", "parts": "weight"})
    filled = stored(filled, "targets")
    total, parts = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return filled.select("source", "place", "source_size", "before", "weight", F.lit(0.0).alias("target"))
    held = F.col("caps") * F.col("weight") + F.col("cap") * (parts - F.col("parts")) < total * F.col("weight")
    capped, held_parts = filled.filter(held).agg(F.coalesce(F.sum("cap"), F.lit(0)),
                                                 F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (total - capped) / (parts - held_parts) if parts > held_parts else 0.0
    target = F.when(held, F.col("cap").cast("double")).otherwise(
        F.least(F.col("weight") * F.lit(float(level)), F.col("cap").cast("double")))
    return filled.select("source", "place", "source_size", "before", "weight", target.alias("target"))


def _first_left_out(items: DataFrame, total: int) -> tuple[float, int, int] | None:
    """Finish, place and epoch of the first item after the longest start of at most `total` words.

    Sums over bins of virtual time find the bin in which the budget ends, sums over finer bins the
    part of it; only that part's items are put in order.
    """
    last = BINS * UNITS - 1
    coarse = F.least(F.floor(F.col("finish") * BINS), F.lit(last)).cast("long")
    fine = F.floor((F.col("finish") * BINS - coarse) * BINS).cast("long")

    def crossing(rows: DataFrame, bin_: Column, budget: int) -> tuple[int, int] | None:
        sums = rows.groupBy(bin_.alias("bin")).agg(F.sum("size").alias("words"))  # at most BINS * UNITS rows
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("bin")))
        row = upto.filter(F.col("upto") > budget).orderBy("bin").first()
        return None if row is None else (row["bin"], row["upto"] - row["words"])

    found = crossing(items, coarse, total)
    if found is None:
        return None
    at, before = found
    inside = items.filter(coarse == at)
    sub, more = crossing(inside, fine, total - before)
    order = [F.col("finish"), F.col("place"), F.col("epoch")]
    return tuple(
        inside.filter(fine == sub)
        .withColumn("upto", F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        .filter(F.col("upto") + before + more > total).orderBy(*order).select("finish", "place", "epoch").first())


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken, finish (of the first epoch) and mark (hash of the text) for
    each row."""
    sizes = stored(sized(docs, seed), "sizes")
    sources = stored(source_targets(sizes, weights, epochs), "mix")
    named = sources.select(F.col("source").alias("__source"), "place", "source_size", "before", "target")
    # One row a source; Spark broadcasts it if its stored size is small, and splits hot sources if not.
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    queue = stored(running_sums(rows, [F.col(c) for c in ("place", "key", "doc_id", "size", "mark")], {"upto": "size"}), "queue")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    finish = lambda e: (F.col("upto") - F.col("before") + F.col("source_size") * e) / F.col("target")
    live = F.col("size") > 0
    items = queue.filter(live).select("size", "place", F.posexplode(
        F.array(*[finish(e) for e in range(epochs)])).alias("epoch", "finish"))
    end = _first_left_out(items, total) if total else (float("-inf"), 0, 0)

    def served(e: int) -> Column:
        if end is None:
            return F.lit(1)
        here = F.struct(finish(e), F.col("place"), F.lit(e))
        return (here < F.struct(F.lit(end[0]), F.lit(end[1]).cast("long"), F.lit(end[2]))).cast("int")

    times = F.when(live, sum(served(e) for e in range(epochs))).otherwise(0)
    return queue.select("doc_id", "source", "size", "source_size", "target", times.cast("int").alias("times"),
                        (F.col("size") * times).cast("long").alias("taken"), F.when(live, finish(0)).alias("finish"), "mark")


def mixed(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """The mixed stream: whole rows, each as often as it is taken, sorted by virtual finish time.

    Rows are found again by id, source and a hash of the text. Rows alike in these have the same text and so the same
    weight in the mix, whichever gets which number; only they are numbered, all others meet their place in one join.
    """
    alike = ["id", "source", "mark"]
    plan = mix(docs, seed, weights, epochs).select(
        F.col("doc_id").alias("id"), "source", "mark", "times", "finish", (F.col("source_size") / F.col("target")).alias("lap"))
    plan = stored(plan, "plan")
    same = lambda left, right: [left[c].eqNullSafe(right[f"own_{c}"]) for c in alike]
    own = lambda df: df.withColumnsRenamed({c: f"own_{c}" for c in alike})
    several = stored(own(plan.groupBy(*alike).agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows")), "alike")
    # Hashes and ids; their number decides how they meet the rows.
    few = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    # The whole row as one column, so that no name of its columns can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    once = own(plan.filter("times > 0").join(few, same(plan, few), "left_anti"))
    single = rows.join(once, same(rows, once)).select("row", "id", "times", "finish", "lap")
    number = F.row_number().over(Window.partitionBy(*alike).orderBy("finish"))
    taken = plan.filter("times > 0")
    copies = own(taken.join(few, same(taken, few), "left_semi").withColumn("copy", number)).withColumnRenamed("copy", "own_copy")
    again = rows.join(few, same(rows, few), "left_semi").withColumn(
        "copy", F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0))))
    numbered = again.join(copies, [*same(again, copies), again["copy"] == copies["own_copy"]]).select(
        "row", "id", "times", "finish", "lap")
    laps = F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda e: F.col("finish") + e * F.col("lap"))
    return single.unionByName(numbered).withColumn("at", F.explode(laps)).orderBy("at", "id").select("row.*")
