"""The pipeline against the stages' own rules."""

import corpus_pipeline
import numpy as np
from chorale.llm import decontaminate, quality
from chorale.llm.common import stored


def test_stages_take_effect(spark, sf_dir):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    all_ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert set(kept[3]) <= set(kept[2]) <= set(kept[1]) <= set(kept[0]) < all_ids
    assert len(kept[2]) == len(set(kept[2])) < len(kept[1]) < len(kept[0])
    index = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r["slot"] for r in index) == list(range(len(index)))
    assert {d for r in index for d in r["doc_ids"]} == set(kept[3])
    # Against plain Python: no benchmark item is left, and every dropped document held one.
    raw = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = lambda d: any(i in decontaminate.normal(raw[d]) for i in items)
    assert not any(map(holds, kept[2])) and all(map(holds, set(kept[1]) - set(kept[2])))
    # Exact copies are gone.
    assert len({raw[d] for d in kept[1]}) == len(kept[1])
    assert np.mean([quality.votes(quality._raw(raw[d])).count(-1) > 1 for d in kept[0]]) < 0.02


def test_runs_whole(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, tied ids and clashing names: nothing crashes,
    columns stay, and each stage has the result its module states."""
    long = " ".join(f"word{k % 997} is here, and the rest of it as well." for k in range(4_000))
    plain = "The cat sat on the mat and looked at the door, for the dog had gone out. " * 3
    rows = [(1, None), (2, ""), (3, " \n "), (4, plain), (4, plain), (4, plain + "more"), (5, plain), (None, plain), (None, plain),
            (6, long), (7, "one")]
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", 1, 2, 3, "x") for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, row int, copy int, node string")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        kept.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()))
    nothing = [(False, 1), (False, 2), (False, 3)]
    assert set(nothing) <= set(kept[0])  # no vote, so they are kept
    # Of the texts without words one stays, of the equal ones one; rows without an id are never dropped as copies.
    assert kept[1].count((False, 1)) == 1 and not {(False, 2), (False, 3), (False, 5)} & set(kept[1])
    assert kept[1].count((False, 4)) == 1 and kept[1].count((True, 0)) == kept[0].count((True, 0))
    assert kept[2] == kept[1]  # none holds a benchmark item
    assert (False, 1) not in kept[3] and set(kept[3]) <= set(kept[2])  # a text without words is never taken
    index = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r["slot"] for r in index.select("slot").collect()) == list(range(index.count()))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
