"""The stages end to end, each from stored input to stored output."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.operators import assembly, cleaning, metrics, sampling, scoring, searching
from chorale.operators.prompts import labelled_only
from chorale.presets import LEGACY_SAMPLE_SIZE, SAMPLE_SEED
from chorale.registry import RELEVANCE, Feature
from chorale.schema import RAW_COMMENTS, RAW_POSTS
from chorale.sources import files, labels, merged, raw, reports

Ask = Callable[[DataFrame], DataFrame]


def collect(posts: DataFrame, comments: DataFrame, grid: searching.SearchGrid, k: int, folder: str,
            moment: datetime, window: str = "year") -> str:
    """Searches the corpus and stores what was found as one run; returns its id.

    The found posts are stored first and the comments chosen from the stored table, so the search
    runs once. `moment` is UTC unless it says otherwise.
    """
    spark = posts.sparkSession
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    run = raw.run_id(moment)
    bound = grid.size * k
    hits = searching.search_hits(posts, grid, k, as_of=moment, window=window)
    seen_path = f"{folder.rstrip('/')}_seen/{run}"
    searching.first_seen_posts(hits).select("post_id", "cell", "rank").write.mode("errorifexists").parquet(seen_path)
    seen = spark.read.parquet(seen_path)
    found = searching.with_search_lineage(posts, seen, moment.isoformat(), grid, bound)
    raw.write_run(found.select(*RAW_POSTS.fieldNames()), folder, "posts", run)
    kept = searching.first_seen_comments(comments, seen, bound)
    raw.write_run(kept.select(*RAW_COMMENTS.fieldNames()), folder, "comments", run)
    return run


def process(spark: SparkSession, raw_folder: str, out: str, keep: str = "last") -> DataFrame:
    """All runs to the processed table."""
    table = cleaning.process(
        raw.read_runs(spark, raw_folder, "comments"), raw.read_runs(spark, raw_folder, "posts"), keep,
        post_ties=("extraction_query", "extraction_sort"))
    files.write_table(table.drop("extraction_id"), out)
    return files.read_table(spark, out)


def merge_run(spark: SparkSession, raw_folder: str, kind: str, extraction_id: str, out: str, keep: str = "last") -> list[int]:
    """One more run into the merged table of posts or comments; returns the buckets it has rewritten."""
    ties = ("extraction_query", "extraction_sort") if kind == "posts" else ()
    new = raw.read_runs(spark, raw_folder, kind, extraction_id)
    return merged.merge_increment(new, out, extraction_id, f"{kind.removesuffix('s')}_id", keep, ties)


def draw_samples(spark: SparkSession, table: str, train_sheet: str, val_sheet: str, features: Sequence[str],
                 n: int, seed: int, val_ratio: float, train_ids: Sequence[str] = (),
                 val_ids: Sequence[str] = ()) -> bool:
    """Train and validation sheets for labelling. Existing sheets are never touched.

    Listed ids that the table does not hold are named in a warning.
    """
    if labels.sheets_exist(spark, train_sheet, val_sheet):
        return False
    rows = files.read_table(spark, table)
    listed = [*train_ids, *val_ids]
    # At most as many ids as the caller listed.
    absent = [r[0] for r in sampling.missing_ids(rows, listed).toLocalIterator()] if listed else []
    if absent:
        warnings.warn(f"ids not found in {table}: {', '.join(sorted(absent))}", stacklevel=2)
    split = sampling.label_split(rows, n, seed, val_ratio, train_ids, val_ids)
    for name, path in (("train", train_sheet), ("val", val_sheet)):
        if not files.path_exists(spark, path):
            labels.write_sheet(split.filter(F.col("split") == name), path, features)
    return True


def validate(val: DataFrame, features: Sequence[Feature], ask: Ask, store: str, report_path: str,
             run: str, train: DataFrame | None = None) -> DataFrame:
    """Scores the labelled validation rows anew for this run, compares, and appends the report.

    Every run has a store of its own below `store`, so a new scorer is never judged by old answers; the
    same run started again asks only for what it lacks. `train`: the few-shot rows, counted in the report.
    """
    spark = val.sparkSession
    store = f"{store.rstrip('/')}/run={run}"
    scoring.score_into_store(val, store, features, ask)
    answers = scoring.read_store(spark, store)
    guesses = {f.name: scoring.feature_table(answers, f, retried=True) for f in features}
    report = metrics.report(metrics.compare(val, guesses, features), features, train)
    reports.append_report(report, report_path, run)
    return reports.read_reports(spark, report_path).filter(F.col("run") == run)


def generate(df: DataFrame, features: Sequence[Feature], ask: Ask, store: str, pilot: tuple[int, int] | None = None,
             labelled: DataFrame | None = None, retry_errors: bool = False, commits: int = 1,
             unique: bool = True, save_every: int | None = None) -> None:
    """Scores what the store still lacks. `pilot` is (size, seed); each pilot run advances by its size.

    `labelled`: rows people labelled, left out of scoring for the features they have a label for. Features share the scan of a full run; in a
    pilot every feature has a queue of its own. `unique`: ids of `df` are unique, as in a processed table.
    `commits` or `save_every` (rows): stores a long run in shares, see `scoring.score_into_store`.
    """
    skip = None if labelled is None else scoring.labelled_pairs(labelled, features)
    if pilot is None:
        scoring.score_into_store(df, store, features, ask, retry_errors, commits, unique, skip, save_every)
        return
    size, seed = pilot
    for feature in features:
        own = None if skip is None else skip.filter(F.col("feature") == feature.name)
        queue = scoring.open_queue(df, store, [feature], retry_errors, unique, own)
        queue = sampling.pilot_cut(queue, size, seed).withColumn("wanted", F.array(F.lit(feature.name)))
        scoring.append_answers(ask(queue), store, [feature])


def score_directly(df: DataFrame, feature: Feature, ask: Ask, size: int = LEGACY_SAMPLE_SIZE,
                   seed: int = SAMPLE_SEED) -> DataFrame:
    """The older way: a seeded sample scored on the spot, nothing stored, and an error if any answer can't be read.

    The answers are asked for once to check them and once more for each use of the result; for a paid scorer use
    `generate` with a pilot.
    """
    queue = sampling.seeded_sample(scoring.unique_texts(df), size, seed)
    answers = ask(queue).withColumn("scored_at", F.lit(None).cast("timestamp"))
    return scoring.require_answers(scoring.feature_table(answers, feature))


def publish_feature(spark: SparkSession, store: str, feature: Feature, folder: str, retried: bool = True,
                    labelled: DataFrame | None = None, once: bool = False) -> bool:
    """The typed feature table of the store, one row per id, with human labels in place of predictions where given.

    `retried=False` saves a shuffle; only right for a store that never asked an id twice. `once` leaves a feature that is
    published already as it is. Says whether it wrote.
    """
    path = f"{folder.rstrip('/')}/{feature.name}.parquet"
    if once and files.path_exists(spark, path):
        return False
    table = scoring.feature_table(scoring.read_store(spark, store), feature, retried)
    if labelled is not None:
        table = scoring.labels_and_predictions(table, labelled_only(labelled, feature), feature)
    files.write_table(table, path)
    return True


def filter_relevant(spark: SparkSession, table: str, scores: str, out: str, cutoff: int = RELEVANCE.cutoff) -> int:
    """Stores the relevant comments and returns how many there are."""
    kept = assembly.relevant_only(files.read_table(spark, table), files.read_table(spark, scores), cutoff)
    files.write_table(kept, out, inputs=(table, scores))
    return files.read_table(spark, out).count()


def join_all_features(spark: SparkSession, table: str, folder: str, out: str) -> DataFrame:
    """The wide table: every feature of the folder that the base does not have yet."""
    tables = {n: t for n, t in files.feature_folders(spark, folder).items() if n in t.columns}
    files.write_table(assembly.join_features(files.read_table(spark, table), tables), out, inputs=(table,))
    return files.read_table(spark, out)
