"""The stages from the command line, for spark-submit or `python -m chorale`.

    collect   POSTS COMMENTS RAW               one search run over a stored corpus
    process   RAW OUT                          runs to the processed table
    merge     RAW KIND RUN OUT                 one more run into the merged table of posts or comments
    sample    TABLE TRAIN VAL                  label sheets
    validate  TRAIN VAL ANSWERS REPORTS        scores the validation sheet and reports
    generate  TABLE TRAIN ANSWERS              scores what the answer store lacks
    publish   ANSWERS FEATURES                 typed feature tables
    filter    TABLE SCORES OUT                 relevant comments
    join      TABLE FEATURES OUT               the wide table

validate and generate call a model: `--model package.module:connect`, where connect() is run once per
task and returns a function from prompt to answer. The module must be importable in the workers.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from chorale import presets
from chorale.operators import explore, metrics, scoring
from chorale.operators.prompts import few_shot_text, prompt_factory
from chorale.operators.searching import SORTS, SearchGrid
from chorale.plans import stages
from chorale.registry import FIRST_PASS, SECOND_PASS, Feature, select_features
from chorale.sources import files, labels, reports

_PATHS = {
    "collect": "posts comments raw",
    "process": "raw out", "merge": "raw kind run out", "sample": "table train val", "validate": "train val answers reports",
    "generate": "table train answers", "publish": "answers features", "filter": "table scores out",
    "join": "table features out",
}


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="chorale", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    stage = parser.add_subparsers(dest="stage", required=True)
    parsers = {}
    for name, paths in _PATHS.items():
        parsers[name] = stage.add_parser(name)
        for path in paths.split():
            parsers[name].add_argument(path)
    for name in ("sample", "validate", "generate", "publish"):
        parsers[name].add_argument("--feature", nargs="+", dest="names", default=list(FIRST_PASS))
        parsers[name].add_argument("--second-pass", action="store_const", dest="names", const=list(SECOND_PASS),
                                   help="the features of the relevant comments")
    parsers["collect"].add_argument("--limit", type=int, default=presets.SEARCH_LIMIT)
    parsers["collect"].add_argument("--window", default=presets.TIME_WINDOW)
    parsers["collect"].add_argument("--active", action="store_true", help="only the active communities and queries")
    parsers["process"].add_argument("--keep", choices=("first", "last"), default="last")
    parsers["sample"].add_argument("--rows", type=int, default=presets.SAMPLE_SIZE)
    parsers["sample"].add_argument("--seed", type=int, default=presets.SAMPLE_SEED)
    parsers["sample"].add_argument("--ratio", type=float, default=presets.VALIDATION_RATIO)
    parsers["sample"].add_argument("--train-ids", nargs="*", default=[])
    parsers["sample"].add_argument("--val-ids", nargs="*", default=[])
    for name in ("validate", "generate"):
        parsers[name].add_argument("--model", required=True)
        parsers[name].add_argument("--topic", required=True)
        parsers[name].add_argument("--poles", nargs=2, metavar=("LOW", "HIGH"), default=presets.STANCE_POLES)
        parsers[name].add_argument("--tasks", type=int)
        parsers[name].add_argument("--in-flight", type=int, default=8)
    parsers["validate"].add_argument("--run", required=True)
    parsers["generate"].add_argument("--pilot", type=int, nargs="?", const=presets.PILOT_SIZE,
                                     help="score a seeded sample of this size")
    parsers["generate"].add_argument("--pilot-seed", type=int, default=presets.PILOT_SEED)
    parsers["generate"].add_argument("--commits", type=int, default=1, help="store a run in so many shares")
    parsers["generate"].add_argument("--save-every", type=int, nargs="?", const=presets.SAVE_EVERY, metavar="ROWS",
                                     help="store a share after so many rows; a run that died goes on from its last share")
    parsers["generate"].add_argument("--retry-errors", action="store_true")
    parsers["generate"].add_argument("--passed-in", metavar="RUN", help="only features that passed this validation run")
    parsers["generate"].add_argument("--reports", help="folder of the validation reports, with --passed-in")
    parsers["publish"].add_argument("--skip-existing", action="store_true", help="leave published features as they are")
    for name in ("generate", "publish"):
        parsers[name].add_argument("--labelled", nargs="+", default=[], metavar="SHEET",
                                   help="label sheets whose labels stand instead of predictions")
    return parser


def _ask(args: argparse.Namespace, features: Sequence[Feature], train: DataFrame) -> Callable[[DataFrame], DataFrame]:
    module, _, attribute = args.model.partition(":")
    connect = getattr(importlib.import_module(module), attribute)
    examples = {f.name: few_shot_text(train, f) for f in features}
    factory = prompt_factory(connect, features, args.topic, examples, tuple(args.poles))
    return lambda queue: scoring.call_client(queue, features, factory, args.tasks, args.in_flight)


def _labelled(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    sheets = [labels.read_sheet(spark, path, args.names) for path in args.labelled]
    return reduce(DataFrame.unionByName, sheets) if sheets else None


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"chorale {args.stage}").getOrCreate()
    features = select_features(getattr(args, "names", []))
    if args.stage == "collect":
        communities, queries, sorts = (
            (presets.ACTIVE_COMMUNITIES, presets.ACTIVE_QUERIES, presets.ACTIVE_SORTS) if args.active
            else (presets.COMMUNITIES, presets.QUERIES, SORTS))
        run = stages.collect(files.read_table(spark, args.posts), files.read_table(spark, args.comments),
                             SearchGrid(communities, queries, sorts), args.limit, args.raw,
                             datetime.now(timezone.utc), args.window)
        print("run", run)
    elif args.stage == "process":
        stages.process(spark, args.raw, args.out, args.keep)
    elif args.stage == "merge":
        print("buckets rewritten:", len(stages.merge_run(spark, args.raw, args.kind, args.run, args.out)))
    elif args.stage == "sample":
        wrote = stages.draw_samples(spark, args.table, args.train, args.val, args.names, args.rows, args.seed,
                                    args.ratio, args.train_ids, args.val_ids)
        print("sheets written" if wrote else "both sheets exist; nothing done")
    elif args.stage == "validate":
        train, val = (labels.read_sheet(spark, p, args.names) for p in (args.train, args.val))
        stages.validate(val, features, _ask(args, features, train), args.answers, args.reports, args.run,
                        train).show(truncate=False)
    elif args.stage == "generate":
        train = labels.read_sheet(spark, args.train, args.names)
        if args.passed_in:
            run = explore.lookup(reports.read_reports(spark, args.reports), run=args.passed_in)
            features = metrics.passed_features(run, features)
        pilot = (args.pilot, args.pilot_seed) if args.pilot else None
        if features:
            stages.generate(files.read_table(spark, args.table), features, _ask(args, features, train), args.answers,
                            pilot, _labelled(spark, args), retry_errors=args.retry_errors, commits=args.commits, save_every=args.save_every)
    elif args.stage == "publish":
        for feature in features:
            wrote = stages.publish_feature(spark, args.answers, feature, args.features, labelled=_labelled(spark, args),
                                           once=args.skip_existing)
            print(feature.name, "published" if wrote else "is there already; nothing done")
    elif args.stage == "filter":
        print("relevant comments:", stages.filter_relevant(spark, args.table, args.scores, args.out))
    else:
        stages.join_all_features(spark, args.table, args.features, args.out)


if __name__ == "__main__":
    main()
