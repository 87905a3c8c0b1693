"""Scoring comments with a user-supplied scorer: queue, call, parse, store, resume.

A scorer is either a Column function `text -> JSON answer` (stays in generated code), or a
`ClientFactory` that runs in Python workers. Answers are stored raw, one row per comment and
feature, in an append-only folder partitioned by feature and by bucket of the id; typed values are
read from there. A paid-for answer is therefore never rewritten and never asked for twice, and who looks for the answers
of some ids opens only their buckets.

A long run is committed share by share: its queue is stored once, a share is a set of buckets, and a run that is started
again after it died reads the shares that are still open.

Run scoring jobs without speculative execution: a speculative twin would pay again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.responses import cast_label, parse_response, with_value
from chorale.operators.ranking import one_per_key
from chorale.operators.sampling import ID, without_ids
from chorale.registry import Feature
from chorale.schema import RESPONSES
from chorale.sources.files import delete, list_names, path_exists

# Buckets of a new store: few enough that an append has few small files, and more for stores of many billion ids.
STORE_BUCKETS = 16
ColumnScorer = Callable[[Column], Column]
# text -> array of (feature, response)
ColumnAnswers = Callable[[Column], Column]
# Called once per task; the returned function answers one (feature name, text) at a time.
ClientFactory = Callable[[], Callable[[str, str], str | None]]


def call_client(queue: DataFrame, features: Sequence[Feature], factory: ClientFactory, tasks: int | None = None,
                in_flight: int = 8) -> DataFrame:
    """Answers of a Python client: comment_id, feature, response.

    `queue` has comment_id, text_content and optionally `wanted`, the feature names still open for
    the row. One scan feeds all features; each task holds one client and keeps `in_flight` calls
    open. Only the needed columns reach Python. A fixed number of tasks is not merged by AQE.
    A failed call is a missing answer, not a failed job; `error` tells what the client raised.
    """
    names = [f.name for f in features]
    wanted = F.col("wanted") if "wanted" in queue.columns else F.array(*[F.lit(n) for n in names])
    rows = queue.select(ID, F.col("text_content"), wanted.alias("wanted"))
    if tasks:
        rows = rows.repartition(tasks, ID)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()

        def ask(call: tuple[str, str, str]) -> tuple[str | None, str | None]:
            try:
                return client(call[1], call[2]), None
            except Exception as failure:  # noqa: BLE001 - any client error means no answer
                return None, f"{type(failure).__name__}: {failure}"

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                calls = [(key, name, text) for key, text, todo in batch.itertuples(index=False) for name in todo]
                answers = list(pool.map(ask, calls))
                yield pd.DataFrame({
                    ID: [c[0] for c in calls], "feature": [c[1] for c in calls],
                    "response": pd.Series([a for a, _ in answers], dtype="object"),
                    "error": pd.Series([e for _, e in answers], dtype="object"),
                })

    return rows.mapInPandas(run, f"{ID} string, feature string, response string, error string")


def each(scorers: Mapping[str, ColumnScorer]) -> ColumnAnswers:
    """One Column scorer per feature, as a function giving all answers of a text."""
    return lambda text: F.array(*[
        F.struct(F.lit(name).alias("feature"), score(text).alias("response")) for name, score in scorers.items()])


def call_columns(queue: DataFrame, answers: ColumnAnswers) -> DataFrame:
    """Answers computed by Spark expressions, in the same shape as `call_client`."""
    has_wanted = "wanted" in queue.columns
    kept = queue.select(ID, "text_content", *(["wanted"] if has_wanted else []))
    out = kept.withColumn("a", F.explode(answers(F.col("text_content")))).drop("text_content")
    if has_wanted:
        out = out.filter(F.array_contains("wanted", F.col("a.feature")))
    return out.select(ID, "a.feature", "a.response")


def store_buckets(spark: SparkSession, path: str, default: int = STORE_BUCKETS) -> int:
    """How many buckets a store has: what its first answers were stored with."""
    if not path_exists(spark, path):
        return default
    for feature in list_names(spark, path):
        for name in list_names(spark, f"{path}/{feature}"):
            if name.startswith("bucket="):
                return int(name.removeprefix("bucket=").split(".")[0])
    return default


def bucket_of(buckets: int) -> Column:
    """An id's bucket, named after the number of buckets and its own: `64.7`."""
    return F.concat_ws(".", F.lit(buckets), F.pmod(F.xxhash64(ID), F.lit(buckets)))


def read_store(spark: SparkSession, path: str, buckets: Sequence[str] | None = None) -> DataFrame:
    """All stored answers, newest attempts included, or those of some buckets; an absent store is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RESPONSES)
    rows = spark.read.schema(f"{RESPONSES.toDDL()}, bucket string").parquet(path)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(*buckets))
    return rows.select(*RESPONSES.fieldNames())


def answered(store: DataFrame, features: Sequence[Feature], retry_errors: bool = False) -> DataFrame:
    """(comment_id, feature) pairs that need no further call."""
    done = store.filter(F.col("feature").isin(*[f.name for f in features]))
    if retry_errors:
        good = F.lit(False)
        for f in features:
            good = good | ((F.col("feature") == f.name) & parse_response(F.col("response"), f).isNotNull())
        done = done.filter(good)
    return done.select(ID, "feature")


def resume_queue(df: DataFrame, done: DataFrame, features: Sequence[Feature] | None = None) -> DataFrame:
    """Rows with something left to score; null ids are never scored.

    For one feature this is an anti-join on ids. For several, `wanted` lists what each row still lacks.
    """
    if features is None or len(features) == 1:
        return without_ids(df, done)
    per_id = done.groupBy(ID).agg(F.collect_set("feature").alias("__done"))  # at most one entry per feature
    names = F.array(*[F.lit(f.name) for f in features])
    left = df.filter(F.col(ID).isNotNull()).join(per_id, ID, "left")
    return (
        left.withColumn("wanted", F.array_except(names, F.coalesce("__done", F.array().cast("array<string>"))))
        .filter(F.size("wanted") > 0).drop("__done")
    )


def unique_texts(df: DataFrame, unique: bool = False) -> DataFrame:
    """Id and text, one row per id, so a comment delivered twice is paid for once.

    `unique` says that the ids are unique already, as in a processed table; nothing is done then.
    """
    texts = df.select(ID, "text_content")
    return texts if unique else one_per_key(texts, [ID], [F.asc("text_content")])


def append_answers(answers: DataFrame, path: str, features: Sequence[Feature]) -> None:
    """Adds the features' answers to the store; nothing is read back or rewritten.

    Rows are brought together by feature and bucket first, so that an append adds a file or few to each folder.
    """
    error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string").alias("error")
    buckets = store_buckets(answers.sparkSession, path)
    (answers.filter(F.col("feature").isin(*[f.name for f in features]))
     .withColumn("scored_at", F.current_timestamp())
     .select("comment_id", "response", error, "scored_at", "feature", bucket_of(buckets).alias("bucket"))
     .hint("rebalance", "feature", "bucket")
     .write.mode("append").partitionBy("feature", "bucket").parquet(path))


def open_queue(df: DataFrame, store_path: str, features: Sequence[Feature], retry_errors: bool = False,
               unique: bool = False, skip: DataFrame | None = None) -> DataFrame:
    """The rows of `df` that the store has no answer for; opens only the buckets their ids belong to.

    The ids are read once to name the buckets, at most as many as the store has. `skip`: further (comment_id, feature)
    pairs that need no answer.
    """
    spark = df.sparkSession
    number = store_buckets(spark, store_path)
    wanted = None
    if path_exists(spark, store_path):
        wanted = [r[0] for r in df.filter(F.col(ID).isNotNull()).select(bucket_of(number)).distinct().collect()]
    done = answered(read_store(spark, store_path, wanted), features, retry_errors)
    if skip is not None:
        done = done.unionByName(skip)
    return resume_queue(unique_texts(df, unique), done, features)


def score_into_store(df: DataFrame, store_path: str, features: Sequence[Feature],
                     ask: Callable[[DataFrame], DataFrame], retry_errors: bool = False, commits: int = 1,
                     unique: bool = False, skip: DataFrame | None = None, save_every: int | None = None) -> None:
    """Asks for what the store lacks and appends the answers. Run twice, the second run asks nothing.

    With several `commits`, or one for each `save_every` rows, the open queue is stored once, in shares of whole buckets;
    each share is asked for and stored before the next. A run that dies loses one share of paid answers at most; started
    again it reads the open shares of the queue it left, without another scan of `df`, and only then looks for rows
    that came since.
    """
    if commits <= 1 and not save_every:
        append_answers(ask(open_queue(df, store_path, features, retry_errors, unique, skip)), store_path, features)
        return
    path = f"{store_path.rstrip('/')}_queue/{'-'.join(f.name for f in features)}"
    left = finish_queue(df.sparkSession, path, store_path, features, ask, retry_errors)
    queue = open_queue(df, store_path, features, retry_errors, unique, skip)
    if not left or not queue.isEmpty():
        _store_queue(queue, path, store_path, commits, save_every)
        finish_queue(df.sparkSession, path, store_path, features, ask, retry_errors)


def _store_queue(queue: DataFrame, path: str, store_path: str, commits: int, save_every: int | None) -> None:
    """The queue in shares, a share being the buckets that leave the same remainder."""
    spark = queue.sparkSession
    delete(spark, path)
    number = store_buckets(spark, store_path)
    if "wanted" not in queue.columns:
        queue = queue.withColumn("wanted", F.lit(None).cast("array<string>"))
    rows = queue.withColumn("bucket", F.pmod(F.xxhash64(ID), F.lit(number)))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    if save_every:
        commits = -(-spark.read.parquet(f"{path}/rows").count() // save_every)
    # A share has a bucket at least.
    spark.range(1).select(F.lit(max(1, min(commits, number))).alias("shares"), F.lit(number).alias("buckets")).coalesce(1).write.json(f"{path}/plan")


def finish_queue(spark: SparkSession, path: str, store_path: str, features: Sequence[Feature],
                 ask: Callable[[DataFrame], DataFrame], retry_errors: bool = False) -> int:
    """Works off the open shares of a stored queue; returns how many there were.

    A share counts as done once its mark stands. One whose answers were stored but not marked is held against the
    buckets it covers, so its answers are not paid for again.
    """
    if not path_exists(spark, f"{path}/plan/_SUCCESS"):
        return 0
    plan, left = spark.read.json(f"{path}/plan").first(), 0
    shares, number = plan["shares"], plan["buckets"]
    rows = spark.read.parquet(f"{path}/rows")
    several = len(features) > 1
    for share in range(shares):
        mark = f"{path}/done/{share}"
        if path_exists(spark, mark):
            continue
        left += 1
        own = [b for b in range(number) if b % shares == share]
        part = rows.filter(F.col("bucket").isin(*own))
        if not retry_errors:
            stored = read_store(spark, store_path, [f"{number}.{b}" for b in own])
            part = resume_queue(part.drop("wanted"), answered(stored, features), features) if not several else _still_open(
                part, answered(stored, features))
        append_answers(ask(part.drop("bucket") if several else part.drop("bucket", "wanted")), store_path, features)
        spark.range(0).write.parquet(mark)
    delete(spark, path)
    return left


def _still_open(part: DataFrame, done: DataFrame) -> DataFrame:
    """Queue rows less the features that are answered meanwhile."""
    per_id = done.groupBy(ID).agg(F.collect_set("feature").alias("__done"))
    return (part.join(per_id, ID, "left")
            .withColumn("wanted", F.array_except("wanted", F.coalesce("__done", F.array().cast("array<string>"))))
            .filter(F.size("wanted") > 0).drop("__done"))


def labelled_pairs(labelled: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """(comment_id, feature) for every usable label: a row labelled for one feature still lacks the others."""
    named = [F.when(cast_label(F.col(f.name).cast("string"), f).isNotNull(), f.name)
             for f in features if f.name in labelled.columns]
    names = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    return labelled.filter(F.col(ID).isNotNull()).select(ID, F.explode(names).alias("feature"))


def feature_table(store: DataFrame, feature: Feature, retried: bool = False) -> DataFrame:
    """comment_id, the typed feature column, is_error, out_of_domain, raw_response.

    `retried`: the store may hold several attempts per id; a readable answer beats an error, then the
    newest wins. Without retries ids are unique already and no shuffle is spent on it.
    """
    rows = store.filter(F.col("feature") == feature.name).drop("feature")
    rows = with_value(rows, feature)
    if retried:
        rows = one_per_key(rows, [ID], [F.asc("is_error"), F.desc("scored_at"), F.asc("response")])
    return rows.select(ID, feature.name, "is_error", "out_of_domain", F.col("response").alias("raw_response"))


def require_answers(table: DataFrame) -> DataFrame:
    """The feature table itself, or an error when any answer could not be read. Costs one count."""
    failed = table.filter("is_error").count()
    if failed:
        raise ValueError(f"{failed} comments have no readable answer")
    return table


def labels_and_predictions(predicted: DataFrame, labels: DataFrame, feature: Feature) -> DataFrame:
    """Feature table of human labels plus predictions for all other comments, with `origin`.

    A comment labelled twice keeps its smaller label, so that ids stay unique.
    """
    human = labels.filter(F.col(feature.name).isNotNull()).select(ID, feature.name)
    human = one_per_key(human, [ID], [F.asc(feature.name)]).withColumn("origin", F.lit("human"))
    rest = without_ids(predicted.select(ID, feature.name), human).withColumn("origin", F.lit("predicted"))
    return human.unionByName(rest)


def embed(df: DataFrame, factory: Callable[[], Callable[[list[str]], list]], tasks: int | None = None) -> DataFrame:
    """comment_id and `embedding` from a user's batch embedder, one instance per task."""
    rows = df.select(ID, "text_content")
    if tasks:
        rows = rows.repartition(tasks, ID)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            yield pd.DataFrame({ID: batch[ID], "embedding": list(encode(batch["text_content"].tolist()))})

    return rows.mapInPandas(run, f"{ID} string, embedding array<float>")


VECTORS = "comment_id string, embedding array<float>, norm double, fault string, embedded_at timestamp, bucket string"


def vector_fault(vector: Column, dimensions: int) -> Column:
    """Why a vector can't be used, or null: missing, of another length, with a null, NaN or infinite component, or zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.when(vector.isNull(), "missing").when(F.size(vector) != dimensions, "dimensions")
            .when(odd, "not finite").when(F.forall(vector, lambda x: x == 0), "zero"))


def read_vectors(spark: SparkSession, path: str, buckets: Sequence[str] | None = None) -> DataFrame:
    """Stored vectors, faulty ones included (with a null embedding); an absent store is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], VECTORS).drop("bucket")
    rows = spark.read.schema(VECTORS).parquet(path)
    return (rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))).drop("bucket")


def embed_into_store(df: DataFrame, path: str, factory: Callable[[], Callable[[list[str]], list]], dimensions: int,
                     tasks: int | None = None, retry_faults: bool = False, unique: bool = False) -> int:
    """Embeds what the store lacks and appends it, checked; returns how many of the new vectors are faulty.

    A faulty vector is stored as null with its fault, so it is neither used nor paid for again unless `retry_faults`.
    """
    spark = df.sparkSession
    names = list_names(spark, path) if path_exists(spark, path) else []
    held = [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]
    number = int(held[0].split(".")[0]) if held else STORE_BUCKETS
    # At most as many names as the store has buckets.
    wanted = [r[0] for r in df.filter(F.col(ID).isNotNull()).select(bucket_of(number)).distinct().collect()]
    faults = lambda: read_vectors(spark, path, wanted).filter("fault is not null").count()
    done, before = read_vectors(spark, path, wanted), faults()
    done = done.filter("fault is null") if retry_faults else done
    queue = without_ids(unique_texts(df, unique), done)
    vector = F.col("embedding")
    # Before the write, so that the embedder runs once.
    fault = vector_fault(vector, dimensions)
    rows = embed(queue, factory, tasks).withColumn("fault", fault).withColumns({
        "norm": F.when(F.col("fault").isNull(), F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))),
        "embedding": F.when(F.col("fault").isNull(), vector),
        "embedded_at": F.current_timestamp(), "bucket": bucket_of(number)})
    (rows.select(ID, "embedding", "norm", "fault", "embedded_at", "bucket").hint("rebalance", "bucket")
     .write.mode("append").partitionBy("bucket").parquet(path))
    return faults() - before


def vector_table(store: DataFrame) -> DataFrame:
    """comment_id and embedding of every id with a usable vector, the newest where there are several."""
    good = store.filter("fault is null")
    return one_per_key(good, [ID], [F.desc("embedded_at")]).select(ID, "embedding")
