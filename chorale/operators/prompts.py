"""Few-shot lists and the full prompt of each row, as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.responses import cast_label
from chorale.registry import CATEGORICAL, Feature


def labelled_only(df: DataFrame, feature: Feature) -> DataFrame:
    """Rows with a usable label for the feature, cast to its type."""
    return df.withColumn(feature.name, cast_label(F.col(feature.name).cast("string"), feature)).filter(
        F.col(feature.name).isNotNull())


def example_list(train: DataFrame, feature: Feature) -> DataFrame:
    """One row, one column `examples`: JSON array of `{text_content, <feature>}` in id order.

    Empty train data give `[]`. Train samples are of fixed size (see `label_split`).
    """
    shot = F.struct("comment_id", "text_content", feature.name)
    ordered = F.array_sort(F.collect_list(shot))
    shown = F.transform(ordered, lambda s: F.struct(s["text_content"].alias("text_content"),
                                                    s[feature.name].alias(feature.name)))
    return labelled_only(train, feature).agg(F.to_json(shown, {"ignoreNullFields": "false"}).alias("examples"))


def few_shot_text(train: DataFrame, feature: Feature, max_examples: int | None = None) -> str:
    """The example list as driver text, since a prompt is one text.

    `max_examples`: refuse a train set larger than the model's context can hold; None takes any.
    """
    rows = labelled_only(train, feature)
    if max_examples is not None and len(rows.select("comment_id").take(max_examples + 1)) > max_examples:
        raise ValueError(f"more than {max_examples} examples; draw a smaller train sample")
    return example_list(rows, feature).first()["examples"]


def rubric_text(feature: Feature, topic: str, poles: tuple[str, str] | None = None) -> str:
    """`poles`: what the low and the high end of a scale between two sides stand for."""
    if feature.between_poles and poles is None:
        raise ValueError(f"{feature.name} needs the names of its two poles")
    lines = [f"You assess comments in a study of public opinion on {topic}.", feature.task, ""]
    lines += [f"{value}: {meaning}" for value, meaning in feature.levels]
    example = f'"{feature.labels[0]}"' if feature.kind == CATEGORICAL else feature.levels[1][0]
    lines += ["", f'Answer with one JSON object such as {{"{feature.name}": {example}}}.']
    text = "\n".join(lines)
    return text.replace("{first}", poles[0]).replace("{second}", poles[1]) if feature.between_poles else text


def prompt_parts(feature: Feature, topic: str, examples: str,
                 poles: tuple[str, str] | None = None) -> tuple[str, str]:
    """Everything before the text, and everything after it."""
    head = f"{rubric_text(feature, topic, poles)}\n\nExamples labelled by experts:\n{examples}\n\nText:\n"
    return head, "\n"


def prompt_column(text: Column, feature: Feature, topic: str, examples: str,
                  poles: tuple[str, str] | None = None) -> Column:
    head, tail = prompt_parts(feature, topic, examples, poles)
    return F.concat(F.lit(head), text, F.lit(tail))


def prompt_factory(connect: Callable[[], Callable[[str], str]], features: Sequence[Feature], topic: str,
                   examples: Mapping[str, str], poles: tuple[str, str] | None = None) -> Callable[[], Callable[[str, str], str]]:
    """A client factory for `call_client` around a model that maps a prompt to its answer.

    `connect` is called once per task and opens the model; `examples` holds each feature's few-shot
    text, `[]` for none.
    """
    parts = {f.name: prompt_parts(f, topic, examples[f.name], poles) for f in features}

    def factory() -> Callable[[str, str], str]:
        model = connect()

        def client(feature: str, text: str) -> str:
            head, tail = parts[feature]
            return model(head + text + tail)

        return client

    return factory
