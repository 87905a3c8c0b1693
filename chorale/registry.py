"""The six features as data: kind, domain, thresholds and the rubric shown to a scorer."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

ORDINAL, CONTINUOUS, CATEGORICAL = "ordinal", "continuous", "categorical"

# Spark type of the stored value, and the value stored when a response cannot be read.
SPARK_TYPE = {ORDINAL: "int", CONTINUOUS: "double", CATEGORICAL: "string"}
SENTINEL = {ORDINAL: -1, CONTINUOUS: 0.0, CATEGORICAL: "ERROR"}


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    threshold: float
    low: float | None = None
    high: float | None = None
    labels: tuple[str, ...] = ()
    cutoff: int | None = None
    task: str = ""
    levels: tuple[tuple[str, str], ...] = field(default=(), repr=False)

    @property
    def spark_type(self) -> str:
        return SPARK_TYPE[self.kind]

    @property
    def sentinel(self) -> int | float | str:
        return SENTINEL[self.kind]

    @property
    def between_poles(self) -> bool:
        """The rubric names the two ends of the scale, {first} and {second}, which the study supplies."""
        return "{first}" in self.task


# Feature names, scales, category names, cutoff and validation thresholds.
RELEVANCE = Feature(
    "content_relevance_score", ORDINAL, 0.8, low=0, high=5, cutoff=3,
    task="Rate how closely the comment is about the studied topic, whatever its tone or length. "
         "The post is background only.",
    levels=(
        ("0", "nothing to do with it, or spam"),
        ("1", "noise inside a thread, such as insults between users"),
        ("2", "a keyword used in passing or in another sense"),
        ("3", "the wider setting, with no direct link"),
        ("4", "clearly about it, though brief"),
        ("5", "names it, its actors or its events"),
    ),
)
STANCE = Feature(
    "political_stance", ORDINAL, 0.9, low=1, high=5,
    task="Place the comment between {first} and {second}. Judge the position, not the temper.",
    levels=(
        ("1", "strongly {first}"),
        ("2", "leans {first}"),
        ("3", "balanced or purely factual"),
        ("4", "leans {second}"),
        ("5", "strongly {second}"),
    ),
)
QUALITY = Feature(
    "argument_quality_score", ORDINAL, 0.9, low=0, high=5,
    task="Rate how well the comment argues, whatever it argues for.",
    levels=(
        ("0", "unreadable or automated"),
        ("1", "a bare reaction or slogan"),
        ("2", "an opinion with hardly a reason"),
        ("3", "an opinion with one sound reason"),
        ("4", "evidence tied to claims, some nuance"),
        ("5", "sources, counter-arguments and synthesis"),
    ),
)
SENTIMENT = Feature(
    "sentiment_score", CONTINUOUS, 0.25, low=-1.0, high=1.0,
    task="Rate the emotional valence of the wording alone; agreement with a side does not count.",
    levels=(
        ("-1.0", "hatred or despair"),
        ("-0.5", "criticism, frustration, irony"),
        ("0.0", "no emotion"),
        ("0.5", "sympathy, hope, mild praise"),
        ("1.0", "celebration or gratitude"),
    ),
)
TONE = Feature(
    "discourse_tone", CATEGORICAL, 0.8,
    labels=("Analytical", "Emotional", "Hostile", "Sarcastic", "Informative", "Other"),
    task="Name the tone that dominates the comment.",
    levels=(
        ("Analytical", "reasons from facts"),
        ("Emotional", "grief, fear or compassion"),
        ("Hostile", "attacks people or groups"),
        ("Sarcastic", "mocks by saying the opposite"),
        ("Informative", "passes on news or links"),
        ("Other", "none of these"),
    ),
)
FRAME = Feature(
    "dominant_frame", CATEGORICAL, 0.8,
    labels=("Humanitarian/Legal", "Security/Military", "Geopolitical/Political",
            "Media/Narrative", "Historical/Religious", "Other"),
    task="Name the lens through which the comment sees the topic.",
    levels=(
        ("Humanitarian/Legal", "rights, law, civilian harm, aid"),
        ("Security/Military", "armed forces, attacks, defence"),
        ("Geopolitical/Political", "states, governments, diplomacy"),
        ("Media/Narrative", "reporting, bias, propaganda"),
        ("Historical/Religious", "history, scripture, claims of origin"),
        ("Other", "none of these"),
    ),
)

FEATURES: dict[str, Feature] = {
    f.name: f for f in (RELEVANCE, STANCE, QUALITY, SENTIMENT, TONE, FRAME)
}
# First pass over all comments; second pass over the relevant ones.
FIRST_PASS = (RELEVANCE.name,)
SECOND_PASS = (STANCE.name, SENTIMENT.name, TONE.name, FRAME.name, QUALITY.name)


def select_features(names: Iterable[str]) -> list[Feature]:
    """Features by name, in the given order; an unknown name is an error."""
    names = list(names)
    if unknown := [n for n in names if n not in FEATURES]:
        raise KeyError(f"unknown features: {unknown}")
    return [FEATURES[n] for n in names]
