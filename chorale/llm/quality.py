"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the table of vote patterns estimates how often each labeller votes what on good and on bad
documents, and with that the probability that a document with a given pattern is good. These posterior
labels train a logistic scorer on hashed features, which decides.

The vote table covers all documents and has at most 3 ** 8 rows. The scorer is fitted on at most
`sample` documents (2,000 by default), half with a posterior label of each kind, the smallest hashes
of their ids first; no given label is used.

Texts under 25 words or with hardly any blanks hold too little for the scorer's features: the labellers that
need no length vote on them, and the posterior of their votes is their score; 1 without a bad vote.

Edge cases: null, empty and blank texts get no vote and are kept with a score of 1. Repeated rows count as often as they appear; an empty table gives an
empty result; if all posterior labels agree there is nothing to learn and the posterior itself decides;
other columns are kept by `keep_good` and never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import stored

SAMPLE = 2_000
WIDTH = 4_096
MIN_WORDS = 25
# More bytes a word than this on average: blanks don't part words.
RARE_BYTES = 40
BARE_MARKS = re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")
SENTENCE_ENDS = re.compile(rb"[.!?](?=\s|$)")
WIDE_ENDS = re.compile("。|！|？".encode())


def _table(**classes: bytes) -> bytes:
    """Translation of bytes to classes; a byte in none stands for itself."""
    out = bytearray(range(256))
    for name, members in classes.items():
        for b in members:
            out[b] = ord(name)
    return bytes(out)


# Letters a and A, digits 0, blanks _. Bytes beyond ASCII count as lower-case letters.
CLASSES = _table(a=bytes(range(97, 123)) + bytes(range(128, 256)), A=bytes(range(65, 91)),
                 **{"0": bytes(range(48, 58)), "_": b" \t\n\r\x0b\x0c"})


def units_of(raw: bytes) -> list[bytes]:
    """Words; where blanks are rare (encoded data, Chinese, Japanese, Thai), pairs of characters."""
    words = raw.split()
    if not _blanks_rare(raw, words):
        return words
    text = b"".join(words).decode("utf-8", "surrogatepass")
    return [text[k:k + 2].encode("utf-8", "surrogatepass") for k in range(0, len(text), 2)]


def _blanks_rare(raw: bytes, words: list[bytes]) -> bool:
    return len(raw) > RARE_BYTES * len(words)


def measures(raw: bytes) -> tuple[float, ...] | None:
    """Shares the labellers look at; None for a text without words."""
    words = raw.split()
    if not words:
        return None
    rare, units = _blanks_rare(raw, words), units_of(raw)
    n = len(units)
    kinds = np.bincount(np.frombuffer(raw.translate(CLASSES), np.uint8), minlength=128)
    upper, lower, digit, blank = (int(kinds[ord(c)]) for c in "Aa0_")
    letters = max(1, upper + lower)
    marks = len(raw) - upper - lower - digit - blank
    ends = len(SENTENCE_ENDS.findall(raw)) + (len(WIDE_ENDS.findall(raw)) if rare else 0)
    # Of a script without blanks, the letters between two say nothing.
    foreign = rare and 2 * sum(b > 127 for b in raw) > len(raw)
    a_word = 8.0 if foreign else (letters + digit) / len(words)
    return (marks / n, upper / letters, sum(map(eq, units, units[1:])) / n, raw.count(b"!") / n,
            len(set(units)) / n, n / (1 + ends), a_word, len(BARE_MARKS.findall(raw)) / n, n)


def votes(raw: bytes) -> list[int]:
    """1 good, -1 bad, 0 no vote, by eight labellers.

    Texts under `MIN_WORDS` units: only marks, repeats, letters a word and bare marks vote, and a share counts
    as bad only by three cases or more: a lone sentence has one mark, however short it is.
    """
    m = measures(raw)
    if m is None:
        return [0] * 8
    marks, upper, repeats, shouts, distinct, sentence, letters, bare, n = m
    side = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    if n < MIN_WORDS:
        few = lambda x, good, bad: 0 if side(x, good, bad) < 0 and round(x * n) < 3 else side(x, good, bad)
        return [few(marks, 0.4, 0.8), 0, few(repeats, 0.03, 0.15), 0, 0, 0, side(abs(letters - 8), 5, 9 if n > 2 else 24),
                few(bare, 0.05, 0.2)]
    return [
        side(marks, 0.4, 0.8),
        side(upper, 0.2, 0.5),
        side(repeats, 0.03, 0.15),
        side(shouts, 0.1, 0.4),
        0 if n < 30 else side(-distinct, -0.35, -0.2 if n < 400 else -0.05),
        side(sentence, 30, 120),
        side(abs(letters - 8), 5, 9),
        side(bare, 0.05, 0.2),
    ]


def scorable(raw: bytes) -> bool:
    """Enough words for the scorer's features; other texts are judged by their votes."""
    words = raw.split()
    return len(words) >= MIN_WORDS and not _blanks_rare(raw, words)


def features(raw: bytes) -> np.ndarray:
    """Hashed runs of four character classes, a run of letters as one, and two shares of words."""
    codes = np.frombuffer(raw.translate(CLASSES), np.uint8)
    if len(codes):
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != codes[:-1]) | ((codes[1:] != ord("a")) & (codes[1:] != ord("A")))
        codes = codes[keep].astype(np.uint32)
    out = np.zeros(WIDTH + 2, np.float32)
    if len(codes) >= 4:
        gram = codes[:-3]
        for k in (1, 2, 3):
            gram = gram * np.uint32(0x01000193) ^ codes[k:len(codes) - 3 + k]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out[:WIDTH] = np.sqrt(np.bincount(gram, minlength=WIDTH)[:WIDTH] / len(gram))
    words = raw.split()
    if words:
        out[WIDTH] = sum(map(eq, words, words[1:])) / len(words)
        out[WIDTH + 1] = min(1.0, len(set(words)) / min(len(words), 200))
    return out


def _raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pattern_of(raw: bytes) -> str:
    return "".join("0+-"[v] for v in votes(raw))


def voted(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, scorable): the votes of each document as one string of +, - and 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = [_raw(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "pattern": [pattern_of(r) for r in raws],
                                "scorable": [scorable(r) for r in raws]})
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id long, pattern string, scorable boolean")


def expectation_maximisation(patterns: list[str], counts: list[int], rounds: int = 100) -> np.ndarray:
    """Probability of good for each pattern. Starts from one dissent being
    enough, since every kind of junk is the business of a few labellers only."""
    vote = np.array([["0+-".index(c) for c in p] for p in patterns])
    weight = np.array(counts, float)
    good = np.where((vote == 2).any(1), 0.1, 0.95)
    for _ in range(rounds):
        share = (good * weight).sum() / weight.sum()
        logs = np.log(np.clip([1 - share, share], 1e-6, 1))[None].repeat(len(vote), 0)
        for k in range(vote.shape[1]):
            for side, own in enumerate((1 - good, good)):
                table = np.array([(own * weight)[vote[:, k] == v].sum() for v in range(3)]) + 0.5
                logs[:, side] += np.log(table / table.sum())[vote[:, k]]
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return good


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; the same input gives the same weights."""
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
    w, b, turned = np.zeros(x.shape[1], np.float32), np.float32(0), np.ascontiguousarray(x.T)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        grad = np.append(turned @ error / len(y) + decay * w, error.mean()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        step = (0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Model:
    """Scores texts: weights of the scorer, or none when all posterior labels agreed on `fallback`; posterior by
    pattern for texts the scorer can't judge."""

    def __init__(self, weights: np.ndarray | None, bias: float, fallback: float, posterior: dict[str, float] | None = None):
        self.weights, self.bias, self.fallback, self.posterior = weights, bias, fallback, posterior or {}

    def score(self, text: str | None) -> float:
        raw = _raw(text)
        if not scorable(raw):
            pattern = pattern_of(raw)
            return float(self.posterior.get(pattern, self.fallback)) if "-" in pattern else 1.0
        if self.weights is None:
            return self.fallback
        return float(1 / (1 + np.exp(-(features(raw) @ self.weights + self.bias))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Votes on all documents, posterior labels from all votes, the scorer from a bounded sample."""
    rows = stored(voted(docs), "votes")
    table = sorted((r["pattern"], r["n"]) for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect())
    table = [(p, n) for p, n in table if p.strip("0")]
    if not table:
        return Model(None, 0.0, 1.0)
    posterior = dict(zip([p for p, _ in table], expectation_maximisation(*map(list, zip(*table, strict=True))), strict=True))
    good = [p for p, x in posterior.items() if x >= 0.5]
    if len(good) in (0, len(posterior)):
        return Model(None, 0.0, float(bool(good)), posterior)
    side = F.col("pattern").isin(good)
    order = Window.partitionBy("good").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (rows.filter(F.col("pattern").isin(list(posterior)) & F.col("doc_id").isNotNull() & F.col("scorable")).withColumn("good", side)
              .withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample // 2)
              .select("doc_id", "good").distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "good": batch["good"],
                                "x": [features(_raw(t)).astype(np.float16).tobytes() for t in batch["text"]]})
    found = texts.mapInPandas(shapes, "doc_id long, good boolean, x binary").collect()
    if len({r["good"] for r in found}) < 2:
        return Model(None, 0.0, float(found[0]["good"]) if found else 1.0, posterior)
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float16).reshape(len(found), -1).astype(np.float32)
    return Model(*logistic(x, np.array([r["good"] for r in found], float)), 1.0, posterior)


def score_column(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)
    return score(F.col("text").cast("string"))


def scored(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), score_column(fit(docs, sample)).alias("score"))
    return rows.withColumn("keep", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows the scorer accepts, whole."""
    return docs.filter(score_column(fit(docs, sample)) >= 0.5)
