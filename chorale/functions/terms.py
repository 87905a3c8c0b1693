"""Boolean keyword search as composable predicates over a lower-cased text column.

    anyone = any_of(term("gaza"), prefix("palestine"), phrase("hate speech"))
    posts.filter(all_of(anyone, term("war")).matches(F.lower("post_title")))

Word boundaries are ASCII classes written out, so the result does not depend on a regex engine's
idea of a word character. Words of one `any_of` become a single alternation: one pass over the text,
and only over texts that hold one of the words as a plain substring, which costs next to nothing to
test.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9_]"


def whole_words(patterns: Sequence[str]) -> str:
    """A pattern for any of the given word patterns between word edges.

    Patterns are grouped by first letter and that letter is looked at before anything else, so most
    positions of a text are skipped after one step.
    """
    by_first: dict[str, list[str]] = {}
    for p in patterns:
        cut = 2 if p[0] == "\\" else 1
        by_first.setdefault(p[:cut], []).append(p[cut:])
    body = "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in sorted(by_first.items()))
    return f"(?=[{''.join(sorted(by_first))}])(?<!{WORD})(?:{body})(?!{WORD})"


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text.lower())


@dataclass(frozen=True)
class Word:
    """One word or phrase; `open_end` also accepts longer words that begin with it."""

    text: str
    open_end: bool = False

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError("an empty word matches nothing")

    @property
    def pattern(self) -> str:
        body = r"\s+".join(_quote(part) for part in self.text.split())
        return body + (f"{WORD}*" if self.open_end else "")

    def may_match(self, text: Column) -> Column:
        """A cheap necessary condition: every part occurs somewhere."""
        return reduce(and_, [text.contains(part) for part in self.text.lower().split()])

    def matches(self, text: Column) -> Column:
        return any_of(self).matches(text)

    def words(self) -> tuple[Word, ...]:
        return (self,)

    def __str__(self) -> str:
        shown = self.text + ("*" if self.open_end else "")
        return f'"{shown}"' if re.search(r"[^\w]", self.text) else shown


@dataclass(frozen=True)
class Group:
    parts: tuple[Word | Group, ...]
    every: bool

    def matches(self, text: Column) -> Column:
        if self.every:
            return reduce(and_, [p.matches(text) for p in self.parts])
        words = [p for p in self.parts if isinstance(p, Word)]
        tests = [p.matches(text) for p in self.parts if isinstance(p, Group)]
        if words:
            held = reduce(or_, [w.may_match(text) for w in words])
            tests.insert(0, held & text.rlike(whole_words([w.pattern for w in words])))
        return reduce(or_, tests)

    def words(self) -> tuple[Word, ...]:
        return tuple(dict.fromkeys(w for p in self.parts for w in p.words()))

    def __str__(self) -> str:
        return "(" + (" AND " if self.every else " OR ").join(map(str, self.parts)) + ")"


def term(word: str) -> Word:
    return Word(word)


def prefix(stem: str) -> Word:
    return Word(stem, open_end=True)


def phrase(text: str, open_end: bool = False) -> Word:
    return Word(text, open_end)


def _parts(parts: tuple[Word | Group | str, ...]) -> tuple[Word | Group, ...]:
    if not parts:
        raise ValueError("a group needs at least one part")
    return tuple(Word(p) if isinstance(p, str) else p for p in parts)


def any_of(*parts: Word | Group | str) -> Group:
    return Group(_parts(parts), every=False)


def all_of(*parts: Word | Group | str) -> Group:
    return Group(_parts(parts), every=True)


def matched_words(query: Word | Group, text: Column) -> Column:
    """How many different words of the query the text holds."""
    return reduce(lambda a, b: a + b, [w.matches(text).cast("int") for w in query.words()])


def searchable(*columns: str) -> Column:
    """The searched text: the given columns, nulls as empty, lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
