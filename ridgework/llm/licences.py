"""Licence notices and identifier tags in texts, with licence expressions evaluated.

One Aho-Corasick automaton over word sequences finds notice phrases, another over the text finds
identifier tags. The expression after a tag goes through a shunting-yard parser (``with`` binds tighter
than ``and``, ``and`` tighter than ``or``) and is evaluated to the licences it names and to how freely it
lets a text be used: ``and`` takes the lesser freedom, ``or`` the greater, ``with`` leaves the licence's.

Defined cases: a NULL text has no words, labels or places and score 0; an expression that does not
parse gives its known identifiers, joined as by ``and``; unknown identifiers are labels with freedom
``UNKNOWN``; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.llm.tables import ascii_words

# Fixed by the contract: the phrases every scan counts, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices that only add labels.
MORE_PHRASES = {
    "released under the bsd license": "bsd",
    "licensed under the bsd": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")
# How freely a text under a licence may be used, by the start of its label.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by-sa": 0.6, "cc-by-nc": 0.2,
    "cc-by-nd": 0.2, "cc-by": 0.9, "lgpl": 0.6, "mpl": 0.6, "epl": 0.6, "gpl": 0.4, "agpl": 0.3, "proprietary": 0.0,
}
UNKNOWN = 0.5
BINDING = {"or": 1, "and": 2, "with": 3}

_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_SPACE = re.compile(r"[ \t]*")


def freedom(label: str) -> float:
    starts = [start for start in FREEDOM if label.startswith(start)]
    return FREEDOM[max(starts, key=len)] if starts else UNKNOWN


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard; raises ``ValueError`` for what is no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True
    for token in tokens:
        word = token.lower()
        if (word == "(" or word not in BINDING and word != ")") != operand:
            raise ValueError(f"unexpected {token!r}")
        if word == "(":
            waiting.append(word)
        elif word == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("a bracket closes that none opened")
            waiting.pop()
        elif word in BINDING:
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = True
        else:
            out.append(word)
            operand = False
    if operand or "(" in waiting:
        raise ValueError("the expression ends early")
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Licences an expression names and the freedom it gives."""
    tokens = _TOKEN.findall(expression)
    try:
        postfix = to_postfix(tokens)
    except ValueError:
        known = {t.lower() for t in tokens if t.lower() not in BINDING and t not in "()" and freedom(t.lower()) != UNKNOWN}
        return known, min(map(freedom, known), default=0.0)
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in BINDING:
            stack.append(({token}, freedom(token)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{name}-with-{extra}" for name in left[0] for extra in right[0]}, left[1]))
        else:
            choose = min if token == "and" else max
            stack.append((left[0] | right[0], choose(left[1], right[1])))
    return stack.pop()


def expression_at(text: str, at: int) -> str:
    """The longest run of expression tokens from ``at`` within the line.

    Stops where a word follows a finished operand without an operator between.
    """
    end, operand, depth, last = at, True, 0, at
    while (match := _TOKEN.match(text, _SPACE.match(text, end).end())):
        token = match.group().lower()
        if token == ")":
            if depth == 0 or operand:
                break
            depth -= 1
        elif token in BINDING:
            if operand:
                break
            operand = True
        elif not operand:
            break
        elif token == "(":
            depth += 1
        else:
            operand = False
        end = match.end()
        if not operand and depth == 0:
            last = end
    return text[at:last if last > at else end].rstrip(".")


class Scanner:
    def __init__(self):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for base, phrases in ((True, BASE_PHRASES), (False, MORE_PHRASES)):
            for phrase, label in phrases.items():
                self.phrases.add_word(f" {phrase} ", (base, label, len(phrase) + 2))
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """``n_words, n_base, first_word, last_word, base_labels, labels, score, expressions``."""
        words = ascii_words(text)
        line = f" {b' '.join(words).decode()} "
        base, starts, labels, degrees = set(), [], set(), []
        for end, (is_base, label, size) in self.phrases.iter(line):
            labels.add(label)
            degrees.append(freedom(label))
            if is_base:
                base.add(label)
                starts.append(end - size + 1)
        # The number of spaces before a phrase's own is the number of words before it.
        places = [line.count(" ", 0, at) for at in ((min(starts), max(starts)) if starts else ())]
        expressions = []
        lower = (text or "").lower()
        for end, _ in self.tags.iter_long(lower):
            expression = expression_at(lower, end + 1)
            if expression.strip():
                named, degree = evaluate(expression)
                labels |= named
                degrees.append(degree)
                expressions.append(expression.strip())
        score = min(degrees) if degrees else 0.0
        return (
            len(words), len(starts), places[0] if places else None, places[1] if places else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions,
        )


FIELDS = (
    ("n_words", "bigint", pa.int64()), ("n_base", "bigint", pa.int64()), ("first_word", "bigint", pa.int64()),
    ("last_word", "bigint", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()),
    ("score", "double", pa.float64()), ("expressions", "array<string>", pa.list_(pa.string())),
)


def licences(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, labels, how freely it may be used, and expressions found."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([row[i] for row in rows], kind) for i, (_, _, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *[name for name, _, _ in FIELDS]])

    ddl = "doc_id bigint, " + ", ".join(f"{name} {kind}" for name, kind, _ in FIELDS)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(scan, ddl)
