"""Licence scans: phrases and identifier tags by one automaton, licence expressions by operator precedence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fitgrid.llm.tokens import text_batches

# The phrases that a scan must always report, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Names and notice texts beyond them, word by word.
NAMES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# Words that announce a licence, and tags that a licence expression follows.
LEADS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "subject to the terms of")
TAGS = ("spdx license identifier", "spdx license expression", "license expression")
# How much a licence asks of those who pass a work on.
FREE, NOTICE, FILES, WORK, NETWORK = range(5)
FAMILIES = {
    "cc0": FREE, "unlicense": FREE, "0bsd": FREE, "mit": NOTICE, "bsd": NOTICE, "isc": NOTICE, "apache": NOTICE, "zlib": NOTICE,
    "bsl": NOTICE, "cc-by": NOTICE, "lgpl": FILES, "mpl": FILES, "epl": FILES, "gpl": WORK, "cc-by-sa": WORK, "agpl": NETWORK,
}
_LEAD_WORDS = 6  # from a lead to the name it announces
_SPACE = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"[ \t:]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*(?::[A-Za-z0-9.-]+)?))")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: its plain form, the licences it names, and how much it asks at least."""

    text: str
    labels: frozenset[str]
    asks: int | None


def _licence(name: str) -> Terms:
    plain = name.lower().rstrip(".")
    plain = re.sub(r"-(only|or-later)$|\+$", "", plain)
    family = plain
    while family not in FAMILIES and "-" in family:
        family = family.rpartition("-")[0]
    return Terms(name.rstrip("."), frozenset([plain] if family in FAMILIES else []), FAMILIES.get(family))


def _joined(operator: str, left: Terms, right: Terms) -> Terms:
    """``or`` leaves the choice, ``and`` binds to both, an exception behind ``with`` frees the work but not its files."""
    text, labels = f"{left.text} {operator.upper()} {right.text}", left.labels | right.labels
    if operator == "with":
        return Terms(text, left.labels, left.asks if left.asks is None else min(left.asks, FILES))
    known = [t.asks for t in (left, right) if t.asks is not None]
    if operator == "or":
        return Terms(f"({text})", labels, min(known, default=None))
    return Terms(f"({text})", labels, max(known) if len(known) == 2 else None)


def evaluate(expression: str) -> Terms | None:
    """The licence expression that a text begins with; None if there is none or its brackets do not close.

    Operators stand on one stack until one that binds less follows, values on
    the other. Reading stops where the text goes on in a way that an expression
    cannot: at a second name without an operator, or at any other character.
    """
    values: list[Terms] = []
    operators: list[str] = []
    wants_value, at = True, 0

    def reduce_to(rank: int) -> None:
        while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= rank:
            right, left = values.pop(), values.pop()
            values.append(_joined(operators.pop(), left, right))

    while found := _TOKEN.match(expression, at):
        bracket, word = found.groups()
        operator = (word or "").lower()
        if wants_value and bracket == "(":
            operators.append("(")
        elif wants_value and word and operator not in _BINDS:
            values.append(_licence(word))
            wants_value = False
            if word.endswith("."):  # the end of a sentence
                break
        elif not wants_value and operator in _BINDS:
            reduce_to(_BINDS[operator])
            operators.append(operator)
            wants_value = True
        elif not wants_value and bracket == ")" and "(" in operators:
            reduce_to(0)
            operators.pop()
        else:
            break
        at = found.end()
    if wants_value and operators and operators[-1] in _BINDS:  # "MIT and more": what follows is prose
        operators.pop()
        wants_value = False
    if wants_value or "(" in operators:
        return None
    reduce_to(0)
    return values[0]


class Scanner:
    """One automaton over word sequences, for phrases, leads and tags alike."""

    def __init__(self, base: Mapping[str, str] = BASE_PHRASES, names: Mapping[str, str] = NAMES):
        entries: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base.items()), ("name", names.items()),
                              ("lead", ((p, "") for p in LEADS)), ("tag", ((p, "") for p in TAGS))):
            for phrase, label in phrases:
                entries.setdefault(f" {phrase} ", []).append((kind, label))
        self.automaton = ahocorasick.Automaton()
        for phrase, meanings in entries.items():
            self.automaton.add_word(phrase, (len(phrase), phrase.count(" ") - 1, meanings))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """n_words, starts of base phrases, base labels, all labels, expressions, asks, score of one text."""
        data = text.encode("utf-8", "surrogatepass")
        words = data.translate(_SPACE).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts, base, named, tags = [], set(), [], []
        lead_end, word, counted = -1, 0, 0
        announced = False
        for end, (length, size, meanings) in self.automaton.iter(line):
            # words before the phrase: the spaces before the one it begins with
            begin = end - length + 1
            if begin >= counted:
                word += line.count(" ", counted, begin)
            else:
                word -= line.count(" ", begin, counted)
            counted = begin
            for kind, label in meanings:
                if kind == "lead":
                    lead_end = max(lead_end, word + size)
                elif kind == "tag":
                    tags.append(word + size)
                else:
                    if kind == "base":
                        starts.append(word)
                        base.add(label)
                    named.append(label)
                    announced |= 0 <= word - lead_end <= _LEAD_WORDS and lead_end >= 0
        expressions = self._expressions(data, tags) if tags else []
        labels = base.union(named, *[t.labels for t in expressions])
        asks = [a for a in [t.asks for t in expressions] + [FAMILIES.get(label) for label in named] if a is not None]
        known = any(t.labels for t in expressions)
        score = 1 - (0.05 if known else 1.0) * (0.2 if announced else 1.0) * (0.5 if named else 1.0)
        return len(words), starts, sorted(base), sorted(labels), [t.text for t in expressions], max(asks, default=None), score

    @staticmethod
    def _expressions(data: bytes, tags: Sequence[int]) -> list[Terms]:
        """The expressions behind the tags, which end at the given words; read in the text itself, to the end of the line."""
        ends = set(tags)
        found = []
        for i, match in enumerate(_WORD.finditer(data), 1):
            if i in ends:
                line_end = data.find(b"\n", match.end())
                rest = data[match.end():line_end if line_end >= 0 else len(data)]
                terms = evaluate(rest.decode("utf-8", "replace"))
                if terms:
                    found.append(terms)
        return found


@cache
def _scanner() -> Scanner:
    return Scanner()


_FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("expressions", T.ArrayType(T.StringType())), T.StructField("asks", T.IntegerType()),
    T.StructField("score", T.DoubleType())])


def scan_licenses(documents: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, for every whole text, the licences it states.

    ``n_words`` counts runs of letters, digits and characters beyond ASCII.
    ``n_base`` places hold a base phrase word by word, ``first_word`` and
    ``last_word`` are the smallest and largest of their word numbers (null
    without one), ``base_labels`` their labels. ``labels`` adds those of longer
    names and notice texts, and of the licences in ``expressions``, which follow
    an identifier tag. ``asks`` is the most that any of them demands, from 0
    (nothing) to 4 (source to network users), null if unknown. ``score`` is 0
    without any sign, and nears 1 as a name, a lead such as "licensed under"
    before it, and a readable tag come together.

    A null or empty text has no words and no labels. Every row is scanned alone,
    repeated rows and rows without id alike. Kept columns named like a result
    give way to it.
    """
    kept = [c for c in keep if c not in _FIELDS.names]
    rows = documents.select(*kept, documents["text"].alias("__text"))
    schema = T.StructType([*documents.select(*kept).schema.fields, *_FIELDS.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner().scan
        for batch, texts in text_batches(batches, "__text"):
            found = []
            for text in texts:
                n, starts, base, labels, expressions, asks, score = scan(text)
                found.append((n, len(starts), min(starts, default=None), max(starts, default=None),
                              base, labels, expressions, asks, score))
            types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 3 + [pa.int32(), pa.float64()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], [*kept, *_FIELDS.names])

    return rows.mapInArrow(work, schema)
