"""License scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notice phrases of the method, as normalised words, with label and weight.
NOTICES = {
    "permission is hereby granted free of charge to any person": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "isc license": ("isc", 0.9),
    "unlicense": ("unlicense", 0.6),
    "released into the public domain": ("public-domain", 0.8),
    "licensed under cc by": ("cc-by", 0.9),
    "licensed under cc by nc": ("cc-by-nc", 0.9),
    "licensed under cc by sa": ("cc-by-sa", 0.9),
    "licensed under cc by nd": ("cc-by-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "all rights reserved": ("proprietary", 0.5),
}
#: The words of the tags that a licence expression follows.
TAGS = {"spdx license identifier": "spdx", "spdx licenseid": "spdx", "license expression": "spdx"}

#: First letters of an identifier and its label, longest match first.
FAMILIES = {
    "agpl": "agpl", "apache": "apache", "bsd": "bsd", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "public-domain", "epl": "epl", "gpl": "gpl", "isc": "isc",
    "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense",
}

_OTHER = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TAG_LINE = re.compile(r"(?:spdx-license-?identifier|spdx-licenseid|license-expression)[ \t]*[:=][ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """Label of a licence identifier; None for one that is not known."""
    name = max((k for k in FAMILIES if identifier.startswith(k)), key=len, default=None)
    return FAMILIES[name] if name else None


def parse(expression: str) -> list[str]:
    """Licence expression to postfix order. It ends where the text stops being an expression (comment ends,
    prose); operators and parentheses that lack a partner raise ValueError."""
    out: list[str] = []
    held: list[str] = []
    at, operand = 0, True  # operand: a licence or an opening parenthesis must come next
    while found := _TOKEN.match(expression, at):
        token = found[1]
        if operand and token != "(" and (token == ")" or token in _RANK):
            raise ValueError(f"licence expected at {found.start(1)}")
        if not operand and token != ")" and token not in _RANK:
            break
        at = found.end()
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif token in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            out.append(token.rstrip(".:"))
            operand = False
    if operand or "(" in held:
        raise ValueError("expression breaks off")
    return out + held[::-1]


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The ways to comply, as sets of labels: ``or`` joins the ways of both sides, ``and`` combines each of
    one side with each of the other, ``with`` keeps the licence that it grants an exception from."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in _RANK:
            label = family(token)
            stack.append([frozenset([label] if label else [])])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            ways = left + right
        elif token == "and":
            ways = [a | b for a in left for b in right]
        else:
            ways = left
        stack.append(list(dict.fromkeys(ways)))
    return stack.pop()


def ways_of(expression: str) -> list[frozenset[str]]:
    """The ways to comply with an expression; none if it is broken."""
    try:
        return evaluate(parse(expression))
    except ValueError:
        return []


def expression_labels(expression: str) -> set[str]:
    return set().union(*ways_of(expression))


def choices_text(ways: list[frozenset[str]]) -> str:
    """Ways to comply as text: labels that hold together joined by ``+``, ways by ``|``. A way that asks for all of another one and
    more is no choice of its own."""
    least = [w for w in ways if not any(v < w for v in ways)]
    return "|".join(sorted({"+".join(sorted(w)) for w in least if w}))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase in phrases:
            found.add_word(f" {phrase} ", (kind, phrase, len(phrase) + 2))
    found.make_automaton()
    return found


def scan_text(text: str, finder: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, choices) of one whole text."""
    lowered = text.translate(_LOWER)
    line = " " + " ".join(_OTHER.sub(" ", lowered).split(" ")).strip(" ") + " "
    n_words = line.count(" ") - 1 if len(line) > 2 else 0
    places: list[int] = []
    base: set[str] = set()
    labels: dict[str, float] = {}
    notices: dict[int, str] = {}
    tagged = False
    choices: list[str] = []
    at, word = 0, 0
    for end, (kind, phrase, size) in finder.iter(line):
        if kind == "base":
            begin = end - size + 1
            # Phrases end in order but may begin before one that is already counted.
            word += line.count(" ", at, begin) if begin >= at else -line.count(" ", begin, at)
            at = begin
            places.append(word)
            base.add(BASE[phrase])
            labels[BASE[phrase]] = max(0.8, labels.get(BASE[phrase], 0))
        elif kind == "notice":
            notices[end - size] = max(phrase, notices.get(end - size, ""), key=len)  # the longest one that begins there
        else:
            tagged = True
    for label, weight in (NOTICES[phrase] for phrase in notices.values()):
        labels[label] = max(weight, labels.get(label, 0))
    if tagged:
        for found in _TAG_LINE.finditer(lowered):
            ways = ways_of(found[1])
            for label in set().union(*ways):
                labels[label] = 1.0
            if said := choices_text(ways):
                choices.append(said)
    return (
        n_words, len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), max(labels.values(), default=0.0), ";".join(choices),
    )


_LOWER = {k: k + 32 for k in range(65, 91)}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, choices string"
)
_FIELDS = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("choices", pa.string())]
)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    One narrow pass without a shuffle over whole texts. ``score`` is the weight of the best evidence: 1 for an
    identifier tag, 0.8 for a base phrase, less for vague notices, 0 for none. ``choices`` has what each licence expression evaluates to, in
    order of the text and joined by ``;``: ``a|b+c`` is a, or b and c together. A null or empty text has no words and no labels; a
    null doc_id stays null; repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            rows = [(i, *scan_text(t or "", finder)) for i, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")))]
            yield pa.record_batch([list(x) for x in zip(*rows)] if rows else [[] for _ in _FIELDS], schema=_FIELDS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)
