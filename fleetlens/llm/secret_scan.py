"""Secret scan: all rules in one deterministic automaton that reads every byte of a text once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Positions, byte_classes, ends_automaton, minimal, starts_automaton, together


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``expression`` that do not overlap, each as long as it can be; of these the ones whose
    ``group`` (0: all) has at least ``least`` bytes."""

    kind: str
    expression: str
    group: int = 0
    least: int = 0


#: The base rules. A run of hexadecimal digits is as long as it can be, so part of its least length may stand in the
#: expression: fewer words of prose are looked at, while each digit counted there multiplies the states.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{8,}", 0, 32),
)
#: Rules of the method: forms of credentials that say by themselves what they are.
OWN = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D ]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]+", 0, 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9\-]+", 0, 24),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", 0, 39),
    Rule("stripe", r"(sk|rk)_(live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 0, 40),
    Rule("url", r"""[a-z][a-z0-9+.\-]*://[A-Za-z0-9._~%+\-]+:([^\x00-\x20@/"'<>]+)@""", 1, 3),
)
RULES = BASE + OWN


@dataclass(frozen=True)
class Scanner:
    """Transition arrays. ``step[state + class]`` is the next state, both as offsets; states from ``accepting`` on mark ends
    of the rules in the bits of ``marks``. ``back`` reads one rule's match from its end to its start."""

    rules: tuple[Rule, ...]
    classes: bytes
    width: int
    step: np.ndarray
    accepting: int
    marks: np.ndarray
    back: tuple[tuple[np.ndarray, np.ndarray], ...]

    @classmethod
    @lru_cache(4)
    def of(cls, rules: tuple[Rule, ...] = RULES) -> Scanner:
        forms = [Positions.of(r.expression) for r in rules]
        classes, samples = byte_classes(forms)
        table, marks = together([minimal(*ends_automaton(f, samples)) for f in forms])
        order = np.argsort(marks != 0, kind="stable")  # accepting states last, the start stays 0
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        width = len(samples)
        return cls(
            tuple(rules), classes.tobytes(), width, (number[table[order]] * width).ravel().astype(np.int32),
            int((marks == 0).sum()) * width, marks[order],
            tuple(minimal(*starts_automaton(f, samples)) for f in forms),
        )


class Scan:
    """A scanner as plain lists, which a loop over bytes reads fastest."""

    def __init__(self, scanner: Scanner):
        self.rules, self.classes, self.width = scanner.rules, scanner.classes, scanner.width
        self.step, self.accepting, self.marks = scanner.step.tolist(), scanner.accepting, scanner.marks.tolist()
        self.back = [(t.tolist(), a.tolist(), self._dead(t, a)) for t, a in scanner.back]
        self.checks = [re.compile(r.expression.encode()) if r.group else None for r in scanner.rules]

    @staticmethod
    def _dead(table: np.ndarray, accepting: np.ndarray) -> int:
        stays = (table == np.arange(len(table))[:, None]).all(axis=1) & ~accepting
        return int(np.flatnonzero(stays)[0]) if stays.any() else -1

    def ends(self, coded: bytes) -> list[tuple[int, int]]:
        """(end, mark) at every place where a rule may end a match."""
        step, accepting, state, found = self.step, self.accepting, 0, []
        for at, c in enumerate(coded, 1):
            state = step[state + c]
            if state >= accepting:
                found.append((at, self.marks[state // self.width]))
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        coded = text.translate(self.classes)
        found = self.ends(coded)
        spans = []
        for r, rule in enumerate(self.rules):
            own = [at for at, mark in found if mark >> r & 1]
            floor = 0
            for at, following in zip(own, [*own[1:], -1]):
                if following == at + 1:
                    continue  # the match goes on
                start = self._start(r, coded, at, floor)
                if self._holds(r, rule, text[start:at]):
                    spans.append((start, r, at))
                floor = at
        return sorted(spans)

    def _start(self, r: int, coded: bytes, end: int, floor: int) -> int:
        """The earliest start, at ``floor`` or behind it, of a match of a rule that ends at ``end``."""
        table, accepting, dead = self.back[r]
        state, start = 0, end
        for at in range(end - 1, floor - 1, -1):
            state = table[state][coded[at]]
            if state == dead:
                break
            if accepting[state]:
                start = at
        return start

    def _holds(self, r: int, rule: Rule, span: bytes) -> bool:
        return len(self.checks[r].fullmatch(span)[rule.group] if rule.group else span) >= rule.least


def code_points(text: bytes, places: list[int]) -> list[int]:
    """Byte offsets, ascending, as offsets in code points."""
    if text.isascii():
        return places
    out, last, count = [], 0, 0
    for place in places:
        count += len(text[last:place].decode("utf-8", "replace"))
        last = place
        out.append(count)
    return out


FOUND = "array<struct<kind:string,start:long,end:long>>"
_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, found) for all rows of ``docs`` (doc_id, text): the spans of all rules by start, then rule, in code points.

    One narrow pass without a shuffle over whole texts; the arrays go to the tasks with the function, their size depends on
    the rules alone. A null or empty text has no spans; a null doc_id stays null; repeated rows give repeated rows; a text of any length is
    read byte by byte in memory of its own size; an empty table gives no rows; other columns are not read.
    """
    scanner = Scanner.of(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Scan(scanner)
        for batch in batches:
            found = []
            for text in batch.column("text").cast(pa.binary()):
                raw = text.as_py() or b""
                spans = finder.spans(raw)
                places = sorted({p for start, _, end in spans for p in (start, end)})
                point = dict(zip(places, code_points(raw, places)))
                found.append([{"kind": rules[r].kind, "start": point[start], "end": point[end]} for start, r, end in spans])
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, _LIST)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, found {FOUND}")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs``, with every span of the text replaced by its kind in brackets; spans that overlap are
    replaced as one, by the kind of the first. Null texts stay null."""
    scanner, schema = Scanner.of(rules), docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Scan(scanner)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if (raw := t.as_py()) is None else _replaced(raw, finder) for t in batch.column(at).cast(pa.binary())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))

    return docs.mapInArrow(scan, schema)


def _replaced(text: bytes, finder: Scan) -> bytes:
    out, last = [], 0
    for start, r, end in finder.spans(text):
        if start >= last:
            out += [text[last:start], f"[{finder.rules[r].kind}]".encode()]
        last = max(last, end)
    return b"".join([*out, text[last:]])


def digest(found: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans) of what ``scan_secrets`` found."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"),
    )
