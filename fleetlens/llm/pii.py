"""Personal data: base patterns, and candidate spans that boosted trees select."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import boosting

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret",)
ALL = KINDS + EXTRA

Span = tuple[str, int, int]

# Base patterns --------------------------------------------------------------------------------------
# The given patterns, with runs that cannot match anew held together so that no text takes square time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    """Each match holds one ``@`` with all that may precede it, so matches are found from the ``@``."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    backwards = ""
    while at >= 0:
        begin = at
        if begin > last:
            backwards = text[last:at][::-1]
            begin -= _LOCAL.match(backwards).end()
        if begin < at and (found := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, found.end()))
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    if _DIGIT.search(text):
        # A dotted run that breaks off is not the start of a match further on: "1.2.3" has none, "1.2.3.4.5" one.
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# Candidates -----------------------------------------------------------------------------------------
_RUN = re.compile(r"[^\s@<>\"'()\[\],;]+")
_BETWEEN = re.compile(r"@|\s?\(at\)\s?|\s?\[at\]\s?")
_NUMBER_LIKE = re.compile(r"[+(]?[0-9](?:[0-9]|[\x20().-]{1,2}+(?=[0-9(])){6,}+")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,4}+(?:[.:][0-9]{1,4}+){3}(?![0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+(?![A-Za-z0-9_+/=-])")
_ASSIGNED = re.compile(r"(?i)(?:token|key|secret|password|passwd|credential)s?[\x20\t]*[=:][\x20\t]*[\"']?$")

#: Other ways to write ``@``; a mailbox and card groups once they are undone.
_AT = re.compile(r"\s?[(\[]at[)\]]\s?")
_MAILBOX = re.compile(r"[^\s@]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_CARD_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}(?:[ .()-]{1,2}[0-9]{4}){2}[ .()-]{1,2}[0-9]{1,7}|[0-9]{4}[ .()-]{1,2}[0-9]{6}[ .()-]{1,2}[0-9]{5}")
#: A number with its area code in parentheses, a date, and words that announce a phone number or an address.
_AREA = re.compile(r"\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}")
_DATE = re.compile(r"[0-9]{4}[-.][0-9]{2}[-.][0-9]{2}")
_TEL = re.compile(r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax)\b\W{0,4}(?:(?:us|me|at|on|no|number|is)\b\W{0,3}){0,2}$")
_HOST = re.compile(r"(?i)\b(?:ip|host|addr|address|server)\b\W{0,4}(?:is\b\W{0,3})?$")

#: Words before a span that speak for a kind.
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "secret": ("token", "key", "secret", "passw", "credential"),
}
CONTEXT = 32  #: characters before and after a span that features look at


def _mail_like(text: str) -> Iterator[tuple[int, int]]:
    """A run of characters of any length on both sides of ``@`` or another way to write it."""
    begins: dict[int, int] = {}
    ends: dict[int, int] = {}
    for m in _RUN.finditer(text):
        begins[m.start()], ends[m.end()] = m.end(), m.start()
    for m in _BETWEEN.finditer(text):
        if m.start() in ends and m.end() in begins:
            end = begins[m.end()]
            end = m.end() + len(text[m.end() : end].rstrip(".:!?"))
            if end - m.end() >= 2:
                yield ends[m.start()], end


def candidates(text: str) -> list[Span]:
    """Overlapping spans of high recall: one stretch of digits is proposed as a card and as a phone number."""
    out: list[Span] = []
    if "@" in text or "(at)" in text or "[at]" in text:
        out += [("email", *s) for s in _mail_like(text)]
    if _DIGIT.search(text):
        for m in _NUMBER_LIKE.finditer(text):
            out += [("card", *m.span()), ("phone", *m.span())]
        out += [("ip", *m.span()) for m in _DOTTED.finditer(text)]
        out += [("secret", *m.span()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit()]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, begin, end = span
    body, before, after = text[begin:end], text[max(0, begin - CONTEXT) : begin], text[end : end + CONTEXT]
    digits = "".join(c for c in body if "0" <= c <= "9")
    counts = Counter(body)
    n = len(body)
    groups = re.findall("[0-9]+", body)
    low = before.lower()
    mail = _AT.sub("@", body)
    return [
        *(float(kind == k) for k in ALL),
        n, len(digits), len(digits) / n, sum(map(str.isalpha, body)) / n, sum(map(str.isupper, body)) / n,
        sum(c in "aeiouAEIOU" for c in body) / n, sum(not c.isalnum() for c in body), body.count("."), body.count("-"), len(groups),
        max(map(len, groups), default=0), float(all(map(_small, groups))), float(13 <= len(digits) <= 19 and luhn(digits)),
        float(9 <= len(digits) <= 15), float(body[0] == "+"), float("@" in mail), float(bool(re.search(r"@[\w-]+(\.[\w-]+)*\.[^\W\d_]{2}", mail))),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(any(cue in low for cue in CUES[kind])), float(any(cue in low for k in ALL if k != kind for cue in CUES[k])),
        float(before.rstrip(" \"'").endswith(("=", ":"))), float(before.endswith(("\"", "'"))), float(after[:1] in ("\"", "'")), float(before[-1:].isalnum()), float(after[:1].isalnum()),
    ]


def _covered(text: str, spans: list[Span], kind: str | None = None) -> bytearray:
    """1 where a span, of the kind if one is given, covers a character."""
    out = bytearray(len(text))
    for k, begin, end in spans:
        if kind in (None, k):
            out[begin:end] = b"\x01" * (end - begin)
    return out


def weak_label(text: str, span: Span) -> bool:
    """Whether checks that are certain by themselves call a candidate off the base personal data of its kind: its form once
    it is normalised, and words before it."""
    kind, begin, end = span
    body, before = text[begin:end], text[max(0, begin - CONTEXT) : begin]
    if kind == "secret":
        return bool(_ASSIGNED.search(before)) and len(set(body)) >= 8
    if kind == "email":
        return bool(_MAILBOX.fullmatch(_AT.sub("@", body)))
    if before[-1:].isalnum() or text[end : end + 1].isalnum():
        return False
    if kind == "ip":
        return all(map(_small, re.findall("[0-9]+", body))) and bool(_HOST.search(before))
    digits = "".join(_DIGIT.findall(body))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(_CARD_GROUPS.fullmatch(body))
    return 7 <= len(digits) <= 15 and not _DATE.match(body) and bool(_AREA.fullmatch(body) or _TEL.search(before))


def masked(text: str, span: Span) -> list[tuple[str, Span]]:
    """A candidate that a base pattern finds, in its text, as the base patterns would not find it: without ``+``, without the
    country, with other separators, with ``(at)``. What it is does not change."""
    kind, begin, end = span
    body = text[begin:end]
    if kind == "email":
        forms = [body.replace("@", " (at) "), body.replace("@", "[at]")]
    elif kind == "phone":
        forms = [body.lstrip("+"), re.sub(r"^\+[0-9]+[ .-]*", "", body)]
    elif kind == "card":
        forms = [re.sub("[ -]", ".", body)]
    else:
        forms = []
    out = []
    for form in dict.fromkeys(forms):
        if form != body and len(form) > 6:
            # A window as wide as features look keeps this linear in texts with many spans.
            left, right = text[max(0, begin - CONTEXT) : begin], text[end : end + CONTEXT]
            out.append((left + form + right, (kind, len(left), len(left) + len(form))))
    return out


def examples(text: str) -> Iterator[tuple[Span, int, list[float], bool]]:
    """(candidate, turn, features, label). The selector sees candidates off the base only, so those that a base pattern
    finds teach in masked form."""
    spans = candidates(text)
    found = base_spans(text) if spans else []
    base = {k: _covered(text, found, k) for k in KINDS} if spans else {}
    for s in spans:
        if s[0] in base and base[s[0]].find(1, s[1], s[2]) >= 0:
            for turn, (other, span) in enumerate(masked(text, s)):
                yield s, turn, features(other, span), True
        else:
            yield s, 0, features(text, s), weak_label(text, s)


# Model ----------------------------------------------------------------------------------------------
@dataclass
class Selector:
    trees: boosting.Trees | None
    limits: dict[str, float]

    def select(self, text: str, base: list[Span]) -> list[tuple[str, int, int, float]]:
        """Candidates above their kind's limit that touch no base span; of overlapping ones the best."""
        if self.trees is None:
            return []
        taken = _covered(text, base)
        spans = [s for s in candidates(text) if taken.find(1, s[1], s[2]) < 0]
        if not spans:
            return []
        scores = self.trees.probability(np.array([features(text, s) for s in spans]))
        out: list[tuple[str, int, int, float]] = []
        for score, (kind, begin, end) in sorted(zip(scores.tolist(), spans), key=lambda x: (-x[0], x[1])):
            if score >= self.limits.get(kind, math.inf) and taken.find(1, begin, end) < 0:
                taken[begin:end] = b"\x01" * (end - begin)
                out.append((kind, begin, end, score))
        return out


#: Parts that the candidates are cut into; each is scored by trees fitted on the others.
FOLDS = 3
#: No candidate is selected that the trees hold to be more likely false than true.
LEAST = 0.5


def fit_selector(docs: DataFrame, sample: int = 20_000, precision: float = 0.98) -> Selector:
    """Trees and limits from all candidates of all documents.

    Labels are weak: see ``weak_label`` and ``masked``. Every candidate is scored by trees that did not see its
    document, and these scores set the limits: for each kind the lowest score from which ``precision`` of its candidates are true, and
    for a kind without a true candidate that of all kinds together. The rule is the same for any number of candidates. Without both
    true and false ones nothing is selected. Up to ``sample`` candidates are fitted on the driver, more in
    tasks, which hand over sums and counts of scores; none is left out.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for place, text in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist()):
                rows += [(place, s[0], s[1], turn, row, label) for s, turn, row, label in examples(text)]
            yield pa.record_batch(
                [list(x) for x in zip(*rows)] if rows else [[]] * 6,
                schema=pa.schema([("place", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("turn", pa.int64()), ("features", pa.list_(pa.float64())), ("label", pa.bool_())]),
            )

    proposed = docs.where("text is not null").select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("place"), F.col("text").cast("string").alias("text"))
    schema = "place long, kind string, start long, turn long, features array<double>, label boolean"
    found = settle(proposed.mapInArrow(propose, schema), "span-candidates")
    if found.limit(sample + 1).count() > sample:
        return _fit_in_tasks(found, precision)
    rows = found.orderBy("place", "start", "kind", "turn").collect()
    y = np.array([r["label"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Selector(None, {})
    x = np.array([r["features"] for r in rows])
    kinds = np.array([r["kind"] for r in rows])
    fold = np.array([r["place"] % FOLDS for r in rows])
    score, scored = np.zeros(len(y)), np.zeros(len(y), bool)
    for held in (fold == i for i in range(FOLDS)):
        if 0 < y[~held].sum() < (~held).sum():
            score[held], scored[held] = boosting.fit(x[~held], y[~held]).probability(x[held]), True
    score, y_scored, kinds = score[scored], y[scored], kinds[scored]
    together = boosting.threshold(score, y_scored, precision, 1)
    limits = {}
    for k in ALL:
        own = boosting.threshold(score[kinds == k], y_scored[kinds == k], precision, 1)
        limits[k] = max(LEAST, own if own < math.inf else together)
    return Selector(boosting.fit(x, y), limits)


#: Steps between 0 and 1 in which scores are counted.
STEPS = 10_000


def _fit_in_tasks(found: DataFrame, precision: float) -> Selector:
    """The same for candidates of any number. Limits are rounded down to steps of the score, so that counts by step are all that the
    driver gets."""
    scores, models = boosting.fit_rows(found.select(F.pmod("place", F.lit(FOLDS)).cast("int").alias("fold"), "kind", "label", "features"), FOLDS)
    if FOLDS not in models:
        return Selector(None, {})
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    counted = scores.groupBy("kind", step).agg(F.count("*").alias("n"), F.count_if("label").alias("true")).collect()
    limit = lambda kinds: boosting.threshold_of(_by_step(r for r in counted if r["kind"] in kinds), precision)
    together = limit(ALL)
    own = {k: limit((k,)) for k in ALL}
    return Selector(models[FOLDS], {k: max(LEAST, v if v < math.inf else together) for k, v in own.items()})


def _by_step(counted: Iterable) -> list[tuple[float, int, int]]:
    """(score, rows, true rows) by step over all kinds."""
    rows, true = Counter(), Counter()
    for r in counted:
        rows[r["step"]] += r["n"]
        true[r["step"]] += r["true"]
    return [(k / STEPS, rows[k], true[k]) for k in rows]


# Scans ----------------------------------------------------------------------------------------------
def _join(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e, *_ in sorted(spans, key=lambda s: (ALL.index(s[0]), s[1], s[2])))


def redact_text(text: str, spans: list[tuple]) -> str:
    """Each stretch covered by spans becomes the kind of its first span in brackets."""
    out, last = [], 0
    merged: list[list] = []
    for kind, begin, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and begin < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, begin, end])
    for kind, begin, end in merged:
        out += [text[last:begin], f"[{kind.upper()}]"]
        last = end
    return "".join(out) + text[last:]


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "found array<struct<kind: string, start: long, end: long, score: double>>"
)
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_personal_data(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base spans, their digest, all spans as text and as structs.

    Base spans have score 1. The selector is fitted on ``docs`` unless given. Narrow passes, no shuffle but of candidates; offsets are code points of whole texts. A null text counts as empty and has no spans; a null doc_id stays null; repeated rows give
    repeated rows; an empty table gives no rows; other columns are not read.
    """
    chosen = docs.sparkSession.sparkContext.broadcast(selector or fit_selector(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(*s, 1.0) for s in base] + chosen.value.select(text, base)
                spans.sort(key=lambda s: (ALL.index(s[0]), s[1], s[2]))
                n = Counter(k for k, _, _ in base)
                row = [n[k] for k in KINDS] + [hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), [dict(zip(("kind", "start", "end", "score"), s)) for s in spans]]
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), _FOUND]
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def redact(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind; all columns and rows stay."""
    chosen = docs.sparkSession.sparkContext.broadcast(selector or fit_selector(docs))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = base + chosen.value.select(text, base) if text else []
                texts.append(redact_text(text, spans) if spans else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
