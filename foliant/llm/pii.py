"""Personal data: labelers vote on candidate spans, EM weighs the votes, a span classifier decides.

Spans of the base kinds (email, ip, card, phone) follow fixed rules and always stay.
Further candidates come from wide patterns. Labelers (strict patterns, gazetteers,
the words around a candidate) vote for or against each, or abstain. The corpus is
reduced to counts of vote patterns, a table whose size depends on the number of
labelers only; expectation-maximisation over these counts estimates how reliable
each labeler is, and a logistic classifier over the votes, the kind and the length
is trained on the resulting probabilities.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "number", "person", "address")
RANK = {kind: i for i, kind in enumerate(BASE_KINDS + ADDED_KINDS)}

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DIGIT = re.compile(r"[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates beyond the base kinds.
ASSIGNED = re.compile(r"(?i:\b(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3})([^\s\"',;]{6,})")
KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_-])")
NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9][0-9 ().-]{5,28}[0-9](?![\w-])")
PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ([A-ZÀ-Ý][\w'-]{1,30}(?: [A-ZÀ-Ý][\w'-]{1,30})?)")
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")
SPELLED = re.compile(r"[\w.+-]{1,40} ?[\[(]at[\])] ?[\w-]{1,40} ?[\[(]dot[\])] ?\w{2,10}")

# Gazetteers.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "xoxb-", "xoxp-", "AIza", "ya29")
GIVEN_NAMES = frozenset((
    "Alice", "Anna", "Antonio", "Carlos", "Carmen", "Charles", "Claire", "David", "Elena", "Emma", "Hans", "James",
    "Jean", "Johann", "John", "Jose", "Juan", "Karl", "Laura", "Lucia", "Maria", "Marie", "Mary", "Michael", "Paul",
    "Peter", "Pierre", "Robert", "Sofia", "Sophie", "Thomas", "William"))
# Words that announce personal data, and words that follow plain quantities.
CUES = re.compile(r"(?i)(?:\b(?:call|phone|tel|telefon|téléphone|teléfono|mobile|fax|mail|contact|contacto|card|ssn|iban|account|"
                  r"konto|passport|name|key)\b|(?:password|passwd|pwd|secret|token|key)\s{0,3}[=:])\W{0,6}(?:\w{1,12}\W{1,3}){0,2}$")
QUANTITIES = re.compile(r"(?i)\s?(?:%|€|\$|km\b|kg\b|m\b|pages?\b|items?\b|years?\b|euros?\b|dollars?\b)")
DATE = re.compile(r"(?:1[0-9]|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:1[0-9]|20)[0-9]{2}")
NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|0[0-9]{2,4}[ ./-][0-9]{5,8}")
NATIONAL_HERE = re.compile(rf"(?<![\w.+-])(?:{NATIONAL.pattern})(?![\w-])")
LABELERS = ("pattern", "gazetteer", "cue_before", "quantity_after", "mixture", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = floor + len(head.rstrip(LOCAL_CHARS))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, ordered by start and then by kind as listed."""
    found = [(start, "email", end) for start, end in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                parts = [p.lstrip("0") for p in m[0].split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    found.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], RANK[s[1]]))


def _wide_spans(text: str) -> set[tuple[int, str, int]]:
    found = set()
    for m in ASSIGNED.finditer(text) if "=" in text or ":" in text else ():
        found.add((m.start(2), "secret", m.end(2)))
    if DIGIT.search(text):
        for m in KEY.finditer(text):
            if DIGIT.search(m[0]) and not m[0].isdigit():
                found.add((m.start(), "secret", m.end()))
        for shape in (NUMBER, NATIONAL_HERE):  # a national number may stand beside other digits, so it is a candidate of its own
            found.update((m.start(), "number", m.end()) for m in shape.finditer(text))
    if any(t in text for t in TITLES):
        found.update((m.start(1), "person", m.end(1)) for m in PERSON.finditer(text))
    if "at]" in text or "at)" in text:
        found.update((m.start(), "address", m.end()) for m in SPELLED.finditer(text))
    return found


def votes(text: str, start: int, kind: str, end: int, base: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains; by LABELERS."""
    value, before = text[start:end], text[max(0, start - 48): start]
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    strict = base or kind == "address" or kind == "number" and bool(NATIONAL.fullmatch(value)) or kind == "secret" and bool(
        re.fullmatch(r"A[KS]IA[0-9A-Z]{16}|[0-9a-f]{16,64}", value))
    if kind == "person":
        listed = 1 if value.split(" ")[0] in GIVEN_NAMES else 0
    else:
        listed = 1 if kind == "secret" and value.startswith(KEY_PREFIXES) else 0
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    mixture = 0 if kind != "secret" else 1 if switches >= 3 and letters else -1
    shape = -1 if kind == "number" and (DATE.fullmatch(value) or digits < 9) else 1 if kind in BASE_KINDS and digits + letters > 6 else 0
    return (1 if strict else -1 if kind == "number" else 0, listed, 1 if CUES.search(before) else 0,
            -1 if QUANTITIES.match(text, end) else 0, mixture, shape)


def candidates(text: str) -> list[tuple[int, str, int, str]]:
    """Base spans and the wide ones that touch none of them: (start, kind, end, pattern of kind, length and votes).

    Wide ones may overlap each other; they are judged before that is resolved.
    """
    base = base_spans(text)
    starts, reach = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
    more = []
    for span in _wide_spans(text):
        before = bisect_left(starts, span[2])  # base spans that begin before its end; reach is how far any of them goes
        if not before or reach[before - 1] <= span[0]:
            more.append(span)
    out = []
    for is_base, spans in ((True, base), (False, more)):
        for start, kind, end in spans:
            length = 0 if end - start < 10 else 1 if end - start < 20 else 2
            out.append((start, kind, end, f"{kind} {length} " + "".join("-0+"[v + 1] for v in votes(text, start, kind, end, is_base))))
    return sorted(out, key=lambda s: (s[0], RANK[s[1]]))


@dataclass
class Model:
    """Probability that a candidate with a vote pattern is personal data, by pattern, and each labeler's reliability."""

    probability: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, float] = field(default_factory=dict)


def fit_counts(counts: dict[str, int], rounds: int = 60) -> Model:
    """EM over vote pattern counts, then the span classifier on the expected labels."""
    if not counts:
        return Model()
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    ballots = np.array([["-0+".index(c) for c in p.split(" ")[2]] for p in patterns])
    kinds = sorted({p.split(" ")[0] for p in patterns})
    kind = np.array([kinds.index(p.split(" ")[0]) for p in patterns])
    belief = 1 / (1 + np.exp(-1.5 * (ballots - 1).sum(axis=1)))  # the majority begins
    smooth = np.array([[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]])  # labelers are taken to be better than chance
    for _ in range(rounds):
        odds = np.zeros(len(patterns))
        tables = []
        for j in range(ballots.shape[1]):
            counted = np.stack([np.bincount(ballots[:, j], n * w, minlength=3) for w in (1 - belief, belief)]) + smooth
            table = counted / counted.sum(axis=1, keepdims=True)
            tables.append(table)
            odds += np.log(table[1, ballots[:, j]]) - np.log(table[0, ballots[:, j]])
        prior = (np.bincount(kind, n * belief, len(kinds)) + 2) / (np.bincount(kind, n, len(kinds)) + 4)
        belief = 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior))[kind], -30, 30)))
    right = {name: float((t[0, 0] + t[1, 2]) / (t[0, 0] + t[0, 2] + t[1, 0] + t[1, 2])) for name, t in zip(LABELERS, tables)}
    length = np.array([int(p.split(" ")[1]) for p in patterns])
    x = np.concatenate([np.eye(3)[ballots].reshape(len(patterns), -1), np.eye(len(kinds))[kind], np.eye(3)[length]], axis=1)
    weight = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge-penalised logistic fit to soft labels
        p = 1 / (1 + np.exp(-x @ weight))
        gradient = x.T @ (n * (belief - p)) - weight
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(weight))
        step = np.linalg.solve(hessian, gradient)
        weight += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-x @ weight))
    return Model(dict(zip(patterns, p.tolist())), right)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all candidates in ``docs``; the driver sees counts of vote patterns only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if value := text.as_py():
                    seen.update(c[3] for c in candidates(value))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "pattern string, n long")
    return fit_counts({r["pattern"]: r["n"] for r in parts.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def personal_spans(text: str | None, model: Model, threshold: float = 0.5) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, base) of a whole text: base spans, and candidates that the classifier accepts.

    Of accepted candidates that overlap the likeliest stays, then the first, then the longest.
    """
    if not text:
        return []
    out, judged = [], []
    for start, kind, end, pattern in candidates(text):
        if kind in BASE_KINDS:
            out.append((start, kind, end, True))
        elif (p := model.probability.get(pattern, 0.0)) >= threshold:
            judged.append((-p, start, -end, RANK[kind], kind))
    held: list[tuple[int, int]] = []  # accepted places, apart from each other and in order
    for _, start, end, _, kind in sorted(judged):
        i = bisect_left(held, (start, 0))
        if (i == 0 or held[i - 1][1] <= start) and (i == len(held) or held[i][0] >= -end):
            held.insert(i, (start, -end))
            out.append((start, kind, -end, False))
    return sorted(out, key=lambda s: (s[0], RANK[s[1]]))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None,
             threshold: float = 0.5) -> DataFrame:
    """(id, spans) of every row; places count code points, the end is exclusive.

    Fits a model on ``docs`` unless one is given. Null and empty texts have no spans;
    equal rows stay separate; an empty table gives none.
    """
    model = model or fit(docs, text_col)
    names = ["start", "kind", "end", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = [[dict(zip(names, s)) for s in personal_spans(x.as_py(), model, threshold)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", SPANS)]))


def masked(text: str | None, spans: list[tuple[int, str, int, bool]]) -> str | None:
    """The text with each run of touching or overlapping spans replaced by the first one's kind."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", model: Model | None = None,
             threshold: float = 0.5) -> DataFrame:
    """``docs`` with personal data masked in ``text_col``, and ``length_col``, if it is there, brought up to date.

    Texts without personal data, null ones included, stay as they are, and so does their length.
    """
    model = model or fit(docs, text_col)
    columns = docs.columns
    place = columns.index(text_col)
    size = columns.index(length_col) if length_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [personal_spans(x.as_py(), model, threshold) for x in batch.column(place)]
            texts = [masked(x.as_py(), s) for x, s in zip(batch.column(place), spans)]
            out = list(batch.columns)
            out[place] = pa.array(texts, pa.string())
            if size is not None:
                lengths = pa.array([len(t or "") for t in texts], pa.int64()).cast(out[size].type)
                out[size] = pc.if_else(pa.array([bool(s) for s in spans]), lengths, out[size])
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return docs.mapInArrow(run, docs.schema)
