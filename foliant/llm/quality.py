"""Quality classifier by co-training: the content and the metadata of documents as two views.

Each view has a logistic classifier. In every round each one is fitted to the
labelled documents and to those documents that the other view was sure of, and is
calibrated on labelled documents that no fit has seen. The calibrated views are
combined by a third logistic fit on these. All documents take part, whatever their
number: fits are distributed, and only coefficients reach the driver. Copies of a text
count once for the content view and each with its own metadata and label for the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.shared import empty_if_null, free_names, text_key, written

ROUNDS = 2
SURE = 0.97  # calibrated probability from which a view teaches the other
CALIBRATION = 4  # one labelled text in so many is kept for calibration
THRESHOLD = 0.5
META_COLUMNS = (("lang", 8), ("source", 32))
LENGTHS = 22
ROWS = 1000
RIDGE = 1e-3

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset((
    b"the", b"of", b"and", b"to", b"in", b"a", b"is", b"that", b"it", b"was", b"for", b"on", b"with", b"as", b"at", b"by", b"be",
    b"de", b"la", b"le", b"les", b"et", b"des", b"du", b"en", b"un", b"une", b"que", b"qui", b"pour", b"pas", b"est", b"sur", b"dans", b"par",
    b"der", b"die", b"das", b"und", b"den", b"von", b"zu", b"mit", b"ist", b"im", b"nicht", b"ein", b"eine", b"auf", b"dem",
    b"el", b"los", b"las", b"y", b"se", b"del", b"por", b"con", b"no", b"su", b"para", b"al", b"lo"))
CONTENT = ("log_words", "upper", "digits", "symbols", "bars", "bangs", "word_length", "long_words", "distinct_words", "distinct_pairs",
           "top_word", "stop_words", "marked_words", "line_words", "repeated_lines", "accents", "bare", "log_words_distinct")
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-|"]] = True
_MARKED = re.compile(rb"[!#$%&*+=<>|~^]")


def content_features(text: str | None) -> list[float]:
    """Figures of a whole text, by CONTENT."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(CONTENT) - 2) + [1.0, 0.0]
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = int(bytes_.sum())
    upper, lower = int(bytes_[_UPPER].sum()), int(bytes_[_LOWER].sum())
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    log_words = np.log1p(n)
    distinct = len(counts) / n
    stops = sum(k for w, k in counts.items() if w in STOP_WORDS) / n
    marked = sum(k for w, k in counts.items() if _MARKED.search(w)) / n
    letters = max(1, size - int(bytes_[32]) - int(bytes_[10]))
    return [log_words, upper / max(1, upper + lower), bytes_[48:58].sum() / size, bytes_[_SYMBOLS].sum() / size, bytes_[124] / size,
            bytes_[33] / size, min(letters / n, 40) / 10, sum(k for w, k in counts.items() if len(w) > 18) / n, distinct, pairs,
            max(counts.values()) / n, stops, marked, np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
            bytes_[128:].sum() / size, 0.0, log_words * distinct]


def meta_features(values: list, length, buckets: tuple[int, ...]) -> list[float]:
    """One place set for each hashed column (null is a value of its own) and for the length's power of two."""
    out = []
    for value, width in zip(values, buckets):
        place = zlib.crc32(b"" if value is None else b"v" + str(value).encode()) % width
        out += [1.0 if i == place else 0.0 for i in range(width)]
    size = 0 if length is None or length < 1 else min(LENGTHS - 1, int(length).bit_length())
    return out + [1.0 if i == size else 0.0 for i in range(LENGTHS)]


def _views(batch: pa.RecordBatch, first: int, buckets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a batch that has text, length and the hashed columns from column ``first``."""
    content = np.array([content_features(x.as_py()) for x in batch.column(first)], float).reshape(batch.num_rows, len(CONTENT))
    rest = [batch.column(i).to_pylist() for i in range(first + 1, first + 2 + len(buckets))]
    meta = np.array([meta_features(list(v), length, buckets) for length, *v in zip(*rest)], float).reshape(batch.num_rows, sum(buckets) + LENGTHS)
    return content, meta


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows, so that a task holds the figures of a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _inputs(docs: DataFrame, text_col: str, length_col: str, meta_columns) -> tuple[list[Column], tuple[int, ...]]:
    """Text, length and metadata columns; those that are absent count as null."""
    def there(name, kind):
        return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind)

    return ([F.col(f"`{text_col}`").cast("string").alias("_text"), there(length_col, "long").alias("_length"),
             *[there(name, "string").alias(f"_meta_{i}") for i, (name, _) in enumerate(meta_columns)]],
            tuple(width for _, width in meta_columns))


def features(docs: DataFrame, id_col: str, text_col: str, length_col: str, meta_columns) -> DataFrame:
    """(id, k1, k2, content, meta) of every row, written."""
    inputs, buckets = _inputs(docs, text_col, length_col, meta_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            content, meta = _views(batch, 3, buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(content), _lists(meta)], names=["id", "k1", "k2", "content", "meta"])

    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *text_key(empty_if_null(F.col(f"`{text_col}`").cast("string"))), *inputs)
    return written(frame.mapInArrow(run, "id long, k1 long, k2 long, content array<double>, meta array<double>"))


@dataclass
class Linear:
    weights: list[float]
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.weights) + self.bias

    def column(self, name: str) -> Column:
        return F.aggregate(F.zip_with(F.col(name), F.array(*map(F.lit, self.weights)), lambda a, b: a * b), F.lit(self.bias), lambda s, x: s + x)


@dataclass
class Model:
    """Two views, the scale that calibrates each one's odds, and their combination."""

    content: Linear
    meta: Linear
    scales: tuple[Linear, Linear]
    both: Linear

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(calibrated probability by content, by metadata, combined) that a document is good."""
        a = np.clip(self.scales[0].odds(self.content.odds(content)[:, None]), -30, 30)
        b = np.clip(self.scales[1].odds(self.meta.odds(meta)[:, None]), -30, 30)
        c = np.clip(self.both.odds(np.stack([a, b], axis=1)), -30, 30)
        return tuple(1 / (1 + np.exp(-z)) for z in (a, b, c))


def _fitted(rows: DataFrame, column: str, width: int, ridge: float = RIDGE) -> Linear:
    """Logistic fit to ``y`` with weight ``w``; constant where the rows have one class only."""
    seen = rows.agg(F.sum(F.when(F.col("y") == 1, F.col("w"))).alias("good"), F.sum(F.when(F.col("y") == 0, F.col("w"))).alias("bad")).first()
    if not seen["good"] or not seen["bad"]:
        return Linear([0.0] * width, float(np.log(((seen["good"] or 0) + 1) / ((seen["bad"] or 0) + 1))))
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=ridge, maxIter=40, tol=1e-6)
    model = fit.fit(rows.select(array_to_vector(F.col(column)).alias("x"), F.col("y").cast("double"), F.col("w").cast("double")))
    return Linear(model.coefficients.toArray().tolist(), float(model.intercept))


def _clear_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(label_id, y): one row for each id whose labels agree by majority; null labels don't count."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(
        F.avg(F.col(label_col).cast("double")).alias("mean")).where("mean <> 0.5").select("label_id", (F.col("mean") > 0.5).cast("int").alias("y"))


def fit(found: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", rounds: int = ROUNDS,
        sure: float = SURE) -> Model | None:
    """The co-trained model of the features ``found``; None if the labels don't show two classes."""
    y = _clear_labels(labels, label_id, label_col)
    decided = lambda mean: F.when(mean != 0.5, (mean > 0.5).cast("int"))
    # Rows of one text and one metadata are one row that weighs as much: its labels count for it, and its open rows are taught.
    alike = found.join(y, found["id"] == y["label_id"], "left").groupBy("k1", "k2", "meta").agg(
        F.first("content").alias("content"), F.count("*").alias("n"), F.count("y").alias("marks"), F.sum("y").alias("goods"))
    label = decided(F.col("goods") / F.when(F.col("marks") > 0, F.col("marks")))
    alike = written(alike.select("k1", "k2", "content", "meta", "n", "marks", "goods", label.alias("label"),
                                 (F.col("n") - F.when(label.isNull(), 0).otherwise(F.col("marks"))).alias("open"),
                                 (F.pmod(F.xxhash64("k1", "k2"), F.lit(CALIBRATION)) == 0).alias("held")))
    # The content view has one row a text; its metadata is the mean of all its rows, whose odds are the mean of theirs.
    texts = alike.groupBy("k1", "k2").agg(
        F.first("content").alias("content"), vector_to_array(Summarizer.mean(array_to_vector("meta"), F.col("n").cast("double"))).alias("meta"),
        F.sum("marks").alias("marks"), F.sum("goods").alias("goods"), F.first("held").alias("held"))
    texts = written(texts.select("content", "meta", decided(F.col("goods") / F.when(F.col("marks") > 0, F.col("marks"))).alias("label"), "held"))
    labelled = alike.where("label is not null")
    if labelled.select("label").distinct().count() < 2:
        return None
    widths = tuple(labelled.select(F.size("content"), F.size("meta")).first())
    # Of each view: its labelled rows, and those that the other view may teach it.
    own = (texts.where("label is not null").select("content", "label", "held", F.lit(1.0).alias("w")),
           labelled.select("meta", "label", "held", F.col("marks").cast("double").alias("w")))
    others = (texts.where("label is null").select("content", "meta", F.lit(1.0).alias("w")),
              alike.where("open > 0").select("content", "meta", F.col("open").cast("double").alias("w")))
    known = [{r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("w").alias("w")).collect()} for rows in own]
    taught: list[tuple[Linear, Linear] | None] = [None, None]  # what each view was taught by: the other and its scale
    for turn in range(rounds + 1):
        views = []
        for i, column in enumerate(("content", "meta")):
            rows = own[i].where("not held").select(column, F.col("label").alias("y"), "w")
            if taught[i]:
                other, scale = taught[i]
                odds = other.column(("meta", "content")[i]) * scale.weights[0] + scale.bias
                edge = float(np.log(sure / (1 - sure)))
                new = others[i].select(column, odds.alias("odds"), "w").where(F.abs("odds") >= edge)
                new = new.select(column, (F.col("odds") > 0).cast("int").alias("y"), "w")
                # Together they weigh no more than the labels do, and each class as much as among the labels at most.
                share = {r["y"]: r["w"] for r in new.groupBy("y").agg(F.sum("w").alias("w")).collect()}
                weight = {c: min(1.0, w / share[c]) for c, w in known[i].items() if share.get(c)}
                rows = rows.union(new.select(column, "y", F.col("w") * F.when(F.col("y") == 1, weight.get(1, 0.0)).otherwise(weight.get(0, 0.0))))
            views.append(_fitted(rows, column, widths[i]))
        held = written(labelled.where("held").select(
            F.array(views[0].column("content")).alias("a"), F.array(views[1].column("meta")).alias("b"), F.col("label").alias("y"),
            F.col("marks").cast("double").alias("w")))
        scales = tuple(_fitted(held, c, 1, 1e-6) for c in ("a", "b"))
        taught = [(views[1], scales[1]), (views[0], scales[0])]
    pair = held.select(F.array(*[F.col(c)[0] * s.weights[0] + s.bias for c, s in zip("ab", scales)]).alias("ab"), "y", "w")
    return Model(views[0], views[1], scales, _fitted(pair, "ab", 2, RIDGE))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
                    meta_columns=META_COLUMNS, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(id, p_content, p_meta, score, keep) of every row.

    Null texts count as empty and null metadata as a value of its own. Labels that
    contradict each other by halves, null labels and labels without a document don't
    count. Without labels of both classes nothing can be learnt: scores are null and
    everything is kept. Equal rows get equal scores; an empty table gives no rows.
    """
    found = features(docs, id_col, text_col, length_col, meta_columns)
    model = fit(found, labels, **options)
    if model is None:
        none = F.lit(None).cast("double")
        return found.select("id", none.alias("p_content"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            views = [np.asarray(batch.column(i).flatten()).reshape(n, -1) for i in (1, 2)] if n else [np.zeros((0, len(v.weights))) for v in (model.content, model.meta)]
            a, b, c = model.scores(*views)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= threshold)],
                                             names=["id", "p_content", "p_meta", "score", "keep"])

    return found.select("id", "content", "meta").mapInArrow(run, "id long, p_content double, p_meta double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
              meta_columns=META_COLUMNS, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``score_documents`` keeps.

    The fitted model is applied to the rows themselves, so that ids may repeat.
    """
    model = fit(features(docs, id_col, text_col, length_col, meta_columns), labels, **options)
    if model is None:
        return docs
    inputs, buckets = _inputs(docs, text_col, length_col, meta_columns)
    own = len(docs.columns)
    inputs = [c.alias(name) for c, name in zip(inputs, free_names(docs.columns, *[f"_in_{i}" for i in range(len(inputs))]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = model.scores(*_views(batch, own, buckets))[2] >= threshold
            yield batch.filter(pa.array(keep)).select(list(range(own)))

    return docs.select("*", *inputs).mapInArrow(run, T.StructType(docs.schema.fields))
