"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

For every character n-gram the number of toxic and of clean training documents that hold it is counted over
all of them.  The log ratio of the two (smoothed) frequencies scales the n-gram's presence, and a logistic
regression on the scaled presences is fitted to a bounded sample of training rows.  Only n-grams whose ratio
stands out from its standard error enter the regression; the rest would be noise in long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.tables import if_small, in_sample, narrow
from recollect.llm.words import list_column
from recollect.plans.materialize import stored

SIZES = (3, 4, 5)
#: Documented bound of the sample the regression is fitted to.
TRAIN_ROWS = 20_000
#: How many standard errors an n-gram's log ratio must be from zero to be a feature; all that are, are.
DEVIATION = 4.0
PENALTY = 1e-3
STEPS = 400
HELD_COUNTS = 4_000_000
#: Presences the fit works on at once.
HELD_PRESENCES = 1_000_000
PIECE_CHARS = 2_000_000
FILTER_BITS = 22


def ngram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """32-bit hashes of all n-grams of the lower-cased text, white space runs as one space, piece by piece."""
    joined = " " + " ".join((text or "").lower().split()) + " "
    step = PIECE_CHARS
    for at in range(0, len(joined), step):
        chars = np.frombuffer(joined[at : at + step + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        value = chars[:0]
        for n in range(1, max(SIZES) + 1):
            if len(chars) < n:
                break
            value = chars * np.uint32(1) if n == 1 else value[: len(chars) - n + 1] * np.uint32(0x01000193) ^ chars[n - 1 :]
            if n in SIZES:
                mixed = (value ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield (mixed ^ mixed >> np.uint32(15)) * np.uint32(0xC2B2AE35)


def distinct_hashes(text: str | None) -> np.ndarray:
    parts = list(ngram_hashes(text))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)


def class_counts(train: DataFrame) -> DataFrame:
    """(ngram, toxic, clean): documents of each class that hold the n-gram, over all rows (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def out() -> pa.RecordBatch:
            both = [np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for h in held]
            keys = np.union1d(both[0][0], both[1][0])
            columns = [np.zeros(len(keys), dtype=np.int64) for _ in held]
            for column, (k, n) in zip(columns, both, strict=True):
                column[np.searchsorted(keys, k)] = n
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(columns[1]), pa.array(columns[0])], names=["ngram", "toxic", "clean"]
            )

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = distinct_hashes(text)
                held[int(label)].append(found)
                size += len(found)
                if size > HELD_COUNTS:
                    yield out()
                    held, size = [[], []], 0
        if size:
            yield out()

    counted = train.select("text", "label").mapInArrow(count, "ngram bigint, toxic bigint, clean bigint")
    return counted.groupBy("ngram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Classifier:
    """Sorted n-gram hashes, their log-count ratios and weights, and the intercept."""

    ngrams: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float

    def filter_table(self) -> np.ndarray:
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        table[self.ngrams >> np.uint32(32 - FILTER_BITS)] = True
        return table

    def places(self, text: str | None, table: np.ndarray) -> np.ndarray:
        """Numbers of the features the text holds."""
        if not len(self.ngrams):
            return np.zeros(0, dtype=np.int64)
        found = [h[table[h >> np.uint32(32 - FILTER_BITS)]] for h in ngram_hashes(text)]
        hits = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.ngrams, hits), len(self.ngrams) - 1)
        return at[self.ngrams[at] == hits]

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + (self.weights * self.ratios)[places].sum()))))


def fit(
    column: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic regression on ratio-scaled presences (Adam, full batches).

    Row i holds the next ``sizes[i]`` feature numbers of ``column``.
    """
    n, ends = len(sizes), np.r_[0, np.cumsum(sizes)]
    cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(0, ends[-1] + 1, HELD_PRESENCES)), n]) if n else np.zeros(1, dtype=int)
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    rate = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    w = np.zeros(len(ratios) + 1)
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        scaled, slope, bias = w[:-1] * ratios, np.zeros(len(ratios)), 0.0
        for first, last in parts:
            own = column[ends[first] : ends[last]]
            row = np.repeat(np.arange(last - first), sizes[first:last])
            margin = w[-1] + np.bincount(row, scaled[own], last - first)
            error = (1 / (1 + np.exp(-margin)) - labels[first:last]) / n
            slope += np.bincount(own, error[row], len(ratios))
            bias += error.sum()
        grad = np.r_[slope * ratios + penalty * w[:-1] / np.sqrt(n), bias]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def train_classifier(train: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Fit to (doc_id, text, label): counts over all rows, the regression on ``train_rows`` rows by id hash."""
    spark = train.sparkSession
    sizes = train.agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1))).first()
    none = np.zeros(0)
    if not sizes[0] or not sizes[1]:  # one class only: its share is all there is to say
        rate = (sizes[0] + 1) / (sizes[0] + sizes[1] + 2)
        return Classifier(none.astype(np.uint32), none, none, float(np.log(rate / (1 - rate))))
    ratio = F.log((F.col("toxic") + 1) / (sizes[0] + 2)) - F.log((F.col("clean") + 1) / (sizes[1] + 2))
    spread = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    scaled = class_counts(train).filter(F.col("toxic") + F.col("clean") > 2).select("ngram", ratio.alias("ratio"), (ratio / spread).alias("z"))
    chosen = scaled.filter(F.abs("z") >= DEVIATION).select("ngram", "ratio").toArrow()
    ngrams = chosen.column("ngram").to_numpy().astype(np.uint32)
    order = np.argsort(ngrams)
    model = Classifier(ngrams[order], chosen.column("ratio").to_numpy()[order], np.ones(len(order)), 0.0)
    shared = spark.sparkContext.broadcast(model)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, shared.value.filter_table()
        for batch in batches:
            places = [own.places(t, table) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("label"), list_column(places, pa.int32())], names=["turn", "label", "places"])

    rows = train.select(F.xxhash64("doc_id", "text").alias("turn"), "text", F.col("label").cast("int").alias("label"))
    rows = rows.filter(in_sample(F.col("turn"), sizes[0] + sizes[1], train_rows))
    sample = rows.mapInArrow(featurise, "turn bigint, label int, places array<int>").orderBy("turn").limit(train_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("places").flatten().to_numpy(), np.diff(b.column("places").offsets.to_numpy()), b.column("label").to_numpy()) for b in batches]
        column, sizes, labels = (np.concatenate(x) for x in zip(*parts, strict=True))
        weights, intercept = fit(column, sizes, labels.astype(float), shared.value.ratios)
        yield pa.RecordBatch.from_arrays([list_column([weights], pa.float64()), pa.array([intercept])], names=["weights", "intercept"])

    learned = sample.mapInArrow(learn, "weights array<double>, intercept double").toArrow()  # the sample stays on an executor
    model.weights, model.intercept = learned.column("weights").combine_chunks().flatten().to_numpy(), learned.column("intercept")[0].as_py()
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: the crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_texts(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null is an empty text, and empty texts get what the intercept says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = narrow(docs, id=id_col, text=text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, shared.value.filter_table()
        for batch in batches:
            scores = [own.score(own.places(t, table)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(score, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def labelled(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, text, label) of the rows that may be learned from; an id with several labels takes the largest."""
    rows = narrow(docs, doc_id="doc_id", text="text").filter(~held_out(F.col("doc_id")))
    named = narrow(labels, doc_id="doc_id", label=label_col).filter("doc_id is not null and label in (0, 1)")
    named = named.groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("doc_id")))
    return rows.join(if_small(named, 1_000_000), "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from ``threshold`` on).

    Labels other than 0 and 1 and rows without an id are not learned from; every row is scored.  Without labels
    of both classes every score is the same.
    """
    model = train_classifier(stored(labelled(docs, labels, "toxic"), "labelled"))
    return score_texts(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
