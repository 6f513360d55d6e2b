"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on a few statistics of the whole text (character classes, repetition, word and line
shapes) gives each document its own evidence.  Documents of one path and one host share their evidence: the
rate of good documents of a host is shrunk towards the global rate, that of a path towards its host, each by
the strength that the spread of the rates supports (method of moments), so a site with few documents says
little.  The document's log odds are its own evidence over the training rate plus those of its path, where the
document itself is left out of its site's counts.  Everything about sites is grouped sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.tables import if_small, in_sample, narrow
from recollect.llm.words import binary_column, list_column, plain_pieces, tidy
from recollect.plans.materialize import stored

#: Documented bound of the labelled sample the regression is fitted to.
TRAIN_ROWS = 50_000
PENALTY = 1e-2
STEPS = 30
#: Bounds of the strength (in documents) with which a site is drawn to what is above it.
WEAKEST, STRONGEST = 1.0, 10_000.0
#: Log odds of a document's own evidence are kept within these bounds.
OWN_BOUND = 12.0

FEATURES = (
    "letters", "upper", "digits", "spaces", "stops", "quotes", "marks", "rare_marks", "controls",
    "distinct_words", "distinct_lines", "mean_word", "long_words", "word_ends_in_mark", "words_per_line", "log_words",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


UPPER = _mask(bytes(range(65, 91)))
LETTERS = UPPER | _mask(bytes(range(97, 123))) | _mask(bytes(range(128, 256)))
DIGITS = _mask(bytes(range(48, 58)))
SPACES = _mask(b" \t\n\r\v\f")
STOPS = _mask(b".,;:?!")
QUOTES = _mask(b"'\"()-")
CONTROLS = _mask(bytes(i for i in [*range(32), 127] if i not in b"\t\n\r\v\f"))
MARKS = ~(LETTERS | DIGITS | SPACES | CONTROLS)
RARE = MARKS & ~STOPS & ~QUOTES


def features(raw: bytes | None) -> np.ndarray:
    """Bounded statistics of the whole text; all zero without words."""
    out = np.zeros(len(FEATURES), dtype=np.float32)
    if not raw or not raw.strip():
        return out
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    letters = counts[LETTERS].sum()
    out[0] = letters / n
    out[1] = counts[UPPER].sum() / max(1, letters)
    for i, mask in enumerate((DIGITS, SPACES, STOPS, QUOTES, MARKS, RARE, CONTROLS), 2):
        out[i] = counts[mask].sum() / n
    words, size, long, marked, distinct = 0, 0, 0, 0, set()
    for piece in plain_pieces(raw):
        words += len(piece)
        lengths = np.fromiter(map(len, piece), dtype=np.int64, count=len(piece))
        size += int(lengths.sum())
        long += int((lengths > 20).sum())
        marked += sum(w[-1] < 128 and bool(RARE[w[-1]] or w[-1] == 33) for w in piece)
        distinct.update(map(hash, piece))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[9] = len(distinct) / words
    out[10] = len(set(lines)) / max(1, len(lines))
    out[11] = min(1.0, size / words / 20)
    out[12], out[13] = long / words, marked / words
    out[14] = min(1.0, words / max(1, len(lines)) / 50)
    out[15] = min(1.0, np.log1p(words) / 12)
    return out


@dataclass(frozen=True)
class Model:
    """Weights on standardised features, and the rate of good documents it was trained at."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -OWN_BOUND, OWN_BOUND)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Penalised logistic regression by Newton steps; with one class only, its smoothed share for all."""
    rate = (y.sum() + 1) / (len(y) + 2)
    weights = np.zeros(len(FEATURES) + 1)
    weights[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), weights, float(rate))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    ridge = np.r_[np.full(len(FEATURES), penalty * np.sqrt(len(y))), 1e-9]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        grad = z.T @ (p - y) + ridge * weights
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(ridge + 1e-6)
        step = np.linalg.solve(curve, grad)
        weights = weights - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, weights, float(rate))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, host, path, x): the features of every row of ``docs`` (doc_id, text, host, path)."""

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in binary_column(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "tie", "host", "path")), list_column(x, pa.float32())],
                names=["doc_id", "tie", "host", "path", "x"],
            )

    rows = docs.withColumn("tie", F.xxhash64("text")).select("doc_id", "tie", "host", "path", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(measure, f"doc_id {kind}, tie bigint, host string, path string, x array<float>")


def train(rows: DataFrame, labels: DataFrame, train_rows: int) -> Model:
    """Fit to at most ``train_rows`` labelled rows, by id hash."""
    joined = rows.select("doc_id", "tie", "x").join(labels, "doc_id")
    rows = joined.select(F.xxhash64("doc_id", "tie").alias("turn"), "label", "x")
    sample = rows.filter(in_sample(F.col("turn"), joined.count(), train_rows)).orderBy("turn").limit(train_rows).toArrow()
    x = np.array(sample.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample.column("label").to_numpy().astype(np.float64))


def _key(column: Column) -> Column:
    """Null is a site of its own."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))


def strength(groups: DataFrame, n: Column, s: Column, prior: Column) -> float:
    """Beta prior strength from the spread of group rates around their priors beyond what counting explains."""
    rate = s / n
    usual = prior * (1 - prior)
    sums = groups.filter(n >= 2).agg(
        F.sum(n * F.pow(rate - prior, 2)).alias("seen"), F.sum(usual).alias("chance"), F.sum((n - 1) * usual).alias("scale")
    )
    r = sums.first()
    if not r.scale:
        return STRONGEST
    share = max((r.seen - r.chance) / r.scale, 1e-9)  # of the variance that lies between groups
    return float(np.clip(1 / share - 1, WEAKEST, STRONGEST))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Sums of each (host, path) with those of its host, the global rate and both strengths.

    ``evidence`` has (host, path, e): e is 1 for a good document, 0 for a bad one, or a probability.
    """
    paths = stored(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    all_of = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = float(((all_of[1] or 0.0) + 1) / ((all_of[0] or 0) + 2))
    host_k = strength(hosts, F.col("host_n"), F.col("host_s"), F.lit(rate))
    both = paths.join(hosts, "host")
    prior = (F.col("host_s") + host_k * rate) / (F.col("host_n") + host_k)
    path_k = strength(both, F.col("n"), F.col("s"), prior)
    return both, rate, host_k, path_k


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_col: str = "quality", threshold: float = 0.25, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Per row of ``docs``: id, tie (text hash), own, host_rate, path_rate, score, keep.

    ``own`` is the probability from the text alone, the rates are those of the document's host and path
    without the document, ``score`` combines them and ``keep`` is score >= ``threshold``.

    Null and empty texts have all statistics zero.  Null hosts and paths are sites of their own.  An id with
    several labels takes the smallest; rows sharing an id share its label.  Rows without an id and labels other
    than 0 and 1 are not learned from.  Without labels of both classes the texts say nothing and all rows stay.
    Texts of any length count whole.  Repeated rows are judged one by one; other columns are not passed on.  An
    empty table gives none.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col, host=_key(docs[host_col]), path=_key(docs[path_col]))
    seen = stored(measured(rows), "measured")
    named = narrow(labels, doc_id="doc_id", label=label_col).filter("doc_id is not null and label in (0, 1)")
    named = stored(named.groupBy("doc_id").agg(F.min("label").alias("label")), "labels")
    named = if_small(named, 1_000_000)
    model = train(seen, named, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(seen.dtypes)["doc_id"]

    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().astype(np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "tie", "host", "path")), pa.array(shared.value.log_odds(x))],
                names=["doc_id", "tie", "host", "path", "odds"],
            )

    judged = seen.mapInArrow(judge, f"doc_id {kind}, tie bigint, host string, path string, odds double")
    own = 1 / (1 + F.exp(-F.col("odds")))
    evidence = judged.join(named, "doc_id", "left").withColumn("own", own)
    evidence = stored(evidence.withColumn("e", F.coalesce(F.col("label").cast("double"), F.col("own"))).drop("label"), "evidence")
    sites, rate, host_k, path_k = site_posteriors(evidence)
    joined = evidence.join(if_small(sites, 200_000), ["host", "path"])
    host_rate = (F.col("host_s") - F.col("e") + host_k * rate) / (F.col("host_n") - 1 + host_k)
    path_rate = (F.col("s") - F.col("e") + path_k * F.col("host_rate")) / (F.col("n") - 1 + path_k)
    odds = F.col("odds") - float(np.log(model.rate / (1 - model.rate))) + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    scored = joined.withColumn("host_rate", inside(host_rate)).withColumn("path_rate", inside(path_rate))
    return scored.withColumn("score", 1 / (1 + F.exp(-odds))).select(
        F.col("doc_id").alias(id_col), "tie", "own", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep")
    )


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, labels).drop("tie")
