"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percola.llm import ragged
from percola.llm.language import held_out
from percola.llm.statistics import statistics
from percola.session import Staged

#: Statistics of a document, random features, and bins of the score that is calibrated.
STATISTICS, RANDOM, BINS = 18, 192, 400
#: Partial sums that the driver adds up, whatever the number of partitions.
PARTIALS = 16


def document_statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS numbers for each text, all bounded or logarithmic; zeros for a text without words."""
    s = statistics(column)
    words, lines, m = np.maximum(s.n_words, 1), np.maximum(s.n_lines, 1), s.marks
    letters, size = np.maximum(m["upper"] + m["lower"], 1), np.maximum(s.n_bytes, 1)
    per_line = lambda flags: ragged.grouped_sum(flags, s.line_first) / lines
    cols = [
        np.log1p(s.n_words), s.word_chars / words / 10, s.n_symbols / words, m["upper"] / letters, m["digit"] / size * 5,
        m["pipe"] / words, m["bang"] / words, m["high"] / size, s.n_dup_lines / lines, s.n_repeat_words / words,
        s.n_distinct_words / words, s.n_stutters / words, np.log1p(s.n_words / lines), per_line(s.line_ends), per_line(s.line_lower),
        per_line(s.line_marks["symbol"] > 0), per_line(s.line_marks["upper"] * 2 > s.line_marks["lower"]), per_line(s.line_repeats * 2 > s.line_words),
    ]
    out = np.stack([np.asarray(c, float) for c in cols], 1)
    out[s.n_words == 0] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(w.z + b) features of standardised statistics: their products approximate a Gaussian kernel."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.concatenate([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / RANDOM), np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)


def pool_adjacent(count: np.ndarray, total: np.ndarray, prior: float = 0.0) -> np.ndarray:
    """Isotonic means of groups in order, each of `count` cases that add up to `total`; each pool takes one case of the prior in, if any."""
    blocks: list[list[float]] = []
    for c, t in zip(count.tolist(), total.tolist(), strict=True):
        blocks.append([c, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    extra = float(prior > 0)
    return np.concatenate([np.full(int(n), (t + prior) / (c + extra)) for c, t, n in blocks]) if blocks else np.zeros(0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ragged.slices(batch):
            stats = document_statistics(part.column("text")).astype(np.float32)
            rest = [(c, n) for c, n in zip(part.columns, part.schema.names, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in rest], ragged.binary(stats)], [*[n for _, n in rest], "stats"])


def _partial(make):
    """One row of summed vectors for each task: make(stats, label) gives what to add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                got = make(ragged.fixed(part.column("stats"), 4 * STATISTICS, np.float32).astype(float), part.column("label").to_numpy(zero_copy_only=False).astype(float))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], ["sums"])

    return run


def _add_up(key, table):
    total = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist())
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def summed(rows: DataFrame, make) -> np.ndarray | None:
    """make's vectors added up over all rows: within each task, then in PARTIALS groups of tasks, then here."""
    partial = rows.select("stats", "label").mapInArrow(_partial(make), "sums binary").withColumn("g", F.spark_partition_id() % PARTIALS)
    got = partial.groupBy("g").applyInArrow(_add_up, "sums binary").collect()
    return sum(np.frombuffer(r["sums"], float) for r in got) if got else None


def _moments(stats: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(stats)], stats.sum(0), (stats**2).sum(0)])


def fit(rows: DataFrame, ridge: float = 1e-2, width: float = 1.0, seed: int = 7) -> Model:
    """From (stats, label, calibrate): all rows with calibrate false fit the ridge scores, the others calibrate them.

    Normal equations are sums over rows, so tasks send one matrix each and memory does not grow with the
    rows. Isotonic regression sees the calibration scores through a fixed grid of BINS bins.
    Without rows of both parts, scores are 0.5.
    """
    fit_rows, cal_rows = rows.where(~F.col("calibrate")), rows.where("calibrate")
    rng = np.random.Generator(np.random.PCG64(seed))
    frequencies = rng.normal(0, 1 / (width * np.sqrt(STATISTICS)), (STATISTICS, RANDOM))
    model = Model(np.zeros(STATISTICS), np.ones(STATISTICS), frequencies, rng.uniform(0, 2 * np.pi, RANDOM), np.zeros(RANDOM + 1), np.array([0.0]), np.array([0.5]))
    m = summed(fit_rows, _moments)
    if m is None:
        return model
    model.mean = m[1 : STATISTICS + 1] / m[0]
    model.scale = np.sqrt(np.maximum(m[STATISTICS + 1 :] / m[0] - model.mean**2, 1e-8)) + 1e-3

    def normal(stats: np.ndarray, label: np.ndarray) -> np.ndarray:
        x = model.features(stats)
        return np.concatenate([(x.T @ x).ravel(), x.T @ label])

    s = summed(fit_rows, normal)
    gram, target = s[: (RANDOM + 1) ** 2].reshape(RANDOM + 1, RANDOM + 1), s[(RANDOM + 1) ** 2 :]
    penalty = ridge * m[0] / RANDOM * np.eye(RANDOM + 1)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(gram + penalty + 1e-9 * np.eye(RANDOM + 1), target)
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(stats: np.ndarray, label: np.ndarray) -> np.ndarray:
        raw = np.clip(model.raw(stats), edges[0], edges[-1])
        at = np.minimum(((raw - edges[0]) * (BINS / 2.0)).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, label, BINS), np.bincount(at, raw, BINS)])

    h = summed(cal_rows, histogram)
    if h is None:
        h = summed(fit_rows, histogram)
    count, total, place = h[:BINS], h[BINS : 2 * BINS], h[2 * BINS :]
    some = count > 0
    # a slight slope keeps the order of scores within a pool
    level = pool_adjacent(count[some], total[some], total.sum() / count.sum())
    model.knots = place[some] / count[some]
    model.levels = np.maximum.accumulate(level) + 1e-6 * np.arange(some.sum())
    return model


def _apply(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(sent.value)
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(ragged.fixed(batch.column("stats"), 4 * STATISTICS, np.float32).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(raw))], ["doc_id", "held_out", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, staged: Staged | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Statistics of whole texts are measured once and written, 72 bytes a document; fitting and scoring read
    those. Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2; of these, every
    fifth by another hash calibrates. All labelled rows take part. score is the calibrated chance of label 1,
    predicted is 1 at `threshold` or above. labels, lang, source and doc_id are no inputs of a score.

    Null, empty or wordless text: statistics 0, scored like any. Null doc_id: not held out, never labelled.
    Several labels of a doc_id: their greatest; null labels are ignored. Repeated rows: one result each, and
    each counts in fitting. No labels: all scores 0.5. Empty table: empty result.
    """
    staged = staged or Staged(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    measured = staged.put(source.mapInArrow(_measure, "doc_id long, held_out boolean, stats binary"), "statistics")
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label"))
    rows = measured.where(~F.col("held_out")).join(known, "doc_id")
    rows = rows.select("stats", "label", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0).alias("calibrate"))
    model = fit(staged.put(rows, "labelled"))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    out = measured.mapInArrow(_apply(sent), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
