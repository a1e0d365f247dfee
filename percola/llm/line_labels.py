"""Quality rules from lines labelled by a linear-chain conditional random field."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percola.llm import ragged
from percola.llm.statistics import Stats, statistics

#: Labelled documents that the field is fitted to, and lines of a training sequence.
TRAIN_DOCS, TRAIN_LINES = 4000, 64
CONTENT, BOILERPLATE = 0, 1
FEATURES = 22


def line_features(s: Stats) -> np.ndarray:
    """A row of 0/1 features for each line that has a word."""
    words, size = s.line_words, np.maximum(s.line_bytes, 1)
    m = s.line_marks
    letters = np.maximum(m["upper"] + m["lower"], 1)
    edge = np.zeros(len(words), bool)
    starts = s.line_first[:-1][s.n_lines > 0]
    edge[starts] = True
    last = np.zeros(len(words), bool)
    last[s.line_first[1:][s.n_lines > 0] - 1] = True
    cols = [
        np.ones(len(words), bool), words <= 2, (words > 2) & (words <= 6), (words > 6) & (words <= 15), words > 15,
        m["symbol"] > 0, m["symbol"] * 20 > size, m["symbol"] * 8 > size, m["upper"] * 2 > letters, m["upper"] * 4 > letters,
        m["pipe"] > 0, m["bang"] * 3 > words, m["digit"] > 0, m["digit"] * 5 > size, ~s.line_ends, s.line_lower, s.line_again,
        s.line_stutters * 3 > words, s.line_repeats * 2 > words, s.line_repeats > 0, edge, last,
    ]
    return np.stack(cols, 1).astype(np.float32)


@dataclass
class Field:
    """A linear-chain CRF with two labels: weights of features, of the step from label to label, and of the first label."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    @staticmethod
    def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, ridge: float = 1.0, rate: float = 0.15, chain: bool = True) -> Field:
        """Maximum penalised likelihood by Adam; forward-backward runs over all sequences a line at a time. Without chain, lines are independent."""
        theta = np.zeros(2 * FEATURES + 6)
        if not sequences:
            return Field(theta[:-6].reshape(-1, 2), np.zeros((2, 2)), np.zeros(2))
        sequences = sorted(sequences, key=lambda q: -len(q[1]))
        size = np.array([len(y) for _, y in sequences])
        n, longest = len(size), int(size[0])
        x = np.zeros((longest, n, FEATURES), np.float32)
        y = np.zeros((longest, n), np.int64)
        for i, (a, b) in enumerate(sequences):
            x[: len(b), i], y[: len(b), i] = a, b
        live = np.array([(size > t).sum() for t in range(longest)])
        on = np.arange(n)[None, :] < live[:, None]
        flat = x[on]
        gold_emit = np.stack([flat.T @ (y[on] == c).astype(np.float32) for c in (0, 1)], 1)
        both = on[1:] & on[:-1]
        gold_step = np.array([[(both & (y[:-1] == a) & (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        gold_start = np.array([(y[0] == c).sum() for c in (0, 1)], float)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for it in range(1, rounds + 1):
            emit, step, start = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
            scores = flat @ emit.astype(np.float32)
            if not chain:
                p = np.exp(scores - np.logaddexp(scores[:, :1], scores[:, 1:]))
                grad = np.concatenate([(gold_emit - flat.T @ p).ravel(), np.zeros(6)]) - ridge * theta
                theta, first, second = Field._step(theta, grad / size.sum(), first, second, it, rate)
                continue
            e = np.zeros((longest, n, 2))
            e[on] = scores
            ahead, back = np.full((longest, n, 2), 0.0), np.zeros((longest, n, 2))
            ahead[0] = e[0] + start
            for t in range(1, longest):
                k = live[t]
                ahead[t, :k] = np.logaddexp(ahead[t - 1, :k, :1] + step[0], ahead[t - 1, :k, 1:] + step[1]) + e[t, :k]
            for t in range(longest - 2, -1, -1):
                k = live[t + 1]
                on_next = e[t + 1, :k] + back[t + 1, :k]
                back[t, :k] = np.logaddexp(step[:, 0] + on_next[:, :1], step[:, 1] + on_next[:, 1:])
            norm = np.logaddexp.reduce(ahead[0] + back[0], 1)
            p = np.exp(np.minimum(ahead + back - norm[None, :, None], 0.0)) * on[:, :, None]
            onward = e[1:] + back[1:] - norm[None, :, None]
            pair = np.array([[np.exp(np.minimum(ahead[:-1, :, i] + step[i, j] + onward[:, :, j], 0.0))[both].sum() for j in (0, 1)] for i in (0, 1)])
            grad = np.concatenate([(gold_emit - flat.T @ p[on].astype(np.float32)).ravel(), (gold_step - pair).ravel(), gold_start - p[0].sum(0)]) - ridge * theta
            theta, first, second = Field._step(theta, grad / size.sum(), first, second, it, rate)
        return Field(theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:])

    @staticmethod
    def _step(theta: np.ndarray, grad: np.ndarray, first: np.ndarray, second: np.ndarray, it: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One ascent by Adam."""
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        return theta + rate * (first / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.999**it)) + 1e-8), first, second

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest labels of all lines; first has each text's first line, and the end. All texts take a line at a time."""
        n = np.diff(first)
        out = np.zeros(len(features), np.int8)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        if not len(order):
            return out
        size, begin = n[order], first[:-1][order]
        e = features @ self.emit.astype(np.float32)
        best = e[begin] + self.start
        from_ = np.zeros((len(features), 2), np.int8)
        final = np.zeros((len(order), 2))
        final[:] = best
        live = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
        for t in range(1, size[0]):
            k = live[t]
            a, b = final[:k, :1] + self.step[0], final[:k, 1:] + self.step[1]
            from_[begin[:k] + t] = b > a
            final[:k] = np.maximum(a, b) + e[begin[:k] + t]
        label = (final[:, 1] > final[:, 0]).astype(np.int8)
        out[begin + size - 1] = label
        for t in range(size[0] - 1, 0, -1):
            k = live[t]
            label[:k] = from_[begin[:k] + t, label[:k]]
            out[begin[:k] + t - 1] = label[:k]
        return out


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = 1 << np.arange(FEATURES, dtype=np.int64)
    for batch in batches:
        for part in ragged.slices(batch):
            s = statistics(part.column("text"))
            bits = line_features(s).astype(np.int64) @ weights
            rows = [bits[a:b].tolist() for a, b in zip(s.line_first[:-1], s.line_first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(rows, pa.list_(pa.int64()))], ["quality", "lines"])


def fit_field(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Field:
    """Fit the field to a bounded sample of labelled documents: the train_docs with the least hashes of (doc_id, quality).

    A line of a document of quality 0 counts as boilerplate; a line of one of quality 1 as content, unless
    it repeats an earlier line. A fit without the chain then moves lines that look like the other kind. From each document come at most 4 runs of train_lines lines.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", "quality"), "doc_id").limit(train_docs)
    # train_docs rows at most
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    rows = text.mapInArrow(_training_lines, "quality int, lines array<long>").select("quality", F.slice("lines", 1, 4 * train_lines).alias("lines")).toLocalIterator()
    sequences, good = [], []
    again = 16
    for r in sorted((r["quality"], tuple(r["lines"])) for r in rows):
        bits = np.array(r[1], np.int64)
        x = ((bits[:, None] >> np.arange(FEATURES)) & 1).astype(np.float32)
        y = np.where((r[0] == 0) | (x[:, again] > 0), BOILERPLATE, CONTENT)
        sequences += [(x[i : i + train_lines], y[i : i + train_lines]) for i in range(0, len(y), train_lines)]
        good += [r[0] == 1] * -(-len(y) // train_lines)
    # documents' labels are coarse: lines alone first, then the chain on what those say of each line
    alone = Field.fit(sequences, chain=False)
    finer = []
    for (x, y), ok in zip(sequences, good, strict=True):
        odds = x @ (alone.emit[:, BOILERPLATE] - alone.emit[:, CONTENT])
        finer.append((x, np.where(odds > 3, BOILERPLATE, y) if ok else np.where(odds > 0, BOILERPLATE, CONTENT)))
    return Field.fit(finer)


def _judge(model, least_words: int, most_repeated: int, least_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = pickle.loads(model.value)
        for batch in batches:
            for part in ragged.slices(batch):
                s = statistics(part.column("text"))
                label = field.viterbi(line_features(s), s.line_first)
                content = ragged.grouped_sum(np.where(label == CONTENT, s.line_words, 0), s.line_first)
                failed = (s.n_words < least_words) | (100 * s.n_repeat_words > most_repeated * s.n_words)
                share = content / np.maximum(s.n_words, 1)
                rest = [(c, n) for c, n in zip(part.columns, part.schema.names, strict=True) if n != "text"]
                counts = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [*[c for c, _ in rest], *[pa.array(c.astype(np.int64)) for c in counts], pa.array(failed), pa.array(share), pa.array(~failed & (share >= least_content))],
                    [*[n for _, n in rest], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
                )

    return run


def quality_rules(
    docs: DataFrame, field: Field, least_words: int = 50, most_repeated: int = 50, least_content: float = 0.5, key: str = "doc_id"
) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept) for each row of docs.

    base_failed: fewer than least_words words, or more than most_repeated percent of them in three-word
    windows found twice or more. Viterbi decoding labels the lines of whole texts; content_share is the
    share of words in content lines, and a document is kept if its base holds and the share is at least
    least_content. Texts stay where they are read; nothing is shuffled.

    Null, empty or wordless text: counts 0, base failed. Null or repeated keys: a row each. Empty table:
    empty result. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select(key, "text").mapInArrow(_judge(model, least_words, most_repeated, least_content), schema)
