"""Removal of recurring lines by a fixed-depth tree of line templates with open fields."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percola.llm import ragged
from percola.session import Staged

#: Words that the tree looks at below the count of words, and the hundredths of a line's words that stay when a field is left open.
DEPTH, PERCENT = 3, 80
#: The hash of a word with a digit, and what tells documents apart, in their order.
_OPEN = np.uint64(0x5DEECE66D)
_ROW = ["no_id", "id", "row"]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text with the columns that tell documents apart."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select("doc_id", "text", doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("row"))


@dataclass
class Lines:
    """Lines with a word: the text's index, the line's place in it, and hashes of its leaf, of itself and, concatenated, of its templates."""

    text: np.ndarray
    pos: np.ndarray
    leaf: np.ndarray
    key: np.ndarray
    templates: np.ndarray
    n_templates: np.ndarray


def parse(column: pa.Array, depth: int = DEPTH, percent: int = PERCENT) -> Lines:
    """Lines of texts, hashed as `dedup_lines` tells them apart."""
    buf, off = ragged.utf8(column)
    mapped, begin, end, first = ragged.words(buf, off, ragged.SPACED)
    h = ragged.word_hashes(mapped, begin, end)
    before = lambda hit: np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    newlines, digits = before(buf == 10), before((buf >= 48) & (buf <= 57))
    text = np.repeat(np.arange(len(column)), np.diff(first))
    line = newlines[begin] + text
    start = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
    n = np.diff(start)
    numbered = digits[end] > digits[begin]
    h[numbered & np.repeat(ragged.grouped_sum(numbered, start) < n, n)] = _OPEN
    at, to = start[:-1], start[1:]
    leaf = ragged.mix(ragged.word_hashes(h, at, np.minimum(at + depth, to)) + n.astype(np.uint64) * _OPEN)
    # a template: the line without one run of the words below the leaf, by sums of word hashes weighted by place
    size = n * (100 - percent) // 100
    many = np.where((size > 0) & (n > depth), -(-(n - depth) // np.maximum(size, 1)), 0)
    owner, nth = np.repeat(np.arange(len(n)), many), ragged.ranges(many)
    up, down = ragged.powers(len(h))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    lo = at[owner] + depth + nth * size[owner]
    hi = np.minimum(lo + size[owner], to[owner])
    rest = (total[to[owner]] - total[at[owner]] - (total[hi] - total[lo])) * down[at[owner]]
    templates = ragged.mix(rest + (nth.astype(np.uint64) + np.uint64(1)) * ragged._P)
    text = text[at]
    return Lines(text, newlines[begin[at]] - newlines[off[text]], leaf.view(np.int64), ragged.word_hashes(h, at, to).view(np.int64), templates.view(np.int64), many)


def _places(part: pa.RecordBatch, lines: Lines, rows: np.ndarray | slice = slice(None)) -> list[pa.Array]:
    return [*[pa.array(part.column(c).to_numpy(zero_copy_only=False)[lines.text[rows]]) for c in _ROW], pa.array(lines.pos[rows])]


def _distinct(depth: int, percent: int):
    """The distinct lines of a slice of texts, each with its count, first place and templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch):
                x = parse(part.column("text"), depth, percent)
                if not len(x.leaf):
                    continue
                places = [p.to_numpy(zero_copy_only=False) for p in _places(part, x)]
                order = np.lexsort([*places[::-1], x.key, x.leaf])
                same = np.zeros(len(order), bool)
                same[1:] = (x.leaf[order][1:] == x.leaf[order][:-1]) & (x.key[order][1:] == x.key[order][:-1])
                head = np.flatnonzero(~same)
                rows = order[head]
                cut = np.concatenate([[0], np.cumsum(x.n_templates)])
                flat = x.templates[np.repeat(cut[rows], x.n_templates[rows]) + ragged.ranges(x.n_templates[rows])]
                ends = np.concatenate([[0], np.cumsum(x.n_templates[rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.leaf[rows]), pa.array(x.key[rows]), pa.array(np.diff(np.append(head, len(order)))), *_places(part, x, rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["leaf", "key", "n", *_ROW, "pos", "templates"],
                )

    return run


def _located(depth: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch):
                x = parse(part.column("text"), depth, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x.leaf), pa.array(x.key), *_places(part, x)], ["leaf", "key", *_ROW, "pos"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ragged.slices(batch):
            texts, kept, counts = part.column("text").to_pylist(), [], []
            for text, gone in zip(texts, part.column("gone").to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                counts.append(len(lines))
                dropped = set(gone or ())
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in dropped) if dropped else text)
            n_gone = [len(x or ()) for x in part.column("gone").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )


def recurring_lines(rows: DataFrame, depth: int, percent: int, staged: Staged) -> DataFrame:
    """(leaf, key, lead): each distinct line that has an occurrence beyond the first of one of its templates, and the least place of all of these."""
    place = F.struct(*_ROW, "pos")
    lines = rows.mapInArrow(_distinct(depth, percent), "leaf long, key long, n long, no_id boolean, id long, row long, pos long, templates array<long>")
    # equal lines meet after each task has summed up its own, so a line that a third of the corpus has is a row a task
    lines = lines.groupBy("leaf", "key").agg(F.sum("n").alias("n"), F.min(place).alias("own"), F.first("templates").alias("templates"))
    lines = staged.put(lines, "lines")
    # only leaves of several lines can have a template of several lines; their lines and templates are counted before they move
    shared = lines.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1").select("leaf")
    several = lines.join(shared, "leaf").select("leaf", "key", "own", F.explode("templates").alias("template"))
    several = staged.put(several, "templates")
    first = several.groupBy("leaf", "template").agg(F.min("own").alias("first"), F.count("*").alias("lines")).where("lines > 1").drop("lines")
    lead = several.join(first, ["leaf", "template"]).where(F.col("first") < F.col("own")).groupBy("leaf", "key").agg(F.min("first").alias("lead"))
    found = lines.drop("templates").join(lead, ["leaf", "key"], "left").where("n > 1 or lead is not null")
    return found.select("leaf", "key", F.coalesce("lead", "own").alias("lead"))


def dedup_lines(docs: DataFrame, depth: int = DEPTH, percent: int = PERCENT, staged: Staged | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text), one row for each row of docs: text without lines whose template came before.

    Lines are apart at U+000A, words at space and U+0009 to U+000D. A tree deals lines by their count of words and their
    first `depth` words to leaves. Variable fields are left open: a word with an ASCII digit is, unless all words of the line
    have one; and below the leaf a line is cut into runs of 100 - percent hundredths of its words (rounded down), each of
    which may be left open, which gives a template for each run. Lines of a leaf that agree in all but one run thus share a
    template; a line too short for a run is its own only template.

    Of the lines of a template, in all documents, the first stays: by doc_id, then a hash of the text, then place. A
    line goes if one of its templates has an earlier line. Templates depend on lines alone and their firsts are minima,
    so results don't depend on partitioning, and no leaf or template is one task's: both are summed up before
    they move, and joins back to lines are Spark's to split. Lines are compared by 128 bits of hashes.

    Null text: null, no lines. Lines without a word stay. Null doc_id: after all others. Rows that repeat a doc_id
    with another text are documents of their own; with the same text they're one, and each row has its result.
    Empty table: empty result. Other columns are ignored.
    """
    staged = staged or Staged(docs.sparkSession)
    rows = _rows(docs)
    recurring = staged.put(recurring_lines(rows, depth, percent, staged), "recurring")
    located = rows.mapInArrow(_located(depth, percent), "leaf long, key long, no_id boolean, id long, row long, pos long")
    later = located.join(recurring, ["leaf", "key"]).where(F.struct(*_ROW, "pos") != F.col("lead"))
    gone = later.groupBy(*_ROW).agg(F.collect_set("pos").alias("gone"))
    left = rows.join(gone, _ROW, "left").select("doc_id", "text", "gone")
    types = dict(docs.dtypes)
    return left.mapInArrow(_without, f"doc_id {types['doc_id']}, n_lines long, n_dropped long, text string")
