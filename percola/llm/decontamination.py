"""Benchmark decontamination by winnowed k-gram fingerprints, each hit extended to the whole window."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percola.llm import ragged
from percola.session import Staged

#: Words of a fingerprint; with windows of 13 words, each window of 13 - 8 + 1 = 6 fingerprints keeps one.
GRAM = 8
#: Text bytes of benchmark items that one broadcast block holds; more items make more blocks.
BLOCK_BYTES = 16_000_000
#: With several blocks, a bitmap of all fingerprints says which documents can have a hit: between so many bits (2**k), 128 MB at most.
BITMAP_LOG2 = (20, 30)


def winnow(hashes: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Indices of the fingerprints kept: in each run of `span` hashes of one text (or all of a shorter one) the rightmost minimum.

    first: for each text, and the end, the index of its first hash.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    last = np.repeat(first[1:], np.diff(first)) - 1
    for j in range(1, span):
        other = np.minimum(np.arange(n) + j, last)
        best = np.where(hashes[other] <= hashes[best], other, best)
    # runs that would cross the end of a text of at least span hashes add nothing new
    inside = (np.arange(n) + span - 1 <= last) | (np.arange(n) == np.repeat(first[:-1], np.diff(first)))
    return np.unique(best[inside])


def probes(kind: str, size: int, hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and the indices of those that are looked up: winnowed ones for long items, all for short ones."""
    own = ragged.windows(hashes, size)
    if not len(own):
        return own, np.zeros(0, np.int64)
    n = np.diff(first)
    whole = np.arange(len(own)) + size <= np.repeat(first[1:], n)[: len(own)]
    if kind == "short":
        return own, np.flatnonzero(whole)
    # only texts of `window` words can hold a window; keep one fingerprint in each of its runs
    idx = np.flatnonzero(whole & (np.repeat(n, n)[: len(own)] >= window))
    counts = np.where(n >= window, n - size + 1, 0)
    return own, idx[winnow(own[idx], np.concatenate([[0], np.cumsum(counts)]), window - size + 1)]


class Index:
    """Windows of benchmark items, for one block of them: plain arrays, sized by the block.

    An item of `window` words or more has its windows; a shorter one, if it has words, is one
    window. Items are kept as concatenated word hashes; equal words have equal hashes.
    """

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        texts = pa.array([t for _, t in items], pa.large_string())
        buf, off = ragged.utf8(texts)
        mapped, begin, end, first = ragged.words(buf, off, ragged.ALNUM_LOWER)
        self.names = [i for i, _ in items]
        self.words = ragged.word_hashes(mapped, begin, end)
        self.first = first
        n = np.diff(first)
        # long items: fingerprints by winnowing; short items: one gram of all their words
        grams, at, item, length = [], [], [], []
        long = np.flatnonzero(n >= window)
        full = ragged.windows(self.words, gram)
        for i in long:
            own = full[first[i] : first[i] + n[i] - gram + 1]
            keep = winnow(own, np.array([0, len(own)]), window - gram + 1)
            grams.append(own[keep])
            at.append(first[i] + keep)
            item.append(np.full(len(keep), i))
            length.append(np.full(len(keep), gram))
        self.short = sorted({int(x) for x in n[(n > 0) & (n < window)]})
        for size in self.short:
            own = np.flatnonzero(n == size)
            grams.append(ragged.windows(self.words, size)[first[own]])
            at.append(first[own])
            item.append(own)
            length.append(np.full(len(own), size))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        grams, at, item, length = cat(grams, np.uint64), cat(at, np.int64), cat(item, np.int64), cat(length, np.int64)
        order = np.lexsort((grams, length))
        self.by_length = {}
        for size in [gram if (length == gram).any() and len(long) else None, *self.short]:
            if size is not None:
                kept = order[length[order] == size]
                long_item = n[item[kept]] >= window
                for kind, mask in (("long", long_item), ("short", ~long_item)):
                    if mask.any():
                        self.by_length[(kind, size)] = (grams[kept[mask]], at[kept[mask]], item[kept[mask]])

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from word, to word, item) of every window occurrence found, for texts of concatenated word hashes."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = np.diff(first)
        last = np.repeat(first[1:], n)
        for (kind, size), (grams, at, item) in self.by_length.items():
            own, idx = probes(kind, size, hashes, first, self.window)
            if not len(own):
                continue
            lo, hi = np.searchsorted(grams, own[idx]), np.searchsorted(grams, own[idx], "right")
            some = hi > lo
            idx, lo, many = idx[some], lo[some], (hi - lo)[some]
            if not len(idx):
                continue
            pos, ref = np.repeat(idx, many), np.repeat(lo, many) + ragged.ranges(many)
            ipos, it = at[ref], item[ref]
            if kind == "short":
                same = np.ones(len(pos), bool)
                for j in range(size):
                    same &= hashes[pos + j] == self.words[ipos + j]
                out.append((pos[same], pos[same] + size, it[same]))
            else:
                # extend to the longest run of equal words around the hit, within text and item
                doc_first, doc_last = np.repeat(first[:-1], n)[pos], last[pos]
                item_first, item_last = self.first[it], self.first[it + 1]
                left, right = pos.copy(), pos.copy()
                going = np.ones(len(pos), bool)
                while going.any():
                    a, b = right[going], ipos[going] + right[going] - pos[going]
                    ok = (a < doc_last[going]) & (b < item_last[going])
                    ok[ok] = hashes[a[ok]] == self.words[b[ok]]
                    right[np.flatnonzero(going)[ok]] += 1
                    going[np.flatnonzero(going)[~ok]] = False
                going[:] = True
                while going.any():
                    a, b = left[going] - 1, ipos[going] + left[going] - pos[going] - 1
                    ok = (a >= doc_first[going]) & (b >= item_first[going])
                    ok[ok] = hashes[a[ok]] == self.words[b[ok]]
                    left[np.flatnonzero(going)[ok]] -= 1
                    going[np.flatnonzero(going)[~ok]] = False
                enough = right - left >= self.window
                out.append((left[enough], right[enough], it[enough]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(index, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = pickle.loads(index.value)
        for batch in batches:
            for part in ragged.slices(batch):
                buf, off = ragged.utf8(part.column("text"))
                mapped, begin, end, first = ragged.words(buf, off, ragged.ALNUM_LOWER)
                hashes = ragged.word_hashes(mapped, begin, end)
                a, b, item = ix.hits(hashes, first)
                doc = np.searchsorted(first, a, "right") - 1
                spans: list[list[int]] = [[] for _ in range(part.num_rows)]
                items: list[list[str]] = [[] for _ in range(part.num_rows)]
                for d in np.unique(doc):
                    own = doc == d
                    spans[d] = np.unique(np.stack([a[own], b[own]], 1) - first[d], axis=0).ravel().tolist()
                    items[d] = sorted({ix.names[i] for i in np.unique(item[own])})
                carried = [name for name in part.schema.names if with_text or name != "text"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(name) for name in carried], pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
                    ],
                    [*carried, "n_words", "spans", "items"],
                )

    return run


def _bitmap(benchmark: DataFrame, block_bytes: int, window: int) -> tuple[bytes, int, list[tuple[str, int]]]:
    """Bits at the top bits of every fingerprint of the benchmark, how many top bits, and the kinds and lengths of its windows."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = min(BITMAP_LOG2[1], max(BITMAP_LOG2[0], (8 * size).bit_length()))
    bits, kinds = np.zeros(1 << (log2 - 3), np.uint8), set()
    for items in _blocks(benchmark, block_bytes):
        index = Index(items, window, GRAM)
        kinds |= set(index.by_length)
        for grams, _, _ in index.by_length.values():
            at = (grams >> np.uint64(64 - log2)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes(), log2, sorted(kinds)


def _can_hit(sent, window: int):
    """Rows, without further columns, of texts that have a fingerprint in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, log2, kinds = sent.value
        bits = np.frombuffer(data, np.uint8)
        for batch in batches:
            for part in ragged.slices(batch):
                buf, off = ragged.utf8(part.column("text"))
                mapped, begin, end, first = ragged.words(buf, off, ragged.ALNUM_LOWER)
                hashes = ragged.word_hashes(mapped, begin, end)
                found = np.zeros(part.num_rows, bool)
                for kind, size in kinds:
                    own, idx = probes(kind, size, hashes, first, window)
                    at = (own[idx] >> np.uint64(64 - log2)).astype(np.int64)
                    hit = idx[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    found[np.searchsorted(first, hit, "right") - 1] = True
                yield part.filter(pa.array(found))

    return run


def _no_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ragged.slices(batch, "_text"):
            buf, off = ragged.utf8(part.column("_text"))
            first = ragged.words(buf, off, ragged.ALNUM_LOWER)[3]
            rest = [(c, n) for c, n in zip(part.columns, part.schema.names, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in rest], pa.array(np.diff(first))], [*[n for _, n in rest], "n_words"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about block_bytes, streamed through the driver a partition at a time; order doesn't matter."""
    held: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("item_id is not null and text is not null").dropDuplicates()
    for r in rows.toLocalIterator():
        held.append((r["i"], r["text"]))
        size += len(r["text"])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", keep: list[str] | None = None,
    staged: Staged | None = None,
) -> DataFrame:
    """(columns keep, n_words, n_hit, spans, item_ids, contaminated) for each row of docs; keep is the key by default.

    Words are runs of [0-9a-z] and non-ASCII characters after A-Z is lower-cased. A word inside any
    occurrence of a window of `window` item words (an item of fewer words: all of them) is hit; spans are
    the hit ranges [from, to), flattened and sorted, and may overlap. contaminated: n_hit > 0 and
    100 * n_hit >= percent * n_words.

    Fingerprints are minima of GRAM-word hashes over runs of window - GRAM + 1, on both sides, so every
    shared span of `window` words has a common one; a hit is extended word by word. The benchmark is
    broadcast in blocks of bounded size; with one block, documents are read once and nothing is shuffled.
    With more, a bitmap of all fingerprints, of bounded size too, first picks the documents that can have a hit; each
    block then makes a pass over those, and all passes' hits meet the documents in one join by key.

    Null or wordless text: no words, no hits. Null or repeated keys: one result row for each row of docs
    (with several blocks, hits of rows with equal keys and equal word counts are united). Null items are
    ignored; an item_id may have several texts. Empty tables: no rows, or no hits.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    sc = docs.sparkSession.sparkContext
    added = {"n_words", "n_hit", "spans", "items", "item_ids", "contaminated"}
    keep = [key] if keep is None else [key, *[c for c in keep if c != key and c.lower() not in added]]
    sent = docs.select(*keep, *(["text"] if "text" not in keep else []))

    def scan(frame: DataFrame, items: list[tuple[str, str]], keep: list[str] = keep) -> DataFrame:
        index = sc.broadcast(pickle.dumps(Index(items, window, GRAM)))
        carried = [f for f in frame.schema.fields if f.name != "text" or "text" in keep]
        added = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
        return frame.mapInArrow(_scan(index, "text" in keep), T.StructType([*carried, *added]))

    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        found = scan(sent, first)
    else:
        staged = staged or Staged(docs.sparkSession)
        bitmap = sc.broadcast(_bitmap(benchmark, block_bytes, window))
        narrow = docs.select(F.col(key).alias("_k"), "text")
        some = staged.put(narrow.mapInArrow(_can_hit(bitmap, window), narrow.schema), "can-hit")
        hits = None
        for items in _blocks(benchmark, block_bytes):
            part = staged.put(scan(some, items, ["_k"]).where(F.size("spans") > 0), "hits")
            hits = part if hits is None else hits.union(part)
        hits = hits.groupBy("_k", F.col("n_words").alias("_n")).agg(F.flatten(F.collect_list("spans")).alias("_s"), F.flatten(F.collect_list("items")).alias("_i"))
        counted = sent.withColumn("_text", F.col("text")) if "text" in keep else sent.withColumnRenamed("text", "_text")
        fields = [f for f in counted.schema.fields if f.name != "_text"]
        counted = counted.mapInArrow(_no_hits, T.StructType([*fields, T.StructField("n_words", T.LongType())]))
        found = counted.join(hits, F.col(key).eqNullSafe(F.col("_k")) & (F.col("n_words") == F.col("_n")), "left").select(
            *keep, "n_words", F.coalesce("_s", F.array().cast("array<long>")).alias("spans"), F.coalesce("_i", F.array().cast("array<string>")).alias("items")
        )
    # covered words: sorted by begin, each range adds what lies beyond all ranges before it
    end = lambda i, add: F.col("spans")[(2 * i + add).cast("int")]
    ranges = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int")), lambda i: F.struct(end(i, 0).alias("a"), end(i, 1).alias("b")))
    pairs = F.array_sort(ranges)
    covered = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")),
    )["n"]
    n_hit = F.when(F.size("spans") > 0, covered).otherwise(F.lit(0).cast("long"))
    return found.withColumn("n_hit", n_hit).select(
        *keep, "n_words", "n_hit", "spans", F.array_sort(F.array_distinct("items")).alias("item_ids"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


