"""Near-duplicate components by a signature-coordinate inverted join, each link confirmed on full shingle sets.

Plan, for documents D:
1. One pass over texts gives each document its set size, a 128-bit fingerprint of the set and
   a 64-coordinate MinHash signature. Equal sets become one class, the least doc_id its representative.
2. A count-min sketch of all (coordinate, value) pairs, of bounded size, ranks them from rare to common.
   Two signatures that agree in THRESHOLD of COORDINATES must share one of their
   PREFIX = COORDINATES - THRESHOLD + 1 rarest, so only those are posted. Any one order gives whole results;
   the sketch only makes lists short.
3. Posting lists are merged: collisions are counted over whole (4-bit) signatures, and the list
   yields a spanning forest of the pairs at THRESHOLD or above, never all pairs. Postings are counted
   exactly, summed up before they move; a list above LIST_BLOCK is cut into blocks, and each pair of blocks is a task.
4. Components of that forest hold every candidate pair. Each is verified on full sets, in blocks
   of bounded rows and shingles, again emitting a spanning forest of the confirmed links. Linked sets are of
   like sizes, so in a component of several blocks only those of neighbouring sizes are paired.
5. Components of the links, carried back to all members of each class.
A pair at similarity 0.85 misses THRESHOLD with probability below 3e-7 (Chernoff bound for 36 of 64).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percola.llm import ragged
from percola.operators.components import connected_components
from percola.session import Staged

COORDINATES, THRESHOLD = 64, 36
PREFIX = COORDINATES - THRESHOLD + 1
#: Cells of the sketch: between these, about one for each 16 representatives; so the broadcast stays under 64 MB.
CELLS_LOG2 = (18, 24)
#: Rows of a block of a long posting list; rows and shingles of a block of a large candidate component.
LIST_BLOCK, ROWS_BLOCK, SHINGLES_BLOCK = 2048, 512, 400_000
_SKETCH_BLOCK = 14

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLIERS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles, sorted within each text, and n+1 offsets. A text of 1 to k-1 words has one: all its words."""
    buf, off = ragged.utf8(column)
    mapped, begin, end, first = ragged.words(buf, off, ragged.SPACED_LOWER)
    hashes = ragged.word_hashes(mapped, begin, end)
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first[:-1], n) + ragged.ranges(n)
    full = ragged.windows(hashes, k)
    values = full[np.minimum(at, len(full) - 1)] if len(full) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        short = np.zeros(1, np.uint64)
        for h in hashes[first[i] : first[i + 1]]:
            short = short * ragged._P + h
        values[np.searchsorted(doc, i)] = ragged.mix(short + np.uint64(n_words[i]))[0]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))])


def signatures(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minima of COORDINATES hash functions, as rows of 32-bit values, for the sets that aren't empty."""
    n = np.diff(off)
    out = np.zeros((int((n > 0).sum()), COORDINATES), np.uint32)
    if not len(out):
        return out
    starts = off[:-1][n > 0]
    for c, m in enumerate(_MULTIPLIERS):
        out[:, c] = np.minimum.reduceat((values * m) >> np.uint64(32), starts).astype(np.uint32)
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch):
                values, off = shingle_sets(part.column("text"), k)
                n = np.diff(off)
                filled = n > 0
                sig = np.zeros((len(n), COORDINATES), np.uint32)
                sig[filled] = signatures(values, off)
                twice = ragged.mix(values)
                fp = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
                if filled.any():
                    fp[0][filled] = np.add.reduceat(values, off[:-1][filled])
                    fp[1][filled] = np.add.reduceat(twice, off[:-1][filled])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in fp], ragged.binary(sig)],
                    ["doc_id", "n", "fp1", "fp2", "sig"],
                )

    return run


def _sig_rows(column: pa.Array) -> np.ndarray:
    return ragged.fixed(column, 4 * COORDINATES, np.uint32)


def _tokens(sig: np.ndarray) -> np.ndarray:
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64)


def _count(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << log2, np.int64)
        for batch in batches:
            if batch.num_rows:
                cell = ragged.mix(_tokens(_sig_rows(batch.column("sig")))) >> np.uint64(64 - log2)
                cells += np.bincount(cell.ravel().astype(np.int64), minlength=1 << log2)
        at = np.flatnonzero(cells)
        block = at >> _SKETCH_BLOCK
        cut = np.searchsorted(block, np.arange((1 << (log2 - _SKETCH_BLOCK)) + 1))
        rows = [(b, at[x:y].astype(np.int32).tobytes(), cells[at[x:y]].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            ["block", "cells", "counts"],
        )

    return run


def _add_up(key, table):
    total = np.zeros(1 << _SKETCH_BLOCK, np.int64)
    for cells, counts in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(cells, np.int32) & ((1 << _SKETCH_BLOCK) - 1)] += np.frombuffer(counts, np.int64)
    total = np.minimum(total, 2**31 - 1).astype(np.int32)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _post(sketch, log2: int):
    """(token, doc_id, n, low): a signature under each of its PREFIX rarest tokens, by the sketch's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.frombuffer(sketch.value, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = _sig_rows(part.column("sig"))
                tokens = ragged.mix(_tokens(sig))
                count = frequency[(tokens >> np.uint64(64 - log2)).astype(np.int64)]
                first = np.lexsort((tokens, count), axis=1)[:, :PREFIX]
                tokens = np.take_along_axis(tokens, first, 1)
                low = (ragged.mix(sig.astype(np.uint64) + np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(15)).astype(np.uint8)
                packed = (low[:, ::2] << 4) | low[:, 1::2]
                row = np.repeat(np.arange(part.num_rows), PREFIX)
                doc, n = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.ravel().view(np.int64)), pa.array(doc), pa.array(n), ragged.binary(packed[row])], ["token", "doc_id", "n", "low"])

    return run


def _dealt(postings: DataFrame, staged: Staged) -> DataFrame:
    """Postings with the pair of blocks of their list: 0 for a list of one block; each posting of a longer one in every pair that its block is in."""
    counts = postings.groupBy("token").count().where(F.col("count") > LIST_BLOCK)
    long = staged.put(counts.select("token", F.ceil(F.col("count") / LIST_BLOCK).alias("blocks")), "long-lists")
    # 16 MB at most; beyond that the join is Spark's choice, and it splits skewed tokens
    some = long.count()
    dealt = postings.join(F.broadcast(long) if some <= 1_000_000 else long, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    return dealt.select("token", pair.alias("pair"), "doc_id", "n", "low")


def forest(n: np.ndarray, near, ratio: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph near(i, others) -> mask: each node is compared with those that no tree has reached."""
    left = np.argsort(n, kind="stable")
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            lo, hi = np.searchsorted(n[left], [np.ceil(ratio * n[i] - 1e-9), np.floor(n[i] / ratio + 1e-9) + 0.5])
            hit = left[lo:hi][near(i, left[lo:hi])] if hi > lo else left[:0]
            if len(hit):
                edges += [(i, j) for j in hit]
                frontier += list(hit)
                left = left[~np.isin(left, hit)]
    return edges


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with equal keys, from batches sorted by them; rows of the last group wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        differs = np.zeros(batch.num_rows, bool)
        for c in cols:
            differs[1:] |= c[1:] != c[:-1]
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        cut = np.flatnonzero(differs)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if not len(cut):
            held.append(batch)
            continue
        if same:  # end the held group first, so that a large group is joined only once
            yield pa.Table.from_batches([*held, batch.slice(0, cut[0])])
            if cut[-1] > cut[0]:
                yield pa.Table.from_batches([batch.slice(cut[0], cut[-1] - cut[0])])
        else:
            yield pa.Table.from_batches([batch.slice(0, cut[-1])])
        held = [batch.slice(cut[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _edges(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(left), pa.int64()), pa.array(cat(right), pa.int64())], ["src", "dst"])


def _merge(ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["token", "pair"]):
            table = table.combine_chunks()
            token, pair, doc, n = (table.column(c).to_numpy() for c in ("token", "pair", "doc_id", "n"))
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (pair[1:] != pair[:-1])]))
            sizes = np.diff(np.concatenate([starts, [len(token)]]))
            if not (sizes > 1).any():
                continue
            low = ragged.fixed(table.column("low").chunk(0), COORDINATES // 2, np.uint8)
            left, right = [], []
            at = starts[sizes == 2]
            if len(at):
                x = low[at] ^ low[at + 1]
                agree = ((x >> 4) == 0).sum(1) + ((x & 15) == 0).sum(1)
                ok = (agree >= THRESHOLD) & (np.minimum(n[at], n[at + 1]) >= ratio * np.maximum(n[at], n[at + 1]) - 1e-9)
                left.append(doc[at[ok]])
                right.append(doc[at[ok] + 1])
            for s, m in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                sub = low[s : s + m]
                nib = np.concatenate([sub >> 4, sub & 15], 1)
                for i, j in forest(n[s : s + m], lambda i, o, nib=nib: (nib[o] == nib[i]).sum(1) >= THRESHOLD, ratio):
                    left.append(doc[s + i : s + i + 1])
                    right.append(doc[s + j : s + j + 1])
            if left:
                yield _edges(left, right)

    return run


def _confirm(k: int, above: int, out_of: int):
    def links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        doc = table.column("doc_id").to_numpy()
        sets = []
        for batch in table.to_batches():
            for part in ragged.slices(batch):
                values, off = shingle_sets(part.column("text"), k)
                sets += [values[x:y] for x, y in zip(off[:-1], off[1:], strict=True)]
        n = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(n)])
        vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mask = np.zeros(len(vocabulary), bool)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            mine = ids[starts[i] : starts[i + 1]]
            mask[mine] = True
            sizes = n[others]
            at = np.repeat(starts[others], sizes) + ragged.ranges(sizes)
            common = ragged.grouped_sum(mask[ids[at]], np.concatenate([[0], np.cumsum(sizes)]))
            mask[mine] = False
            return out_of * common >= above * (n[i] + sizes - common)

        for i, j in forest(n, near, above / out_of):
            yield doc[i : i + 1], doc[j : j + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["cluster", "pair"]):
            cluster, pair = (whole.column(c).to_numpy() for c in ("cluster", "pair"))
            cut = [0, *(np.flatnonzero((cluster[1:] != cluster[:-1]) | (pair[1:] != pair[:-1])) + 1), len(cluster)]
            found = [e for x, y in zip(cut[:-1], cut[1:], strict=True) if y - x > 1 for e in links(whole.slice(x, y - x))]
            if found:
                yield _edges([a for a, _ in found], [b for _, b in found])

    return run


def _compared(sized: DataFrame, percent: int, staged: Staged) -> DataFrame:
    """(doc_id, cluster, pair): the tasks in which a member of a candidate component is compared.

    A component of one block is one task. In a larger one, members are dealt to bands of set sizes, so wide that linked
    sets are in one band or in neighbouring ones, bands to blocks, and blocks of such bands are paired. A document whose
    rows have sets of several sizes is in all bands between them.
    """
    needed = lambda n: F.greatest(F.ceil(F.count("*") / ROWS_BLOCK), F.ceil(F.sum(n) / SHINGLES_BLOCK), F.lit(1)).cast("long")
    whole = staged.put(sized.groupBy("cluster").agg(needed("most").alias("blocks")), "cluster-blocks")
    small = sized.join(whole.where("blocks = 1"), "cluster", "left_semi").select("doc_id", "cluster", F.lit(-1).cast("long").alias("pair"))
    width = -math.log(percent / 100) * (1 + 1e-9) if percent < 100 else 1e-9
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / width).cast("long")
    large = sized.join(whole.where("blocks > 1"), "cluster", "left_semi")
    large = staged.put(large.select("doc_id", "cluster", "most", F.explode(F.sequence(band("n"), band("most"))).alias("band")), "cluster-bands")
    bands = staged.put(large.groupBy("cluster", "band").agg(needed("most").alias("blocks")), "band-blocks")
    # the two bands beside a band, and itself
    near = bands.select("cluster", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), F.struct(F.col("band").alias("at"), "blocks").alias("other"))
    near = near.groupBy("cluster", "band").agg(F.collect_list("other").alias("others")).join(bands, ["cluster", "band"])
    code = lambda at, block: at * (1 << 22) + block
    own = code(F.col("band"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    paired = large.join(near, ["cluster", "band"]).select("doc_id", "cluster", own.alias("own"), F.explode("others").alias("x"))
    paired = paired.select("doc_id", "cluster", "own", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("x.blocks") - 1), lambda i: code(F.col("x.at"), i))).alias("other"))
    pair = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    return small.union(paired.select("doc_id", "cluster", pair.alias("pair")))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 85, staged: Staged | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word
    shingles (A-Z lower-cased, words apart at space and U+0009 to U+000D); a text of fewer words has one
    shingle, the whole of it. component_id is the least doc_id that links reach, kept marks it. The
    signature threshold is set for percent >= 80; lower values are refused.

    Null or empty text, or no word: n_shingles 0, linked with nothing, a component of its own. Null
    doc_id: component_id null, kept true. Rows that repeat a doc_id share one node: sets under either
    row count for it, and each row is returned. Empty table: empty result. Other columns are ignored.
    """
    if percent < 80:
        raise ValueError("percent must be at least 80")
    spark = docs.sparkSession
    staged = staged or Staged(spark)
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(k), "doc_id long, n long, fp1 long, fp2 long, sig binary")
    s = staged.put(s, "signatures")
    key = ["n", "fp1", "fp2"]
    classes = staged.put(s.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    n_classes = classes.count()
    reps = s.where("n > 0").join(classes.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi")
    reps = staged.put(reps.select("doc_id", *key, "sig").dropDuplicates(["doc_id", *key]).drop("fp1", "fp2"), "representatives")

    log2 = min(CELLS_LOG2[1], max(CELLS_LOG2[0], (max(1, n_classes) // 16).bit_length()))
    counted = reps.select("sig").mapInArrow(_count(log2), "block int, cells binary, counts binary")
    rows = counted.groupBy("block").applyInArrow(_add_up, "block int, counts binary").collect()
    sketch = np.zeros(1 << log2, np.int32)
    for r in rows:
        sketch[r["block"] << _SKETCH_BLOCK : (r["block"] + 1) << _SKETCH_BLOCK] = np.frombuffer(r["counts"], np.int32)
    sketch = spark.sparkContext.broadcast(sketch.tobytes())

    postings = _dealt(reps.mapInArrow(_post(sketch, log2), "token long, doc_id long, n long, low binary"), staged)
    postings = postings.repartition(F.col("token"), F.col("pair")).sortWithinPartitions("token", "pair")
    candidates = staged.put(postings.mapInArrow(_merge(percent / 100), "src long, dst long").where("src <> dst").distinct(), "candidates")
    clusters = staged.put(connected_components(candidates, staged=staged), "clusters")

    sized = reps.join(clusters, F.col("doc_id") == F.col("node")).groupBy("doc_id").agg(F.first("component").alias("cluster"), F.min("n").alias("n"), F.max("n").alias("most"))
    sized = staged.put(sized, "cluster-members")
    tasks = _compared(sized, percent, staged)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized.select("doc_id"), "doc_id", "left_semi")
    tasks = tasks.join(texts, "doc_id")
    tasks = tasks.repartition(F.col("cluster"), F.col("pair")).sortWithinPartitions("cluster", "pair")
    links = staged.put(tasks.mapInArrow(_confirm(k, percent, 100), "src long, dst long").where("src <> dst").distinct(), "links")
    # rows that repeat a doc_id with other sets tie those classes together
    several = s.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    ties = s.where("n > 0").join(several, "doc_id").join(classes, key).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    components = connected_components(links.union(ties), staged=staged)

    classes = classes.join(components, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    classes = staged.put(classes, "class-components")
    out = s.select("doc_id", *key).join(classes, key, "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, staged: Staged | None = None) -> DataFrame:
    """docs without the rows of documents that aren't the least of their component; one row of each doc_id stays.

    Rows without a doc_id all stay. Of rows that repeat a doc_id, the one with the least hash stays.
    """
    staged = staged or Staged(docs.sparkSession)
    found = staged.put(near_duplicates(docs, k, percent, staged), "decisions")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    # the same plan at every size: whether these ids could be broadcast depends on the corpus
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    several = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not several.limit(1).count():
        return left
    whole = F.struct(*docs.columns)
    one = left.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return left.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
