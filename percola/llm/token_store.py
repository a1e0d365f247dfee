"""Token ids of documents in a content-addressed store.

A store is a folder of Parquet tables in a shared file system:
  chunks    digest, n, ids       each distinct chunk of ids once; ids are little-endian, 2 or 4 bytes each
  recipes   doc_id, start, n_tokens, digests, root, part, place     documents in ascending doc_id order
  manifest  part, first_start, n_docs, n_tokens, root               one row for each range of documents
  top       root, n_docs, n_tokens, width                           one row
A digest is BLAKE2b of a chunk's ids, a document's root that of its digests, a part's root that of its
documents' roots in order, the top root that of the parts' roots: a Merkle tree over the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percola.llm import ragged
from percola.llm.pretokens import Memo, checked, pretokens, span_hashes, split_special, spread
from percola.session import Staged

DIGEST = 16
#: A chunk ends where the hash of the last SPAN ids has BITS zero bits, no sooner than LEAST ids and no later than MOST.
SPAN, BITS, LEAST, MOST = 16, 10, 256, 4096

_state: dict[str, tuple] = {}


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def encode_pretokens(pretokens: list[str], tokenizer, special: list[str], special_ids: list[int], run: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """How many ids the library gives each of some distinct pre-tokens, and the ids one after another.

    With a special string to part them, `run` pre-tokens go to the library as one text; else each is a text.
    """
    if not special:
        got = [e.ids for e in tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]
        return np.array([len(g) for g in got], np.int64), np.array([i for g in got for i in g], np.int64)
    mark, mark_id = special[0], special_ids[0]
    texts = [mark.join(pretokens[i : i + run]) + mark for i in range(0, len(pretokens), run)]
    ids = np.concatenate([np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    ends = np.flatnonzero(ids == mark_id)
    return np.diff(ends, prepend=-1) - 1, np.delete(ids, ends)


def encode_texts(column: pa.Array, tokenizer, special: list[str], special_ids: list[int], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text, concatenated, and how many each has. The library encodes each distinct pre-token once; ids are then laid out by place."""
    pieces, owner, found = split_special(column, special)
    buf, begin, end, first = pretokens(pieces)
    keys, index, inverse = np.unique(span_hashes(buf, begin, end), return_index=True, return_inverse=True)
    size, flat, off = memo.values(keys)
    new = np.flatnonzero(size < 0)
    if len(new):
        data = buf.tobytes()
        texts = [data[a:b].decode() for a, b in zip(begin[index[new]].tolist(), end[index[new]].tolist(), strict=True)]
        size[new], fresh = encode_pretokens(texts, tokenizer, special, special_ids)
        fresh = fresh.astype(memo.dtype)
        memo.add(keys[new], size[new], fresh)
        off[new] = len(flat) + np.cumsum(size[new]) - size[new]
        flat = np.concatenate([flat, fresh])
    many = size[inverse]
    ids = flat[spread(off[inverse], many)]
    counts = ragged.grouped_sum(many, first)
    if owner is None:
        return ids, counts
    cut = np.concatenate([[0], np.cumsum(counts)])
    out, sizes, piece = [], [], 0
    for f in found:
        row = [ids[cut[piece] : cut[piece + 1]]]
        for s in f:
            piece += 1
            row += [np.array([special_ids[s]], ids.dtype), ids[cut[piece] : cut[piece + 1]]]
        piece += 1
        out += row
        sizes.append(sum(len(r) for r in row))
    return np.concatenate(out) if out else ids, np.array(sizes, np.int64)


def cuts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ends of chunks in concatenated documents: content-defined, and at each document's end."""
    ends = np.cumsum(counts)
    mixed = ragged.mix(ids.astype(np.uint64) + np.uint64(1))
    rolling = ragged.windows(mixed, SPAN)
    cand = np.flatnonzero((rolling >> np.uint64(64 - BITS)) == 0) + SPAN
    out: list[int] = []
    lo, at = 0, np.searchsorted(cand, ends)
    for start, end, hi in zip((ends - counts).tolist(), ends.tolist(), at.tolist(), strict=True):
        last = start
        for c in cand[lo:hi].tolist():
            while c - last > MOST:
                last += MOST
                out.append(last)
            if c - last >= LEAST and c - start >= SPAN and end - c > 0:
                out.append(c)
                last = c
        while end - last > MOST:
            last += MOST
            out.append(last)
        out.append(end)
        lo = hi
    return np.array(out, np.int64)


def _worker_state(name: str, model, width: int) -> tuple:
    """What this process keeps from task to task. Workers reach it by the function's name; a closure would bring its own empty copy."""
    if name not in _state:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state.clear()
        spec = json.loads(model.value)
        t = Tokenizer.from_str(model.value)
        added = [a["content"] for a in spec.get("added_tokens", [])]
        _state[name] = (t, added, [t.token_to_id(a) for a in added], Memo(np.uint16 if width == 2 else np.uint32))
    return _state[name]


def _encode(model, name: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special, special_ids, memo = _worker_state(name, model, width)
        for batch in batches:
            for part in ragged.slices(batch, limit=2_000_000):
                ids, counts = encode_texts(part.column("text"), tokenizer, special, special_ids, memo)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                counts = counts + 1
                cut = cuts(ids, counts)
                data = ids.astype(f"<u{width}").tobytes()
                chunks = [data[a * width : b * width] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
                first = np.concatenate([[0], np.searchsorted(cut, np.cumsum(counts), "right")])
                names = [digest(c) for c in chunks]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(counts),
                        pa.array([b"".join(names[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                        pa.array([chunks[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.binary())),
                    ],
                    ["doc_id", "n_tokens", "digests", "chunks"],
                )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within one sorted range: each document's root, and the documents and ids before it."""
    docs = ids = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        roots = [digest(d) for d in batch.column("digests").to_pylist()]
        ends = ids + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(roots, pa.binary()), pa.array(docs + np.arange(len(n), dtype=np.int64)), pa.array(ends - n)],
            [*batch.schema.names, "root", "place", "local"],
        )
        docs, ids = docs + len(n), ids + int(n.sum())


@dataclass
class Store:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _fold(key, table):
    """A part's root: the digest of its documents' roots in order."""
    order = np.argsort(table.column("place").to_numpy())
    roots = table.column("roots").take(pa.array(order)).to_pylist()
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "root": pa.array([digest(b"".join(roots))], pa.binary())})


def part_roots(recipes: DataFrame, block: int = 4096) -> DataFrame:
    """(part, root): roots of blocks of documents first, so that no task holds more than a block's, then of the blocks."""
    low = recipes.select(F.col("part"), F.floor(F.col("place") / block).alias("block"), "place", F.col("root").alias("roots"))

    def fold_block(key, table):
        out = _fold(key, table)
        return out.append_column("place", pa.array([key[1].as_py()], pa.int64())).rename_columns(["part", "roots", "place"])

    blocks = low.groupBy("part", "block").applyInArrow(fold_block, "part long, roots binary, place long")
    return blocks.groupBy("part").applyInArrow(_fold, "part long, root binary")


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, staged: Staged | None = None) -> Store:
    """Encode docs' texts, each with end_id appended, and write them as a store at path.

    The encoded table is written once, narrow recipes and distinct chunks are both made from it,
    and it is then deleted. Chunks of one digest meet after each task has dropped its own repeats,
    so a chunk that a third of the documents share costs one row a task. Documents are put in
    order of doc_id by ranges of narrow recipes; nulls come first, and rows that repeat a doc_id
    are ordered by content.

    Null or empty text: the end id alone. Empty table: a store of no documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    staged = staged or Staged(spark)
    vocabulary = checked(json.loads(tokenizer_json))
    most = max([end_id, *vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary.get("added_tokens", []))])
    width = 2 if most < 1 << 16 else 4
    model = spark.sparkContext.broadcast(tokenizer_json)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = staged.put(source.mapInArrow(_encode(model, digest(tokenizer_json.encode()).hex(), end_id, width), "doc_id long, n_tokens long, digests binary, chunks array<binary>"), "encoded")

    chunk = encoded.select(F.posexplode("chunks").alias("i", "ids"), "digests")
    chunk = chunk.select(F.expr(f"substring(digests, i * {DIGEST} + 1, {DIGEST})").alias("digest"), "ids")
    chunk.dropDuplicates(["digest"]).withColumn("n", (F.octet_length("ids") / width).cast("int")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    narrow = encoded.select("doc_id", "n_tokens", "digests")
    ranged = narrow.repartitionByRange(F.col("doc_id"), F.col("digests")).sortWithinPartitions("doc_id", "digests")
    schema = "doc_id long, n_tokens long, digests binary, root binary, place long, local long"
    numbered = staged.put(ranged.mapInArrow(_number, schema).withColumn("part", F.spark_partition_id().cast("long")), "numbered")
    # one row a part: as many as shuffle partitions, whatever the input
    totals = numbered.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).join(part_roots(numbered), "part")
    parts = sorted(totals.collect(), key=lambda r: r["part"])
    rows, start = [], 0
    for r in parts:
        rows.append((r["part"], start, r["n_docs"], r["n_tokens"], bytes(r["root"])))
        start += r["n_tokens"]
    manifest = spark.createDataFrame(rows, "part long, first_start long, n_docs long, n_tokens long, root binary").coalesce(1)
    manifest.write.parquet(f"{path}/manifest")
    numbered.join(F.broadcast(manifest.select("part", "first_start")), "part").select(
        "doc_id", (F.col("first_start") + F.col("local")).alias("start"), "n_tokens", "digests", "root", "part", "place"
    ).write.option("compression", "zstd").parquet(f"{path}/recipes")
    top = [(digest(b"".join(r[4] for r in rows)), sum(r[2] for r in rows), start, width)]
    spark.createDataFrame(top, "root binary, n_docs long, n_tokens long, width int").coalesce(1).write.parquet(f"{path}/top")
    staged.drop(encoded, numbered)
    return Store(spark, path)


def _checked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, n = [], []
            for name, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest(ids) != name:
                    raise ValueError(f"chunk {name.hex()} does not match its digest")
                values = np.frombuffer(ids, f"<u{width}")
                crc.append(zlib.crc32(values.astype("<u4").tobytes()))
                n.append(len(values))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return run


def _shift_tables(bits: int = 40) -> np.ndarray:
    """tables[k, j, b]: what 2**k zero bytes after it make of a CRC-32 whose byte j is b, all others 0."""
    one = np.array([zlib.crc32(b"\0", (1 << i) ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for i in range(32)], np.uint32)
    out = np.zeros((bits, 4, 256), np.uint32)
    columns = one
    for k in range(bits):
        for j in range(4):
            for i in range(8):
                out[k, j, (np.arange(256) >> i) & 1 == 1] ^= columns[8 * j + i]
        columns = out[k][0][columns & 255] ^ out[k][1][columns >> 8 & 255] ^ out[k][2][columns >> 16 & 255] ^ out[k][3][columns >> 24]
    return out


def _combine(first: np.ndarray, second: np.ndarray, length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings one after another, from theirs and the second one's length."""
    out = first.astype(np.uint32)
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        on = (length >> k) & 1 == 1
        x = out[on]
        out[on] = tables[k][0][x & 255] ^ tables[k][1][x >> 8 & 255] ^ tables[k][2][x >> 16 & 255] ^ tables[k][3][x >> 24]
    return out ^ second.astype(np.uint32)


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _shift_tables()
    for batch in batches:
        parts = batch.column("parts")
        off = np.asarray(parts.offsets) - np.asarray(parts.offsets)[0]
        values = parts.flatten()
        n, crc = (values.field(f).to_numpy(zero_copy_only=False) for f in ("n", "crc"))
        size = np.diff(off)
        total = np.zeros(len(size), np.uint32)
        for j in range(int(size.max()) if len(size) else 0):
            on = np.flatnonzero(size > j)
            at = off[on] + j
            total[on] = _combine(total[on], crc[at], 4 * n[at], tables)
        yield pa.RecordBatch.from_arrays(
            [batch.column("start"), pa.array(ragged.grouped_sum(n, off)), pa.array(total.astype(np.int64))], ["start", "n_read", "ids_crc32"]
        )


def read_digests(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files.

    First the Merkle tree is recomputed from the recipes up (see `tree_fault`); a root that differs is an error.
    Each chunk is read once, checked against its digest and reduced to its length and CRC-32; a
    document's checksum is combined from its chunks' in recipe order, so ids are never moved.
    A recipe that misses a chunk, or whose chunks don't add up to n_tokens, raises an error.
    """
    wrong = tree_fault(store)
    if wrong:
        raise ValueError(f"the store's Merkle tree does not hold: {wrong}")
    width = store.table("top").first()["width"]
    chunks = store.table("chunks").select("digest", "ids").mapInArrow(_checked(width), "digest binary, n long, crc long")
    recipes = store.table("recipes")
    n = (F.octet_length("digests") / DIGEST).cast("int")
    steps = recipes.select("start", "digests", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    steps = steps.select("start", "i", F.expr(f"substring(digests, i * {DIGEST} + 1, {DIGEST})").alias("digest"))
    parts = steps.join(chunks, "digest").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("i", "n", "crc"))).alias("parts"))
    crcs = parts.mapInArrow(_join_crcs, "start long, n_read long, ids_crc32 long")
    out = recipes.select("doc_id", "start", "n_tokens").join(crcs, "start", "left")
    whole = F.when(F.col("n_read") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("document not whole at "), F.col("start").cast("string"))))
    return out.select("doc_id", "start", "n_tokens", whole.cast("long").alias("ids_crc32"))


def verify(store: Store) -> bool:
    """Whether every root, from the recipes up to the top, is what it should be."""
    return tree_fault(store) is None


def tree_fault(store: Store) -> str | None:
    """What is wrong with the roots, recomputed from the recipes up to the top, or None.

    A document's root is the digest of its chunks' digests in order, so chunks that are swapped, lost or added change it
    even if lengths agree. A part's root covers its documents' roots in order, and its counts and starts are added up
    again; the top root covers the parts'. Chunks themselves are checked by read_digests.
    """
    recipes = store.table("recipes")
    wrong = recipes.select("digests", "root").mapInArrow(_wrong_roots, "wrong long").agg(F.sum("wrong")).first()[0]
    if wrong:
        return f"{wrong} documents' roots"
    counts = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("first_start"))
    # a row for each part: as many as shuffle partitions when the store was written
    found = {r["part"]: (r["first_start"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in counts.join(part_roots(recipes), "part").collect()}
    said = sorted(store.table("manifest").collect(), key=lambda r: r["part"])
    if found != {r["part"]: (r["first_start"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in said}:
        return "a part's root or counts"
    top = store.table("top").first()
    if bytes(top["root"]) != digest(b"".join(bytes(r["root"]) for r in said)) or top["n_tokens"] != sum(r["n_tokens"] for r in said) or top["n_docs"] != sum(r["n_docs"] for r in said):
        return "the top root or counts"
    return None


def _wrong_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad = sum(digest(d) != r for d, r in zip(batch.column("digests").to_pylist(), batch.column("root").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int64())], ["wrong"])


def read_ids(store: Store, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents, from the store's files."""
    width = store.table("top").first()["width"]
    some = store.table("recipes").where(F.col("doc_id").isin(doc_ids))
    steps = some.select("doc_id", "start", F.posexplode(F.expr(f"transform(sequence(0, cast(octet_length(digests) / {DIGEST} as int) - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")).alias("i", "digest"))
    rows = steps.join(store.table("chunks"), "digest").collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["start"], r["i"])):
        out.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], f"<u{width}").astype(np.uint32))
    return {k: np.concatenate(v) for k, v in out.items()}
