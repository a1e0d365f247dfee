"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percola.llm import ragged
from percola.llm.pretokens import Memo, checked, pretokens, span_hashes, split_special

_NONE = np.int64(1) << 40


class Merges:
    """A byte-level BPE vocabulary as arrays: ids of bytes, sorted pairs with their rank and result, special strings."""

    def __init__(self, tokenizer_json: str):
        spec = checked(json.loads(tokenizer_json))
        model, vocab = spec["model"], spec["model"]["vocab"]
        # the byte alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ... in order
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.bytes = np.array([vocab[chr(b if b in set(printable) else next(rest))] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and concatenated ids of byte sequences, none empty.

        In each round every sequence merges all places of its lowest-ranked pair at once, the left
        one of two that overlap; a sequence without a ranked pair is finished and leaves the arrays.
        """
        sym = self.bytes[data]
        seq = np.repeat(np.arange(len(off) - 1), np.diff(off))
        counts = np.zeros(len(off) - 1, np.int64)
        done_sym, done_seq = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            joined = seq[1:] == seq[:-1]
            rank[:-1][joined] = self.ranks(sym[:-1][joined], sym[1:][joined])
            begin = np.flatnonzero(np.concatenate([[True], ~joined]))
            size = np.diff(np.append(begin, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, begin), size)
            over = low == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_seq.append(seq[over])
                counts[seq[begin[over[begin]]]] = size[over[begin]]
                sym, seq, rank, low = sym[~over], seq[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            hit = rank == low
            # a run of overlapping places keeps every other one, from its left end
            idx = np.flatnonzero(hit)
            fresh = np.concatenate([[True], idx[1:] != idx[:-1] + 1])
            nth = np.arange(len(idx)) - np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(idx))))
            idx = idx[nth % 2 == 0]
            sym[idx] = self.made[rank[idx]]
            keep = np.ones(len(sym), bool)
            keep[idx + 1] = False
            sym, seq = sym[keep], seq[keep]
        flat, owner = np.concatenate([np.zeros(0, np.int64), *done_sym]), np.concatenate([np.zeros(0, np.int64), *done_seq])
        return counts, flat[np.argsort(owner, kind="stable")]


_state: dict[str, tuple[Merges, Memo]] = {}


def _worker_state(name: str, model) -> tuple[Merges, Memo]:
    """What this process keeps from task to task. Workers reach it by the function's name; a closure would bring its own empty copy."""
    if name not in _state:
        _state.clear()
        _state[name] = (pickle.loads(model.value), Memo(np.int32))
    return _state[name]


def count_texts(column: pa.Array, merges: Merges, memo: Memo) -> np.ndarray:
    """Tokens of each text; nulls have none."""
    pieces, owner, found = split_special(column, merges.special)
    buf, begin, end, first = pretokens(pieces)
    keys, index, inverse = np.unique(span_hashes(buf, begin, end), return_index=True, return_inverse=True)
    have, flat, _ = memo.values(keys)
    size = np.zeros(len(keys), np.int64)
    size[have > 0] = flat
    new = np.flatnonzero(have < 0)
    if len(new):
        a, b = begin[index[new]], end[index[new]]
        data = buf[np.repeat(a, b - a) + ragged.ranges(b - a)]
        size[new], _ = merges.encode(data, np.concatenate([[0], np.cumsum(b - a)]))
        memo.add(keys[new], np.ones(len(new), np.int64), size[new].astype(memo.dtype))
    counts = ragged.grouped_sum(size[inverse], first)
    if owner is None:
        return counts
    return np.bincount(owner, counts, len(column)).astype(np.int64) + np.array([len(f) for f in found])


def _count(model, name: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, memo = _worker_state(name, model)
        for batch in batches:
            for part in ragged.slices(batch, limit=2_000_000):
                _, off = ragged.utf8(part.column("text"))
                counts = count_texts(part.column("text"), merges, memo)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(off)), pa.array(counts)], [key, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 512, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of docs: no shuffle, texts stay where they are read.

    Counts equal the library's for a byte-level BPE file, without begin, end or other added tokens;
    special strings inside texts count one token each, as is its default. Null text counts as empty: 0.
    Null or repeated keys: a row each. Empty table: empty result. Other columns are ignored.
    tokenizer_json is the file's content, so that executors need no file.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Merges(tokenizer_json)))
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, "text").mapInArrow(_count(model, hashlib.sha256(tokenizer_json.encode()).hexdigest(), key), f"`{key}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
