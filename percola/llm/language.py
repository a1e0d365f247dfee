"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percola.llm import ragged
from percola.session import Staged

#: Bytes of normalised text that a language is learned from, the documents that supply them, and the bytes that one
#: document supplies as long as others have some.
TRAIN_BYTES, TRAIN_DOCS, SHARE_BYTES = 16_000, 64, 4_000
#: Languages whose automata are broadcast at once (some 6 MB for each); further ones take further passes over the texts.
PASS_LANGUAGES = 16
#: Parts that a language's rows are dealt to, step by step, before its training documents are chosen.
PARTS = (256, 16)
#: Texts are parsed in blocks of so many bytes; a phrase ends at a block's end.
BLOCK = 2048


def normalised(text: str) -> bytes:
    """Lower-cased; each run of characters that are no letters is one space."""
    return b" ".join("".join(c if c.isalpha() else " " for c in text.lower()).encode().split())


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the states of the smallest automaton that reads every substring of data from state 0."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return move


@dataclass
class Model:
    """Automata of all languages in one table: step[state * width + code] is 4 times the next state times width, plus the phrases that ended."""

    languages: list[str]
    code: np.ndarray
    width: int
    step: np.ndarray
    roots: np.ndarray
    weight: np.ndarray

    @staticmethod
    def fit(texts: dict[str, bytes]) -> Model:
        """From normalised text of each language. Where the text has no longer match a phrase ends and the next begins
        with the same byte; a byte that the language never has is a phrase of its own."""
        languages = sorted(texts)
        used = sorted({b for t in texts.values() for b in t})
        code = np.zeros(256, np.uint8)
        code[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        tables, roots, base = [], [], 0
        for name in languages:
            move = suffix_automaton(texts[name])
            # a byte that the root can't read is a phrase of its own; another state fails to the root's move, one phrase more
            to_root, own = np.zeros(width, np.int64), np.ones(width, np.int64)
            for c, to in move[0].items():
                to_root[code[c]], own[code[c]] = to, 0
            nxt, ended = np.tile(to_root, (len(move), 1)), np.tile(own + 1, (len(move), 1))
            ended[0] = own
            for s, m in enumerate(move):
                for c, to in m.items():
                    nxt[s, code[c]], ended[s, code[c]] = to, 0
            table = (nxt + base) * width * 4 + ended
            tables.append(table)
            roots.append(base * width)
            base += len(move)
        weight = np.array([math.log2(max(2, len(texts[x]))) for x in languages])
        small = np.int32 if base * width * 4 < 1 << 31 else np.int64
        return Model(languages, code, width, np.concatenate(tables).ravel().astype(small) if tables else np.zeros(0, small), np.array(roots, np.int64), weight)

    @staticmethod
    def fit_passes(texts: dict[str, bytes], most: int = PASS_LANGUAGES) -> list[Model]:
        """Models of at most `most` languages each, in order of name. A language's costs don't depend on the others in its model."""
        names = sorted(texts)
        return [Model.fit({x: texts[x] for x in names[i : i + most]}) for i in range(0, len(names), most)] or [Model.fit({})]

    def phrases(self, blocks: list[bytes]) -> np.ndarray:
        """Phrases of each block in each language. All blocks and languages take a step at a time."""
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        size = np.array([len(blocks[i]) for i in order])
        out = np.zeros((len(blocks), len(self.languages)), np.int64)
        if not len(blocks) or not size[0]:
            return out
        codes = np.zeros((size[0], len(blocks)), np.int32)
        for k, i in enumerate(order):
            codes[: size[k], k] = self.code[np.frombuffer(blocks[i], np.uint8)]
        live = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
        for x, root in enumerate(self.roots):
            state = np.full(len(blocks), root, self.step.dtype)
            count = np.zeros(len(blocks), np.int32)
            for t in range(size[0]):
                m = live[t]
                got = self.step[state[:m] + codes[t, :m]]
                count[:m] += got & 3
                state[:m] = got >> 2
            out[order, x] = count + (state != root)
        return out

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each text in each language, and how many bytes the normalised text has."""
        clean = [normalised(t) if t else b"" for t in texts]
        blocks = [c[i : i + BLOCK] for c in clean for i in range(0, len(c), BLOCK)]
        owner = np.repeat(np.arange(len(clean)), [-(-len(c) // BLOCK) for c in clean])
        total = np.zeros((len(clean), len(self.languages)))
        np.add.at(total, owner, self.phrases(blocks) * self.weight)
        return total, np.array([len(c) for c in clean], np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cut(train_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [normalised(t)[:train_bytes] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(text, pa.binary())], ["lang", "n", "text"])

    return run


def training_texts(docs: DataFrame, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS, share_bytes: int = SHARE_BYTES) -> dict[str, bytes]:
    """Normalised text of each language, up to train_bytes, from the train_docs labelled documents with the least hashes
    (ties by doc_id) that aren't held out and have a letter, however long they are.

    Each gives its first share_bytes, in order of the hashes; if that doesn't fill the bytes, they give what follows.

    Only (lang, doc_id, hash) rows are ranked, in three steps: a language's rows are dealt by the hash to ever fewer
    parts, each of which keeps its first train_docs, so that a language with most of the corpus is many tasks' work. The texts of
    those that remain, and no others, are then taken from the table.
    """
    labelled = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    labelled = labelled.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("doc_id", "text"))
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("hash", "doc_id"))
    chosen = labelled.select("lang", "doc_id", "hash")
    for parts in PARTS:
        chosen = chosen.withColumn("part", F.pmod("hash", F.lit(parts))).withColumn("n", least("lang", "part")).where(F.col("n") <= train_docs)
        chosen = chosen.select("lang", "doc_id", "hash")
    chosen = chosen.distinct().withColumn("n", least("lang")).where(F.col("n") <= train_docs)
    # train_docs narrow rows a language: far less than its automaton, which is broadcast too
    rows = labelled.join(F.broadcast(chosen), ["lang", "doc_id", "hash"])
    again = F.row_number().over(Window.partitionBy("lang", "doc_id", "hash").orderBy("n"))
    rows = rows.withColumn("copy", again).where("copy = 1").select("lang", "n", "text").mapInArrow(_cut(train_bytes), "lang string, n int, text binary")
    out: dict[str, bytes] = {}
    rest: list[bytes] = []
    before = None
    for r in [*rows.orderBy("lang", "n").toLocalIterator(), None]:
        if before is not None and (r is None or r["lang"] != before):
            out[before] = b" ".join([out[before], *rest])[:train_bytes]
            rest = []
        if r is None:
            break
        before = r["lang"]
        out[before] = out.get(before, b"") + b" " + bytes(r["text"][:share_bytes])
        rest.append(bytes(r["text"][share_bytes:]))
    return {k: v for k, v in out.items() if v.strip()}


def _predict(model, earlier: bool, last: bool):
    """One pass: the least cost so far (its language and bytes), and the least of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(model.value)
        names = np.array([*m.languages, None], object)
        for batch in batches:
            for part in ragged.slices(batch, limit=2_000_000):
                total, size = m.costs(part.column("text").to_pylist())
                total = np.concatenate([total, np.full((len(size), 2), np.inf)], 1)
                by = np.argsort(total, 1, kind="stable")[:, :2]
                (best, rest), own = np.take_along_axis(total, by, 1).T, names[np.minimum(by[:, 0], len(m.languages))]
                if earlier:
                    had, had_rest = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_best", "_rest"))
                    kept = had <= best  # of equal ones the first by name
                    own = np.where(kept, np.array(part.column("_lang").to_pylist(), object), own)
                    best, rest = np.where(kept, had, best), np.minimum(np.where(kept, best, had), np.where(kept, had_rest, rest))
                carried = [(c, n) for c, n in zip(part.columns, part.schema.names, strict=True) if n not in ("_best", "_rest", "_lang")]
                if not last:
                    more = [pa.array(best), pa.array(rest), pa.array(own, pa.string())]
                    yield pa.RecordBatch.from_arrays([*[c for c, _ in carried], *more], [*[n for _, n in carried], "_best", "_rest", "_lang"])
                    continue
                none = (size == 0) | np.isinf(best)
                with np.errstate(invalid="ignore"):
                    score = np.where(none, 0.0, np.where(np.isinf(rest), 1.0, rest / (rest + best)))
                    rate = np.where(none, 0.0, best / np.maximum(size, 1))
                yield pa.RecordBatch.from_arrays(
                    [*[c for c, _ in carried], pa.array(np.where(none, "und", own), pa.string()), pa.array(score), pa.array(rate)],
                    [*[n for _, n in carried], "lang_pred", "score", "phrase_rate"],
                )

    return run


def identify(docs: DataFrame, model: Model | list[Model] | None = None, keep: list[str] | None = None, staged: Staged | None = None) -> DataFrame:
    """Columns `keep` of docs (doc_id and text by default) with lang_pred, score and phrase_rate.

    A text is parsed greedily into the longest phrases that occur in a language's training text (Ziv and
    Merhav's cross-parsing); phrases times log2 of the training length estimate its cost there, and the
    language of the least cost wins (ties: the first by name). score is runner-up cost / (runner-up + best):
    0.5 for a tie, 1 with a single language. phrase_rate is the best cost a byte. Whole texts are parsed.

    Any number of languages is learned; each PASS_LANGUAGES of them are a model and a pass over the texts, which
    are written again between passes. With one model, texts are read once and nothing moves.

    Null text or no letter: `und`, score 0. Nothing to learn from: all `und`. Null or repeated doc_id: a row
    each. Empty table: empty result. lang, source and doc_id play no part in a prediction. Columns of keep that
    have a name of an added one (or _best, _rest, _lang) are left out.
    """
    keep = keep or ["doc_id", "text"]
    names = {"lang_pred", "score", "phrase_rate", "_best", "_rest", "_lang"}
    keep = [c for c in keep if c.lower() not in names]
    models = Model.fit_passes(training_texts(docs)) if model is None else [model] if isinstance(model, Model) else model
    out = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    fields = out.schema.fields
    kinds = lambda *pairs: [T.StructField(n, t) for n, t in pairs]
    between = kinds(("_best", T.DoubleType()), ("_rest", T.DoubleType()), ("_lang", T.StringType()))
    added = kinds(("lang_pred", T.StringType()), ("score", T.DoubleType()), ("phrase_rate", T.DoubleType()))
    for i, m in enumerate(models):
        last = i == len(models) - 1
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(m))
        out = out.mapInArrow(_predict(sent, i > 0, last), T.StructType([*fields, *(added if last else between)]))
        if not last:
            staged = staged or Staged(docs.sparkSession)
            out = staged.put(out, "languages")
    return out if "text" in keep else out.drop("text")
