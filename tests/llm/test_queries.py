"""The registered queries themselves, over small tables with nulls, repeats and clashing columns: their columns and their rows."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from percola.llm import queries as q
from tests.llm.test_text_operators import brute_contamination, brute_near, brute_statistics, corpus, junk, ordered

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, row string, items string, spans string, _key string, copies string, label string"
ITEMS = [(1, "the of and"), (2, "Réo ONE two"), (3, None), (None, "end"), (10, "two end"), (2, "4")]


@pytest.fixture(scope="module")
def rows():
    return corpus(9, 60) + [(1000 + i, junk(i)[1], "en", "a", *corpus(9, 1)[0][4:]) for i in range(80)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(1000 + i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def run(spark, folder):
    def go(name, *columns):
        df = q.queries()[name](spark, folder)
        assert df.columns[: len(columns)] == list(columns)
        return [tuple(r) for r in df.collect()]

    return go


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_op1(run, rows):
    got = run("op1_line_dedup", "doc_id", "n_lines", "n_dropped", "text")
    assert ordered((r[0], r[1]) for r in got) == ordered((r[0], 0 if r[1] is None else r[1].count("\n") + 1) for r in rows)
    assert all(r[1] - r[2] == (0 if not r[1] - r[2] else r[3].count("\n") + 1) for r in got if r[3] is not None)


def test_op2(run, rows):
    got = run("op2_mixing", "doc_id", "size", "source_size", "target", "taken")
    assert len(got) == len(rows) and all(r[4] <= 2 * r[1] for r in got)


def test_op3(run, rows):
    got = run("op3_quality", "doc_id", "held_out", "score", "predicted")
    assert ordered((r[0], r[1]) for r in got) == ordered((r[0], held_out(r[0])) for r in rows)
    assert all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in got)


def test_op4(run, rows):
    lib = Tokenizer.from_str(q.tokenizer_file())
    got = sorted(run("op4_token_store", "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1])
    ids = [(r[0], [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    assert ordered((r[0], r[2], r[3]) for r in got) == ordered((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_op5(run, rows):
    got = run("op5_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(a, b, c, len(d), hashlib.sha256(",".join(d).encode()).hexdigest(), e) for a, b, c, d, e in brute_contamination(rows, ITEMS)]
    assert ordered(got) == ordered(want) and any(r[3] > 1 for r in got)


def test_op6(run, rows):
    lib = Tokenizer.from_str(q.tokenizer_file())
    want = [(r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows]
    assert ordered(run("op6_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")) == ordered(want)


def test_op7(run, rows):
    got = run("op7_language", "doc_id", "held_out", "lang_pred", "score")
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert ordered((r[0], r[1], r[2] == "und") for r in got) == ordered((r[0], held_out(r[0]), not letters(r[1])) for r in rows)
    assert {r[2] for r in got} <= {"de", "en", "und"}


def test_op8(run, rows):
    got = run("op8_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    want = [(r[0], len((r[1] or "").encode()) + 16, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows]
    assert ordered(r[:3] for r in got) == ordered(want) and {(r[3], r[6]) for r in got} == {("bytes", None)}
    for s in range(40):
        own = sorted(r[5] for r in got if r[4] == s)
        assert own == list(range(len(own)))


def test_op9(run, rows):
    got = run("op9_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in rows:
        n, chars, symbols, again, repeat = brute_statistics(r[1])
        want.append((r[0], n, chars, symbols, again, repeat, n < 50 or 100 * repeat > 50 * n))
    assert ordered(r[:7] for r in got) == ordered(want)
    assert not any(r[8] for r in got if r[6])


def test_op10(run, rows):
    got = run("op10_near_dedup", "doc_id", "n_shingles", "component_id", "kept")
    component, _ = brute_near(rows, 85)
    assert len(got) == len(rows)
    assert all(r[2] == component.get(r[0]) and r[3] == (r[0] is None or r[2] == r[0]) for r in got)
