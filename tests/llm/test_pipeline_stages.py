"""Each stage of the pipeline, and all of them, against brute force, on rows with nulls, repeats and clashing columns."""

import collections
import random
import zlib

import pytest

import corpus_pipeline
from percola.llm.mixing import mix_plan
from percola.llm.near_dedup import near_duplicates
from percola.session import Staged
from tests.llm.test_text_operators import SPACE_WORD, brute_contamination, brute_near

DE, EN = "der die das und ist nicht ein haus baum weg", "the and of to in that is house tree road"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, lang_pred string, contaminated string, _row string, _copies string"
ITEMS = [(i, " ".join(f"quiz{i}x{k}" for k in range(20))) for i in range(4)] + [(9, None), (None, "the and of")]


def made_rows():
    rng = random.Random(11)
    say = lambda words, n: " ".join(rng.choice(words.split()) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(n))
    rows = [(i, say((DE, EN)[i % 2], 60 + i % 40), ("de", "en")[i % 2], rng.choice("abc")) for i in range(120)]
    for k in range(8):  # near copies of row k, and an exact one
        words = rows[k][1].split()
        words[30] = "changed"
        rows += [(200 + k, " ".join(words), rows[k][2], "a"), (300 + k, rows[k][1], None, "b")]
    for k in range(4):  # whole items, and a share of words too small to count
        rows += [(400 + k, say(EN, 50) + " " + ITEMS[k][1], "en", "a"), (410 + k, say(EN, 600) + " " + ITEMS[k][1], "en", "c")]
    rows += [(500, None, "de", "a"), (501, "", None, None), (502, "12 -- 34", "en", "a"), (503, "haus", None, None), (504, say(DE, 9000), None, "b")]
    rows += [(None, say(EN, 30), "en", "c"), (None, None, None, None), (505, say(EN, 40), "en", "a"), (505, say(DE, 40), "de", "b"), rows[3]]
    return [(*r, None, 7, 8, "x", "y", "z", "c") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(made_rows(), COLUMNS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def with_letters(rows):
    """What language identification keeps; the languages are told apart by their words."""
    kept = []
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            near = max(("de", "en"), key=lambda x: sum(w.strip("0123456789") in (DE, EN)[x == "en"].split() for w in r[1].split()))
            kept.append((*r[:2], r[2] or near, *r[3:]))
    return kept


def without_near(rows):
    component, _ = brute_near(rows, 80)
    kept, seen = [], collections.defaultdict(list)
    for r in rows:
        if r[0] is None:
            kept.append(r)
        elif component[r[0]] == r[0]:
            seen[r[0]].append(r)
    return kept, seen


def test_language_id(spark, docs, folder):
    out = corpus_pipeline.language_id(spark, docs, folder)
    assert out.columns == docs.columns
    assert rows_of(out) == collections.Counter(with_letters(made_rows()))


def test_near_dedup(spark, docs, folder):
    out = corpus_pipeline.near_dedup(spark, docs, folder)
    got = rows_of(out)
    kept, seen = without_near(made_rows())
    assert out.columns == docs.columns and sum(got.values()) == len(kept) + len(seen)
    for r in kept:
        assert got[r] > 0
    for same in seen.values():
        assert sum(got[r] for r in set(same)) == 1


def test_decontamination(spark, docs, folder):
    bad = [x[4] for x in brute_contamination(made_rows(), ITEMS)]
    assert sum(bad) == 4
    out = corpus_pipeline.decontamination(spark, docs, folder)
    assert out.columns == docs.columns and rows_of(out) == collections.Counter(r for r, b in zip(made_rows(), bad, strict=True) if not b)


def test_mixing(spark, docs, folder):
    unique = docs.where("doc_id is not null and doc_id not in (3, 505)")
    out = corpus_pipeline.mixing(spark, unique, folder)
    copies = {r.doc_id: r.copies for r in mix_plan(unique).collect()}
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({k: n for k, n in copies.items() if n})
    sizes = collections.Counter(r.source for r in mix_plan(docs).collect() for _ in range(r.copies))
    assert collections.Counter(r.source for r in corpus_pipeline.mixing(spark, docs, folder).collect()) == sizes


def test_sharding(spark, docs, folder):
    out = corpus_pipeline.sharding(spark, docs, folder)
    got = out.collect()
    kept = [c for c in docs.columns if c not in ("size", "shard")]
    assert rows_of(out.select(*kept)) == rows_of(docs.select(*kept))
    total = sum(len((r.text or "").encode()) + 16 for r in got)
    for s in range(40):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        # no shard is above its share by more than one document
        assert sum(r.size for r in own) <= total / 40 + max((r.size for r in own), default=0)
    assert all(r.text_crc32 == (None if r.text is None else zlib.crc32(r.text.encode())) for r in got)


def test_run(spark, folder):
    """The stages one after another, by brute force up to the mix, and what the mix takes of that by its plan."""
    rows = with_letters(made_rows())
    kept, seen = without_near(rows)
    # rows 505 and 3 are repeated; either of 505's may stay, so what stayed is read off
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    rest = kept + [max(same, key=lambda r: any(x.text == r[1] for x in out)) for same in seen.values()]
    rest = [r for r, b in zip(rest, brute_contamination(rest, ITEMS), strict=True) if not b[4]]
    assert ids <= {r[0] for r in rest} and not ids & {*range(200, 208), *range(300, 308), *range(400, 404), 500, 501, 502}
    plan = mix_plan(Staged(spark).put(spark.createDataFrame(rest, COLUMNS), "rest")).collect()
    want = collections.Counter()
    for r in plan:
        want[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in out) == +want
    assert {r.shard for r in out} <= set(range(40)) and all(r.size == len(r.text.encode()) + 16 for r in out)
    assert sum(len(SPACE_WORD.findall(r.text)) for r in out) == sum(r.taken for r in plan)


def test_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def text(name, changed=None):
    words = [f"{name}{i}" for i in range(54)]  # 50 shingles, 5 of them around a changed word
    return " ".join("other" if i == changed else w for i, w in enumerate(words))


def test_near_dedup_stage_at_82_percent(spark):
    rows = [(1, text("a")), (2, text("a", 25)), (3, text("b"))]  # 45 of 55 shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_repeated_doc_id_posts_each_text(spark):
    rows = [(1, text("a")), (1, text("b")), (2, text("a", 2)), (3, text("b", 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(docs, percent=80).collect()} == {(1, 1), (2, 1), (3, 1)}
