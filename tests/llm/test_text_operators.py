"""Each operator against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from percola.llm.decontamination import contamination
from percola.llm.language import Model, identify, training_texts
from percola.llm.line_labels import FEATURES, Field, fit_field, quality_rules
from percola.llm.mixing import mix, mix_plan
from percola.llm.near_dedup import drop_near_duplicates, near_duplicates, shingle_sets
from percola.llm.pretokens import Memo
from percola.llm.quality import RANDOM, STATISTICS, document_statistics, fit, pool_adjacent, quality_scores
from percola.llm.sharding import shard, splitters
from percola.llm.statistics import statistics
from percola.llm.token_counts import Merges, count_texts, token_counts
from percola.llm.token_store import _combine, _shift_tables, read_digests, read_ids, verify, write_store
from percola.session import Staged

WORDS = ["the", "of", "and", "Réo", "ther*", "ONE", "two", "x|y", "4", "end.", "ést"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, row string, items string, spans string, _key string, copies string, label string"


def corpus(seed=3, n=70):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(k))
    rows = [(i, text(rng.choice([1, 3, 6, 30, 80])), rng.choice(["en", "de"]), rng.choice(["a", "b", "ß", "c"])) for i in range(n)]
    base = text(120)
    for i in range(n, n + 12):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "b"))
    rows += [(n + 20 + i, base, "en", "b") for i in range(5)]  # exact copies
    rows += [(900, None, None, None), (901, "", "en", None), (902, " \n\t ", None, "a"), (903, "!!! 123 ***", "en", "a"), (None, "a b c d e f", "en", "c"), (None, None, None, None)]
    rows += [(904, text(6000), "en", "a"), (905, "x" * 30_000, "en", "a"), (3, "again a row of this id", "de", "a"), rows[5], rows[5], (906, "<|endoftext|>and<|endoftext|>", "en", "a"), (907, "a\0b \x1c c", "en", "b")]
    return [(*r, None, 1, 0.5, 9, "r", "i", "s", "k", "c", "l") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return Staged(spark).put(spark.createDataFrame(rows, COLUMNS).repartition(3), "docs")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def collected(df, *columns):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def ordered(values):
    return sorted(values, key=lambda r: tuple((v is None, str(v)) for v in r))


SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def test_mix(docs, rows, none):
    plan = mix_plan(docs).collect()
    sizes = [(r[3], len(SPACE_WORD.findall(r[1] or ""))) for r in rows]
    total = collections.Counter()
    for s, k in sizes:
        total[s] += k
    assert sorted((r.source or "~", r.size) for r in plan) == sorted((s or "~", k) for s, k in sizes)
    names = sorted([s for s in total if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), list(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    taken, most = collections.Counter(), collections.Counter()
    for r in plan:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source] and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] + 1 for s in names)
    assert sorted(map(tuple, mix_plan(docs.repartition(5)).collect(), ), key=str) == sorted(map(tuple, plan), key=str)
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in plan)
    unique = docs.where("doc_id between 10 and 60")
    plan = {r.doc_id: r.copies for r in mix_plan(unique).collect()}
    assert collections.Counter(r.doc_id for r in mix(unique).collect()) == collections.Counter({k: c for k, c in plan.items() if c})
    assert mix_plan(none).count() == 0 and mix(none).count() == 0


def test_shard(docs, rows, none, spark):
    out = shard(docs, n_shards=7, tolerance=0.0, lanes=5)
    got = out.collect()
    assert [c for c in out.columns if c in docs.columns] == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "shard"]
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
    for r in got:
        data = (r.text or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == (None if r.text is None else zlib.crc32(data)) and r.law == "bytes" and r.grown_shard is None
    for s in range(7):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    even = spark.range(4000).selectExpr("id AS doc_id", "repeat('ab', cast(id % 50 as int)) AS text")
    sizes = collections.Counter()
    for r in shard(even, 10).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 10 and max(sizes.values()) < 1.02 * min(sizes.values())
    same = spark.range(3000).selectExpr("id AS doc_id", "'one text' AS text")  # a single text is still spread
    counts = collections.Counter(r.shard for r in shard(same, 10).collect())
    assert len(counts) == 10 and max(counts.values()) < 1.1 * min(counts.values())
    assert shard(none).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.02])
def test_splitters(spark, tolerance):
    """Each splitter against the sorted table: as near to its aim as the tolerance asks, or as one key allows."""
    rng = random.Random(6)
    keys = [rng.randrange(1 << 63) for _ in range(300)] + [5 << 40] * 150 + [(5 << 40) + i for i in range(80)] + [0, 0, (1 << 63) - 1]
    rows = [(k, rng.choice([16, 40, 900])) for k in keys]
    for n in (1, 2, 9, 40):
        got = splitters(spark.createDataFrame(rows, "key long, size long"), n, tolerance)
        total = sum(s for _, s in rows)
        assert len(got) == n - 1 and got == sorted(got)
        for j, key in enumerate(got, 1):
            aim = total * j / n
            off = lambda x: abs(sum(s for k, s in rows if k < x) - aim)
            best = min(off(x) for x in {*keys, 1 << 63})
            assert off(key) <= max(best, tolerance * total / n) + 1e-6
    assert splitters(spark.createDataFrame([], "key long, size long"), 4, 0.0) == [(1 << 63) - 1] * 3


def brute_near(rows, percent):
    sets = collections.defaultdict(list)
    for r in rows:
        w = SPACE_WORD.findall(lower(r[1] or ""))
        sets[r[0]].append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates(docs, rows, none):
    want, sets = brute_near(rows, 85)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(s)) for i, ss in sets.items() for s in ss)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    kept = drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for c in want.values()}) and sum(r.doc_id is None for r in kept) == 2
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_near_duplicates_of_many_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(100))) for i in range(300)]
    want, _ = brute_near(rows, 85)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and got[1000] == 1000


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_chains_of_growing_sets(spark, monkeypatch, percent):
    """Candidate components of many blocks and bands: texts that grow word by word, so that near ones are of neighbouring sizes."""
    from percola.llm import near_dedup

    monkeypatch.setattr(near_dedup, "ROWS_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 16)
    rng = random.Random(12)
    rows = []
    for c in range(3):
        words = [f"w{c}x{i}" for i in range(260)]
        rows += [(1000 * c + i, " ".join(words[: 20 + 2 * i])) for i in rng.sample(range(120), 70)]
    rows += [(5000 + i, f"one {' '.join(f'n{i}y{k}' for k in range(6))} end") for i in range(30)]
    rows += [(1003, rows[3][1] + " and more"), (None, rows[5][1])]
    want, _ = brute_near(rows, percent)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    got.pop(None)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\n\t\0\x1c.1", max_size=40), min_size=1, max_size=6))
def test_shingle_sets(texts):
    values, off = shingle_sets(pa.array(texts), 5)
    for i, t in enumerate(texts):
        w = SPACE_WORD.findall(lower(t))
        assert off[i + 1] - off[i] == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items, window=13):
    spans = collections.defaultdict(set)
    for i, t in items:
        w = BENCH_WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - window + 1)) if w and i is not None else []:
            spans[tuple(w[k : k + window])].add(str(i))
    lengths = {len(s) for s in spans}
    for r in rows:
        w = BENCH_WORD.findall(lower(r[1] or ""))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if ids := spans.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        yield r[0], len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [10**6, 200])
def test_contamination(spark, docs, rows, none, block_bytes):
    rng = random.Random(8)
    long = next(r[1] for r in rows if r[0] == 904).split()
    items = [(i, " ".join(long[k : k + 20 + i])) for i, k in enumerate(rng.sample(range(5000), 8))]
    items += [(50, "two end"), (51, "4"), (52, None), (None, "the of and"), (53, "..."), (54, "the of and"), (54, "Réo"), (55, " ".join(["the"] * 30))]
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    got = contamination(docs, bench, block_bytes=block_bytes)
    assert collected(got.selectExpr("doc_id", "n_words", "n_hit", "item_ids", "contaminated"), "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == ordered((a, b, c, list(d), e) for a, b, c, d, e in brute_contamination(rows, items))
    assert contamination(none, bench).count() == 0
    clean = contamination(docs, bench.limit(0))
    assert clean.count() == len(rows) and clean.where("n_hit > 0 or contaminated").count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


ALPHABET = "ab sStdDmM'’ \n\t\r  éñß漢字١²Ⅷ0!?-_|<>.,\U0001f600́"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=8))
def test_counts_equal_the_library(texts):
    lib, merges, memo = test_counts_equal_the_library.tools
    assert count_texts(pa.array(texts), merges, memo).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as _f:
    _json = _f.read()
test_counts_equal_the_library.tools = (Tokenizer.from_str(_json), Merges(_json), Memo(np.int32, 5000))


def test_token_counts(docs, rows, none, vocabulary):
    lib = Tokenizer.from_str(vocabulary)
    want = [(r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows]
    assert collected(token_counts(docs, vocabulary), "doc_id", "n_bytes", "n_tokens", "over_limit") == ordered(want)
    assert token_counts(none, vocabulary).count() == 0


def test_token_store(spark, docs, rows, none, vocabulary):
    lib = Tokenizer.from_str(vocabulary)
    ids = [(r[0], [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    store = write_store(docs, Staged(spark).path("store"), vocabulary)
    got = sorted(read_digests(store).collect(), key=lambda r: r.start)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), crc(x)) for i, x in ids)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    back = read_ids(store, [904, 905, 901])
    assert all(back[i].tolist() == dict(ids)[i] for i in (904, 905, 901))
    chunks = store.table("chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() and verify(store)
    empty = write_store(none, Staged(spark).path("store"), vocabulary)
    assert read_digests(empty).count() == 0 and verify(empty)


def test_a_changed_chunk_is_found(spark, vocabulary):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    store = write_store(docs, Staged(spark).path("store"), vocabulary)
    changed = store.table("chunks").selectExpr("digest", "n", "cast(concat(substring(ids, 1, octet_length(ids) - 1), X'07') as binary) AS ids").collect()
    spark.createDataFrame(changed, "digest binary, n int, ids binary").write.mode("overwrite").parquet(f"{store.path}/chunks")
    with pytest.raises(Exception, match="does not match its digest"):
        read_digests(store).collect()


def test_swapped_recipes_are_found(spark, vocabulary):
    docs = spark.createDataFrame([(1, "one two"), (2, "six ten"), (3, "other")], "doc_id long, text string")
    store = write_store(docs, Staged(spark).path("store"), vocabulary)
    recipes = [r.asDict() for r in store.table("recipes").orderBy("doc_id").collect()]
    assert recipes[0]["n_tokens"] == recipes[1]["n_tokens"]
    recipes[0]["digests"], recipes[1]["digests"] = recipes[1]["digests"], recipes[0]["digests"]
    schema = store.table("recipes").schema
    spark.createDataFrame(recipes, schema).write.mode("overwrite").parquet(f"{store.path}/recipes")
    assert not verify(store)
    with pytest.raises(ValueError, match="documents' roots"):
        read_digests(store)
    recipes[0]["root"], recipes[1]["root"] = recipes[1]["root"], recipes[0]["root"]  # roots of documents hold, the part's doesn't
    spark.createDataFrame(recipes, schema).write.mode("overwrite").parquet(f"{store.path}/recipes")
    with pytest.raises(ValueError, match="a part's root"):
        read_digests(store)


def test_other_tokenizer_files_are_refused(spark, vocabulary):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    spec = json.loads(vocabulary)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError, match="plain byte-level"):
            write_store(docs, Staged(spark).path("store"), json.dumps(spec | change))


@given(st.lists(st.tuples(st.lists(st.integers(0, 60), unique=True), st.integers(0, 3)), max_size=12))
def test_memo_forgets_but_never_errs(steps):
    memo = Memo(np.int32, 20)
    for keys, k in steps:
        keys = np.array(sorted(keys), np.uint64)
        size, flat, off = memo.values(keys)
        for x, n, o in zip(keys.tolist(), size.tolist(), off.tolist(), strict=True):
            assert n in (-1, x % 4) and (n < 0 or flat[o : o + n].tolist() == list(range(x, x + n)))
        new = keys[size < 0]
        memo.add(new, (new % np.uint64(4)).astype(np.int64), np.array([i for x in new.tolist() for i in range(x, x + x % 4)], np.int32))
        assert (memo.values(new)[0] >= 0).all() and len(memo) <= 20 + 61 * 2


@given(st.binary(max_size=60), st.binary(max_size=300))
def test_joined_checksums(a, b):
    one = lambda x: np.array([zlib.crc32(x)], np.uint32)
    assert _combine(one(a), one(b), np.array([len(b)]), _shift_tables(12))[0] == zlib.crc32(a + b)


def greedy(text, train):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcd e", min_size=1, max_size=80), min_size=1, max_size=3), st.lists(st.text(alphabet="abcd eq", max_size=50), max_size=5))
def test_phrases(train, texts):
    model = Model.fit({f"l{i}": t.encode() for i, t in enumerate(train)})
    got = model.phrases([t.encode() for t in texts])
    assert got.tolist() == [[greedy(t, x) for x in train] for t in texts]


def test_languages(spark, docs, rows, none):
    got = identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert identify(none).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}
    one, two = "der die das und ist nicht ein ", "the and of to in that is "
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice((one, two)[i % 2].split()) for _ in range(30)), ("de", "en")[i % 2]) for i in range(200)]
    out = identify(spark.createDataFrame(made, "doc_id long, text string, lang string"), keep=["doc_id", "lang", "text"]).collect()
    assert all(r.lang == r.lang_pred for r in out)


def test_languages_of_long_texts_are_learned(spark):
    rng = random.Random(2)
    text = lambda words, n: " ".join(rng.choice(words.split()) for _ in range(n))
    de, en = "der die das und ist nicht ein", "the and of to in that is"
    made = [(i, text(de, 25_000), "de") for i in range(6)] + [(i, text(en, 20), "en") for i in range(10, 30)]
    made += [(i, "123 " * 30_000, "no") for i in range(40, 140)] + [(140, "123 " * 20_000 + text("ord og eller ikke", 400), "no")]
    made += [(30, text(en, 20), "en")] * 300  # one row many times
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    assert set(training_texts(docs)) >= {"de", "en"} and all(len(x) <= 16_000 for x in training_texts(docs).values())
    assert all(r.lang_pred == r.lang for r in identify(docs, keep=["lang", "text"]).collect() if r.lang != "no")
    wide = training_texts(docs, train_docs=2, share_bytes=100)
    assert len(wide["de"]) == 16_000 and len(wide["en"]) < 400


def test_more_languages_than_a_pass(spark):
    rng = random.Random(3)
    words = [["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(6)] for _ in range(70)]
    made = [(70 * j + i, " ".join(rng.choice(w) for _ in range(40)), f"l{i:02}") for j in range(8) for i, w in enumerate(words)]
    made += [(10_000, None, None), (10_001, "", "l01"), (10_002, "12 !", "l02")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    texts = training_texts(docs)
    assert len(texts) == 70
    keys = ("doc_id", "lang_pred", "score", "phrase_rate")
    want = collected(identify(docs, Model.fit(texts)), *keys)
    assert collected(identify(docs), *keys) == want and collected(identify(docs, Model.fit_passes(texts, 30)), *keys) == want
    known = {r[0]: r[2] for r in made}
    assert sum(known[w[0]] == w[1] for w in want) > 0.95 * 560


def brute_statistics(t):
    w = SPACE_WORD.findall(t or "")
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if SPACE_WORD.search(line):
            again += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(cover)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\r\0#|", max_size=60)), min_size=1, max_size=6))
def test_statistics(texts):
    s = statistics(pa.array(texts, pa.string()))
    got = list(zip(s.n_words.tolist(), s.word_chars.tolist(), s.n_symbols.tolist(), s.n_dup_lines.tolist(), s.n_repeat_words.tolist(), strict=True))
    assert got == [brute_statistics(t) for t in texts]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    field = Field(rng.normal(size=(22, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [0, 1, 5, 3, 0, 7]
    x = rng.integers(0, 2, (sum(sizes), 22)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = field.viterbi(x, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        def value(y, a=a):
            return field.start[y[0]] + sum(field.emit[:, c] @ x[a + i] for i, c in enumerate(y)) + sum(field.step[c, d] for c, d in zip(y, y[1:]))
        if b > a:
            best = max(([int(c) for c in f"{k:0{b - a}b}"] for k in range(2 ** (b - a))), key=value)
            assert value(best) == pytest.approx(value(got[a:b].tolist()), abs=1e-4)


def junk(i):
    good = "The quick words of a plain sentence follow here.\nAnother line of them is calm and ends." * 4
    bad = "BUY*** NOW!! $$$ | CLICK | %%%\nFREE$$$ CASH!! ### | WIN |" * 5
    return (i, f"{good} {i} {i * 7}" if i % 2 else f"{bad} {i} {i * 7}")


def test_quality_rules(spark, docs, rows, none):
    made = spark.createDataFrame([junk(i) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i in range(200)], (None, 1, 0), (5000, 1, 0), (7, None, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
    field = fit_field(made, labels)
    got = quality_rules(docs, field).collect()
    want = []
    for r in rows:
        n, chars, symbols, again, repeat = brute_statistics(r[1])
        want.append((r[0], n, chars, symbols, again, repeat, n < 50 or 100 * repeat > 50 * n))
    assert ordered(tuple(r)[:7] for r in got) == ordered(want)
    assert all(not r.kept for r in got if r.base_failed)
    loose = quality_rules(made, field, least_words=1, most_repeated=100).collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in loose)
    assert quality_rules(none, field).count() == 0
    assert quality_rules(docs, fit_field(made, labels.limit(0))).count() == len(rows)


def test_quality_scores(spark, docs, rows, none):
    made = spark.createDataFrame([*[junk(i) for i in range(400)], (901, ""), (902, None), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(400)], (None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    got = quality_scores(made, labels).collect()
    assert len(got) == 403
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id < 400)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(none, labels).count() == 0


def test_quality_fit_equals_dense_ridge(spark):
    """The partition-summed fit against the dense one: standardised features, ridge weights, and isotonic means of bins."""
    made = [junk(i) for i in range(300)]
    stats = document_statistics(pa.array([t for _, t in made])).astype(np.float32)
    label = np.array([float((i * 7 + i // 5) % 3 > 0) for i in range(300)])
    cal = np.arange(300) % 5 == 0
    rows = [(bytearray(x.tobytes()), float(y), bool(c)) for x, y, c in zip(stats, label, cal, strict=True)]
    model = fit(spark.createDataFrame(rows, "stats binary, label double, calibrate boolean").repartition(7))
    x = stats[~cal].astype(float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(0), 1e-8)) + 1e-3, rtol=1e-4)
    f = model.features(x)
    z = np.clip((x - model.mean) / model.scale, -4, 4)
    assert np.allclose(f[:, :-1], np.cos(z @ model.frequencies + model.phases) * np.sqrt(2 / RANDOM)) and (f[:, -1] == 1).all()
    penalty = np.diag([*[1e-2 * len(x) / RANDOM] * RANDOM, 0]) + 1e-9 * np.eye(RANDOM + 1)
    assert np.allclose(f @ model.weights, f @ np.linalg.solve(f.T @ f + penalty, f.T @ label[~cal]), atol=1e-6)
    # calibration: the best monotone means of the bins, each pool with one case of the prior
    raw, y = model.raw(stats[cal].astype(float)), label[cal]
    at = np.minimum(((np.clip(raw, -0.5, 1.5) + 0.5) * 200).astype(int), 399)
    bins = np.unique(at)
    count, total = np.array([(at == b).sum() for b in bins]), np.array([y[at == b].sum() for b in bins])
    plain = pool_adjacent(count, total)
    for k in range(len(bins)):  # the min-max formula of isotonic regression
        means = [min(total[a : b + 1].sum() / count[a : b + 1].sum() for b in range(k, len(bins))) for a in range(k + 1)]
        assert plain[k] == pytest.approx(max(means))
    assert np.allclose(model.knots, [raw[at == b].mean() for b in bins]) and (np.diff(model.levels) > 0).all()
    # the kernel that the features' products approximate
    k = f[:40, :-1] @ f[:40, :-1].T
    exact = np.exp(-((z[:40, None] - z[None, :40]) ** 2).sum(2) / (2 * STATISTICS))
    assert np.abs(k - exact).mean() < 0.08


def test_null_and_empty_texts_have_one_score(spark):
    made = spark.createDataFrame([*[junk(i) for i in range(200)], (901, ""), (902, None), (903, " \n"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    score = {r.doc_id: r.score for r in quality_scores(made, labels).collect()}
    assert [score[i] for i in (902, 903, None)] == pytest.approx([score[901]] * 3)


def test_field_maximises_its_likelihood():
    """fit() ends where the penalised likelihood, by enumeration of all labellings, has next to no slope."""
    rng = np.random.default_rng(3)
    sequences = [(rng.integers(0, 2, (n, FEATURES)).astype(np.float32), rng.integers(0, 2, n)) for n in (1, 2, 3, 4, 4)]
    field = Field.fit(sequences, rounds=3000, rate=0.02)
    start = np.concatenate([field.emit.ravel(), field.step.ravel(), field.start])

    def value(theta):
        emit, step, begin = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        out = -0.5 * (theta**2).sum()
        for x, y in sequences:
            score = lambda z: begin[z[0]] + (x @ emit)[np.arange(len(z)), z].sum() + sum(step[a, b] for a, b in zip(z, z[1:], strict=False))  # noqa: B023, E731
            every = [score([int(c) for c in f"{k:0{len(y)}b}"]) for k in range(2 ** len(y))]
            out += score(y.tolist()) - np.logaddexp.reduce(every)
        return out

    for i in range(0, len(start), 3):
        step = np.zeros_like(start)
        step[i] = 1e-4
        assert abs(value(start + step) - value(start - step)) / 2e-4 < 0.05
    assert value(start) > max(value(start + rng.normal(0, 0.1, len(start))) for _ in range(20))


def test_a_document_of_both_kinds_of_line(spark):
    """The share of words in content lines decides: junk lines outweigh or not."""
    made = spark.createDataFrame([junk(i) for i in range(300)], "doc_id long, text string")
    field = fit_field(made, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"))
    bad = junk(0)[1].split("\n")
    good = [f"Another line of {w} is calm and plain and ends." for w in ("them", "words", "these", "those", "a sentence", "the kind", "our sort", "his")]
    rows = [(k, "\n".join(bad[: len(bad) * k // 4] + good[: len(good) * (4 - k) // 4])) for k in range(5)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), field, least_words=1, most_repeated=100).collect()}
    share = [got[k].content_share for k in range(5)]
    assert share == sorted(share, reverse=True) and share[0] > 0.9 and 0.2 < share[2] < 0.9 and share[4] < 0.1
    assert all(got[k].kept == (share[k] >= 0.5) for k in range(5))


@given(st.lists(st.tuples(st.integers(1, 5), st.floats(0, 1)), min_size=1, max_size=20))
def test_pools_ascend(groups):
    count, total = np.array([c for c, _ in groups], float), np.array([c * m for c, m in groups])
    level = pool_adjacent(count, total)
    assert (np.diff(level) >= -1e-9).all() and (level * count).sum() == pytest.approx(total.sum(), abs=1e-6)


