"""Recurring lines against brute force: the tree of templates and what stays of each text."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from percola.llm.line_dedup import DEPTH, PERCENT, dedup_lines, parse
from percola.llm.queries import QUERIES


def templates(words):
    """What a line shares with others: its words with numbers left open, without one run below the leaf, and where that was."""
    size, out = len(words) * (100 - PERCENT) // 100, [(words, -1)]
    if size:
        out += [(words[:a] + words[a + size :], a) for a in range(DEPTH, len(words), size)]
    return [(len(words), words[:DEPTH], *t) for t in out]


def brute(rows):
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    places = {}
    for d in docs:
        for pos, raw in enumerate(d[2].split("\n")):
            words = re.findall(r"[^ \t-\r]+", raw)
            masked = ["<*>" if re.search("[0-9]", w) else w for w in words]
            if words:
                for t in templates(tuple(words if set(masked) == {"<*>"} else masked)):
                    places.setdefault(t, []).append((*d, pos))
    gone = {p for found in places.values() for p in found if p > min(found)}
    out = []
    for i, t in rows:
        at = [] if t is None else t.split("\n")
        kept = [x for p, x in enumerate(at) if (i is None, i or 0, t, p) not in gone]
        out.append((i, len(at), len(at) - len(kept), t if t is None else "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "a", "Réo", "of", "x|y", "end."])
    banner = lambda i: f"Copyright {1990 + i} by the firm, page {i} of 9{i}"
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.choice([1, 2, 6, 10]))) for _ in range(rng.randrange(9))]
        rows.append((i, "\n".join([banner(i), *lines, f"{i} 7 {i * 3}", "", " \t "])))
    near = "Sign up for our letter to read more news on {} every day"
    rows += [(100 + k, near.format(w)) for k, w in enumerate(["cats", "dogs", "birds"])]
    rows += [(200, None), (201, ""), (202, "same id"), (202, "same id, other text"), (203, "twice\ntwice"), (203, "twice\ntwice"), (None, near.format("cows")), (204, "x" * 40_000 + "\r")]
    want = sorted(brute(rows), key=str)
    # several documents have one text only where the id is the same, so the hash orders nothing but id 202's two, which share no line
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(map(tuple, dedup_lines(df).collect()), key=str) == want
    by_id = {r[0]: r for r in want}
    assert by_id[0][3].startswith("Copyright 1990") and "Copyright" not in by_id[1][3]  # numbers differ
    assert by_id[100][2] == 0 and by_id[101][3] == "" and by_id[None][3] == ""  # one word differs
    assert by_id[5][3].find("5 7 15") >= 0  # numbers alone are no template
    assert dedup_lines(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "7", "é9"]), min_size=1, max_size=16), min_size=1, max_size=12))
def test_templates_are_those_of_brute_force(lines):
    x = parse(pa.array(["\n".join(" ".join(w) for w in lines)]))
    cut = np.concatenate([[0], np.cumsum(x.n_templates)])
    got = [{("line", int(x.leaf[i]), int(x.key[i])), *[(int(x.leaf[i]), int(t)) for t in x.templates[cut[i] : cut[i + 1]]]} for i in range(len(lines))]
    masked = [tuple("#" if re.search("[0-9]", w) else w for w in line) for line in lines]
    want = [set(templates(tuple(line) if set(m) == {"#"} else m)) for line, m in zip(lines, masked, strict=True)]
    for i in range(len(lines)):
        assert len(got[i]) == len(want[i])
        for j in range(i):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_hot_leaf_and_hot_line(spark):
    # a third of the lines are one line, a third share a leaf and nothing else, a third differ in one field
    word = lambda i: "".join(chr(97 + (i * 7919 >> k) % 26) for k in range(0, 24, 4))
    kinds = ["one line that all of these have", "the same leaf {} {} {} {} {} {}", "user name is {} and all else here is alike"]
    rows = [(i, kinds[i % 3].format(*[word(6 * i + k) for k in range(6)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id % 3, r.n_dropped) for r in dedup_lines(df).collect())
    assert got == {(0, 0): 1, (0, 1): 999, (1, 0): 1000, (2, 0): 1, (2, 1): 999}


def test_registered():
    assert "op1_line_dedup" in QUERIES and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
