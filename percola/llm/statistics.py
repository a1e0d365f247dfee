"""Counts over whole texts and their lines, for a run of texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from percola.llm import ragged

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _BANG, _END, _HIGH = (1 << i for i in range(8))
_marks = np.zeros(256, np.uint8)
for _bytes, _mark in (
    (range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (SYMBOLS, _SYMBOL),
    (b"|", _PIPE), (b"!", _BANG), (b".!?", _END), (range(128, 256), _HIGH),
):
    _marks[list(_bytes)] |= _mark


def repeated(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (group, key) pairs: which occur twice or more, and which equal an earlier one; groups ascend."""
    order = np.lexsort((np.arange(len(keys)), keys, group))
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (group[order][1:] == group[order][:-1])
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    again[order] = same[:-1]
    return twice, again


@dataclass
class Stats:
    """Arrays with an entry for each text, and for each line that has a word (line_*)."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_lines: np.ndarray
    n_distinct_words: np.ndarray
    n_bytes: np.ndarray
    marks: dict[str, np.ndarray]
    n_stutters: np.ndarray
    line_first: np.ndarray
    line_words: np.ndarray
    line_bytes: np.ndarray
    line_again: np.ndarray
    line_stutters: np.ndarray
    line_repeats: np.ndarray
    line_marks: dict[str, np.ndarray]
    line_ends: np.ndarray
    line_lower: np.ndarray


def statistics(column: pa.Array) -> Stats:
    """Words are runs of bytes other than space and U+0009 to U+000D, as written; lines are split at \\n. Nulls count as empty."""
    buf, off = ragged.utf8(column)
    n_texts = len(off) - 1
    mapped, begin, end, first = ragged.words(buf, off, ragged.SPACED)
    hashes = ragged.word_hashes(mapped, begin, end)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_texts), n_words)
    total = lambda flags, cut: ragged.grouped_sum(flags, cut)

    # three-word windows found twice or more, and the words they cover
    triple = ragged.windows(hashes, 3)
    inside = doc[: len(triple)] == doc[2:] if len(triple) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice, _ = repeated(triple[at], doc[at])
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    _, seen = repeated(hashes, doc)

    # lines: from a text's begin or after a \n, to the next \n or the text's end
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    starts = starts[starts < len(buf)]
    stops = np.append(starts[1:], len(buf))[: len(starts)]
    stops = stops - (buf[stops - 1] == 10)
    word_cut = np.searchsorted(begin, np.append(starts, len(buf)))
    with_word = np.diff(word_cut) > 0
    starts, stops, low, high = starts[with_word], stops[with_word], word_cut[:-1][with_word], word_cut[1:][with_word]
    line_doc = np.searchsorted(off, starts, "right") - 1
    line_hash = ragged.word_hashes(buf.astype(np.uint16) + np.uint16(1), starts, stops)
    _, again = repeated(line_hash, line_doc)
    line_first = np.searchsorted(line_doc, np.arange(n_texts + 1))

    mark = _marks[buf]
    names = {"upper": _UPPER, "lower": _LOWER, "digit": _DIGIT, "symbol": _SYMBOL, "pipe": _PIPE, "bang": _BANG, "high": _HIGH}
    sums = {k: np.concatenate([[0], np.cumsum((mark & m) != 0)]) for k, m in names.items()}
    lead = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & (mapped != 0))])
    of_words = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    span = lambda c, a, b: c[b] - c[a]
    st, rp = of_words(stutter), of_words(covered)
    last_byte = mark[end[high - 1] - 1] if len(high) else np.zeros(0, np.uint8)
    first_byte = mark[begin[low]] if len(low) else np.zeros(0, np.uint8)
    return Stats(
        n_words=n_words, word_chars=span(lead, off[:-1], off[1:]), n_symbols=span(sums["symbol"], off[:-1], off[1:]),
        n_dup_lines=total(again, line_first), n_repeat_words=total(covered, first), n_lines=np.diff(line_first),
        n_distinct_words=n_words - total(seen, first), n_bytes=np.diff(off),
        marks={k: span(c, off[:-1], off[1:]) for k, c in sums.items()}, n_stutters=total(stutter, first),
        line_first=line_first, line_words=high - low, line_bytes=stops - starts, line_again=again,
        line_stutters=span(st, low, high), line_repeats=span(rp, low, high),
        line_marks={k: span(c, starts, stops) for k, c in sums.items()}, line_ends=(last_byte & _END) != 0, line_lower=(first_byte & _LOWER) != 0,
    )
