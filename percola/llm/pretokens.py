"""Pre-tokens of byte-level BPE for a run of texts at once, as spans of their UTF-8 bytes."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from percola.llm import ragged

_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
#: Code points with the White_Space property.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the byte-level pattern splits off after an apostrophe.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_classes = np.full(0x110000, _UNKNOWN, np.uint8)
_classes[_WHITE] = _SPACE


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; classes are looked up once for each that occurs."""
    out = _classes[points]
    new = points[out == _UNKNOWN]
    if len(new):
        for p in np.unique(new).tolist():
            kind = unicodedata.category(chr(p))[0]
            _classes[p] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
        out = _classes[points]
    return out


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes; begin and end of each pre-token; for each text, and the end, its first pre-token's index.

    A run of letters, of numbers or of other characters takes one space before it along; a run of
    white space leaves its last character out if text follows; an apostrophe alone takes one of the
    endings along.
    """
    buf, off = ragged.utf8(column)
    if not len(buf):
        return buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    lead = (buf & 0xC0) != 0x80
    at = np.append(np.flatnonzero(lead), len(buf))
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    text_off = np.searchsorted(at, off)
    kind = classes(points)
    edge = np.zeros(n + 1, bool)
    edge[text_off] = True
    change = edge.copy()
    change[0] = change[n] = True
    change[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change[:n])
    end = np.append(run[1:], n)
    white = kind[run] == _SPACE
    start = change[:n].copy()
    followed = white & ~edge[end]
    tail = end[followed] - 1
    start[tail] = True
    spaced = points[tail] == 32
    start[tail[spaced] + 1] = False
    # an apostrophe that is a run of its own, with no space to take along
    apostrophe = run[(points[run] == 39) & (end - run == 1) & start[run]]
    apostrophe = apostrophe[(apostrophe + 1 < n)]
    apostrophe = apostrophe[~edge[apostrophe + 1]]
    padded = np.append(points, [0, 0]).astype(np.int64)
    done = np.zeros(len(apostrophe), bool)
    for ending in _ENDINGS:
        hit = ~done & (padded[apostrophe + 1] == ord(ending[0]))
        if len(ending) == 2:
            hit &= (padded[apostrophe + 2] == ord(ending[1])) & ~edge[np.minimum(apostrophe + 2, n)]
        done |= hit
        start[apostrophe[hit] + 1] = False
        to = apostrophe[hit] + 1 + len(ending)
        start[to[to < n]] = True
    begin = np.flatnonzero(start)
    first = np.searchsorted(begin, text_off)
    bounds = at[begin]
    return buf, bounds, np.append(bounds[1:], len(buf)), first


def span_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return ragged.word_hashes(buf.astype(np.uint16) + np.uint16(1), begin, end)


def split_special(column: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray | None, list[list[int]] | None]:
    """Texts cut at special strings: the pieces, the text of each, and for each text its special strings' places in the list.

    None, None if no text has any. Earlier and, at one place, longer strings win.
    """
    import re

    import pyarrow.compute as pc

    if not special:
        return column, None, None
    pattern = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    if not pc.any(pc.match_substring_regex(column.cast(pa.large_string()), pattern)).as_py():
        return column, None, None
    pieces, owner, found = [], [], []
    for i, text in enumerate(column.to_pylist()):
        parts = re.split(f"({pattern})", text or "")
        pieces += parts[::2]
        owner += [i] * len(parts[::2])
        found.append([special.index(p) for p in parts[1::2]])
    return pa.array(pieces, pa.large_string()), np.array(owner), found


def checked(spec: dict) -> dict:
    """A tokenizer file's content, if its pre-tokens are those that are cut here: plain byte-level BPE. Else an error."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    more = [spec.get("normalizer"), *[model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or any(more):
        raise ValueError("only plain byte-level BPE is supported")
    return spec


class _Generation:
    """Sorted keys, some in a small second run that is merged into the first from time to time; values lie one after another."""

    def __init__(self, dtype: type):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.runs = [none, none]
        self.off, self.flat, self.n, self.used = np.zeros(1024, np.int32), np.zeros(4096, dtype), 0, 0

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys; -1 where unknown."""
        out = np.full(len(keys), -1, np.int32)
        for have, place in self.runs:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = place[at[hit]]
        return out

    def add(self, keys: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        n, used = self.n + len(keys), self.used + len(flat)
        if n >= len(self.off):
            self.off = np.concatenate([self.off, np.zeros(n, np.int32)])
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, self.flat.dtype)])
        self.off[self.n + 1 : n + 1] = self.used + np.cumsum(counts)
        self.flat[self.used : used] = flat
        self.runs[1] = self._joined(self.runs[1], (keys, np.arange(self.n, n, dtype=np.int32)))
        if 8 * len(self.runs[1][0]) > len(self.runs[0][0]):
            self.runs = [self._joined(*self.runs), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        self.n, self.used = n, used

    @staticmethod
    def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


class Memo:
    """What is known of pre-tokens by hash: an array of values for each.

    At `limit` keys a new generation begins; keys that are met again move into it, and the generation before the last
    is forgotten. So memory is bounded, and what is frequent stays known however much text a worker sees.
    """

    def __init__(self, dtype: type, limit: int = 1_000_000):
        self.dtype, self.limit = dtype, limit
        self.now, self.before = _Generation(dtype), _Generation(dtype)

    def __len__(self) -> int:
        return self.now.n + self.before.n

    def values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted keys: how many values each has (-1: unknown), and known values one after another."""
        size = np.full(len(keys), -1, np.int64)
        found = []
        for g in (self.now, self.before):
            place = g.look_up(keys)
            new = np.flatnonzero((place >= 0) & (size < 0))
            size[new] = g.off[place[new] + 1] - g.off[place[new]]
            found.append((g, new, place[new]))
        known = np.maximum(size, 0)
        begin = np.cumsum(known) - known
        flat = np.empty(int(known.sum()), self.dtype)
        moved = None
        for g, rows, place in found:
            if len(rows):
                many = size[rows]
                flat[spread(begin[rows], many)] = moved = g.flat[spread(g.off[place], many)]
        g, rows, _ = found[1]
        if len(rows):
            self._add(keys[rows], size[rows], moved)
        return size, flat, begin

    def add(self, keys: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """Sorted keys that values() doesn't know."""
        self._add(keys, counts, flat)

    def _add(self, keys: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        if self.now.n and self.now.n + len(keys) > self.limit:
            self.before, self.now = self.now, _Generation(self.dtype)
        self.now.add(keys, counts, flat)


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... counts[i] times, one i after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + counts, counts)
