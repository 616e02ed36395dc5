"""Maximal periodic runs of words, by a descending-LCP Kruskal over the suffixes of each text.

The texts of a batch stand one after the other, words numbered by text, so that no suffix matches one of another text.

1. Prefix doubling sorts the suffixes: groups of equal first 1, 2, 4, ... words are split by the group of the words that
   follow. Groups of one are done, and after the first ``FLOOR`` words only suffixes that have a partner go on.
2. The longest common prefix (LCP) of neighbours in suffix order is read off the groups of each step.
3. Neighbours are united in the order of decreasing LCP. A class holds the ordered positions of suffixes with a common prefix
   of the present LCP; the smaller class enters the larger one. Where two positions of different classes become neighbours at a
   distance ``q`` within the LCP ``h``, the stretch of ``q + h`` words from the first has period ``q``.

That finds every run once: let a run of smallest period ``q`` and length ``L >= 2q`` start at ``s``. The suffixes at ``s`` and
``s + q`` share exactly ``L - q >= q`` words. A position between them in their class would give the run a smaller period (Fine
and Wilf), so they become neighbours in the very step that unites them. The other way round a new pair at distance ``q <= h``
that does not go on to the left is a whole run, and ``q`` its smallest period, as a smaller one would put a position between.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A run has this length at least, and this many periods.
LEAST, TIMES = 6, 4
#: Words of texts that are sorted together; a longer text is sorted alone.
TOGETHER = 100_000
BLOCK = 512


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves one block only."""

    __slots__ = ("blocks", "size")

    def __init__(self, values: list[int]) -> None:
        self.blocks, self.size = [values], len(values)

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int, int]:
        """The greatest position below ``x`` and the smallest above; -1 where there is none."""
        blocks = self.blocks
        b = self._block(x)
        block = blocks[b]
        at = bisect_left(block, x)
        below = block[at - 1] if at else blocks[b - 1][-1] if b else -1
        return below, block[at] if at < len(block) else -1

    def _block(self, x: int) -> int:
        """The first block whose last position is above ``x``, else the last block."""
        low, high = 0, len(self.blocks) - 1
        while low < high:
            middle = (low + high) // 2
            if self.blocks[middle][-1] < x:
                low = middle + 1
            else:
                high = middle
        return low

    def add(self, x: int) -> None:
        b = self._block(x)
        block = self.blocks[b]
        insort(block, x)
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]


def suffix_neighbours(ids: np.ndarray, ends: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, h): neighbours in suffix order that share ``h >= floor`` words; ``ends`` is the end of each position's text.

    Equal ``ids`` stand for equal words of one text.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.append(True, ids[order][1:] != ids[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, k, active = [rank], 1, order
    while True:
        # only suffixes whose first k words have a partner go on
        own = rank[active]
        same = own[1:] == own[:-1]
        active = active[np.append(False, same) | np.append(same, False)]
        if not len(active):
            break
        own, after = rank[active], active + k
        follows = np.where(after < ends[active], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((follows, own))
        active, own, follows = active[by], own[by], follows[by]
        head = np.append(True, own[1:] != own[:-1])
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        fresh = np.append(True, (own[1:] == own[:-1]) & (follows[1:] != follows[:-1])) | head
        offset = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] - start
        rank = rank.copy()
        rank[active] = own + offset
        levels.append(rank)
        k *= 2
        if k > floor and not (rank[active][1:] == rank[active][:-1]).any():
            break
    # neighbours among the suffixes that share the greatest power of two within floor
    base = 1 << (floor.bit_length() - 1)
    group = levels[min(base.bit_length() - 1, len(levels) - 1)]
    if len(levels) < base.bit_length():
        return (np.zeros(0, np.int64),) * 3
    place = levels[-1]
    rows = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)
    rows = rows[np.argsort(place[rows], kind="stable")]
    a, b = rows[:-1], rows[1:]
    near = group[a] == group[b]
    a, b = a[near], b[near]
    h = np.zeros(len(a), np.int64)
    for step in range(len(levels) - 1, -1, -1):
        x, y = a + h, b + h
        inside = (x < ends[a]) & (y < ends[b])
        h += np.where(inside & (levels[step][np.minimum(x, n - 1)] == levels[step][np.minimum(y, n - 1)]), 1 << step, 0)
    long = h >= floor
    return a[long], b[long], h[long]


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period, in the texts that begin at ``starts``.

    Equal ``ids`` stand for equal words; words of different texts have different ids.
    """
    n = len(ids)
    if not n:
        return []
    text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    ends = np.append(starts[1:], n)[text]
    first = starts[text]
    # a run of period q shares length - q words with itself q words on: times q - q, or least - q where that is more
    floor = min(max(least, times * q) - q for q in range(1, least + 1))
    a, b, h = suffix_neighbours(ids, ends, max(floor, 1))
    order = np.argsort(-h, kind="stable")
    words, begins = ids, first
    home: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def find(x: int) -> int:
        top = x
        while (up := home.setdefault(top, top)) != top:
            top = up
        while home[x] != top:
            home[x], x = top, home[x]
        return top

    found = []
    for i, j, shared in zip(a[order].tolist(), b[order].tolist(), h[order].tolist(), strict=True):
        one, two = find(i), find(j)
        small, large = sets.pop(one, None) or Positions([one]), sets.pop(two, None) or Positions([two])
        if small.size > large.size:
            small, large, one, two = large, small, two, one
        entering = list(small)
        for at, x in enumerate(entering):
            below, above = large.around(x)
            before, after = entering[at - 1] if at else -1, entering[at + 1] if at + 1 < len(entering) else -1
            # positions of the two classes that are neighbours once they are one class
            for left, right in ((below, x) if below > before else (-1, -1), (x, above) if after < 0 or above < after else (-1, -1)):
                if left < 0 or right < 0:
                    continue
                q = right - left
                if q > shared or q + shared < least or q + shared < times * q:
                    continue
                if left == begins[left] or words[left - 1] != words[right - 1]:
                    found.append((left, q + shared, q))
        for x in entering:
            large.add(x)
        home[one] = two
        sets[two] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between blanks, tabs and line ends (bytes 9 to 13 and 32)."""
    return text.split() if text else []


def planted(doc: int | None, n: int) -> np.ndarray:
    """For each word the number of the original word in its place: every tenth id repeats a stretch of its text."""
    places = np.arange(n)
    if doc is None or not n:
        return places
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(places >= a, a + (places - a) % p, places)


def period_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, plant: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """Per row: ``id_col``, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    The longest run is shown (ties: smallest start, then period; nulls without a run). A null, empty or blank text has no
    words, so no runs and an empty collapsed text; null ids and repeated rows pass through row by row; an empty table gives
    an empty result; other columns are not looked at. ``plant`` gives, by id and number of words, the original place of the
    word to put in each place; null leaves texts as they are. Memory follows one batch of texts or the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(docs_):
                words, ids, starts, begin, size = [], [], [], at, 0
                while at < len(docs_) and (at == begin or size < TOGETHER):
                    own = words_of(texts[at].as_py())
                    numbers: dict[bytes, int] = {}
                    # a word's number is the first place it stands in, so texts share none
                    codes = np.fromiter((numbers.setdefault(w, i) for i, w in enumerate(own, size)), np.int64, len(own))
                    if plant:
                        places = plant(docs_[at], len(own))
                        codes = codes[places] if len(own) else codes
                        own = [own[i] for i in places.tolist()] if (places != np.arange(len(own))).any() else own
                    words.append(own)
                    ids.append(codes)
                    starts.append(size)
                    size += len(own)
                    at += 1
                yield _digests(batch.column(0).slice(begin, at - begin), words, np.array(starts), runs_of(np.concatenate(ids), np.array(starts), least, times))

    def _digests(doc_ids: pa.Array, words: list[list[bytes]], starts: np.ndarray, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        cuts = np.searchsorted([r[0] for r in found], np.append(starts, np.iinfo(np.int64).max)) if found else [0] * (len(starts) + 1)
        # an empty text begins where the next one does
        out = []
        for k, own in enumerate(words):
            base = int(starts[k])
            runs = [(s - base, length, q) for s, length, q in found[cuts[k] : cuts[k + 1]]]
            kept = own
            if runs:
                drop = np.zeros(len(own) + 1, np.int64)
                for s, length, q in runs:
                    drop[s + q] += 1
                    drop[s + length] -= 1
                kept = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
            listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
            out.append((len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary"))
    return source.mapInArrow(run, f"`{id_col}` long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
