"""Periodic runs of words, found on a Re-Pair grammar of each text.

The words of a text become ids, and Re-Pair replaces pairs that occur more than once by new
symbols until none does.  It works in rounds: pairs are ranked by how often they occur, in
classes of powers of two, and of two occurrences that overlap the one of higher rank is
replaced.  A run lies in the expansion of some symbol across the border of its two halves.
So the runs across a border are computed once per new symbol, on its first occurrence,
and are translated to all places where the symbol was put.  The symbols that are left
are joined two by two in a balanced tree, whose borders are treated alike.  Pieces of one run that smaller
symbols gave lie within it; only maximal intervals stay.

A run of period q with at least two periods that crosses border m has equal words at
(m-1, m-1+q) or at (m-q, m).  Few periods pass this test; for them the stretch of equal words is measured
both ways with prefix hashes.  The runs found are compared word by word in the end, so a
collision of hashes is noticed and the slice computed again with other hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_slices

PRIMES = (2_147_483_647, 2_147_483_629)
BLANK = re.compile(rb"[ \t-\r]")
#: Periods of all borders that are tested at once.
CANDIDATES = 1 << 21
#: Words compared one by one before hashes are used.
STEPS = 8


def word_lists(text: str, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, a long one in parts of about ``most`` bytes."""
    data, at = text.encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        blank = BLANK.search(data, at + most)
        end = blank.start() if blank else len(data)
        yield data[at:end].split()
        at = end


class Words:
    """The words of some texts in one row; ids are given per text."""

    def __init__(self, texts: list[str]):
        self.words: list[bytes] = []
        parts, sizes = [], []
        for text in texts:
            seen: dict[bytes, int] = {}
            number, base, size = seen.setdefault, len(self.words), 0
            for words in word_lists(text):
                parts.append(np.fromiter((number(w, len(seen)) for w in words), np.int32, len(words)) + base)
                size += len(words)
            sizes.append(size)
            self.words += seen
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)

    def joined(self, text: int, dropped: np.ndarray) -> str:
        """The words of a text that are not dropped, with one space between."""
        a, b = self.ends[text] - self.sizes[text], self.ends[text]
        kept = self.ids[a:b][~dropped[a:b]].tolist()
        return b" ".join(map(self.words.__getitem__, kept)).decode("utf-8", "surrogatepass")


def rule_rounds(ids: np.ndarray, sizes: np.ndarray, left: list) -> Iterator[tuple[np.ndarray, ...]]:
    """Re-Pair: per round the occurrences that are replaced, as (start, border, end, symbol).
    The symbols that remain are appended to ``left`` as (start, end, text)."""
    at = np.arange(len(ids))
    symbols, stop, text = ids.astype(np.int64), at + 1, np.repeat(np.arange(len(sizes)), sizes)
    fresh, rng = int(symbols.max(initial=-1)) + 1, np.random.default_rng(11)
    while len(symbols):
        pairs = np.flatnonzero(text[1:] == text[:-1])
        a, b = symbols[pairs], symbols[pairs + 1]
        twin = np.flatnonzero(a == b)
        if len(twin):  # of a row of equal symbols every other pair counts
            nth = np.arange(len(twin))
            begin = np.ones(len(twin), bool)
            begin[1:] = np.diff(pairs[twin]) != 1
            nth -= np.maximum.accumulate(np.where(begin, nth, 0))
            use = np.ones(len(pairs), bool)
            use[twin[nth % 2 == 1]] = False
            pairs, a, b = pairs[use], a[use], b[use]
        _, which, times = np.unique(a * fresh + b, return_inverse=True, return_counts=True)
        often = times[which] > 1
        pairs, which = pairs[often], which[often]
        rank = (np.frexp(times)[1].astype(np.int64) << 40) + rng.permutation(len(times))
        rank = rank[which]
        chosen = np.ones(len(pairs), bool)
        meet = np.flatnonzero(np.diff(pairs) == 1)
        lower = np.where(rank[meet] < rank[meet + 1], meet, meet + 1)
        chosen[lower] = False
        chosen &= np.bincount(which[chosen], minlength=len(times))[which] > 1
        pairs, which = pairs[chosen], which[chosen]
        if len(pairs):
            yield at[pairs], stop[pairs], stop[pairs + 1], which
        symbols[pairs] = fresh + which
        stop[pairs] = stop[pairs + 1]
        fresh += len(times)
        stays, going_on = np.ones(len(symbols), bool), np.zeros(len(sizes), bool)
        stays[pairs + 1] = False
        going_on[text[pairs]] = True
        done = stays & ~going_on[text]
        left.append((at[done], stop[done], text[done]))
        stays &= going_on[text]
        symbols, at, stop, text = symbols[stays], at[stays], stop[stays], text[stays]


def tree_levels(at: np.ndarray, stop: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Joins neighbours of one text two by two: (start, border, end) of each new node."""
    while True:
        first = np.ones(len(at), bool)
        first[1:] = text[1:] != text[:-1]
        place = np.arange(len(at))
        nth = place - np.maximum.accumulate(np.where(first, place, 0))
        pairs = np.flatnonzero(~first[1:] & (nth[:-1] % 2 == 0))
        if not len(pairs):
            return
        yield at[pairs], stop[pairs], stop[pairs + 1]
        stop = stop.copy()
        stop[pairs] = stop[pairs + 1]
        stays = np.ones(len(at), bool)
        stays[pairs + 1] = False
        at, stop, text = at[stays], stop[stays], text[stays]


class Stretches:
    """How far words agree, from two places on."""

    def __init__(self, ids: np.ndarray, seed: int):
        self.ids, self.seed, self.tables = ids, seed, None

    def hashes(self):
        if self.tables is None:
            rng = np.random.default_rng(self.seed)
            n, self.tables = len(self.ids), []
            for prime in PRIMES:
                value = rng.integers(1, prime, int(self.ids.max()) + 1)
                power = np.ones(n + 1, np.int64)
                base, size = int(rng.integers(1 << 20, prime)), 1
                while size <= n:
                    more = min(size, n + 1 - size)
                    power[size:size + more] = power[:more] * pow(base, size, prime) % prime
                    size += more
                sums = np.zeros(n + 1, np.int64)
                np.cumsum(value[self.ids] * power[:n] % prime, out=sums[1:])
                self.tables.append((prime, power.astype(np.uint32), (sums % prime).astype(np.uint32)))
        return self.tables

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from i on agree with those from j > i on, by their hashes."""
        out = np.ones(len(i), bool)
        for prime, power, sums in self.hashes():
            one = sums[i + size].astype(np.int64) - sums[i]
            two = sums[j + size].astype(np.int64) - sums[j]
            out &= one * power[j - i] % prime == two % prime
        return out

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from i and j on (way 1) or before them (way -1), at most ``most``."""
        found, going = np.zeros(len(i), np.int64), np.arange(len(i))
        for step in range(STEPS):
            going = going[most[going] > step]
            k = step if way > 0 else -1 - step
            going = going[self.ids[i[going] + k] == self.ids[j[going] + k]]
            found[going] += 1
        if len(going):
            i, j, low, high = i[going], j[going], found[going], most[going].copy()
            while (low < high).any():
                middle = (low + high + 1) // 2
                back = 0 if way > 0 else middle
                same = self.equal(i - back, j - back, middle)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            found[going] = low
        return found


def runs_across(stretches: Stretches, start: np.ndarray, border: np.ndarray, end: np.ndarray,
                least: int, times: int) -> tuple[np.ndarray, ...]:
    """Runs across the borders, within start and end: (which border, start, end, period)."""
    ids, out = stretches.ids, []
    periods = np.where(end - start >= least, (end - start) // times, 0)
    last = np.cumsum(periods)
    total = int(last[-1]) if len(last) else 0
    for lo in range(0, total, CANDIDATES):
        hi = min(total, lo + CANDIDATES)
        a, b = np.searchsorted(last, lo, "right"), np.searchsorted(last, hi - 1, "right") + 1
        begins = np.maximum(last[a:b] - periods[a:b], lo)
        which = np.repeat(np.arange(a, b), np.minimum(last[a:b], hi) - begins)
        q = np.arange(lo, hi) - (last - periods)[which] + 1
        m = border[which]
        for case in (0, 1):
            if case == 0:  # the words before the border and a period behind that
                use = np.flatnonzero(m - 1 + q < end[which])
                use = use[ids[m[use] - 1] == ids[m[use] - 1 + q[use]]]
                i = m[use] - 1
            else:
                use = np.flatnonzero(m - q >= start[which])
                use = use[ids[m[use] - q[use]] == ids[m[use]]]
                i = m[use] - q[use]
            w, period = which[use], q[use]
            want = np.maximum(times * period, least) - period
            ahead = stretches.reach(i, i + period, end[w] - i - period, 1)
            use = np.flatnonzero(ahead + i - start[w] >= want)
            i, w, period, ahead, want = i[use], w[use], period[use], ahead[use], want[use]
            behind = stretches.reach(i, i + period, i - start[w], -1)
            use = np.flatnonzero(ahead + behind >= want)
            out.append((w[use], (i - behind)[use], (i + ahead + period)[use], period[use]))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    w, s, e, q = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((q, e, s, w))  # a stretch's smallest period
    w, s, e, q = w[order], s[order], e[order], q[order]
    one = np.ones(len(w), bool)
    one[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return w[one], s[one], e[one], q[one]


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """The intervals that no other of the same period holds, by start, then period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    _, group = np.unique(period, return_inverse=True)
    reach = group * (int(end.max(initial=0)) + 1) + end  # grows from one period to the next
    keep = np.ones(len(end), bool)
    keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def holds(ids: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether all intervals have their periods, word by word."""
    size = end - start - period
    last = np.cumsum(size)
    total = int(last[-1]) if len(last) else 0
    for lo in range(0, total, CANDIDATES):
        flat = np.arange(lo, min(total, lo + CANDIDATES))
        which = np.searchsorted(last, flat, "right")
        i = start[which] + flat - (last - size)[which]
        if (ids[i] != ids[i + period[which]]).any():
            return False
    return True


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs of the texts, whose words stand in one row."""
    for seed in count(1):
        stretches, found, left = Stretches(ids, seed), [], []
        for start, border, end, symbol in rule_rounds(ids, sizes, left):
            _, first, which = np.unique(symbol, return_index=True, return_inverse=True)
            r, s, e, q = runs_across(stretches, start[first], border[first], end[first], least, times)
            if len(r):  # to all places of the symbol
                s, e = s - start[first][r], e - start[first][r]
                order = np.argsort(which, kind="stable")
                n = np.bincount(which)
                nth = np.arange(n[r].sum()) - np.repeat(np.cumsum(n[r]) - n[r], n[r])
                run = np.repeat(np.arange(len(r)), n[r])
                base = start[order[(np.cumsum(n) - n)[r][run] + nth]]
                found.append((base + s[run], base + e[run], q[run]))
        if left:
            at, stop, text = (np.concatenate(c) for c in zip(*left))
            order = np.argsort(at, kind="stable")
            for start, border, end in tree_levels(at[order], stop[order], text[order]):
                found.append(runs_across(stretches, start, border, end, least, times)[1:])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        runs = maximal(*(np.concatenate(c) for c in zip(*found)))
        if holds(ids, *runs):
            return runs


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least: int = 6, times: int = 4) -> DataFrame:
    """The runs of every text and the text without their repetitions: id, n_words, runs (start,
    length, period, by start and then period; numbers of words, from 0) and collapsed.

    A run is a stretch of at least ``least`` words and ``times`` >= 2 times its smallest period that
    cannot be extended.  ``collapsed`` holds the words, with one space between, that lie in no run or
    among the first ``period`` words of each run they lie in.  Null, empty and blank
    texts have no words and no runs.  Rows stand for themselves: repeated and null ids stay,
    an empty table gives none; other columns are not read.  Nothing is shuffled; a text is
    treated whole, in a few hundred bytes a word.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")

    def run(batches):
        for batch, texts in text_slices(batches, "text"):
            words = Words(texts)
            start, end, period = find_runs(words.ids, words.sizes, least, times)
            change = np.zeros(len(words.ids) + 1, np.int32)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            dropped = np.cumsum(change[:-1]) > 0
            firsts = words.ends - words.sizes
            text = np.searchsorted(words.ends, start, "right")
            ends = np.searchsorted(text, np.arange(len(texts) + 1), "left")
            runs = pa.StructArray.from_arrays(
                [pa.array(start - firsts[text]), pa.array(end - start), pa.array(period)],
                ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.sizes),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs),
                 pa.array([words.joined(k, dropped) for k in range(len(texts))], pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,"
                                "period:long>>, collapsed string").withColumnRenamed("id", id_col)
