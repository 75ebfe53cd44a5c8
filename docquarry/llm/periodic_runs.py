"""Periodic runs of words: maximal stretches that repeat a block of words four times or more, and texts without them.

A run is a maximal stretch of words with a smallest period q (words q apart are identical) and a length of at least
max(``LEAST``, ``TIMES`` * q).  Every run begins with copies of a Lyndon word of length q that is, in one of the two
orders of the words (an order and its reverse), the longest Lyndon word at its place; so the longest Lyndon words
at all places give all runs.  They come from a stack scanned right to left: the factor that begins at a place takes
over the factors on the stack as long as it is smaller than they are, which compares two suffixes.  Comparing, and
extending a factor to its run, needs the length to which words at two places agree.  That is found by binary search
over a rolling hash, and then the words themselves are compared; if a hash was wrong, words decide.  What was
compared at a distance is kept as a stretch, so long periodic texts are compared once.  There is no suffix array.

Only words that occur ``TIMES`` times can be in a run, and no run holds another word: those others cut a text into
stretches, and stretches too short for a run are left out before the scan.

Defined results: null and empty texts, and texts of white space, have no runs and an empty collapsed text.  Rows are
independent of each other; repeated rows have equal results.  All columns stay, whatever their names; the result
takes the first free name from ``runs`` on.  Memory is linear in the length of one text.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import arrow_text
from docquarry.llm.common import bounded_batches, free_name

#: Least length of a run in words, and in periods.
LEAST, TIMES = 6, 4
#: A hash of words is a polynomial modulo this prime.
MODULUS, BASE = (1 << 61) - 1, 1_000_003
#: How often stretches are cut again at the words that are rare within them.
CUTS = 3
TYPE = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


class Agreement:
    """How far words at two places of a list of word numbers agree."""

    def __init__(self, ids: list[int], modulus: int = MODULUS):
        self.ids, self.modulus = ids, modulus
        self.hashes = list(accumulate(ids, lambda h, x: (h * BASE + x + 1) % modulus, initial=0))
        self.powers = list(accumulate(range(len(ids)), lambda p, _: p * BASE % modulus, initial=1))
        #: By distance: (a, b) if words of [a, b) equal those at the distance, and the word of b doesn't.
        self.stretches: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, n: int) -> bool:
        """Whether n words at i and j have one hash."""
        h, p, m = self.hashes, self.powers[n], self.modulus
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % m == 0

    def _search(self, most: int, same) -> int:
        """The greatest n up to most for which same(n) holds; it holds for all smaller."""
        low, step = 0, 1
        while low + step <= most and same(low + step):
            low, step = low + step, 2 * step
        high = min(most, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(middle) else (low, middle - 1)
        return low

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on agree with those from j on; i < j."""
        ids, distance = self.ids, j - i
        a, b = self.stretches.get(distance, (-1, -1))
        if a <= i <= b:
            return b - i
        most = a - i if a > i else len(ids) - j
        n = self._search(most, lambda n: self._same(i, j, n))
        if ids[i : i + n] != ids[j : j + n]:  # a hash was wrong
            n = next(k for k in range(n) if ids[i + k] != ids[j + k])
        if i + n == a:
            n = b - i
        self.stretches[distance] = (i, i + n)
        return n

    def behind(self, i: int, distance: int) -> int:
        """How many words before i agree with those at the distance from them; ahead(i, i + distance) was asked before."""
        ids = self.ids
        a, b = self.stretches[distance]
        n = self._search(a, lambda n: self._same(a - n, a - n + distance, n))
        if ids[a - n : a] != ids[a - n + distance : a + distance]:
            n = next(k for k in range(n) if ids[a - 1 - k] != ids[a - 1 - k + distance])
        self.stretches[distance] = (a - n, b)
        return i - (a - n)


def lyndon_factors(ids: list[int], order: list[int], agreement: Agreement) -> list[tuple[int, int]]:
    """For each place: the end of the longest Lyndon word that begins there, by the numbers in ``order``, and how far
    the words from there on agree with those from its end on."""
    n = len(ids)
    out, stack = [(n, 0)] * n, [n]
    for i in range(n - 1, -1, -1):
        agree, x = 0, order[i]
        while (j := stack[-1]) < n:
            y = order[j]
            if x == y:
                agree = agreement.ahead(i, j)
                if j + agree == n or order[i + agree] > order[j + agree]:
                    break  # the suffix at j is smaller
            else:
                agree = 0
                if x > y:
                    break
            stack.pop()
        else:
            agree = 0
        out[i] = (stack[-1], agree)
        stack.append(i)
    return out


def runs_within(ids: list[int], modulus: int = MODULUS) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of word numbers."""
    agreement, out = Agreement(ids, modulus), set()
    for order in (ids, [-x for x in ids]):
        for i, (end, agree) in enumerate(lyndon_factors(ids, order, agreement)):
            period = end - i
            least = max(LEAST, TIMES * period)
            if agree > least - 2 * period:  # else the run is too short, or this isn't the first of its factors
                before = agreement.behind(i, period) if agreement.ahead(i, end) else 0
                if before < period and before + period + agree >= least:
                    out.add((i - before, before + period + agree, period))
    return out


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the stretches that can hold runs: without words that occur less than TIMES times in them."""
    found = [(0, len(ids))]
    for _ in range(CUTS):
        cut = []
        for a, b in found:
            _, which, n = np.unique(ids[a:b], return_inverse=True, return_counts=True)
            often = np.flatnonzero(np.diff(np.concatenate(([0], (n[which] >= TIMES).view(np.int8), [0]))))
            cut += [(a + x, a + y) for x, y in zip(often[::2].tolist(), often[1::2].tolist(), strict=True) if y - x >= LEAST]
        if cut == found:
            break
        found = cut
    return found


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    if len(words) < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    out = []
    for a, b in stretches(np.array(ids)):
        out += [(a + start, length, period) for start, length, period in runs_within(ids[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def runs(text: Column) -> Column:
    """Struct of a text's runs (by start, then period) and its collapsed text."""
    bounded_batches()

    @F.arrow_udf(TYPE)
    def of(texts: pa.Array) -> pa.Array:
        found, left = [], []
        for text in arrow_text.each(texts):
            words = text.split()
            own = word_runs(words)
            found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            left.append(collapsed(words, own))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return of(F.coalesce(text, F.lit("")))


def strongest(found: Column) -> Column:
    """Of an array of runs the one of the greatest exact length / period; ties go to the first."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda best, x: F.when(more(x, best), x).otherwise(best))


def with_runs(df: DataFrame, text: str = "text", name: str = "runs") -> DataFrame:
    """df with a struct column of each text's runs and its collapsed text."""
    return df.withColumn(free_name(df, name), runs(F.col(f"`{text}`")))
