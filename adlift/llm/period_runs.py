"""Runs of words that repeat with a period, found by seed-and-extend along diagonals.

A run of period q and length at least max(least, 2 * q) matches itself at lag q
over max(least - q, q) words or more, its guaranteed overlap. Lags are taken in
ranges. Below ``least`` the overlap is half of ``least`` at the least: all
grams of that many words are indexed. From there on each range [lo, 2 * lo)
guarantees lo words, so grams of half that length that start at multiples of
their length are enough, which bounds the occurrence pairs of a range by about
twice the words, whatever repeats. Grams are looked up in one sorted index of
(gram, place); the words of different documents have different numbers, so
pairs never leave a document.

The pairs of a lag are taken in order of place. A pair inside the stretch found
last for its lag (the furthest place covered) is skipped, and so is one inside
a known run whose period divides the lag, as that run has the smaller period
for exactly these words. Others are extended word by word in both directions,
so hash collisions of grams cannot make a run.

A text is worked on whole in one task, several texts of one Arrow batch
together; nothing is shuffled.

Defined results: a null or empty text has no words and no runs. Null and
repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.common import _BASE, _powers, map_rows, mix, small_batches

CHUNK = 1 << 20     # words worked on together; a longer text is worked on alone


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word (texts share none) and the places where texts begin, and the end."""
    numbers, start, next_number = [], [0], 0
    for found in texts:
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(w, next_number + len(own)) for w in found]
        next_number += len(own)
        start.append(len(numbers))
    return np.array(numbers, dtype=np.int64), np.array(start, dtype=np.int64)


def _grams(a: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` numbers from each place on."""
    power, inverse = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(mix(a.astype(np.uint64) + np.uint64(_BASE)) * power[:len(a)], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[:len(a) - size + 1])


def _pairs(a: np.ndarray, lo: int, hi: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of equal grams at lags in [lo, hi), places in multiples of ``step``, by lag then place."""
    none = np.empty(0, dtype=np.int64)
    if len(a) < size + lo:
        return none, none
    grams = _grams(a, size)
    # only grams that share their slot of a table with a seed and with another gram go into the index
    slot = (grams & np.uint64((1 << int(8 * len(grams)).bit_length()) - 1)).astype(np.int64)
    shared = np.bincount(slot) > 1
    seeded = np.zeros(len(shared), dtype=bool)
    seeded[slot[::step]] = True
    place = np.flatnonzero((shared & seeded)[slot])
    grams = grams[place]
    order = np.lexsort((place, grams))
    grams, place = grams[order], place[order]
    group = np.cumsum(np.concatenate(([0], (grams[1:] != grams[:-1]).astype(np.int64))))[:len(grams)]
    key = group * (len(a) + hi + 1) + place     # rising: gram, then place
    seed = np.flatnonzero(place % step == 0)
    first = np.searchsorted(key, key[seed] + lo)
    count = np.searchsorted(key, key[seed] + hi) - first
    seed, first, count = seed[count > 0], first[count > 0], count[count > 0]
    if not len(seed):
        return none, none
    at = np.repeat(place[seed], count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lag = place[np.repeat(first, count) + nth] - at
    by = np.lexsort((at, lag))
    return lag[by], at[by]


def _reach(equal: Callable[[int, int], np.ndarray], limit: int) -> int:
    """How many of ``limit`` comparisons hold from the first on; ``equal`` compares a slice."""
    done, width = 0, 16
    while done < limit:
        same = equal(done, min(limit, done + width))
        if not same.all():
            return done + int(np.argmin(same))
        done, width = min(limit, done + width), width * 4
    return limit


def _uncovered(lags: np.ndarray, places: np.ndarray, runs: dict[int, tuple[list[int], list[int]]]) -> np.ndarray:
    """Marks the pairs (place, place + lag) that no known run of a period dividing the lag holds."""
    left = np.arange(len(lags))
    for period, (starts, ends) in runs.items():
        some = left[lags[left] % period == 0]
        # of runs of one period, only the last that starts at or before a place can hold the pair
        near = np.searchsorted(starts, places[some], side="right") - 1
        inside = (near >= 0) & (places[some] + lags[some] < np.array(ends)[near])
        left = np.setdiff1d(left, some[inside], assume_unique=True)
    return left


def runs_of(a: np.ndarray, least: int = 12, start: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run in the numbers ``a``, in order of period, then start. ``start`` has the places
    where texts begin, and the end; texts come by rising length and share no numbers."""
    start = np.array([0, len(a)]) if start is None else start
    length = np.diff(start)
    runs: dict[int, tuple[list[int], list[int]]] = {}
    size, step, lo, hi = (least + 1) // 2, 1, 1, least
    while len(length) and length[-1] >= max(least, 2 * lo):
        skip = int(start[np.searchsorted(length, max(least, 2 * lo))])     # shorter texts have no run of these periods
        lags, places = _pairs(a[skip:], lo, hi, size, step)
        places = places + skip
        left = _uncovered(lags, places, runs)
        lags, places = lags[left], places[left]
        cuts = np.flatnonzero(np.diff(lags)) + 1
        for group in np.split(np.arange(len(lags)), cuts) if len(lags) else []:
            _extend(a, int(lags[group[0]]), places[group], runs, least, lo)
        size = step = (hi + 1) // 2
        lo, hi = hi, 2 * hi
    return [(s, e, q) for q in sorted(runs) for s, e in zip(*runs[q], strict=True)]


def _extend(a: np.ndarray, lag: int, places: np.ndarray, runs: dict[int, tuple[list[int], list[int]]], least: int, lo: int) -> None:
    """Adds the runs of period ``lag`` that the pairs (place, place + lag) lead to; runs of periods below ``lo`` are done."""
    same_range = {q: r for q, r in runs.items() if q >= lo and lag % q == 0}
    if same_range:
        places = places[_uncovered(np.full(len(places), lag), places, same_range)]
    found, nth = ([], []), 0
    while nth < len(places):
        i = int(places[nth])
        right = _reach(lambda x, y: a[i + x:i + y] == a[i + lag + x:i + lag + y], len(a) - lag - i)
        if right:
            left = _reach(lambda x, y: (a[i - y:i - x] == a[i + lag - y:i + lag - x])[::-1], i)
            if right + left + lag >= max(least, 2 * lag):
                found[0].append(i - left)
                found[1].append(i + right + lag)
        nth = int(np.searchsorted(places, i + max(right, 1)))
    if found[0]:
        runs[lag] = found


def _batches(texts: list[str | None]) -> list[list[int]]:
    """Rows worked on together: texts of similar length, at most CHUNK words unless a text alone has more."""
    out, room = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or "")):
        need = len(texts[i] or "") // 2 + 1     # a word and its gap have two characters at least
        if need > room:
            out.append([])
            room = CHUNK
        out[-1].append(i)
        room -= need
    return out


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """doc_id, runs (array of start, length and period by start, then period), collapsed (the words, joined by one
    space, that no run holds after its first period)."""
    if least < 2:
        raise ValueError(f"least must be 2 or more, got {least}")
    small_batches(docs.sparkSession)

    def make():
        def work(rows: dict) -> dict:
            texts = rows["text"]
            runs: list = [[] for _ in texts]
            collapsed: list = [""] * len(texts)
            for batch in _batches(texts):
                # bytes.split() cuts at the six ASCII white space bytes
                words = {i: (texts[i] or "").encode("utf-8", "surrogatepass").split() for i in batch}
                batch = sorted(batch, key=lambda i: len(words[i]))
                a, start = _numbers([words[i] for i in batch])
                drop = np.zeros(len(a) + 1, dtype=np.int64)
                for s, e, q in runs_of(a, least, start):
                    own = int(np.searchsorted(start, s, side="right")) - 1
                    runs[batch[own]].append({"start": s - int(start[own]), "length": e - s, "period": q})
                    drop[s + q] += 1
                    drop[e] -= 1
                keep = np.cumsum(drop) == 0
                for i, s in zip(batch, start.tolist(), strict=False):
                    w = words[i]
                    left = w if keep[s:s + len(w)].all() else [x for x, k in zip(w, keep[s:s + len(w)], strict=True) if k]
                    collapsed[i] = b" ".join(left).decode("utf-8", "surrogatepass")
            for r in runs:
                r.sort(key=lambda x: (x["start"], x["period"]))
            return {"doc_id": rows["doc_id"], "runs": runs, "collapsed": collapsed}
        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string", make)
