"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The usual linear algorithm: suffixes are classified as smaller or larger than the one that follows; the substrings between
leftmost-smaller positions are sorted by one round of induction and named; the string of names is sorted recursively unless
all names differ; a second round of induction spreads that order to all suffixes.

An induction reads the array slot by slot, and each entry may write one further slot. Here a stretch of slots is read at a
time, up to the first slot that the stretch itself writes to, so each entry is still read after it was written. With many
symbols a stretch has some sqrt(n) slots, with few a whole bucket.
"""

from __future__ import annotations

import numpy as np


def _in_runs(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the values and keeps equal ones as they are, the values in it, and for each of them how many
    equal ones come before it. places: 0, 1, 2 ..., at least as many."""
    order = values.argsort(kind="stable")
    ordered = values[order]
    at = places[: len(values)].copy()
    at[1:][ordered[1:] == ordered[:-1]] = 0
    return order, ordered, places[: len(values)] - np.maximum.accumulate(at)


def _spread(text: np.ndarray, taken: np.ndarray, sa: np.ndarray, edge: np.ndarray, places: np.ndarray, step: int) -> None:
    """Reads the array from its start (step 1) or end (step -1), and puts the suffix before each read one, if it is taken,
    into the next free slot of its symbol's bucket, from the bucket's edge on in the direction of step."""
    n = len(sa)
    rows = sa if step > 0 else sa[::-1]  # slots are counted in the direction of reading
    free = edge.copy() if step > 0 else n - 1 - edge
    size, at = 1024, 0
    while at < n:
        end = min(n, at + size)
        some = rows[at:end]
        slots = (some > 0).nonzero()[0]
        before = some[slots] - 1
        take = taken[before]
        before, slots = before[take], slots[take]
        if len(before):
            order, symbols, rank = _in_runs(text[before], places)
            target = free[symbols] + rank
            stop = int(target.min())
            if stop < end:  # entries beyond the first slot that is written to are read again
                early = order < slots.searchsorted(stop - at)
                order, symbols, target, end = order[early], symbols[early], target[early], stop
            rows[target] = before[order]
            free[symbols] = target + 1  # of several the last one, which is the largest, stays
        size = max(64, min(1 << 18, 2 * (end - at)))
        at = end


def _induce(text: np.ndarray, smaller: np.ndarray, sa: np.ndarray, heads: np.ndarray, tails: np.ndarray, places: np.ndarray) -> None:
    """Puts larger suffixes in from the left and then smaller ones from the right. heads and tails: the first and last slot
    of each symbol's bucket. Entries of -1 are empty."""
    _spread(text, ~smaller, sa, heads, places, 1)
    # smaller suffixes are put in anew; those that were in only served the larger ones
    filled = np.flatnonzero(sa >= 0)
    old = filled[smaller[sa[filled]]]
    old = old[sa[old] != len(sa) - 1]
    sa[old] = -1
    _spread(text, smaller, sa, tails, places, -1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of an array of integers from 0 whose last one is 0 and occurs nowhere else."""
    text = np.asarray(text, np.int64)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    places = np.arange(n)
    # smaller[i]: text[i:] < text[i + 1:]; where symbols are equal the next unequal pair to the right decides
    step = text[:-1] - text[1:]
    decider = np.where(step != 0, np.arange(n - 1), n)
    decider = np.minimum.accumulate(decider[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = step[decider] < 0
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text)
    tails = np.cumsum(counts) - 1
    heads = tails - counts + 1
    if len(counts) <= 1 << 16:
        text = text.astype(np.uint16)  # sorted by digits

    def placed(order: np.ndarray) -> np.ndarray:
        """An array with these positions at the ends of their buckets, in this order."""
        sa = np.full(n, -1, np.int64)
        back = order[::-1]
        by, symbols, rank = _in_runs(text[back], places)
        sa[tails[symbols] - rank] = back[by]
        return sa

    sa = placed(starts)
    _induce(text, smaller, sa, heads, tails, places)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    ordered = sa[is_start[sa]]
    # names: two neighbours are equal if their substrings, up to and with the next start, are
    ends = np.full(n, n - 1, np.int64)
    ends[starts[:-1]] = starts[1:]
    a, b = ordered[:-1], ordered[1:]
    length = ends[a] - a
    differ = length != ends[b] - b
    open_, k = np.flatnonzero(~differ), 0
    while len(open_):
        x, y = a[open_] + k, b[open_] + k
        unequal = text[x] != text[y]
        differ[open_[unequal]] = True
        open_ = open_[~unequal]
        k += 1
        open_ = open_[length[open_] >= k]
    names = np.concatenate([[0], np.cumsum(differ)])
    if names[-1] + 1 < len(starts):
        name_of = np.empty(n, np.int64)
        name_of[ordered] = names
        ordered = starts[suffix_array(name_of[starts])]
    sa = placed(ordered)
    _induce(text, smaller, sa, heads, tails, places)
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, in the order of the text, the suffix before it in the array and how long a prefix they share, up
    to most: the permuted common-prefix array. Computed within pieces starts[k] to ends[k] of the text, in step: a prefix is
    at most one symbol shorter than that of the position before, so each piece compares in proportion to its length."""
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(len(text), np.int64)
    at, length = starts.copy(), np.zeros(len(starts), np.int64)
    lane = np.arange(len(starts))
    padded = np.concatenate([text, [-1]])
    n = len(text)
    while len(lane):
        i, l = at[lane], length[lane]
        j = before[i]
        same = (j >= 0) & (l < most) & (padded[np.minimum(i + l, n)] == padded[np.minimum(j + l, n)]) & (i + l < n) & (j + l < n)
        length[lane[same]] += 1
        done = lane[~same]
        shared[at[done]] = length[done]
        at[done] += 1
        length[done] = np.maximum(length[done] - 1, 0)
        lane = lane[at[lane] < ends[lane]]
    return before, shared
