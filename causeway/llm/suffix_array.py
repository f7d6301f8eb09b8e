"""Suffix arrays by induced sorting, vectorised, and common prefixes in text order.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour.
The leftmost S suffixes of each run are sorted by their substrings, which are
named; if names repeat, the string of names is sorted itself, by the same
steps. From sorted leftmost ones all others follow in one pass up over the L
suffixes and one pass down over the S suffixes.

Bytes, and names below 256, go through buckets of first symbols. A pass
handles a whole bucket at a time, so it costs a few array operations per
symbol and per round of equal symbols. Names with larger alphabets have too
many buckets for that; there a pass orders all suffixes of a type by their
first symbol and the order of their right neighbour, following runs of one
type in doubling steps.
"""

from __future__ import annotations

import numpy as np

#: Symbols of the strings that go through buckets.
ALPHABET = 256


def _larger_types(s: np.ndarray) -> np.ndarray:
    """True for L suffixes; the end counts as the smallest symbol."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    after = np.searchsorted(change, np.arange(n))  # the next place where the symbol changes
    known = after < len(change)
    out = np.ones(n, bool)
    at = change[after[known]]
    out[known] = s[at] > s[at + 1]
    return out


def _induce(s: np.ndarray, larger: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array from sorted leftmost S suffixes, `seeds`."""
    none = np.empty(0, np.int64)

    def spread(batch: np.ndarray, kind: bool, into: list[list[np.ndarray]], own: int) -> np.ndarray:
        """Hand the batch's left neighbours of a kind to their buckets; those of bucket `own` come back."""
        left = batch[batch > 0] - 1
        left = left[larger[left] == kind]
        if not len(left):
            return none
        first = s[left]
        order = np.argsort(first, kind="stable")
        first, left = first[order], left[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        same = none
        for part in np.split(left, cuts):
            symbol = int(s[part[0]])
            if symbol == own:
                same = part
            into[symbol].append(part)
        return same

    seed_first = s[seeds]
    order = np.argsort(seed_first, kind="stable")
    bounds = np.searchsorted(seed_first[order], np.arange(ALPHABET + 1))
    by_symbol = seeds[order]
    large: list[list[np.ndarray]] = [[] for _ in range(ALPHABET)]
    # the end, smallest of all, comes first and induces the last suffix
    large[int(s[-1])].append(np.array([len(s) - 1]))
    for c in range(ALPHABET):
        at = 0
        while at < len(large[c]):
            batch = large[c][at] if len(large[c]) == at + 1 else np.concatenate(large[c][at:])
            at = len(large[c])
            spread(batch, True, large, c)
        spread(by_symbol[bounds[c] : bounds[c + 1]], True, large, -1)
    up = [np.concatenate(x) if x else none for x in large]
    small: list[list[np.ndarray]] = [[] for _ in range(ALPHABET)]  # parts from the largest down
    for c in range(ALPHABET - 1, -1, -1):
        at = 0
        while at < len(small[c]):
            batch = small[c][at] if len(small[c]) == at + 1 else np.concatenate(small[c][at:])
            at = len(small[c])
            spread(batch, False, small, c)
        spread(up[c][::-1], False, small, -1)
    out = []
    for c in range(ALPHABET):
        out += [up[c], *(x[::-1] for x in reversed(small[c]))]
    return np.concatenate(out)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; bytes beyond the end are 0."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for shift in range(min(8, len(data))):
        count = len(range(shift, len(data), 8))
        out[shift::8] = np.frombuffer(padded.data, "<u8", count, shift)
    return out


def common_prefix(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the suffixes at a and b agree in `most` bytes (a multiple of 8)."""
    ok = (np.maximum(a, b) + most) <= n
    at = np.flatnonzero(ok)
    for step in range(0, most, 8):
        same = words[a[at] + step] == words[b[at] + step]
        at = at[same]
    out = np.zeros(len(a), bool)
    out[at] = True
    return out


def _names(s: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of sorted substrings s[p : end], equal ones alike."""
    lengths = ends - order
    differ = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.flatnonzero(lengths[1:] == lengths[:-1])
        step = 0
        open_ = same
        while len(open_):
            done = lengths[open_] <= step
            differ[open_[done] + 1] = False
            open_ = open_[~done]
            if len(open_):
                open_ = open_[s[order[open_] + step] == s[order[open_ + 1] + step]]
            step += 1
    return np.cumsum(differ) - 1


def _classes(key: np.ndarray) -> np.ndarray:
    """For each key the number of smaller ones, plus one."""
    order = np.argsort(key, kind="stable")
    start = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    out = np.empty(len(key), np.int64)
    out[order] = np.maximum.accumulate(np.where(start, np.arange(1, len(key) + 1), 0))
    return out


def _refine(rank: np.ndarray, at: np.ndarray, steps: np.ndarray) -> None:
    """Order the suffixes `at`, whose runs of one type are `steps` long, beyond their first symbol.

    `rank` holds a class per place, that of the end being 0. A class of `at`
    is told apart by what is `hop` places on, until each run has met the other
    type, whose classes are known.
    """
    hop = 1
    while len(at):
        order = np.argsort(rank[at], kind="stable")
        at, steps = at[order], steps[order]
        same = rank[at[1:]] == rank[at[:-1]]
        tied = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (steps >= hop)
        at, steps = at[tied], steps[tied]
        if not len(at):
            return
        order = np.lexsort((rank[at + hop], rank[at]))
        at, steps = at[order], steps[order]
        own, next_ = rank[at], rank[at + hop]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        part = group | np.concatenate([[True], next_[1:] != next_[:-1]])
        index = np.arange(len(at))
        rank[at] = own + np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        hop *= 2


def _induced_ranks(s: np.ndarray, larger: np.ndarray, leftmost: np.ndarray, seeds: np.ndarray | None) -> np.ndarray:
    """Classes of all suffixes from the order of the leftmost S ones, or by their substrings only where that isn't known."""
    n = len(s)
    places = np.arange(n)
    width = len(leftmost) + 1
    rank = np.zeros(n + 1, np.int64)
    # up: L suffixes end at a leftmost S suffix or at the end
    many = np.flatnonzero(larger)
    ends = np.append(leftmost, n)
    both = np.concatenate([many, leftmost])
    key = s[both] * 2 * width
    key[len(many) :] += width + (0 if seeds is None else seeds)
    rank[both] = _classes(key)
    _refine(rank, many, ends[np.searchsorted(ends, many, "right")] - many)
    # down: S suffixes end at an L suffix
    few = np.flatnonzero(~larger)
    key = s * 2 * (n + 1) + np.where(larger, rank[:n], n + 1)
    rank[:n] = _classes(key)
    rank[n] = 0
    if len(few):
        _refine(rank, few, many[np.searchsorted(many, few, "right")] - few)
    return rank[places]


def _leftmost(larger: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~larger[1:] & larger[:-1]) + 1


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names."""
    if names.max(initial=-1) + 1 == len(names):
        return np.argsort(names, kind="stable")
    return suffix_array(names.astype(np.uint8) if names.max() < ALPHABET else names)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `s`, bytes or names from 0, in order."""
    n = len(s)
    if n == 0:
        return np.empty(0, np.int64)
    symbols = s.astype(np.int64) if s.dtype != np.uint8 else s
    larger = _larger_types(symbols)
    leftmost = _leftmost(larger)
    if s.dtype != np.uint8:
        rank = _induced_ranks(symbols, larger, leftmost, None)
        if len(leftmost):
            names = np.unique(rank[leftmost], return_inverse=True)[1].astype(np.int64)
            seeds = np.empty(len(leftmost), np.int64)
            seeds[_order_of_names(names)] = np.arange(len(leftmost))
            rank = _induced_ranks(symbols, larger, leftmost, seeds)
        return np.argsort(rank, kind="stable")
    if len(leftmost) == 0:
        return _induce(symbols, larger, leftmost)
    rough = _induce(symbols, larger, leftmost)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    order = rough[is_left[rough]]
    # a substring runs to the next leftmost place and its symbol, the last one to the end
    end = np.append(np.minimum(leftmost[1:] + 1, n), n)
    place = np.empty(n, np.int64)
    place[leftmost] = np.arange(len(leftmost))
    names = np.empty(len(leftmost), np.int64)
    names[place[order]] = _names(symbols, order, end[place[order]])
    return _induce(symbols, larger, leftmost[_order_of_names(names)])
