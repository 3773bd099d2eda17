"""Suffix arrays by induced sorting, and repeats read off them.

Suffixes are classified, leftmost-smaller substrings are sorted by an induction, named and ranked
recursively in pairs, and a second induction gives the array. An induction walks over the
first letters and moves all suffixes of a letter's round at once, so its cost is linear and its steps
are array operations. Order is exact for the first `depth` symbols; suffixes that agree longer may stand
in any order.
"""

from __future__ import annotations

import numpy as np

from tunegrain.llm.fingerprints import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < size:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


class RangeHashes:
    """Hashes of any ranges of a sequence of symbols, each in constant time."""

    def __init__(self, symbols: np.ndarray):
        powers, self._inverse = _power_tables(len(symbols) + 1)
        letters = mix(symbols.astype(np.uint64) + _BASE)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[: len(symbols)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._inverse[start]


def _rank_pairs(names: np.ndarray, step: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes of `names` by their first `depth` names: by pairs of ranks, recursively."""
    top = int(names.max(initial=0)) + 1
    if top == len(names) or step >= depth:
        return names
    after = np.zeros(len(names), np.int64)
    after[:-step] = names[step:] + 1
    return _rank_pairs(np.unique(names * (top + 1) + after, return_inverse=True)[1], 2 * step, depth)


def _induce(text, small, seeds, counts):
    """Suffixes in the order that the sorted `seeds` (leftmost-smaller suffixes) induce."""
    letters = len(counts)
    ends = np.cumsum(counts)
    heads = ends - counts
    order = np.full(len(text), -1, np.int64)
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    first = text[seeds]
    seed_counts = np.bincount(first, minlength=letters)
    rank = np.arange(len(seeds)) - (np.cumsum(seed_counts) - seed_counts)[first]
    order[(ends - seed_counts)[first] + rank] = seeds
    filled = heads.copy()

    def move(found, want_small, step, at):
        before = found[found > 0] - 1
        before = before[small[before] == want_small]
        if not len(before):
            return
        letter = text[before]
        by_letter = np.argsort(letter, kind="stable")
        letter = letter[by_letter]
        number = np.bincount(letter, minlength=letters)
        place = np.arange(len(letter)) - (np.cumsum(number) - number)[letter]
        order[at[letter] + (place if step > 0 else -1 - place)] = before[by_letter]
        at += step * number

    used = np.flatnonzero(counts)
    for c in used.tolist():
        done = heads[c]
        while done < filled[c]:
            done, start = filled[c], done
            move(order[start:done], False, 1, filled)
        move(order[ends[c] - seed_counts[c]: ends[c]], False, 1, filled)
    larger = filled  # the larger suffixes of each letter end here
    filled = ends.copy()
    for c in used[::-1].tolist():
        done = ends[c]
        while done > filled[c]:
            done, stop = filled[c], done
            move(order[done:stop][::-1], True, -1, filled)
        move(order[heads[c]: larger[c]][::-1], True, -1, filled)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` (small non-negative integers, the last one a single 0) in order of their first `depth` symbols."""
    size = len(text)
    if size < 2:
        return np.arange(size)
    rises = np.sign(np.diff(text.astype(np.int32)))
    nearest = np.where(rises != 0, np.arange(size - 1), size - 2)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # the next place where letters differ
    small = np.append(rises[nearest] > 0, True)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(text)
    order = _induce(text, small, seeds, counts)
    is_seed = np.zeros(size, bool)
    is_seed[seeds] = True
    ordered = order[is_seed[order]]
    # a substring reaches up to the next seed and holds it
    stop = np.append(seeds[1:] + 1, size)
    number = np.zeros(size, np.int64)
    number[seeds] = np.arange(len(seeds))
    hashes = RangeHashes(text).of(seeds, stop) + (stop - seeds).astype(np.uint64)
    hashes = hashes[number[ordered]]
    names = np.zeros(len(seeds), np.int64)
    names[number[ordered]] = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
    ranks = _rank_pairs(names, 1, depth)
    return _induce(text, small, seeds[np.argsort(ranks, kind="stable")], counts)


def common_prefixes(hashes: RangeHashes, order: np.ndarray, size: int, most: int) -> np.ndarray:
    """By text place: how far each suffix of `order` agrees with the one before it, up to `most` symbols (one less than a power of two)."""
    before, after = order[:-1], order[1:]
    agreed = np.zeros(len(after), np.int64)
    step = (most + 1) // 2
    while step:
        a, b = before + agreed, after + agreed
        fits = np.maximum(a, b) + step <= size
        same = np.zeros(len(after), bool)
        same[fits] = hashes.of(a[fits], a[fits] + step) == hashes.of(b[fits], b[fits] + step)
        agreed += step * same
        step //= 2
    permuted = np.zeros(size, np.int64)
    permuted[after] = agreed
    return permuted


def _equal_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """All windows of `length` bytes in suffix array order: their pieces' numbers, their starts there, and where in this order another window begins."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces) + b"\0", np.uint8)
    text = joined.astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(sizes + 1) - 1
    text[ends], text[-1] = 1, 0
    order = suffix_array(text, 2 * length)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    inside = np.zeros(len(text), bool)
    inside[:-1] = ends[piece] - np.arange(len(text) - 1) >= length
    order = order[inside[order]]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none
    prefixes = common_prefixes(RangeHashes(text), order, len(text), 63)
    begins = np.flatnonzero(np.concatenate([[True], prefixes[order[1:]] < length]))
    number = piece[order]
    return number, order - (ends - sizes)[number], begins


def repeated_windows(pieces: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` bytes that also start in a piece of a smaller owner.

    Returns for each piece that has any: its number, and the first and last such window's start.
    """
    number, start, begins = _equal_windows(pieces, length)
    if not len(number):
        return number, start, begins
    owner = owners[number]
    least = np.repeat(np.minimum.reduceat(owner, begins), np.diff(np.append(begins, len(owner))))
    again = np.flatnonzero(owner > least)
    again = again[np.lexsort((start[again], number[again]))]
    found, first = np.unique(number[again], return_index=True)
    last = np.append(first, len(again))[1:] - 1
    return found, start[again[first]], start[again[last]]


def window_groups(pieces: list[bytes], owners: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every different window of `length` bytes and its smallest owner; then its members, group after group:
    numbers of their pieces, starts there, and the bounds of the groups."""
    number, start, begins = _equal_windows(pieces, length)
    bounds = np.append(begins, len(number))
    if not len(number):
        return [], owners[:0], number, start, bounds
    windows = [pieces[n][a: a + length] for n, a in zip(number[begins].tolist(), start[begins].tolist())]
    return windows, np.minimum.reduceat(owners[number], begins), number, start, bounds
