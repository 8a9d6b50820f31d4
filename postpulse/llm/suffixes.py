"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

Induced sorting scans the array being built; here a scan goes in blocks.  A block ends before
the first slot that one of its own entries fills, so all its entries are final and are handled
at once.  Blocks grow while they are whole and shrink when they are cut.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1024
#: Names (of leftmost-smaller substrings) up to which a recursion ends in rank doubling: blocks
#: of so few entries cost more than sorting them.
_SHORT = 1 << 18


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end is the smallest suffix."""
    n = len(text)
    smaller = np.zeros(n, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    if len(change):
        rising = text[change + 1] > text[change]
        begins = np.concatenate([[0], change[:-1] + 1])
        smaller[: change[-1] + 1] = np.repeat(rising, change - begins + 1)
    return smaller


def _ranks(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: begin of each run, its length, and each entry's place in its run."""
    head = np.empty(len(sorted_keys), bool)
    head[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=head[1:])
    at = np.flatnonzero(head)
    sizes = np.diff(np.append(at, len(sorted_keys)))
    return at, sizes, np.arange(len(sorted_keys)) - np.repeat(at, sizes)


def _slots(keys: np.ndarray, free: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of entries that are put into the buckets ``keys`` one after the other:
    (order of the entries, their slots, buckets, entries per bucket)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at, sizes, place = _ranks(ranked)
    return order, free[ranked] + step * place, ranked[at], sizes


def _induce(text: np.ndarray, smaller: np.ndarray, ends: np.ndarray, sa: np.ndarray, rising: bool) -> None:
    """One scan.  Upwards it places the larger suffixes (from bucket heads), downwards the
    smaller ones (from bucket tails); ``sa`` holds -1 where no suffix is placed yet."""
    n = len(text)
    if rising:
        free, step = np.concatenate([[0], ends[:-1]]), 1
        sa[free[text[-1]]] = n - 1  # what stands before the end
        free[text[-1]] += 1
    else:
        free, step = ends - 1, -1
    done, block = 0, _BLOCK  # slots scanned so far, from either side
    while done < n:
        size = min(block, n - done)
        part = sa[done : done + size] if rising else sa[n - done - size : n - done][::-1]
        at = np.flatnonzero(part > 0)
        before = part[at] - 1
        right = smaller[before] != rising
        at, before = at[right], before[right]
        if not len(at):
            done, block = done + size, block * 2
            continue
        order, slots, buckets, sizes = _slots(text[before], free, step)
        first = int(slots.min()) - done if rising else n - 1 - int(slots.max()) - done
        if first < size:  # only entries before that slot are known by now
            keep = int(np.searchsorted(at, first))
            order, slots, buckets, sizes = _slots(text[before[:keep]], free, step)
            before, size = before[:keep], first
            block = max(64, min(block, 2 * size))
        else:
            block *= 2
        sa[slots] = before[order]
        free[buckets] += step * sizes
        done += size


def _sorted_by(text: np.ndarray, smaller: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the order given."""
    sa = np.full(len(text), -1, np.int32 if len(text) < 1 << 31 else np.int64)
    if len(seeds):
        order, slots, _, _ = _slots(text[seeds[::-1]], ends - 1, -1)
        sa[slots] = seeds[::-1][order]
    _induce(text, smaller, ends, sa, True)
    filled = sa >= 0
    filled[filled] = smaller[sa[filled]]
    sa[filled] = -1
    _induce(text, smaller, ends, sa, False)
    return sa


def _same_pieces(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring equals the one before it in order."""
    n = len(text)
    length = np.append(lms[1:], n) - lms + 1  # with the first character of the next one
    own = length[which]
    same = np.zeros(len(ordered), bool)
    same[1:] = (own[1:] == own[:-1]) & (which[1:] != len(lms) - 1) & (which[:-1] != len(lms) - 1)
    open_, step = np.flatnonzero(same), 0
    while len(open_):
        equal = text[ordered[open_] + step] == text[ordered[open_ - 1] + step]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal & (own[open_] > step)]
    return same


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array of a short text by doubling ranks, where recursion ends.  A rank is the
    first slot of its group; only suffixes whose group has others are sorted again."""
    n, wide = len(text), int(text.max()) + 2
    width = max(1, min(4, int(62 / np.log2(wide))))  # characters that fit one key
    key = np.zeros(n, np.int64)
    for step in range(width):
        key *= wide
        key[: max(0, n - step)] += text[step:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    rank, slots, members, step = np.empty(n, np.int64), np.arange(n), order, width
    ranked = key[order]
    while True:
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        first = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        rank[members] = first
        alone = head & np.concatenate([head[1:], [True]])
        slots, members = slots[~alone], members[~alone]
        if not len(slots):
            return order
        after = members + step
        key = rank[members] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        members, ranked = members[sort], key[sort]
        order[slots] = members
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Begins of the suffixes of ``text`` (non-negative integers) in ascending order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    ends = np.cumsum(np.bincount(text))
    if len(ends) == n and ends[0] == 1 and (np.diff(ends) == 1).all():
        return np.argsort(text)  # every character once
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return _sorted_by(text, smaller, ends, lms)
    sa = _sorted_by(text, smaller, ends, lms)
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(len(lms))
    which = number[sa]
    which = which[which >= 0]
    names_sorted = np.cumsum(~_same_pieces(text, lms, lms[which], which)) - 1
    if names_sorted[-1] == len(lms) - 1:
        order = which
    else:
        names = np.empty(len(lms), np.int64)
        names[which] = names_sorted
        short = len(names) <= _SHORT
        order = _doubled(names) if short else suffix_array(names.astype(np.uint16) if names_sorted[-1] < 65535 else names)
    return _sorted_by(text, smaller, ends, lms[order])


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position (permuted order) the common prefix of its suffix with the one before
    it in ``sa``.  A value is its left neighbour's less one, unless the characters before the
    two suffixes differ or are not neighbours too; only those values are compared."""
    n = len(text)
    previous = np.full(n, -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    # reducible: the pair to the left is the same pair moved by one and its characters agree
    follows = np.zeros(n, bool)
    follows[1:] = (previous[1:] > 0) & (previous[:-1] == previous[1:] - 1) & (text[:-1] == text[np.maximum(previous[1:], 1) - 1])
    start = np.flatnonzero(~follows)
    found = np.zeros(len(start), np.int64)
    wide = np.zeros(n + 8, np.uint64)
    for byte in range(8):
        wide[:n] <<= np.uint64(8)
        wide[: max(0, n - byte)] |= text[byte:].astype(np.uint64)
    open_ = np.flatnonzero(previous[start] >= 0)
    while len(open_):
        a, b = start[open_] + found[open_], previous[start[open_]] + found[open_]
        inside = np.maximum(a, b) + 8 <= n
        equal = inside & (wide[np.minimum(a, n)] == wide[np.minimum(b, n)])
        found[open_[equal]] += 8
        last = open_[~equal]
        for _ in range(8):
            if not len(last):
                break
            a, b = start[last] + found[last], previous[start[last]] + found[last]
            more = (np.maximum(a, b) < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
            last = last[more]
            found[last] += 1
        open_ = open_[equal]
    run = np.diff(np.append(start, n))
    return np.maximum(np.repeat(found, run) - (np.arange(n) - np.repeat(start, run)), 0)
