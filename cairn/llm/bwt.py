"""Which places of a set of strings share a prefix of a given length with another place, from the Burrows-Wheeler transform.

Common prefixes of neighbouring suffixes are derived by increasing value: the interval of a string w of length l in the
suffix order is extended backward by each symbol c that precedes it; if the entry behind the interval of cw has no value
yet, its value is l, and the new interval is kept for the next round. Rounds stop at the least length asked for, and the
entries still without a value are those of that length or more. No longer prefix is ever measured.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places of data sorted by the depth symbols from there on, or more. Symbols are 1 .. 256; the strings' ends are 0, each smaller than any symbol and in order among themselves."""
    n, width = len(data), 7
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the string's end
    key = np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(width, data.dtype)))
    going = np.ones(n, bool)
    for i in range(width):
        going &= left > i
        key <<= 9
        key[going] |= padded[i : n + i][going]
    order = np.argsort(key, kind="stable")  # alike up to their ends: in order of the strings
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (left[order][1:] < width)
    del key, going, padded
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.concatenate((start, [n]))))
    alone = new & np.concatenate((new[1:], [True]))
    active = np.flatnonzero(~alone)  # rows of the order whose suffixes aren't told apart yet
    while width < depth and len(active):
        at = order[active]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[active] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.flatnonzero(new)
        rank[at] = np.repeat(active[start], np.diff(np.concatenate((start, [len(at)]))))
        active = active[~(new & np.concatenate((new[1:], [True])))]
        width *= 2
    return order


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all spans, end to end."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)


def shared_prefixes(strings: list[bytes], least: int, times: np.ndarray | None = None) -> np.ndarray:
    """For each place of the strings end to end, one more for each string's end: whether the next `least` bytes also stand at another place. No match runs over a string's end.

    times: how often each string stands there. Copies of a suffix would be neighbours in the order, with all that is left of
    it in common, so one row stands for all of them: it has a copy as neighbour."""
    lengths = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(lengths) - 1
    data = np.zeros(int(lengths.sum()), np.int16)
    inner = np.ones(len(data), bool)
    inner[ends] = False
    data[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    order = suffix_order(data, ends, least)
    n, count = len(data), len(strings)
    previous = data[order - 1]  # the transform; 0 before the start of a string
    previous[order == 0] = 0
    back = np.empty(n, np.int64)  # the row of the suffix one longer
    back[np.argsort(previous, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    # the empty string's extensions: each end by itself, and each symbol
    symbols = np.bincount(data, minlength=257)
    edge = np.cumsum(symbols)
    some = np.flatnonzero(symbols[1:]) + 1
    low = np.concatenate((np.arange(count), edge[some] - symbols[some]))
    high = np.concatenate((np.arange(count), edge[some] - 1))
    for _ in range(1, least + 1):  # the values of this round are one less
        new = ~known[high + 1]
        known[high + 1] = True
        low, high = low[new], high[new]
        if not len(low):
            break
        sizes = high - low + 1
        rows = spans(low, sizes)
        owner = np.repeat(np.arange(len(low)), sizes)
        extends = previous[rows] > 0
        rows, owner = rows[extends], owner[extends]
        if not len(rows):
            break
        to, symbol = back[rows], previous[rows]
        by = np.argsort(to)
        to, symbol, owner = to[by], symbol[by], owner[by]
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])))
        low = to[first]
        high = to[np.concatenate((first[1:], [True]))]
    longer = ~known
    out = np.empty(n, bool)
    out[order] = longer[:-1] | longer[1:]
    if times is not None:
        left = np.repeat(ends, lengths) - np.arange(n)
        out |= (np.repeat(times, lengths) > 1) & (left >= least)
    return out
