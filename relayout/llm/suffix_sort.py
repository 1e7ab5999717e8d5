"""Suffix arrays of many short strings by two-stage sorting, and the repeats that adjacent prefixes show."""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one a byte later; a string's last suffix is not.

    ``ends``: for each byte, the end of its string. A string's end sorts before any byte.
    """
    n = len(text)
    following = np.full(n, -1, np.int16)
    inner = np.arange(n) + 1 < ends
    following[inner] = text[np.flatnonzero(inner) + 1]
    step = np.sign(following - text.astype(np.int16))
    # a run of equal bytes takes the answer of its last one
    decided = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(decided[::-1])[::-1]
    return step[np.minimum(at, n - 1)] > 0


def suffix_array(data: bytes, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> list[int]:
    """The wanted suffixes (each up to its string's end) in order; equal ones in any order.

    Suffixes smaller than their successors are sorted directly. The others are induced: going through the buckets
    of first bytes in ascending order, the suffix a byte before each one found takes the next free place of its
    bucket. ``wanted``: flags by byte; suffixes that others are induced from are added. ``starts``, ``ends``: of
    the strings.
    """
    text = np.frombuffer(data, np.uint8)
    end = np.repeat(ends, ends - starts)
    small = smaller_than_next(text, end)
    # a larger suffix is induced from its successor, and so on to the next smaller one or the string's end
    source = np.where(small | (np.arange(len(text)) + 1 >= end), np.arange(len(text)), len(text))
    source = np.minimum.accumulate(source[::-1])[::-1]
    reach = np.zeros(len(text) + 1, np.int32)
    asked = np.flatnonzero(wanted)
    np.add.at(reach, asked, 1)
    np.add.at(reach, source[asked] + 1, -1)
    used = np.cumsum(reach[:-1]) > 0
    last = used & ~small & (np.arange(len(text)) + 1 >= end)  # nothing follows: first of their buckets
    direct = np.flatnonzero(used & small)
    stop = end[direct].tolist()
    direct = direct.tolist()
    order = sorted(zip(direct, stop), key=lambda span: data[span[0] : span[1]])
    sorted_by: list[list[int]] = [[] for _ in range(256)]
    for i, _ in order:
        sorted_by[data[i]].append(i)
    induced: list[list[int]] = [[] for _ in range(256)]
    for i in np.flatnonzero(last).tolist():
        induced[data[i]].append(i)
    first = np.zeros(len(text) + 1, bool)
    first[starts] = True
    before = np.zeros(len(text) + 1, bool)  # whether the suffix a byte before is one to induce
    before[1:] = used & ~small
    before[first] = False
    before = before.tolist()
    found: list[int] = []
    for byte in range(256):
        for part in (induced[byte], sorted_by[byte]):
            for i in part:  # the first list grows while it is read
                found.append(i)
                if before[i]:
                    induced[data[i - 1]].append(i - 1)
    return found


def earlier_equals(
    data: bytes, starts: np.ndarray, ends: np.ndarray, window: int, windows: np.ndarray, rank: np.ndarray
) -> np.ndarray:
    """Flags by byte: a wanted window of bytes starts here that also starts, equal, at a lesser place.

    Of each string the first ``windows`` starts are wanted; places compare by the string's ``rank``, equal ones by the
    place in the string.
    """
    size = ends - starts
    offset = np.arange(len(data)) - np.repeat(starts, size)
    wanted = offset < np.repeat(windows, size)
    order = suffix_array(data, starts, ends, wanted)
    order = [i for i, ask in zip(order, wanted[order].tolist()) if ask]
    flags = np.zeros(len(data), bool)
    if len(order) < 2:
        return flags
    # adjacent common prefixes, as far as the window
    heads = [data[i : i + window] for i in order]
    same = np.fromiter((a == b for a, b in zip(heads, heads[1:])), bool, len(heads) - 1)
    order = np.array(order)
    group = np.concatenate([[0], np.cumsum(~same)])
    place = np.repeat(rank, size)[order], offset[order]
    by = np.lexsort((place[1], place[0], group))
    least = np.concatenate([[True], group[by][1:] != group[by][:-1]])
    flags[order[by][~least]] = True
    return flags
