"""Which weighted sets, each standing in a span of time, may share enough: the numpy part of the story join.

A set is given by its terms' hashes and by what each adds to an overlap (`gain`). Two sets are told when what they share may be `floor` of the root of
both squares and their spans lie within `span` of each other. Gains may be too large and squares too small, by `slack` together: no
pair is missed, and those told are decided elsewhere, on whole vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Meetings worked on at a time; cells of the table in which the sets of one step are marked.
MEETINGS, CELLS = 1 << 20, 1 << 24
EPS = 1e-4  # well over what single floats lose


def runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (sizes[0] of them), begin[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


@dataclass
class Sets:
    """Sets end to end: where each begins, its terms as numbers in one order for all, what each adds, whether it can be the first shared."""

    at: np.ndarray
    codes: np.ndarray
    gains: np.ndarray
    leading: np.ndarray
    square: np.ndarray
    first: np.ndarray
    last: np.ndarray


def numbered(hashes: np.ndarray, gains: np.ndarray, at: np.ndarray, square: np.ndarray, first: np.ndarray, last: np.ndarray, least: float) -> Sets:
    """Sets without the terms that only one of them holds. Terms are numbered rarest first; those that add less than `least` come
    last and lead no pair. Where two terms have one hash they count as one, with the larger gain."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
    most = np.zeros(len(found), np.float32)
    np.maximum.at(most, back, gains)
    order = np.lexsort((times, most < least))
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    kept = np.flatnonzero(times[back] > 1)
    of, codes = np.divmod(np.sort(of[kept] * len(found) + rank[back[kept]]), max(len(found), 1))
    gains = most[order][codes]
    return Sets(np.searchsorted(of, np.arange(len(at))), codes.astype(np.int32), gains, gains >= least, square, first, last)


def near_pairs(sets: Sets, floor: float, span: int, begin: int, slack: float = 1.0, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of sets, as two rows of numbers, one of them with its first time at `begin` or later; with `side`, from different sides.

    Of a pair, the set of the smaller square is looked up under the terms from which on it has enough left, by the terms from which on the
    other has.
    """
    n, sizes = len(sets.square), np.diff(sets.at)
    of = np.repeat(np.arange(n, dtype=np.int32), sizes)
    upto = np.concatenate([[0.0], np.cumsum(sets.gains, dtype=np.float64)])
    rest = (upto[sets.at[1:]][of] - upto[:-1]).astype(np.float32)  # what a set has left from each term on
    root = np.sqrt(sets.square * floor * (1 - EPS)).astype(np.float32)
    low = floor**2 / slack - EPS
    listed = np.flatnonzero(sets.leading & (rest >= (floor - EPS) * sets.square[of]))
    asking = np.flatnonzero(sets.leading & (rest >= low * sets.square[of]))
    new, wide = sets.first >= begin, sets.last - sets.first > span
    out = [np.zeros((2, 0), np.int64)]
    for some, ask, timed in ((listed[~wide[of[listed]]], asking, True), (listed[(wide & new)[of[listed]]], asking, False),
                             (listed[(wide & ~new)[of[listed]]], asking[new[of[asking]]], False)):
        if not len(some) or not len(ask):
            continue
        along, lo, hi = (sets.first, sets.first - 2 * span, sets.last + span) if timed else (sets.square, sets.square * (low / slack), sets.square)
        values = np.sort(along)
        some = some[np.argsort(key := sets.codes[some].astype(np.int64) * (n + 1) + np.searchsorted(values, along)[of[some]], kind="stable")]
        key, base = np.sort(key), sets.codes[ask].astype(np.int64) * (n + 1)
        start = np.searchsorted(key, base + np.searchsorted(values, lo)[of[ask]])
        many = np.searchsorted(key, base + np.searchsorted(values, hi, "right")[of[ask]]) - start
        total, k = np.concatenate([[0], np.cumsum(many)]), 0
        while k < len(ask):  # whole sets, of about MEETINGS meetings
            j = max(int(np.searchsorted(total, total[k] + MEETINGS)), k + 1)
            j = int(np.searchsorted(of[ask], of[ask[min(j, len(ask)) - 1]], "right"))
            met, theirs = some[runs(start[k:j], many[k:j])], np.repeat(ask[k:j], many[k:j])
            a, b = of[met], of[theirs]
            good = np.flatnonzero(np.minimum(rest[met], rest[theirs]) >= root[a] * root[b])
            a, b = a[good], b[good]
            good = (sets.square[a] < sets.square[b]) | ((sets.square[a] == sets.square[b]) & (a < b))
            good &= (sets.first[a] - sets.last[b] <= span) & (sets.first[b] - sets.last[a] <= span) & (new[a] | new[b])
            if side is not None:
                good &= side[a] != side[b]
            b, a = np.divmod(np.unique(b[good].astype(np.int64) * n + a[good]), n)
            out.append(sharing(sets, a, b, root))
            k = j
    return np.concatenate(out, axis=1)


def sharing(sets: Sets, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of pairs in the order of `b`, those whose shared terms add up to enough."""
    sizes, width = np.diff(sets.at), int(sets.codes.max(initial=0)) + 1
    rows = max(1, CELLS // width)
    marks, out = np.zeros(rows * width, bool), [np.zeros((2, 0), np.int64)]
    mine, begin, times = np.unique(b, return_index=True, return_counts=True)
    for k in range(0, len(mine), rows):
        some = mine[k : k + rows]
        marked = np.repeat(np.arange(len(some)) * width, sizes[some]) + sets.codes[runs(sets.at[some], sizes[some])]
        marks[marked] = True
        i, j = begin[k], begin[k] + times[k : k + rows].sum()
        n = sizes[a[i:j]]
        terms = runs(sets.at[a[i:j]], n)
        held = marks[np.repeat(np.repeat(np.arange(len(some)) * width, times[k : k + rows]), n) + sets.codes[terms]]
        upto = np.concatenate([[0.0], np.cumsum(sets.gains[terms] * held, dtype=np.float64)])
        ends = np.cumsum(n)
        kept = i + np.flatnonzero(upto[ends] - upto[ends - n] >= root[a[i:j]] * root[b[i:j]])
        out.append(np.stack([a[kept], b[kept]]))
        marks[marked] = False
    return np.concatenate(out, axis=1)
