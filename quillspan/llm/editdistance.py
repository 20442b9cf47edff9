"""Edit distance of many pairs at once: bit-parallel columns (Myers 1999, blocks after Hyyro 2003) over numpy arrays."""

from __future__ import annotations

import numpy as np

from quillspan.functions.kernels import edit_distance

_ONE = np.uint64(1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, lengths, np.cumsum(lengths) - lengths


def _block(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, n_codes: int) -> np.ndarray:
    """Distances of rows of the padded code matrices; every a has the same number of 64-bit words."""
    n, words = len(la), int((la.max() + 63) // 64)
    eq = np.zeros((n, n_codes + 1, words), np.uint64)
    rows = np.arange(n)
    for i in range(int(la.max())):
        live = rows[i < la]
        eq[live, a[live, i], i // 64] |= _ONE << np.uint64(i % 64)
    pv = np.full((words, n), ~np.uint64(0))
    mv = np.zeros((words, n), np.uint64)
    score = la.copy()
    last = ((la - 1) % 64).astype(np.uint64)
    top = np.uint64(63)
    for j in range(int(lb.max())):
        live = j < lb
        plus, minus = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        here = eq[rows, b[:, j]]
        for w in range(words):
            e, p, m = here[:, w], pv[w], mv[w]
            xv = e | m
            e = e | minus
            xh = (((e & p) + p) ^ p) | e
            ph, mh = m | ~(xh | p), p & xh
            bit = last if w == words - 1 else top
            out_plus, out_minus = (ph >> bit) & _ONE, (mh >> bit) & _ONE
            ph, mh = (ph << _ONE) | plus, (mh << _ONE) | minus
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            plus, minus = out_plus, out_minus
        score += np.where(live, plus.astype(np.int64) - minus.astype(np.int64), 0)
    return score


def distances(left: list[str], right: list[str], limit: np.ndarray | None = None, block: int = 4096) -> np.ndarray:
    """Smallest number of inserted, deleted and replaced code points of each pair.

    With ``limit``, a pair whose letter counts alone differ by more than its limit gets limit + 1 without
    an alignment.
    """
    n = len(left)
    result = np.zeros(n, np.int64)
    if not n:
        return result
    fa, la, oa = _codes(left)
    fb, lb, ob = _codes(right)
    alphabet, inverse = np.unique(np.concatenate((fa, fb)), return_inverse=True)
    ca, cb = inverse[: len(fa)], inverse[len(fa) :]
    todo = np.ones(n, bool)
    if limit is not None:
        for s in range(0, n, block):
            e = min(n, s + block)
            k = len(alphabet)
            count = [
                np.bincount(np.repeat(np.arange(e - s), ln[s:e]) * k + c[o[s] : o[e - 1] + ln[e - 1]], minlength=(e - s) * k).reshape(e - s, k)
                for c, ln, o in ((ca, la, oa), (cb, lb, ob))
            ]
            diff = count[0] - count[1]
            bound = np.maximum(np.where(diff > 0, diff, 0).sum(1), np.where(diff < 0, -diff, 0).sum(1))
            todo[s:e] = bound <= limit[s:e]
        result[~todo] = limit[~todo] + 1
    empty = todo & ((la == 0) | (lb == 0))
    result[empty] = np.maximum(la, lb)[empty]
    todo &= ~empty
    order = np.flatnonzero(todo)
    order = order[np.lexsort((lb[order], (la[order] + 63) // 64))]
    width = (la[order] + 63) // 64
    for w in np.unique(width):
        group = order[width == w]
        if w > 8:
            # long texts one by one: the words of a column fill an integer
            result[group] = [edit_distance(left[i], right[i]) for i in group]
            continue
        # the table of masks takes alphabet x words x 8 bytes a pair
        step = max(1, min(block, 64_000_000 // (8 * int(w) * (len(alphabet) + 1))))
        for s in range(0, len(group), step):
            idx = group[s : s + step]
            mats = []
            for c, ln, o in ((ca, la, oa), (cb, lb, ob)):
                wide = int(ln[idx].max())
                at = o[idx][:, None] + np.arange(wide)[None, :]
                ok = np.arange(wide)[None, :] < ln[idx][:, None]
                mats.append(np.where(ok, c[np.minimum(at, len(c) - 1)], len(alphabet)))
            result[idx] = _block(mats[0], la[idx], mats[1], lb[idx], len(alphabet))
    return result
