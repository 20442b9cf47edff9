"""Kernels that are sequential by nature, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(a: str, b: str) -> float:
    """Matched share of two words without regard to case (Ratcliff and Obershelp; the order of the arguments matters)."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


@F.pandas_udf(T.DoubleType())
def similarity_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length), from the longest common subsequence, bit-parallel."""
    if not a and not b:
        return 100.0
    common = _common_length(a, b)
    return 200.0 * common / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def edit_distance(a: str, b: str) -> int:
    """Least number of inserted, deleted and replaced code points: one column at a time in the bits of an integer (Myers 1999)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, len(a) - 1
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += (ph >> last & 1) - (mh >> last & 1)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


@F.pandas_udf(T.LongType())
def edit_distance_col(a: pd.Series, b: pd.Series) -> pd.Series:
    """For long texts, where a table of all cells would be too slow."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def word_edits(ref: list[str], hyp: list[str]) -> tuple[int, int]:
    """(edits, hits): the least number of word edits, and the most equal words in an alignment of that cost.

    One number a cell, edits times a large number less hits, a row at a time: what is put in is a running minimum along the row.
    """
    if not ref or not hyp:
        return max(len(ref), len(hyp)), 0
    number = {w: i for i, w in enumerate(dict.fromkeys(ref + hyp))}
    h, one = np.array([number[w] for w in hyp]), len(ref) + len(hyp) + 1
    slope = np.arange(len(hyp) + 1) * one
    row = slope.copy()
    for i, w in enumerate(ref, 1):
        new = np.append(i * one, np.minimum(row[:-1] + np.where(h == number[w], -1, one), row[1:] + one))
        row = np.minimum.accumulate(new - slope) + slope
    edits = -(-int(row[-1]) // one)
    return edits, edits * one - int(row[-1])


@F.pandas_udf(T.StructType([T.StructField("edits", T.LongType()), T.StructField("hits", T.LongType())]))
def word_edits_col(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Texts that are equal, as most are, need no alignment."""
    rows = []
    for r, h in zip(ref, hyp, strict=True):
        a, b = (r or "").split(), (h or "").split()
        rows.append((0, len(a)) if a == b else word_edits(a, b))
    return pd.DataFrame(rows or None, columns=["edits", "hits"])


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Word edits over the words of the reference; 0 or 1 for a reference without words."""
    n = F.size(F.filter(F.split(ref, r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]+"), lambda w: w != ""))
    e = word_edits_col(ref, hyp)["edits"]
    return F.when(n == 0, F.when(e == 0, 0.0).otherwise(1.0)).otherwise(e / n)


UNLIKE = 2.05
_COSTS: dict[tuple[str, str], float] = {}


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _pair_cost(a: str, b: str) -> float:
    """1 - 0.6 * similarity for words at least half alike, else more than leaving out and putting in. Remembered across texts."""
    got = _COSTS.get((a, b))
    if got is None:
        if len(_COSTS) > 500_000:
            _COSTS.clear()
        # matched blocks are a common subsequence
        s = SequenceMatcher(None, a, b).ratio() if _common_length(a, b) * 4 >= len(a) + len(b) else 0.0
        got = _COSTS[a, b] = 1 - 0.6 * s if s >= 0.5 else UNLIKE
    return got


def align_words(key: list[str], read: list[str], ignore_case: bool = False) -> list[tuple[int | None, int | None]]:
    """Pairs of places. Equal words cost 0, words at least half alike 1 - 0.6 * similarity, others 2.05 (more than
    leaving out and putting in); on ties a pair comes before leaving out, and that before putting in.

    Equal words at the end are paired at once. For the rest an alignment of equal words alone bounds the cost, and a
    path that costs no more stays in a band about the diagonal, so only the band is searched, a row at a time.
    """
    composed = lambda w: w if w.isascii() else unicodedata.normalize("NFC", w)
    plain = lambda w: (w.lower() if ignore_case else w).replace("ё", "е").replace("Ё", "Е")
    key, read = [composed(w) for w in key], [composed(w) for w in read]
    kp, rp = [plain(w) for w in key], [plain(w) for w in read]
    n, m = len(key), len(read)
    tail: list[tuple[int | None, int | None]] = []
    while n and m and kp[n - 1] == rp[m - 1]:
        n, m = n - 1, m - 1
        tail.append((n, m))
    kl, rl = [w.lower() for w in key[:n]], [w.lower() for w in read[:m]]
    number = {w: i for i, w in enumerate(dict.fromkeys(kp[:n] + rp[:m]))}
    ids_k, ids_r = [number[w] for w in kp[:n]], np.array([number[w] for w in rp[:m]], np.int64)
    most = n + m - 2 * _common_length("".join(map(chr, (0x10000 + i for i in ids_k))), "".join(map(chr, (0x10000 + i for i in ids_r.tolist()))))
    # a cell is on the way of a path of that cost only if the shifts before and after it add up to no more
    low, high = -((most - (m - n)) // 2), (most + (m - n)) // 2
    width = high - low + 1
    letters = {c: i for i, c in enumerate(dict.fromkeys("".join(kl + rl)))}

    def counts(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(letters) + 1), np.int16)
        for i, w in enumerate(words):
            for c in w:
                out[i, letters[c]] += 1
        return out

    ck, cr = counts(kl), counts(rl)
    sizes = cr.sum(1)
    shifts = np.arange(low, high + 1)
    row = np.where((shifts >= 0) & (shifts <= m), shifts, np.inf)
    steps = [bytes([2]) * width]
    for i in range(1, n + 1):
        cost = np.full(width, np.inf)
        a, b = max(1, i + low), min(m, i + high)  # columns of this row that can pair
        if a <= b:
            c = np.where(ids_r[a - 1 : b] == ids_k[i - 1], 0.0, UNLIKE)
            # the matched share can't be more than the letters two words have in common, so few pairs are compared in full
            may = (np.minimum(ck[i - 1], cr[a - 1 : b]).sum(1) * 4 >= ck[i - 1].sum() + sizes[a - 1 : b]) & (c > 0)
            for x in np.flatnonzero(may).tolist():
                c[x] = _pair_cost(kl[i - 1], rl[a - 1 + x])
            cost[a - i - low : b - i - low + 1] = c
        paired, left_out = row + cost, np.append(row[1:], np.inf) + 1
        columns = shifts + i
        best = np.where((columns >= 0) & (columns <= m), np.minimum(paired, left_out), np.inf)
        how = bytearray((left_out < paired).astype(np.int8).tobytes())
        # a word put in costs one more than the cell before, from left to right
        got, before = best.tolist(), np.inf
        for x, v in enumerate(got):
            if before + 1 < v and columns[x] <= m:
                got[x] = v = before + 1
                how[x] = 2
            before = v
        row = np.array(got)
        steps.append(bytes(how))
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        how = steps[i][j - i - low]
        i, j = i - (how != 2), j - (how != 1)
        out.append((i if how != 2 else None, j if how != 1 else None))
    return out[::-1] + tail[::-1]


def assign(similar: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns of the largest total (shortest augmenting paths)."""
    if not similar.size:
        return []
    flip = similar.shape[0] > similar.shape[1]
    cost = -(similar.T if flip else similar)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def edit_events(correct: str, written: str) -> list[tuple[str, str, str, float | None]]:
    """(op, from, to, place) between a word and its misspelling: one letter for another (sub), left out (del), put in after a
    letter (ins; ``^`` at the start) or doubled (dbl), each with its place in tenths of the word; anything longer is complex, without a place."""
    out: list[tuple[str, str, str, float | None]] = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, correct, written, autojunk=False).get_opcodes():
        a, b = correct[i1:i2], written[j1:j2]
        if tag == "equal":
            continue
        place = round(i1 / max(1, len(correct)), 1)
        before = correct[i1 - 1] if i1 else "^"
        match (len(a), len(b)):
            case (1, 1):
                out.append(("sub", a, b, place))
            case (1, 0):
                out.append(("del", a, "", place))
            case (0, 1):
                out.append(("dbl", b, b, place) if b == before else ("ins", before, b, place))
            case _:
                out.append(("complex", a, b, None))
    return out


def ctc_spans(log_probs: np.ndarray, labels: list[int], blank: int = 0) -> list[tuple[int, int]] | None:
    """First and last frame of each label on the best path (Viterbi over blank-interleaved labels); None if there is none."""
    frames, states = len(log_probs), 2 * len(labels) + 1
    wide = np.full(states, blank)
    wide[1::2] = labels
    skip = np.zeros(states, bool)
    skip[3::2] = wide[3::2] != wide[1:-2:2]
    score = np.full(states, -np.inf)
    score[: min(2, states)] = log_probs[0, wide[: min(2, states)]]
    back = np.zeros((frames, states), np.int8)
    for t in range(1, frames):
        options = np.full((3, states), -np.inf)
        options[0], options[1, 1:] = score, score[:-1]
        options[2, 2:] = np.where(skip[2:], score[:-2], -np.inf)
        back[t] = options.argmax(0)
        score = options.max(0) + log_probs[t, wide]
    at = states - 1 if states == 1 or score[-1] >= score[-2] else states - 2
    if not np.isfinite(score[at]):
        return None
    spans: list[list[int]] = [[] for _ in labels]
    for t in range(frames - 1, -1, -1):
        if at % 2:
            spans[at // 2].append(t)
        at -= int(back[t, at])
    return [(s[-1], s[0]) for s in spans]


def ctc_score(log_probs: np.ndarray, labels: list[int], blank: int = 0) -> float:
    """Log probability of a label sequence, summed over all paths (forward algorithm)."""
    states = 2 * len(labels) + 1
    wide = np.full(states, blank)
    wide[1::2] = labels
    skip = np.zeros(states, bool)
    skip[3::2] = wide[3::2] != wide[1:-2:2]
    alpha = np.full(states, -np.inf)
    alpha[: min(2, states)] = log_probs[0, wide[: min(2, states)]]
    with np.errstate(invalid="ignore"):
        for t in range(1, len(log_probs)):
            total = np.logaddexp(alpha, np.concatenate(([-np.inf], alpha[:-1])))
            far = np.concatenate(([-np.inf, -np.inf], alpha[:-2]))[:states]
            alpha = np.where(skip, np.logaddexp(total, far), total) + log_probs[t, wide]
    return float(np.logaddexp(alpha[-1], alpha[-2]) if states > 1 else alpha[-1])


def letter_spans(frames: list[tuple[int, int]], n_frames: int, per_frame: float, start: float = 0.0) -> list[tuple[float, float]]:
    """Stretch of each letter in pixels: from half a frame before it fires to half a frame before the next does; the last ends
    two and a half frames after it fires, within ``n_frames``. A letter is one frame wide at least."""
    out = []
    for k, (first, last) in enumerate(frames):
        a = max(0.0, first - 0.5)
        b = frames[k + 1][0] - 0.5 if k + 1 < len(frames) else min(float(n_frames), last + 2.5)
        out.append((start + a * per_frame, start + max(b, a + 1) * per_frame))
    return out


def letter_marks(ink: str, correct: str, spans: list[tuple[float, float]], top: float, bottom: float, per_frame: float, start: float = 0.0) -> list[tuple[str, str, tuple[float, float, float, float]]]:
    """(ink, correct, box) of each difference: letters that stand for others or too much have their own boxes, letters that
    are missing a narrow box between their neighbours."""
    out = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, ink, correct, autojunk=False).get_opcodes():
        if tag in ("replace", "delete"):
            out.append((ink[i1:i2], correct[j1:j2], (min(a for a, _ in spans[i1:i2]), top, max(b for _, b in spans[i1:i2]), bottom)))
        elif tag == "insert":
            x = spans[i1 - 1][1] if i1 else spans[i1][0] if spans else start
            half = max(4.0, per_frame) / 2
            out.append(("", correct[j1:j2], (x - half, top, x + half, bottom)))
    return out


def trusted_letters(log_probs: np.ndarray, frames: list[tuple[int, int]], labels: list[int], spans: list[tuple[float, float]], least: float = 0.6, share: float = 0.5) -> list[bool] | None:
    """Which letters of a word are certain where they fire; None for a word with too few of them or with letters of unlikely width."""
    sure = [bool(np.exp(log_probs[a : b + 1, x].max()) >= least) for (a, b), x in zip(frames, labels, strict=True)]
    if sum(sure) < max(1, share * len(sure)):
        return None
    widths = [b - a for a, b in spans]
    middle = float(np.median(widths))
    return None if middle < 4 or any(w > 3 * middle or w < 0.15 * middle for w in widths) else sure


def greedy_pairs(similar: np.ndarray, least: float = 0.0) -> list[tuple[int, int]]:
    """Each row in turn with the free column most like it, if that's more than ``least``."""
    used, out = np.zeros(similar.shape[1], bool), []
    for i, row in enumerate(similar):
        if used.all():
            break
        j = int(np.argmax(np.where(used, -np.inf, row)))
        if row[j] > least:
            used[j] = True
            out.append((i, j))
    return out


def cut_points(profile: np.ndarray, guesses: list[float], middle: float, first: int, last: int) -> list[int] | None:
    """Places of cuts between letters: thin places of an ink profile in order, near the guesses, with letters of likely width.

    Costs 0.7 * shift / ``middle`` + 1.5 * ink + 0.8 * abs(log(width / ``middle``)); a letter is at least 0.4 ``middle`` wide and a cut shifts by
    at most twice ``middle``. None if there is no such choice.
    """
    smooth = np.convolve(profile, np.ones(5) / 5, mode="same")
    peak = max(1e-6, float(smooth.max()))
    thin = {c for c in range(first + 2, last - 2) if smooth[c] <= smooth[c - 1] and smooth[c] <= smooth[c + 1]}
    places = np.array(sorted(thin | {int(round(min(max(g, first + 2), last - 3))) for g in guesses}))
    if not len(places) or not guesses:
        return None if guesses else []
    narrow, far = max(2.0, 0.4 * middle), 2.0 * middle
    uneven = lambda w: 0.8 * np.abs(np.log(np.maximum(w, 1.0) / middle))
    total = np.where(places - first >= narrow, uneven(places - first), np.inf)
    back = []
    for k, g in enumerate(guesses):
        if k:
            wide = places[None, :] - places[:, None]
            reach = np.where(wide >= narrow, total[:, None] + uneven(wide), np.inf)
            back.append(reach.argmin(0))
            total = reach.min(0)
        total = total + np.where(np.abs(places - g) <= far, 0.7 * np.abs(places - g) / middle + 1.5 * smooth[places] / peak, np.inf)
    total = total + np.where(last - places >= narrow, uneven(last - places), np.inf)
    at = int(total.argmin())
    if not np.isfinite(total[at]):
        return None
    out = [at]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return places[out[::-1]].tolist()
