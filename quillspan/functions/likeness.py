"""Which of many lines have a text that is much like them: every pair within reach is ruled out by a bound or measured, whole blocks of pairs at a time.

Likeness is 200 * c / (m + n) for texts of m and n letters whose longest common subsequence has c. For a threshold, c must reach
``least``; then at most m + n - 2c letters are unmatched, u of the one and v of the other. What rules a pair out, cheapest first:

* both have fewer than c letters in common, counted by class (rare letters share a class, which only weakens the bound);
* more than 3(u + v) letter pairs are in one of them only: an unmatched letter breaks at most two letter pairs of its own text and
  one of the other (rare pairs share bits, which only weakens the bound);
* after the first k letters of a text, their common subsequence with the line's letters up to the same distance from its end, and all
  letters behind, don't reach c.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterable

import numpy as np

OWN, POOLS, COMBINATIONS = 40, 8, 512
PAIR_BITS, OWN_PAIRS = 512, 400
#: Lines, texts and pairs that are dealt with at once, and lines that are prepared at once.
LINES, TEXTS, PAIRS, SLICE = 2048, 64, 1 << 15, 8192
#: Letters of a text after which a pair may be given up.
STOPS = (32, 38, 44, 52, 60)
WORD = 64


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the code points of each text in a row, 0 behind its end (a letter of code 0 counts as another control code)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.zeros((len(texts), int(length.max(initial=0))), np.uint32)
    rows[np.arange(rows.shape[1]) < length[:, None]] = codes + (codes == 0) * np.uint32(0x110000)
    return length, rows


def _script(length: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The share of letters beyond ASCII, in eighths."""
    return (rows >= 128).sum(1) * 8 // np.maximum(length, 1)


def _in_order(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts and their lengths; those of one script and of about one length lie together, so that blocks of pairs can be left out."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    script = np.concatenate([_script(*_padded(texts[s : s + SLICE])) for s in range(0, len(texts), SLICE)])
    order = np.lexsort((length, script))
    return [texts[k] for k in order], length[order]


def _pairs(length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter pairs of the texts, their ends included, as hashes that also depend on how often the text has the pair already; each
    one's text, and whether it has a letter beyond ASCII."""
    ends = np.zeros((len(rows), rows.shape[1] + 2), np.uint32)
    ends[:, 1:-1] = rows
    h = ends[:, :-1] * np.uint32(0x9E3779B1) + ends[:, 1:] * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(15))) & ~np.uint32(1) | ((ends[:, :-1] >= 128) | (ends[:, 1:] >= 128))
    inside = np.arange(h.shape[1]) <= length[:, None]
    h = np.sort(np.where(inside, h.astype(np.int64), np.int64(1) << 40), axis=1)
    again = np.zeros(h.shape, np.int64)
    for r in (1, 2, 3):
        again[:, r:] += h[:, r:] == h[:, :-r]
    at, k = np.nonzero(np.arange(h.shape[1]) <= length[:, None])
    return h[at, k] + (again[at, k] << 32), at, (h[at, k] & 1).astype(bool)


def _least(total: np.ndarray, threshold: float) -> np.ndarray:
    """Common letters that two texts of so many letters together need at least."""
    return np.ceil(threshold / 200.0 * total - 1e-9).astype(np.int64)


def _total(counts: np.ndarray) -> np.ndarray:
    """Sums of rows of eight small counts, all eight at once."""
    x = counts.view(np.uint64)[:, 0]
    low = np.uint64(0x00FF00FF00FF00FF)
    return (((x & low) + ((x >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def prepared(lines: list[str], threshold: float) -> list[Lines]:
    """The lines by length (up to 192 letters, twice that, and so on), so that a few long ones don't make all rows long."""
    groups: dict[int, list[str]] = {}
    for x in lines:
        groups.setdefault(max(0, (len(x) - 1) // 192).bit_length(), []).append(x)
    return [Lines(x, threshold) for _, x in sorted(groups.items())]


def like_any(groups: list[Lines], batches: Iterable[list[str]]) -> list[str]:
    """The prepared lines that a text of the batches is like; the prepared ones stay as they are."""
    own = [copy.copy(g) for g in groups]
    for g in own:
        g.open = np.ones(len(g.lines), bool)
    for texts in batches:
        for g in own:
            g.like(texts)
    return [g.lines[k] for g in own for k in np.flatnonzero(~g.open)]


class Lines:
    """Lines to be searched for, all of about one order of length; ``like`` closes those that a text is like."""

    def __init__(self, lines: list[str], threshold: float):
        self.threshold = threshold
        self.lines, self.length = _in_order(lines)
        self.alphabet, at = self._alphabet()
        self._classes(at)
        self._frequent_pairs()
        self.rows, self.counts, self.bits = self._joined(self.lines)
        self.top = self.counts.max(1)
        self.open = np.ones(len(lines), bool)

    def _alphabet(self) -> tuple[np.ndarray, np.ndarray]:
        n: Counter[int] = Counter()
        for s in range(0, len(self.lines), SLICE):
            _, rows = _padded(self.lines[s : s + SLICE])
            key, at = np.unique(rows[rows > 0], return_counts=True)
            n.update(dict(zip(key.tolist(), at.tolist(), strict=True)))
        key = sorted(n)
        return np.array(key, np.uint32), np.array([n[k] for k in key], np.int64)

    def _classes(self, at: np.ndarray) -> None:
        """A class for each of the frequent letters of ASCII, and of those beyond; a few for the rest."""
        wide = self.alphabet >= 128
        self.cls = np.where(wide, POOLS, 0) + (self.alphabet % POOLS).astype(np.int64)
        self.side = np.zeros(2 * (POOLS + OWN), bool)
        self.side[POOLS : 2 * POOLS] = True
        first = 2 * POOLS
        for beyond in (True, False):
            top = np.flatnonzero(wide == beyond)
            top = top[np.argsort(-at[top], kind="stable")[:OWN]]
            self.cls[top] = first + np.arange(len(top))[::-1]
            self.side[first : first + OWN] = beyond
            first += OWN

    def _frequent_pairs(self) -> None:
        """Frequent letter pairs have a bit of their own (one that a pair of the other kind may have too)."""
        pair, _, wide = _pairs(*_padded(self.lines[:: -(-len(self.lines) // SLICE)]))
        frequent = []
        for side in (wide, ~wide):
            key, n = np.unique(pair[side], return_counts=True)
            frequent.append(key[np.argsort(-n, kind="stable")[:OWN_PAIRS]])
        own, bit = np.concatenate(frequent), np.concatenate([np.arange(len(x)) for x in frequent])
        by = np.argsort(own)
        self.pair, self.pair_bit = own[by], bit[by]

    def _features(self, length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        letters = self._letters(rows)
        return letters, self._count(letters), self._bits(*_pairs(length, rows)[:2], len(rows))

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters (text, place), counts (class, text) and bits (text) of texts, made slice by slice."""
        parts = [self._features(*_padded(texts[s : s + SLICE])) for s in range(0, len(texts), SLICE)]
        rows = np.zeros((len(texts), max(x[0].shape[1] for x in parts)), parts[0][0].dtype)
        for k, (letters, _, _) in enumerate(parts):
            rows[k * SLICE : k * SLICE + len(letters), : letters.shape[1]] = letters
        return rows, np.concatenate([x[1] for x in parts], axis=1), np.concatenate([x[2] for x in parts])

    def _letters(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the letters in the alphabet from 1; 0 for those that no line has, and behind the end."""
        kind = np.min_scalar_type(len(self.alphabet) + 1)
        if not len(self.alphabet):
            return np.zeros(rows.shape, kind)
        at = np.minimum(np.searchsorted(self.alphabet, rows), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == rows, at + 1, 0).astype(kind)

    def _count(self, letters: np.ndarray) -> np.ndarray:
        """Letters of each class (class, text)."""
        at, k = np.nonzero(letters)
        cls = self.cls[letters[at, k].astype(np.int64) - 1]
        n = len(self.side)
        counts = np.bincount(at * n + cls, minlength=len(letters) * n).reshape(-1, n).T
        return np.ascontiguousarray(counts, np.uint8 if counts.max(initial=0) <= 255 else np.int64)

    def _bits(self, pair: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        bits = np.zeros((n, PAIR_BITS), bool)
        k = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        bits[at, np.where(self.pair[k] == pair, self.pair_bit[k], OWN_PAIRS + (pair ^ (pair >> 13)) % (PAIR_BITS - OWN_PAIRS))] = True
        return np.packbits(bits, axis=1).view(np.uint64)

    def _combinations(self, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Classes put together while the texts have few combinations of their counts: the classes, the combinations and each text's."""
        b = np.minimum(counts, self.top[:, None]).astype(np.int64)  # what is above all lines' counts isn't in common
        use = np.flatnonzero(b.max(1) > 0)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        k = 0
        while k < len(use):
            own = [use[k]]
            key, place = np.unique(b[use[k]], return_inverse=True)
            of = key[:, None]
            k += 1
            while k < len(use) and self.side[use[k]] == self.side[own[0]]:
                width = int(b[use[k]].max()) + 1
                key, to = np.unique(place * width + b[use[k]], return_inverse=True)
                if len(key) > COMBINATIONS:
                    break
                of, place = np.column_stack((of[key // width], key % width)), to
                own.append(use[k])
                k += 1
            out.append((np.array(own), of, place))
        return out

    def like(self, texts: list[str]) -> None:
        live, need = np.flatnonzero(self.open), self.threshold / 200.0
        if not len(live):
            return
        low, high = self.length.min() * need / (1 - need) - 1e-6, self.length.max() * (1 - need) / need + 1e-6
        texts = [x for x in texts if low <= len(x) <= high]
        if not texts:
            return
        texts, length = _in_order(texts)
        letters, counts, bits = self._joined(texts)
        letters = np.ascontiguousarray(letters.T)
        sets = self._combinations(counts)
        size = max(16, LINES * 8 // max(8, -(-int(self.length.max()) // WORD)))
        for s in range(0, len(live), size):
            _Block(self, live[s : s + size], length, letters, counts, bits, sets).search()


class _Block:
    """Some lines against a batch of texts."""

    def __init__(self, lines: Lines, at: np.ndarray, length: np.ndarray, letters: np.ndarray, counts: np.ndarray, bits: np.ndarray, sets: list):
        self.lines, self.at, self.lb, self.bits_b = lines, at, length, bits
        self.la, self.bits_a = lines.length[at], lines.bits[at]
        self.all_letters, self.counts_a, self.counts_b = letters, lines.counts[:, at], counts
        self.words = max(1, -(-int(self.la.max()) // WORD))
        self.sets = sets
        self.masks: list[np.ndarray] | None = None

    def search(self) -> None:
        la, lb = self.la, self.lb
        top_a = self.counts_a.max(1)
        starts = np.arange(0, len(lb), TEXTS)
        tops = np.maximum.reduceat(self.counts_b, starts, axis=1)
        shortest, longest = np.minimum.reduceat(lb, starts), np.maximum.reduceat(lb, starts)
        common = np.minimum(np.minimum(top_a[:, None], tops).sum(0, dtype=np.int64), np.minimum(la.max(), longest))
        near = np.flatnonzero(common >= _least(la.min() + shortest, self.lines.threshold))
        if not len(near):
            return
        rows = np.concatenate([np.arange(starts[k], min(starts[k] + TEXTS, len(lb))) for k in near])
        tables = self._tables()
        kind = tables[0][0].dtype
        most = np.iinfo(kind).max
        sum_, part = np.zeros((TEXTS, len(la)), kind), np.empty((TEXTS, len(la)), kind)
        ask, pend, n = {}, [], 0
        for r in range(0, len(rows), TEXTS):
            own = rows[r : r + TEXTS]
            acc, more = sum_[: len(own)], part[: len(own)]
            for k, (t, place) in enumerate(tables):
                np.take(t, place[own], axis=0, out=more if k else acc, mode="clip")
                if k:
                    np.add(acc, more, out=acc)
            cuts = [0, *(np.flatnonzero(np.diff(lb[own])) + 1).tolist(), len(own)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                size = int(lb[own[x]])
                if size not in ask:
                    need = _least(la + size, self.lines.threshold)
                    ask[size] = np.minimum(need, most).astype(kind), 3 * (la + size - 2 * need)
                least, lack = ask[size]
                hit = np.flatnonzero(acc[x:y] >= least)
                if len(hit):
                    q = hit // len(la)
                    p = hit - q * len(la)
                    q = own[x:y].take(q)
                    apart = self.bits_a.take(p, axis=0)
                    apart ^= self.bits_b.take(q, axis=0)
                    keep = np.flatnonzero(_total(np.bitwise_count(apart)) <= lack.take(p))
                    pend.append((p.take(keep), q.take(keep)))
                    n += len(keep)
            if n >= PAIRS:
                self._measure(*(np.concatenate(z) for z in zip(*pend, strict=True)))
                pend, n = [], 0
        if n:
            self._measure(*(np.concatenate(z) for z in zip(*pend, strict=True)))

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Letters that each line has in common with each combination of counts, and the texts' combinations. No sum is above a line's length."""
        kind = np.uint8 if self.la.max() <= 255 else np.uint16 if self.la.max() <= 65_535 else np.uint32
        tables = []
        for own, of, place in self.sets:
            if self.counts_a[own].any():
                t = np.zeros((len(of), len(self.la)), kind)
                for c, cls in enumerate(own):
                    a = self.counts_a[cls].astype(kind)
                    t += np.minimum(np.minimum(of[:, c], np.iinfo(kind).max).astype(kind)[:, None], a[None, :])
                tables.append((t, place))
        return tables or [(np.zeros((1, len(self.la)), kind), np.zeros(len(self.lb), np.int64))]

    def _prepare(self) -> None:
        """Where each letter stands in the lines: a word of bits for each line and letter, for each 64 letters of the lines."""
        letters = self.lines.rows[self.at]
        own = np.unique(letters[letters > 0])
        to = np.zeros(len(self.lines.alphabet) + 1, np.min_scalar_type(len(own) + 1))
        to[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        self.text = to[self.all_letters]
        self.masks = [np.zeros((len(self.at), self.width), np.uint64) for _ in range(self.words)]
        for k in range(int(self.la.max())):
            i = np.flatnonzero(self.la > k)
            self.masks[k // WORD][i, to[letters[i, k]]] |= np.uint64(1) << np.uint64(k % WORD)

    def _measure(self, p: np.ndarray, q: np.ndarray) -> None:
        lines = self.lines
        keep = lines.open[self.at[p]]
        p, q = p[keep], q[keep]
        if not len(p):
            return
        if self.masks is None:
            self._prepare()
        p, q = self._promising(p, q, _least(self.la[p] + self.lb[q], lines.threshold))
        for k in range(0, len(p), 4096):
            i, j = p[k : k + 4096], q[k : k + 4096]
            like = 200.0 * self._common(i, j) / (self.la[i] + self.lb[j]) >= lines.threshold
            lines.open[self.at[i[like]]] = False

    def _promising(self, p: np.ndarray, q: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may still reach what they need after some letters of the text, as far as the first 64 letters of the line tell."""
        base, masks, v = p * self.width, self.masks[0].reshape(-1), np.full(len(p), ~np.uint64(0))
        begin = 0
        for stop in STOPS:
            for col in range(begin, min(stop, len(self.text))):
                m = masks.take(base + self.text[col].take(q))
                u = v & m
                v = (v + u) | (v - u)
            begin = stop
            la, lb = self.la[p], self.lb[q]
            done = np.minimum(stop, lb)
            upto = la - lb + done  # the line's letters but as many as the text has left
            low = np.where(upto >= WORD, ~np.uint64(0), (np.uint64(1) << np.clip(upto, 0, WORD - 1).astype(np.uint64)) - np.uint64(1))
            reach = np.bitwise_count(~v & low) + np.minimum(lb - done, la)
            keep = np.flatnonzero((reach >= need) | (upto > WORD))
            p, q, need, base, v = p[keep], q[keep], need[keep], base[keep], v[keep]
        return p, q

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Longest common subsequences."""
        state = [np.full(len(p), ~np.uint64(0)) for _ in range(self.words)]
        for col in range(int(self.lb[q].max(initial=0))):
            at = p * self.width + self.text[col].take(q)
            carry = np.zeros(len(p), np.uint64)
            for w, v in enumerate(state):
                m = self.masks[w].reshape(-1).take(at)
                u = v & m
                s = v + u
                t = s + carry
                carry = ((s < v) | (t < s)).astype(np.uint64)
                state[w] = t | (v & ~m)
        return sum(np.bitwise_count(~v).astype(np.int64) for v in state)
