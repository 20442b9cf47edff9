"""Same or near-same records across splits (problem 3).

Winnowing fingerprints: a text is cut into ``seed``-character windows, each run of ``window`` windows gives the
one of smallest rolling hash, and records of different splits that share a selected seed at nearly the same
place are candidates. The seeds of a pair are chained (the largest set in the same order in both texts), the
texts are aligned from the chain outwards, and where that needs more edits than are allowed the whole texts are
aligned, so that the chain decides no pair away.

Two texts that share an unedited run of ``seed + window - 1`` characters (18 by default) always share a
selected seed, however many texts hold it. No seed is left out or exchanged for being frequent: a seed is one
place where both sides meet, whatever their number, and pairs are ruled out only by bounds that hold for every
pair within ``share``:

* the shift of the seed is made by insertions and deletions,
* in each of the two parts beside the seed, the letters one text has more are edits (letter counts in 32
  classes of four bits a part, more than 15 count as 15),
* an edit takes away at most three of a text's sets of three letters (1,024 bits a text); seeds that more than ``many`` held-out
  texts have carry these bits too, others are checked by them once the texts are together.

Seeds are sent and joined in ``passes`` by their hash, one after the other: a seed belongs to one pass on both
sides, so each pair of places is met once, and the shuffle files of a pass are let go before the next, so that the disk
holds the seeds of one pass at a time. Their places are selected once and kept with the texts, a byte each.

So the time for one seed grows with the product of the texts that hold it on either side, at some nanoseconds a
pair, and the result doesn't depend on how frequent it is.

Seeds travel packed: a task brings the seeds of its texts into buckets of the seed's hash (those of frequent seeds apart) and
sends each bucket's part as one compressed row of some 25 bytes a seed, and a bucket is joined in sorted arrays, held-out seeds first, train seeds part by part.
A seed that makes up a large part of all is split on either side into parts that meet pairwise, so no task gets
it whole; which ones are is read from counts by hash in arrays of fixed size, where a collision only splits a
seed without need. A bitmap of fixed size of the held-out seeds keeps train seeds that meet none from being sent; where
the data outgrow it, it lets more through and drops nothing.

Copies are one class, so a heading repeated a million times is one text here, and pairs are of classes.

Null ids, null texts, and texts shorter than ``min_chars`` give no rows; a split that is neither train, val nor
exam takes no part; a repeated row counts once. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.editdistance import distances
from quillspan.llm.lookalike import keys_of
from quillspan.llm.skew import spread_join
from quillspan.session import release, written

TRAIN, HELD = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` codes of one or more texts laid end to end."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = _letters(codes)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _MIX + c[i : i + n]
    return _stirred(h)


def _letters(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    c ^= c >> np.uint64(31)
    return c


def _stirred(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _hashes(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The rolling hash of the windows at some places only."""
    c = _letters(codes)
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        h = h * _MIX + c[at + i]
    return _stirred(h)


def _selected(h: np.ndarray, length: np.ndarray, start: np.ndarray, size: int, window: int) -> np.ndarray:
    """Places of the minima of every ``window`` neighbouring seeds, for all texts at once; equal minima count alike.

    ``size`` is at least ``window``, so the places whose seed would run into the next text keep windows apart.
    """
    n = len(h)
    n_seeds = np.maximum(length - size + 1, 0)
    inside = np.zeros(n + 1, np.int32)  # seeds and windows of a text begin at its first character
    full = np.zeros(n + 1, np.int32)
    some = n_seeds > 0
    windows = np.maximum(n_seeds - window + 1, 1)[some]
    first = start[some]
    np.add.at(inside, first, 1)
    np.add.at(inside, first + n_seeds[some], -1)
    np.add.at(full, first, 1)
    np.add.at(full, first + windows, -1)
    h = np.where(np.cumsum(inside[:-1]) > 0, h, np.uint64(2**64 - 1))
    least = h.copy()
    for i in range(1, window):
        np.minimum(least[: n - i], h[i:], out=least[: n - i])
    whole = np.cumsum(full[:-1]) > 0
    chosen = np.zeros(n, bool)
    for i in range(min(window, n)):
        chosen[i:] |= whole[: n - i] & (least[: n - i] == h[i:])
    return np.flatnonzero(chosen & (h != np.uint64(2**64 - 1)))


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, length, np.cumsum(length) - length


CLASSES = 32


LETTERS = 1 << 14  # code points that have a class of their own; others share one


def letter_classes(count: np.ndarray) -> np.ndarray:
    """A class for each code point below ``LETTERS``, so that the 32 classes are about equally frequent."""
    load, out = [0] * CLASSES, np.arange(LETTERS) % CLASSES
    for c in np.flatnonzero(count)[np.argsort(-count[count > 0], kind="stable")].tolist():
        least = load.index(min(load))
        out[c], load[least] = least, load[least] + int(count[c])
    return out


# ---- arrays of fixed size that reach every task ---------------------------------------------------

BITS, SLOTS, BLOCK = 1 << 27, 1 << 20, 1 << 16


def _bit(seeds: np.ndarray) -> np.ndarray:
    return (seeds * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 27)


def _slot(seeds: np.ndarray) -> np.ndarray:
    return (seeds * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - 20)


class Packed:
    """A byte array of fixed size; it travels compressed, block by block."""

    def __init__(self, size: int, blocks: dict[int, bytes]):
        self.size, self.blocks, self.data = size, blocks, None

    def __reduce__(self):
        return Packed, (self.size, self.blocks)

    def bytes(self) -> np.ndarray:
        if self.data is None:
            self.data = np.zeros(self.size, np.uint8)
            for b, m in self.blocks.items():
                self.data[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(zlib.decompress(m), np.uint8)
        return self.data

    def has(self, values: np.ndarray) -> np.ndarray:
        """Read as a bitmap."""
        x = _bit(values)
        return (self.bytes()[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0


PARTS = "what int, block long, m binary"


def _parts(what: int, data: np.ndarray) -> pd.DataFrame:
    rows = data.view(np.uint8).reshape(-1, BLOCK)
    full = np.flatnonzero(rows.any(1))
    return pd.DataFrame({"what": what, "block": full, "m": [zlib.compress(rows[b].tobytes(), 1) for b in full]})


def _collected(parts: DataFrame, sizes: list[int]) -> list[Packed]:
    """The arrays of all tasks put together: ``what`` 0 by bits, others as 64-bit counts. Their sizes are fixed."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in pdf["m"]:
            x = np.frombuffer(zlib.decompress(m), np.uint8)
            out = x.copy() if out is None else (out | x if pdf["what"].iloc[0] == 0 else (out.view(np.int64) + x.view(np.int64)).view(np.uint8))
        return pd.DataFrame({"what": pdf["what"].iloc[:1], "block": pdf["block"].iloc[:1], "m": [zlib.compress(out.tobytes(), 1)]})

    rows = parts.groupBy("what", "block").applyInPandas(join, PARTS).collect()
    return [Packed(size, {r.block: bytes(r.m) for r in rows if r.what == w}) for w, size in enumerate(sizes)]


def _mark(bits: np.ndarray, values: np.ndarray) -> None:
    x = np.unique(_bit(values))
    np.bitwise_or.at(bits, x >> np.uint64(3), (np.uint8(1) << (x & np.uint64(7)).astype(np.uint8)))


# ---- seeds ---------------------------------------------------------------------------------------


def _classes_once(batches: Iterator[pd.DataFrame], many: int = 8_000) -> Iterator[pd.DataFrame]:
    """The classes of either side in a task in parts of some ``many``; copies near each other are one, and the set of those seen stays small."""
    seen: set[int] = set()
    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        if len(seen) > 200_000:
            seen.clear()
        fresh = []
        for mark in (batch["cls"] ^ (batch["side"].astype("int64") * (1 << 32))).tolist():
            fresh.append(mark not in seen)
            seen.add(mark)
        batch = batch[fresh]
        held.append(batch)
        n += len(batch)
        if n >= many:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def steps(texts: list[str], seed: int, window: int) -> list[bytes]:
    """The places of the selected seeds of each text, as steps from one to the next: a step is at most ``window``, a byte."""
    codes, length, start = _flat(texts)
    h = _rolling(codes, seed)
    at = _selected(h, length, start, seed, window) if len(h) else np.empty(0, np.int64)
    edges = np.searchsorted(at, np.append(start, len(codes)))
    step = np.diff(at, prepend=0)
    first = edges[:-1][np.diff(edges) > 0]
    step[first] = at[first] - start[np.diff(edges) > 0]
    data = step.astype(np.uint8).tobytes()
    return [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _seeds(batch: pd.DataFrame, seed: int) -> tuple:
    """Code points, lengths and starts of the texts; the place, text and hash of each selected seed."""
    codes, length, start = _flat(batch["key"].tolist())
    n = np.fromiter(map(len, batch["steps"]), np.int64, len(batch))
    upto = np.cumsum(np.frombuffer(b"".join(batch["steps"]), np.uint8), dtype=np.int64)
    text = np.repeat(np.arange(len(n)), n)
    before = np.append(0, upto)[np.cumsum(n) - n]
    at = start[text] + upto - before[text]
    return codes, length, start, at, text, _hashes(codes, at, seed)


def seed_counts(members: DataFrame, seed: int, every: int = 8) -> list[Packed]:
    """A bitmap of the held-out seeds, how many seeds of either side fall into each slot, and how often the held-out texts have each letter. The train side is counted by one class of
    ``every``, times ``every``: its counts only say how many parts a seed is split into.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, counts, letters = np.zeros(BITS // 8, np.uint8), np.zeros((2, SLOTS), np.int64), np.zeros(LETTERS, np.int64)
        for batch in _classes_once(b[(b["side"] == HELD) | (b["cls"] % every == 0)] for b in batches if len(b)):
            codes, length, _, _, text, h = _seeds(batch, seed)
            side = batch["side"].to_numpy()
            letters += np.bincount(np.minimum(codes[np.repeat(side == HELD, length)], LETTERS - 1), minlength=LETTERS)
            held = side[text] == HELD
            _mark(bits, h[held])
            for k, times in ((TRAIN, every), (HELD, 1)):
                counts[k] += times * np.bincount(_slot(h[held == (k == HELD)]).astype(np.int64), minlength=SLOTS)
        yield from (_parts(0, bits), _parts(1, counts[TRAIN]), _parts(2, counts[HELD]), _parts(3, letters))

    return _collected(members.select("side", "cls", "key", "steps").mapInPandas(mark, PARTS), [BITS // 8, SLOTS * 8, SLOTS * 8, LETTERS * 8])


def _beside(codes: np.ndarray, length: np.ndarray, at: np.ndarray, text: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Letter counts before and from each seed, 32 classes each, at most 15: (seeds, 64) bytes."""
    n = len(length)
    # stretches between the seeds of a text: the stretch of a character is the number of seeds at or before it, plus its text
    ends = np.zeros(len(codes) + 1, np.int32)
    ends[at] = 1
    stretch = np.cumsum(ends[:-1]) + np.repeat(np.arange(n), length)
    fold = classes[np.minimum(codes, LETTERS - 1)]
    counts = np.bincount(stretch * CLASSES + fold, minlength=(len(at) + n) * CLASSES).reshape(-1, CLASSES)
    # differences within a text are right whatever the sums before it have overflowed
    upto = np.zeros((len(counts) + 1, CLASSES), np.uint16 if length.max() < 1 << 16 else np.uint32)
    np.cumsum(counts, 0, dtype=upto.dtype, out=upto[1:])
    seeds_before = np.searchsorted(text, np.arange(n + 1))  # seeds of earlier texts
    first, last = seeds_before[:-1] + np.arange(n), seeds_before[1:] + np.arange(n) + 1
    here = np.arange(len(at)) + text + 1  # the stretch that begins with the seed
    out = np.empty((len(at), 2 * CLASSES), np.uint8)
    out[:, :CLASSES] = np.minimum(upto[here] - upto[first[text]], 15)
    out[:, CLASSES:] = np.minimum(upto[last[text]] - upto[here], 15)
    return out


GRAM, GRAM_BITS = 3, 1024


def _grams(codes: np.ndarray, length: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The grams of each text as a set of bits."""
    bits = np.zeros((len(length), GRAM_BITS), bool)
    h = _rolling(codes, GRAM) % np.uint64(GRAM_BITS)
    text = np.repeat(np.arange(len(length)), length)[: len(h)]
    whole = np.arange(len(h)) + GRAM <= (start + length)[text]
    bits[text[whole], h[whole].astype(np.int64)] = True
    return np.packbits(bits, 1)


def _grams_near(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """False for pairs that can't be within their limits: an edit takes away at most ``GRAM`` grams of either text."""
    lost = [np.bitwise_count(x & ~y).sum(1, dtype=np.int64) for x, y in ((a, b), (b, a))]
    return np.maximum(*lost) <= GRAM * limit


SENT = "bucket int, held_first byte, n long, m binary"
KEY_BYTES = 5  # of a seed's hash; seeds that agree in them by chance are ruled out like others


def _planes(x: np.ndarray, size: int) -> bytes:
    """The bytes of numbers, first bytes first, so that what is always nought packs away."""
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def _packed(key, row, place, length, counts, grams) -> bytes:
    """Seeds in the order of their texts."""
    parts = [
        _planes(key, 8)[: len(key) * KEY_BYTES], _planes(np.diff(row.view(np.uint64), prepend=np.uint64(0)), 8), _planes(place, 4), _planes(length, 4),
        np.ascontiguousarray((counts[:, ::2] | (counts[:, 1::2] << 4)).T).tobytes(), b"" if grams is None else grams.tobytes(),
    ]
    return zstandard.compress(b"".join(parts), 3)


def _unpacked(rows: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {}
    for n, m in rows:
        data, at = np.frombuffer(zstandard.decompress(m), np.uint8), 0

        def take(size: int, full: int, data=data, n=n) -> np.ndarray:
            nonlocal at
            x = np.zeros((full, n), np.uint8)
            x[:size] = data[at : at + size * n].reshape(size, n)
            at += size * n
            return np.ascontiguousarray(x.T).view(f"<u{full}").ravel()

        got = {"key": take(KEY_BYTES, 8), "row": np.cumsum(take(8, 8), dtype=np.uint64).view(np.int64), "place": take(4, 4).astype(np.int32), "length": take(4, 4).astype(np.int32)}
        got["counts"] = np.ascontiguousarray(data[at : at + n * CLASSES].reshape(CLASSES, n).T)  # two a byte
        at += n * CLASSES
        if at < len(data):
            got["grams"] = data[at:].reshape(n, GRAM_BITS // 8)
        for k, v in got.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


class Spread:
    """In how many parts the seeds of a slot are split on either side, and the bucket of each: those of slots with more than
    ``many`` held-out seeds have buckets of their own, the second half."""

    def __init__(self, counts: list[Packed], buckets: int, least: int, many: int):
        both = [c.bytes().view(np.int64) for c in counts]
        most = max(least, int(sum(c.sum() for c in both)) // 4096)
        often = np.flatnonzero((both[0] > most) | (both[1] > most))  # fewer than 8,192 slots
        self.slots, self.buckets, self.crowded = often, buckets, both[HELD] > many
        self.parts = [-(-c[often] // most) for c in both]

    def rows(self, side: int, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which seed, key, bucket): a seed that is split comes once for every part of the other side."""
        which, mine, other = np.arange(len(h)), np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        if len(self.slots):
            slot = _slot(h).astype(np.int64)
            at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            hit = self.slots[at] == slot
            times = np.where(hit, np.maximum(self.parts[1 - side][at], 1), 1)
            own = np.where(hit, np.maximum(self.parts[side][at], 1), 1).astype(np.uint64)
            mine = (((cls.view(np.uint64) * _MIX) >> np.uint64(33)) % own)[(which := np.repeat(which, times))]
            other = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
        train, held = (mine, other) if side == TRAIN else (other, mine)
        key = h[which] ^ (train * np.uint64(0x8CB92BA72F3D8DD7)) ^ (held * np.uint64(0xE7037ED1A0B428DB))
        half = np.uint64(self.buckets // 2)
        bucket = ((key * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)) % half
        return which, key, bucket + half * self.crowded[_slot(h[which]).astype(np.int64)].astype(np.uint64)


def _pass(seeds: np.ndarray, passes: int) -> np.ndarray:
    return ((seeds * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(40)) % np.uint64(passes)


def _sent(seed: int, turn: int, passes: int, classes, useful, spread, many: int = 300_000):
    """The seeds that belong to pass ``turn``, packed by side and bucket in parts of some ``many``."""

    def pack(side: int, parts: list[tuple]) -> pd.DataFrame:
        at, grams = 0, []
        for p in parts:
            grams.append(p[6])
            p[5][:] += at
            at += len(p[6])
        grams = np.concatenate(grams)
        key, bucket, row, place, length, of, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 4, 5, 7))
        by = np.argsort(bucket, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(bucket[by].astype(np.int64), prepend=-1)), len(by))
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            w = by[a:b]
            crowded = int(bucket[w[0]]) >= spread.value.buckets // 2
            rows.append((int(bucket[w[0]]), 1 - side, b - a, _packed(key[w], row[w], place[w], length[w], counts[w], grams[of[w]] if crowded else None)))
        return pd.DataFrame(rows, columns=["bucket", "held_first", "n", "m"])

    def part(side: int, batch: pd.DataFrame) -> tuple | None:
        if not len(batch):
            return None
        codes, length, start, at, text, h = _seeds(batch, seed)
        keep = np.flatnonzero(_pass(h, passes) == turn)
        if side == TRAIN:
            keep = keep[useful.value.has(h[keep])]
        if not len(keep):
            return None
        at, text, h = at[keep], text[keep], h[keep]
        which, key, bucket = spread.value.rows(side, h, batch["cls"].to_numpy(np.int64)[text])
        counts = _beside(codes, length, at, text, classes.value)
        row, place = batch["row"].to_numpy(np.int64)[text], (at - start[text]).astype(np.int32)
        # letter triples of the texts with crowded seeds, the only ones that carry them
        full = np.unique(text[spread.value.crowded[_slot(h).astype(np.int64)]])
        grams = _grams(*_flat(batch["key"].to_numpy()[full].tolist()))
        return key, bucket, row[which], place[which], length[text].astype(np.int32)[which], np.searchsorted(full, text[which]), grams, counts[which]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, n = {HELD: [], TRAIN: []}, {HELD: 0, TRAIN: 0}
        for batch in _classes_once(batches):
            for side in parts:
                made = part(side, batch[batch["side"] == side])
                if made is None:
                    continue
                parts[side].append(made)
                n[side] += len(made[0])
                if n[side] >= many:
                    yield pack(side, parts[side])
                    parts[side], n[side] = [], 0
        for side in parts:
            if n[side]:
                yield pack(side, parts[side])

    return make


def _near(held: dict, train: dict, i: np.ndarray, j: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of seeds that can belong to texts within ``share``."""
    shift = np.abs(held["place"][i] - train["place"][j]) + np.abs(held["rest"][i] - train["rest"][j])
    allowed = np.maximum(held["allowed"][i], train["allowed"][j])
    ok = shift <= allowed
    i, j, allowed = i[ok], j[ok], allowed[ok]
    rough = np.zeros(len(i), np.int64)
    for c in range(held["rough"].shape[0]):
        a, b = held["rough"][c][i], train["rough"][c][j]
        rough += np.abs(a - b)
    # of what differs in a class one half at least is more on one side
    ok = rough <= 2 * allowed
    i, j, allowed = i[ok], j[ok], allowed[ok]
    most = np.maximum(held["by_row"][i], train["by_row"][j]).sum(1, dtype=np.int64)
    ok = most - np.minimum(held["left"][i], train["left"][j]) - np.minimum(held["right"][i], train["right"][j]) <= allowed
    return _by_grams(held, train, i[ok], j[ok])


def _by_grams(held: dict, train: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets of three letters can be near, where seeds carry them."""
    if "grams" not in held or not len(i):
        return i, j
    ok = _grams_near(held["grams"][i], train["grams"][j], np.maximum(held["allowed"][i], train["allowed"][j]))
    return i[ok], j[ok]


def _block(held: dict, train: dict, a: slice, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a slice of held seeds and some train seeds, class by class over a whole block."""
    outer = lambda f, name: f(held[name][a][:, None], train[name][b][None, :])
    allowed = outer(np.maximum, "allowed")
    ok = np.abs(outer(np.subtract, "place")) + np.abs(outer(np.subtract, "rest")) <= allowed
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the larger counts add up to at most both lengths
    small = int(held["length"][a].max()) + int(train["length"][b].max()) < 256
    total = np.zeros(ok.shape, np.uint8 if small else np.uint16)
    one = np.empty(ok.shape, np.uint8)
    counts = np.take(train["counts"], b, 1)  # each class end to end
    for c in range(2 * CLASSES):
        np.maximum(held["counts"][c, a][:, None], counts[c][None, :], out=one)
        total += one
    ok &= total - outer(np.minimum, "left") - outer(np.minimum, "right") <= allowed
    both = np.flatnonzero(ok)
    return _by_grams(held, train, both // len(b) + a.start, b[both % len(b)])


def _ordered(d: dict[str, np.ndarray], share: float, strip: int = 1) -> dict[str, np.ndarray]:
    """Sorted by key, place in strips, and what is left of the text, with what the pairs are compared by."""
    at, rest = d["place"] // strip, d["length"] - d["place"]
    if len(at) and at.max() >= 1 << 12:
        by = np.lexsort((rest, at, d["key"]))
    else:
        by = np.argsort((d["key"] << np.uint64(24)) | (at.astype(np.uint64) << np.uint64(12)) | np.minimum(rest, (1 << 12) - 1).astype(np.uint64))
    d = {k: v[by] for k, v in d.items()}
    two = d["counts"]
    d["by_row"] = np.empty((len(by), 2 * CLASSES), np.uint8)
    d["by_row"][:, ::2], d["by_row"][:, 1::2] = two & 15, two >> 4
    d["counts"] = np.ascontiguousarray(d["by_row"].T)
    d["rough"] = d["counts"].reshape(8, -1, len(by)).sum(1, dtype=np.int16)
    if "grams" in d:
        d["grams"] = d["grams"].view(np.uint64)
    # numbers of short texts in two bytes: what a tile compares stays in the cache
    small = np.int16 if not len(by) or d["length"].max() < 1 << 14 else np.int32
    d["left"], d["right"] = (d["counts"][k * CLASSES : (k + 1) * CLASSES].sum(0, dtype=small) for k in (0, 1))
    d["rest"] = (d["length"] - d["place"]).astype(small)
    d["place"] = d["place"].astype(small)
    d["allowed"] = np.floor(d["length"] * share + 1e-9).astype(small)
    return d


SMALL, MANY, TILE, STRIP = 4096, 1 << 17, (128, 1024), 8


def meet(held: dict, train: dict, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (held, train) pairs of equal key that can be near. Frequent keys are taken in tiles along the place, rare ones many at once."""
    keys, first, n_train = np.unique(train["key"], return_index=True, return_counts=True)
    lo, hi = np.searchsorted(held["key"], keys), np.searchsorted(held["key"], keys, side="right")
    n_held = hi - lo
    work = n_held * n_train
    few = np.flatnonzero((work > 0) & (work <= SMALL))
    upto = np.cumsum(work[few])
    for s in range(0, int(upto[-1]) if len(few) else 0, MANY):
        g = few[np.searchsorted(upto, s, side="right") : np.searchsorted(upto, s + MANY, side="right")]
        if not len(g):
            continue
        w = work[g]
        k = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        wide = np.repeat(n_train[g], w)
        yield _near(held, train, np.repeat(lo[g], w) + k // wide, np.repeat(first[g], w) + k % wide, share)
    for g in np.flatnonzero(work > SMALL).tolist():
        of = slice(int(first[g]), int(first[g] + n_train[g]))
        places, rest, most = train["place"][of].astype(np.int32), train["rest"][of].astype(np.int32), int(train["allowed"][of].max())
        for s in range(int(lo[g]), int(hi[g]), TILE[0]):
            a = slice(s, min(s + TILE[0], int(hi[g])))
            # a seed moves by at most the allowed edits, and so does the end of its text: a tile meets a stretch of places and of ends
            widest = max(int(held["allowed"][a].max()), most)
            if share < 1:  # a longer text is at most so much longer
                widest = min(widest, int(int(held["length"][a].max()) * share / (1 - share)) + 1)
            near = [(int(held[k][a].min()) - widest, int(held[k][a].max()) + widest) for k in ("place", "rest")]
            x, y = np.searchsorted(places, near[0][0]), np.searchsorted(places, near[0][1], side="right")
            b = of.start + x + np.flatnonzero((rest[x:y] >= near[1][0]) & (rest[x:y] <= near[1][1]))
            for t in range(0, len(b), TILE[1]):
                yield _block(held, train, a, b[t : t + TILE[1]])


CANDIDATES = "train_row long, held_row long, places long"  # place in the train text * 2**32 + place in the held-out text


def _joined(share: float, many: int = 500_000):
    """Candidates of the buckets of a partition; held-out seeds of a bucket come first, train seeds follow part by part."""

    def flush(held: list, train: list) -> Iterator[pd.DataFrame]:
        if not held or not train:
            return
        h, t = held[0] if isinstance(held[0], dict) else _ordered(_unpacked(held), share, STRIP), _ordered(_unpacked(train), share)
        held[:] = [h]
        for i, j in meet(h, t, share):
            if len(i):
                yield pd.DataFrame({"train_row": t["row"][j], "held_row": h["row"][i], "places": (t["place"][j].astype(np.int64) << 32) + h["place"][i].astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, train, n = None, [], [], 0
        for batch in batches:
            for b, first, size, m in zip(batch["bucket"], batch["held_first"], batch["n"], batch["m"], strict=True):
                if b != bucket:
                    yield from flush(held, train)
                    bucket, held, train, n = b, [], [], 0
                if first == 0:
                    held.append((size, m))
                elif held:
                    train.append((size, m))
                    n += size
                    if n >= many:
                        yield from flush(held, train)
                        train, n = [], 0
        yield from flush(held, train)

    return run


# ---- pairs ---------------------------------------------------------------------------------------


def read_split(column: str):
    """Split names without regard to case and blanks; null is train. 0 train, 1 val or exam, null otherwise."""
    s = F.lower(F.regexp_replace(F.coalesce(F.col(f"`{column}`"), F.lit("train")), r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]", ""))
    return F.when(s == "train", TRAIN).when(s.isin("val", "exam"), HELD).cast("byte")


def keyed(rows: DataFrame, key: str, text: str, split: str, min_chars: int, seed: int, window: int) -> DataFrame:
    """(id, side, cls, key, steps): the compare key with blanks squeezed, the class of rows that have the same, and the places of its seeds."""
    source = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), read_split(split).alias("side")).where(
        f"id is not null and text is not null and side is not null and length(text) >= {min_chars}"
    )

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["key"] = [" ".join(k.split()) for k in keys_of(batch.pop("text").tolist())] if len(batch) else batch.pop("text")
            batch = batch[batch["key"].str.len() >= min_chars]
            yield batch.assign(steps=steps(batch["key"].tolist(), seed, window))

    made = source.mapInPandas(squeeze, "id long, side byte, key string, steps binary")
    return made.select("id", "side", F.xxhash64("key", F.lit(1)).alias("cls"), "key", "steps")


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The largest set of seeds (place in one text, place in the other) in the same order in both."""
    seeds = sorted(set(seeds))
    if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(seeds, seeds[1:], strict=False)):
        return seeds
    # longest increasing run of second places; of equal first places the larger second comes first
    seeds.sort(key=lambda s: (s[0], -s[1]))
    ends: list[int] = []
    back: list[int] = []
    last: list[int] = []
    for k, (_, y) in enumerate(seeds):
        at = bisect_left(ends, y)
        if at == len(ends):
            ends.append(y)
            last.append(k)
        else:
            ends[at], last[at] = y, k
        back.append(last[at - 1] if at else -1)
    out, k = [], last[-1]
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def gaps(a: str, b: str, seeds: list[tuple[int, int]], size: int) -> list[tuple[str, str]]:
    """What is left to align once the chained seeds stand on each other and are extended over equal characters."""
    out, x, y = [], 0, 0
    for p, q in [*chain(seeds), (len(a), len(b))]:
        if p < x or q < y:
            continue  # overlaps what the seed before covers
        left, right = a[x:p], b[y:q]
        if left != right:
            out.append((left, right))
        x, y = p + size, q + size
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y = x + 1, y + 1
    return out


def _can_be_near(ka: list[str], kb: list[str], limit: np.ndarray) -> np.ndarray:
    """False for pairs whose sets of three letters say that they aren't within their limits."""
    which, texts = pd.factorize(np.array([*ka, *kb], object))
    bits = _grams(*_flat(texts.tolist())).view(np.uint64)
    return _grams_near(bits[which[: len(ka)]], bits[which[len(ka) :]], limit)


def covered(places: list[int], size: int) -> int:
    """Characters that seeds of ``size`` at these places cover together."""
    total, end = 0, 0
    for p in sorted(places):
        total += p + size - max(p, end) if p + size > end else 0
        end = max(end, p + size)
    return total


def _edits(ka: list[str], kb: list[str], places: list[np.ndarray], size: int, limit: np.ndarray, chained: float = 0.4) -> np.ndarray:
    """Edits of each pair: from its chain outwards where its seeds cover ``chained`` of the held-out text; the least number for
    others, and where the chain's is over the limit."""
    held = [(p & 0xFFFFFFFF).tolist() for p in places]
    total = limit + 1
    by_chain = [i for i, (b, p) in enumerate(zip(kb, held, strict=True)) if covered(p, size) >= chained * len(b)]
    pieces = [gaps(ka[i], kb[i], list(zip((places[i] >> 32).tolist(), held[i], strict=True)), size) for i in by_chain]
    owner = np.repeat(np.array(by_chain, np.int64), [len(p) for p in pieces])
    flat = [x for p in pieces for x in p]
    total[by_chain] = 0
    np.add.at(total, owner, distances([x[0] for x in flat], [x[1] for x in flat]))
    over = np.flatnonzero(total > limit)
    total[over] = distances([ka[i] for i in over], [kb[i] for i in over], limit[over])
    return total


def _candidates(members: DataFrame, share: float, seed: int, least: int, many: int, passes: int, bucket_seeds: int = 250_000) -> DataFrame:
    """(train_row, held_row, places): texts that share a seed and can be near, with the places of the seeds they share."""
    spark = members.sparkSession
    sc = spark.sparkContext
    useful, *counts, letters = seed_counts(members, seed)
    classes = sc.broadcast(letter_classes(letters.bytes().view(np.int64)))
    total = int(sum(c.bytes().view(np.int64).sum() for c in counts))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * bucket_seeds * passes))
    useful, spread = sc.broadcast(useful), sc.broadcast(Spread(counts, 8 * parts, least, many))

    def met(turn: int) -> DataFrame:
        sent = members.select("row", "side", "cls", "key", "steps").mapInPandas(_sent(seed, turn, passes, classes, useful, spread), SENT)
        return written(sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "held_first").mapInPandas(_joined(share), CANDIDATES))

    found = None
    for turn in range(passes):
        one = met(turn)
        found = one if found is None else found.unionByName(one)
        release(spark)  # the seeds of this pass
    return found.groupBy("train_row", "held_row").agg(F.collect_list("places").alias("places"))


def class_pairs(members: DataFrame, share: float, seed: int, least: int = 65_536, many: int = 128, passes: int = 2) -> DataFrame:
    """(train_cls, held_cls, distance, longer) of different texts within ``share`` of the longer text."""
    candidates = _candidates(members, share, seed, least, many, passes)
    texts = lambda k, name, key: members.where(f"side = {k}").select(F.col("row").alias(f"{name}_row"), F.col("cls").alias(f"{name}_cls"), F.col("key").alias(key))
    pairs = candidates.join(texts(TRAIN, "train", "ka"), "train_row").join(texts(HELD, "held", "kb"), "held_row").where("train_cls <> held_cls").drop("train_row", "held_row")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            length = np.maximum(batch["ka"].str.len().to_numpy(), batch["kb"].str.len().to_numpy()).astype(np.int64)
            limit = np.floor(length * share + 1e-9).astype(np.int64)
            may = _can_be_near(batch["ka"].tolist(), batch["kb"].tolist(), limit)
            batch, length, limit = batch[may], length[may], limit[may]
            if not len(batch):
                continue
            edits = _edits(batch["ka"].tolist(), batch["kb"].tolist(), batch["places"].tolist(), seed, limit)
            ok = edits <= limit
            yield pd.DataFrame({"train_cls": batch["train_cls"][ok], "held_cls": batch["held_cls"][ok], "distance": edits[ok], "longer": length[ok]})

    made = pairs.mapInPandas(align, "train_cls long, held_cls long, distance long, longer long")
    # copies that different tasks have sent are one class
    return made.groupBy("train_cls", "held_cls").agg(F.min("distance").alias("distance"), F.max("longer").alias("longer"))


def overlaps(rows: DataFrame, key: str, text: str, split: str, *, share: float = 0.15, min_chars: int = 20, seed: int = 12, window: int = 7, least: int = 65_536, many: int = 128, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Membership (id, side, cls) and class pairs (train_cls, held_cls, distance, longer), equal texts with distance 0.

    ``least``: a seed with more texts than that and than a 4096th of all seeds is split over tasks; ``many``: a seed with more
    held-out texts than that carries more to compare by; ``passes``: so many parts of the seeds are on disk one after the other.
    None of them changes the result.
    """
    members = written(keyed(rows, key, text, split, min_chars, seed, window).withColumn("row", F.monotonically_increasing_id()))
    near = written(class_pairs(members, share, seed, least, many, passes))
    sides = members.groupBy("cls").agg(F.bit_or(F.col("side") + 1).alias("sides"), F.max(F.length("key")).cast("long").alias("longer"))
    same = sides.where("sides = 3").select(
        F.col("cls").alias("train_cls"), F.col("cls").alias("held_cls"), F.lit(0).cast("long").alias("distance"), "longer"
    )
    return members.select("id", "side", "cls"), near.unionByName(same)


def row_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Class pairs expanded to (id_a < id_b); classes of many rows are split over tasks on either side."""
    of = lambda k, name: members.where(f"side = {k}").select(F.col("cls").alias(f"{name}_cls"), F.col("id").alias(f"{name}_id"))
    half = written(spread_join(pairs.select("train_cls", "held_cls"), of(HELD, "held"), "held_cls", "train_cls", "held_id").select("train_cls", "held_id"))
    both = spread_join(half, of(TRAIN, "train"), "train_cls", "held_id", "train_id")
    return both.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def record_coverage(rows: DataFrame, key: str, text: str, split: str, source: str, **how) -> DataFrame:
    """One row a held-out record: (id, split, source, n_links, edits, coverage).

    ``n_links`` are the train texts that repeat it exactly or nearly, ``edits`` those of the best of them by
    share, and coverage 1 - edits / longer length; without one null edits and coverage 0. A null source is ''.
    """
    members, pairs = overlaps(rows, key, text, split, **how)
    best = pairs.groupBy(F.col("held_cls").alias("cls")).agg(F.min(F.struct((F.col("distance") / F.col("longer")).alias("gap"), "distance")).alias("b"), F.count("*").alias("n_links"))
    record = members.where(f"side = {HELD}").join(best, "cls").groupBy("id").agg(F.min("b").alias("b"), F.max("n_links").alias("n_links"))
    held = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.lower(F.regexp_replace(F.col(f"`{split}`"), r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]", "")).alias("split"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"),
    ).where("id is not null and split in ('val', 'exam')").distinct()
    return held.join(record, "id", "left").select(
        "id", "split", "source", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("b.distance").alias("edits"), F.coalesce(1 - F.col("b.gap"), F.lit(0.0)).alias("coverage")
    )


def coverage_report(rows: DataFrame, key: str, text: str, split: str, source: str, **how) -> DataFrame:
    """Per split and source of the held-out rows: rows, rows that a train row repeats exactly or nearly, links, mean coverage."""
    record = record_coverage(rows, key, text, split, source, **how)
    return record.groupBy("split", "source").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("edits") == 0).alias("n_exact"),
        F.count_if(F.col("edits") > 0).alias("n_near"),
        F.sum("n_links").alias("n_links"),
        F.avg("coverage").alias("mean_coverage"),
    )
