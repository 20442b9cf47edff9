"""Held-out passages inside a training corpus (problem 1).

Latent semantic retrieval. The corpus is read once as words of the compare key, 64-bit hashes in a written table; a
word falls into one of ``FEATURES`` buckets of its hash, so that every matrix has a size that doesn't depend on the data.

1. Document frequencies of the buckets over all documents give the weights (TF-IDF). Buckets that no item has add
   nothing to any product with an item and are left out.
2. A distributed randomised SVD of the passage-by-bucket matrix of the whole corpus: tasks multiply their rows
   with a random test matrix and back (two passes: range finder and Rayleigh-Ritz), partial products are added
   in two levels by block of buckets, and only buckets-by-rank matrices reach the driver.
3. Passages of documents and of items become unit vectors in the latent space, and pairs of a cosine of at least
   ``cosine`` are candidates. Items are taken in blocks of at most ``max_chars`` characters, each block against all documents.
4. Candidates are checked: ``shared_runs`` asks for the same words in a row, ``paraphrases`` for a longest
   common subsequence and for the item's rarest words (its answers).

Both searches give what a comparison of all pairs would give. For shared runs the passages are all ``run``-word windows of
either side. A shared run is the same window on both sides, whose two vectors are sums of the same numbers in the
same order, so its cosine is 1, whatever the SVD; item vectors are sorted along the first latent direction, and a
block of document vectors meets only the slice of items within reach of the cosine. Windows with a word that no item of the
block has can't be shared and aren't searched. For paraphrases the passages of items are found through lists of
their rarest words: a document passage must hold all but one of them, so only such passages get a vector and a cosine.

Null ids and null or empty texts give no rows; rows repeated under one id count once. An item shorter than
``run`` words can't be found in ``shared_runs``. An empty item set or corpus gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.lookalike import word_hashes
from quillspan.session import written

FEATURES = 1 << 16  # buckets of words
BLOCK = 512  # buckets in a block of a partial product


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, words): a text's words as 64-bit hashes, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            text_no, h = word_hashes(batch["text"].tolist())
            edges = np.searchsorted(text_no, np.arange(len(batch) + 1))
            yield pd.DataFrame({"id": batch["id"], "words": [h[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]})

    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null and text <> ''")
    return source.mapInPandas(run, "id long, words binary")


def _unpack(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch, and the number of the document of each."""
    words = np.frombuffer(b"".join(batch["words"]), np.uint64)
    return words, np.repeat(np.arange(len(batch)), batch["words"].str.len().to_numpy() // 8)


def _feature(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(24)).astype(np.int64) % FEATURES


def _known(items: DataFrame) -> np.ndarray:
    """Which buckets the items have."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FEATURES, bool)
        for batch in batches:
            if len(batch):
                seen[_feature(_unpack(batch)[0])] = True
        yield pd.DataFrame({"f": np.flatnonzero(seen)})

    out = np.zeros(FEATURES, bool)
    out[[r.f for r in items.mapInPandas(mark, "f long").distinct().collect()]] = True  # at most FEATURES rows
    return out


def document_frequency(words: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each bucket, and the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            if len(batch):
                h, doc = _unpack(batch)
                total += np.bincount(np.unique(doc * FEATURES + _feature(h)) % FEATURES, minlength=FEATURES)
                docs += len(batch)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"f": np.append(at, FEATURES), "n": np.append(total[at], docs)})

    rows = words.mapInPandas(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # at most FEATURES + 1 rows
    df = np.zeros(FEATURES + 1, np.int64)
    df[rows["f"]] = rows["n"]
    return df[:FEATURES], int(df[FEATURES])


def _gram_times(words: DataFrame, known: np.ndarray, weight: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """(A'A) q for the matrix A of all ``width``-word passages over the known buckets, rows scaled to unit length."""
    size, rank = q.shape
    place_of = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)
    given = words.sparkSession.sparkContext.broadcast((place_of, weight.astype(np.float32), q.astype(np.float32)))  # FEATURES by rank at most

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place_of, w, m = given.value
        total = np.zeros((size, rank))
        for batch in batches:
            if not len(batch):
                continue
            h, doc = _unpack(batch)
            ids = place_of[_feature(h)]
            first = np.searchsorted(doc, np.arange(len(batch)))
            place = np.arange(len(ids)) - first[doc]
            passage = np.cumsum((place % width == 0)) - 1
            ok = ids >= 0
            ids, passage = ids[ok], passage[ok]
            if not len(ids):
                continue
            starts = np.flatnonzero(np.diff(passage, prepend=-1))
            row = np.cumsum(np.diff(passage, prepend=-1) != 0) - 1
            norm2 = np.add.reduceat(w[ids] ** 2, starts)
            for c in range(rank):
                y = np.add.reduceat(w[ids] * m[ids, c], starts) / norm2
                total[:, c] += np.bincount(ids, weights=y[row], minlength=size)
        total *= w[:, None]
        for b in range(0, size, BLOCK):
            part = total[b : b + BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [b], "m": [part.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m) for m in pdf["m"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "m": [total.tobytes()]})

    parts = words.mapInPandas(multiply, "block long, m binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = parts.groupBy("block", "salt").applyInPandas(lambda pdf: add(pdf), "block long, m binary")
    rows = once.groupBy("block").applyInPandas(lambda pdf: add(pdf), "block long, m binary").collect()  # the vocabulary-by-rank matrix
    out = np.zeros((size, rank))
    for r in rows:
        part = np.frombuffer(r.m).reshape(-1, rank)
        out[r.block : r.block + len(part)] = part
    return out


def latent_table(words: DataFrame, known: np.ndarray, rank: int, width: int, seed: int = 0, oversample: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all buckets in the latent space (weight times leading right singular vectors, one more dimension left free, and a
    row of noughts for no word at the end), and the weights."""
    df, n = document_frequency(words)
    weight = np.log((1 + n) / (1 + df)) + 1
    w = weight[known]
    k = min(len(w), rank + oversample)
    q, _ = np.linalg.qr(_gram_times(words, known, w, np.random.default_rng(seed).standard_normal((len(w), k)), width))
    z = _gram_times(words, known, w, q, width)
    values, vectors = np.linalg.eigh(q.T @ z)
    space = q @ vectors[:, np.argsort(values)[::-1][:rank]]
    table = np.zeros((FEATURES + 1, space.shape[1] + 1), np.float32)
    table[np.flatnonzero(known), :-1] = w[:, None] * space
    return table, weight


def _vectors(windows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit vectors of passages: the word vectors added in order. The last row of ``table`` (no word) is zero."""
    v = np.zeros((len(windows), table.shape[1]), np.float32)
    for j in range(windows.shape[1]):
        v += table[windows[:, j]]
    # a passage outside the latent space gets one common direction, so it still meets its equals
    v[:, -1] += np.float32(1e-6)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class LatentIndex:
    """All item vectors, sorted along the first latent direction."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.argsort(vectors[:, 0], kind="stable")
        self.vectors = np.ascontiguousarray(vectors[self.order])

    def search(self, queries: np.ndarray, cosine: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, item vector, cosine) of at least ``cosine``."""
        reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-5
        by = np.argsort(queries[:, 0], kind="stable")
        first = self.vectors[:, 0]
        found = []
        for s in range(0, len(by), block):
            rows = by[s : s + block]
            lo = np.searchsorted(first, queries[rows[0], 0] - reach)
            hi = np.searchsorted(first, queries[rows[-1], 0] + reach)
            for t in range(lo, hi, 16384):
                part = self.vectors[t : min(hi, t + 16384)]
                cos = queries[rows] @ part.T
                i, j = np.nonzero(cos >= cosine)
                if len(i):
                    found.append((rows[i], self.order[t + j], cos[i, j]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _windows(ids: np.ndarray, text_no: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``run`` words of one text that hold only words of the vocabulary, and the text of each."""
    if len(ids) < run:
        return np.empty((0, run), np.int32), np.empty(0, np.int64)
    bad = np.cumsum(np.concatenate(([0], ids < 0)))
    at = np.flatnonzero((bad[run:] == bad[:-run]) & (text_no[run - 1 :] == text_no[: len(text_no) - run + 1]))
    return ids[at[:, None] + np.arange(run)[None, :]], text_no[at]


def _item_blocks(items: DataFrame, max_chars: int) -> Iterator[DataFrame]:
    """The item words in blocks of about ``max_chars`` characters of text at most."""
    n = -(-(items.agg(F.sum(F.length("words"))).first()[0] or 0) // max_chars)  # a word and its sign take eight characters or more on average
    for b in range(n):
        yield items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)


def _corpus(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, rank: int, width: int):
    """The words of documents and of items as written tables, and the latent table; None if either side has no words."""
    item_words = written(tokens(items, item_key, item_text).distinct())
    known = _known(item_words)
    if not known.any():
        return None
    words = written(tokens(docs, doc_key, doc_text))
    return words, item_words, *latent_table(words, known, rank, width)


def _vocabulary(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block of items in order, the place of each word in them, and the number of its item."""
    h, item_no = _unpack(block)
    vocab, ids = np.unique(h, return_inverse=True)
    return vocab, ids.astype(np.int32), item_no


def _places(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """The place of each word in the vocabulary, -1 for others."""
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    return np.where(vocab[at] == h, at, -1).astype(np.int32)


def _union(parts: list[DataFrame], docs: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_runs(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, *, run: int = 8, rank: int = 32, cosine: float = 0.999, max_chars: int = 4_000_000
) -> DataFrame:
    """(doc_id, item_id): the document and the item share at least ``run`` consecutive words."""
    parts = []
    made = _corpus(docs, doc_key, doc_text, items, item_key, item_text, rank, run)
    if made is not None:
        words, item_words, table, _ = made
        for part in _item_blocks(item_words, max_chars):
            block = part.toPandas().sort_values("id", ignore_index=True)  # bounded by max_chars
            vocab, ids, item_no = _vocabulary(block)
            windows, item_no = _windows(ids, item_no, run)
            if not len(windows):
                continue
            distinct, which = np.unique(windows, axis=0, return_inverse=True)
            holders = np.unique(np.stack((which.ravel(), item_no), 1), axis=0)
            of_word = table[_feature(vocab)]
            given = docs.sparkSession.sparkContext.broadcast((vocab, distinct, holders, block["id"].to_numpy(), of_word, LatentIndex(_vectors(distinct, of_word))))

            def search(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
                vocab, distinct, holders, item_ids, of_word, index = given.value
                for batch in batches:
                    if not len(batch):
                        continue
                    h, doc_no = _unpack(batch)
                    doc_windows, doc_no = _windows(_places(h, vocab), doc_no, run)
                    pairs = set()
                    for s in range(0, len(doc_windows), 65536):
                        q = doc_windows[s : s + 65536]
                        i, j, _ = index.search(_vectors(q, of_word), cosine)
                        same = (q[i] == distinct[j]).all(1)
                        i, j = i[same], j[same]
                        lo, hi = np.searchsorted(holders[:, 0], j), np.searchsorted(holders[:, 0], j, side="right")
                        rows = np.repeat(np.arange(len(j)), hi - lo)
                        at = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[rows]
                        found = np.unique(np.stack((doc_no[s + i[rows]], holders[at, 1]), 1), axis=0)
                        pairs.update(map(tuple, found.tolist()))
                    out = np.array(sorted(pairs), np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"doc_id": batch["id"].to_numpy()[out[:, 0]], "item_id": item_ids[out[:, 1]]})

            parts.append(words.mapInPandas(search, "doc_id long, item_id long"))
    return _union(parts, docs, "doc_id long, item_id long").distinct()


def _passages(ids: np.ndarray, text_no: np.ndarray, width: int, stride: int, nothing: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping passages of up to ``width`` words; the last of a text reaches its end. Padded words are ``nothing``."""
    if not len(ids):
        return np.empty((0, width), np.int64), np.empty(0, np.int64)
    n_texts = int(text_no[-1]) + 1
    first = np.searchsorted(text_no, np.arange(n_texts + 1))
    length = np.diff(first)
    count = np.where(length > 0, np.maximum(1, -(-(length - width) // stride) + 1), 0)
    owner = np.repeat(np.arange(n_texts), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return _from(ids, first, owner, first[owner] + step * stride, width, nothing), owner


def _from(ids: np.ndarray, first: np.ndarray, owner: np.ndarray, start: np.ndarray, width: int, nothing: int) -> np.ndarray:
    """The passages of ``width`` words from given places; unknown words and those of the next text are ``nothing``."""
    at = start[:, None] + np.arange(width)[None, :]
    ok = at < first[owner + 1][:, None]
    got = ids[np.minimum(at, len(ids) - 1)]
    return np.where(ok & (got >= 0), got, nothing)


def _answer_lists(rarest: np.ndarray, size: int, nothing: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages by rare word: where the list of each word begins, and passage numbers."""
    passage = np.repeat(np.arange(len(rarest)), rarest.shape[1])
    word = rarest.ravel()
    passage, word = passage[word != nothing], word[word != nothing]
    by = np.argsort(word, kind="stable")
    return np.searchsorted(word[by], np.arange(size + 1)), passage[by]


def _answer_windows(ids: np.ndarray, doc_no: np.ndarray, lists: tuple[np.ndarray, np.ndarray], need: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, passage): document passages of ``width`` words that begin from first to last hold as many different rare words
    of the item passage as it ``need``s, one or two."""
    begin, of = lists
    known = np.flatnonzero(ids >= 0)
    n = begin[ids[known] + 1] - begin[ids[known]]
    at = np.repeat(known, n)
    passage = of[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[ids[known]], n)]
    # a window with two different words holds two neighbours in the passage's list of places that differ
    by = np.lexsort((at, passage))
    at, passage = at[by], passage[by]
    one = need[passage] <= 1
    a, b, p = at[:-1], at[1:], passage[:-1]
    two = (p == passage[1:]) & (doc_no[a] == doc_no[b]) & (b - a < width) & (ids[a] != ids[b]) & (need[p] > 1)
    first = np.concatenate((at[one] - width + 1, b[two] - width + 1))
    return first, np.concatenate((at[one], a[two])), np.concatenate((passage[one], p[two]))


def lcs_lengths(a: np.ndarray, b: np.ndarray, nothing: int) -> np.ndarray:
    """Longest common subsequences of rows of words, at most 63 each, bit-parallel over all pairs."""
    one, v = np.uint64(1), np.full(len(a), ~np.uint64(0))
    for j in range(b.shape[1]):
        mask = np.zeros(len(a), np.uint64)
        for i in range(a.shape[1]):
            mask |= ((a[:, i] == b[:, j]) & (a[:, i] != nothing)).astype(np.uint64) << np.uint64(i)
        u = v & mask
        v = (v + u) | (v - u)
    return sum((((~v) >> np.uint64(i)) & one).astype(np.int64) for i in range(a.shape[1]))


def paraphrases(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str,
    *, width: int = 24, rank: int = 64, cosine: float = 0.5, share: float = 0.6, answers: int = 3, max_chars: int = 4_000_000,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, n_answers): the best passage of a document for an item that passes the checks.

    Document passages begin at every word, item passages at every eighth of ``width`` (and at the end). A passage passes when at least all
    but one of the item passage's ``answers`` rarest words stand in it, its cosine is at least ``cosine``, and its longest common
    subsequence with the item passage covers ``share`` of the item passage's words (four at least).
    """
    schema = "doc_id long, item_id long, cosine double, lcs_share double, n_answers long"
    parts = []
    made = _corpus(docs, doc_key, doc_text, items, item_key, item_text, rank, width)
    for part in _item_blocks(made[1], max_chars) if made is not None else ():
        words, _, table, weight = made
        block = part.toPandas().sort_values("id", ignore_index=True)  # bounded by max_chars
        vocab, ids, item_no = _vocabulary(block)
        nothing = len(vocab)
        heavy = np.append(weight[_feature(vocab)], 0.0)
        passages, item_no = _passages(ids, item_no, width, width // 8, nothing)
        long_enough = (passages != nothing).sum(1) >= 4
        passages, item_no = passages[long_enough], item_no[long_enough]
        rarest = _rarest(passages, heavy, answers, nothing)
        of_word = np.vstack((table[_feature(vocab)], table[-1:]))
        given = docs.sparkSession.sparkContext.broadcast((vocab, passages, item_no, rarest, block["id"].to_numpy(), of_word))

        def search(batches: Iterator[pd.DataFrame], given=given, nothing=nothing) -> Iterator[pd.DataFrame]:
            vocab, passages, item_no, rarest, item_ids, of_word = given.value
            n_words, n_rare = (passages != nothing).sum(1), (rarest != nothing).sum(1)
            need = np.maximum(1, n_rare - 1)
            lists, vectors = _answer_lists(rarest, nothing, nothing), _vectors(passages, of_word)
            for batch in batches:
                if not len(batch):
                    continue
                h, doc_no = _unpack(batch)
                ids, first = _places(h, vocab), np.searchsorted(doc_no, np.arange(len(batch) + 1))
                for lo, hi in _portions(first, 200_000):
                    x, y = first[lo], first[hi]
                    a, b, passage = _answer_windows(ids[x:y], doc_no[x:y], lists, need, width)
                    for start, p in _expanded(np.maximum(a, first[doc_no[b + x]] - x), b, passage, 65536):
                        doc = doc_no[start + x]
                        q = _from(ids, first, doc, start + x, width, nothing)
                        cos = (_vectors(q, of_word) * vectors[p]).sum(1)
                        hit = ((q[:, :, None] == rarest[p][:, None, :]) & (rarest[p][:, None, :] != nothing)).any(1).sum(1)
                        ok = (cos >= cosine) & (hit >= need[p])
                        q, p, doc, cos, hit = q[ok], p[ok], doc[ok], cos[ok], hit[ok]
                        got = lcs_lengths(passages[p], q, nothing) / n_words[p]
                        ok = got >= share
                        yield pd.DataFrame({"doc_id": batch["id"].to_numpy()[doc[ok]], "item_id": item_ids[item_no[p[ok]]], "cosine": cos[ok].astype(float), "lcs_share": got[ok], "n_answers": hit[ok]})

        parts.append(words.mapInPandas(search, schema))
    every = _union(parts, docs, schema)
    best = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "cosine", "n_answers")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.cosine").alias("cosine"), F.col("b.lcs_share").alias("lcs_share"), F.col("b.n_answers").alias("n_answers"))


def _rarest(passages: np.ndarray, heavy: np.ndarray, answers: int, nothing: int) -> np.ndarray:
    """The heaviest different words of each passage, ``nothing`` where it has fewer."""
    rows = np.sort(passages, 1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = nothing
    return np.take_along_axis(rows, np.argsort(-heavy[rows], axis=1, kind="stable")[:, :answers], 1)


def _portions(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Whole documents, as many as have some ``most`` words together."""
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, first[-1], most)), len(first) - 1))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _expanded(a: np.ndarray, b: np.ndarray, passage: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (start, passage) from a to b, in parts of some ``most``."""
    n = np.maximum(b - a + 1, 0)
    upto = np.cumsum(n)
    edges = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(most, upto[-1] if len(n) else 0, most)), [len(n)])))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        m = n[lo:hi]
        start = np.repeat(a[lo:hi], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        if len(start):
            yield start, np.repeat(passage[lo:hi], m)
