"""Evaluation texts leaking into a corpus: SimHash windows, multi-index Hamming blocks, exact check.

Every run of `n` folded words of an item and of a document becomes a 64-bit SimHash. The item
windows are indexed under `blocks` disjoint bit blocks; two fingerprints within `blocks - 1` bits
of each other agree on at least one block, so looking up every block of every document window
finds all item windows in that radius (pigeonhole). Each candidate is then verified by the exact
similarity of the two windows: the weighted Jaccard share of their shingles of `shingle` words, a
shingle weighing log(1 + windows / windows that hold it) over the item windows. A window is
accepted from `similarity` on; n_words counts only words in windows of similarity 1, that is `n`
consecutive equal words, so a leak in the strict sense is a row with n_words > 0.

Scale: documents are never shuffled; each is read whole in one task. The item index is broadcast
only up to `max_windows` windows (8 bytes and 2 ints each); more items are taken in several blocks,
each a pass over the documents.

Defined results
- null, empty and blank texts, and texts or items of fewer than `n` words: no row.
- the same passage several times, repeated rows of a document or item: one row for each pair of ids.
- shingles longer than the window: the window is one shingle.
- words are runs of letters or digits after case folding, decomposition and dropping of marks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.llm.textfold import words
from planloom.session import spread

_PASS_WORDS = 150_000  # words whose bit sums are held at once


class _Vocabulary:
    """64-bit hashes of words, remembered for one batch."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}

    def codes(self, tokens: list[str]) -> np.ndarray:
        of = self.of
        for t in tokens:
            if t not in of:
                of[t] = xxhash.xxh3_64_intdigest(t)
        return np.fromiter((of[t] for t in tokens), dtype=np.uint64, count=len(tokens))


def simhashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The SimHash of each window of n words, given the words' hashes."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(m, dtype=np.uint64)
    for a in range(0, m, _PASS_WORDS):
        part = codes[a : min(a + _PASS_WORDS, m) + n - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        m_part = len(part) - n + 1
        sums = bits[:m_part].astype(np.uint8 if n < 256 else np.uint32)
        for k in range(1, n):
            sums += bits[k : k + m_part]
        high = sums > n // 2
        out[a : a + len(part) - n + 1] = np.packbits(high, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class WindowIndex:
    """Item windows under each bit block of their SimHash."""

    def __init__(self, items: list[tuple[int, str]], n: int, blocks: int, shingle: int) -> None:
        self.n, self.blocks, self.width, self.shingle = n, blocks, 64 // blocks, min(shingle, n)
        vocabulary = _Vocabulary()
        prints, codes, self.item, self.start, self.words = [], [], [], [], []
        for k, (item_id, text) in enumerate(items):
            w = words(text)
            self.words.append(w)
            c = vocabulary.codes(w)
            s = simhashes(c, n)
            prints.append(s)
            codes.append(c)
            self.item += [k] * len(s)
            self.start += range(len(s))
        self.ids = [i for i, _ in items]
        self.windows = len(self.start)
        # how many item windows hold a shingle: those that begin up to n - shingle words before it
        self.held: dict[tuple[str, ...], int] = {}
        for w in self.words:
            last = len(w) - n
            for k in range(len(w) - self.shingle + 1 if last >= 0 else 0):
                t = tuple(w[k : k + self.shingle])
                self.held[t] = self.held.get(t, 0) + min(k, last) - max(0, k - n + self.shingle) + 1
        self.prints = np.concatenate(prints) if prints else np.empty(0, dtype=np.uint64)
        self.item, self.start = np.array(self.item, dtype=np.int32), np.array(self.start, dtype=np.int32)
        self.order, self.values = [], []
        for b in range(blocks):
            v = self.block(self.prints, b)
            o = np.argsort(v, kind="stable").astype(np.int32)
            self.order.append(o)
            self.values.append(v[o])

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def similarity(self, a: list[str], b: list[str]) -> float:
        """The weighted Jaccard share of two windows' shingles; a repeated shingle counts once."""
        if a == b:
            return 1.0
        k = self.shingle
        x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
        weigh = lambda s: sum(math.log(1 + self.windows / self.held.get(t, 1)) for t in s)
        return weigh(x & y) / weigh(x | y)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in prints, item window) within `blocks - 1` bits."""
        left, right = [], []
        for b in range(self.blocks):
            v = self.block(prints, b)
            lo = np.searchsorted(self.values[b], v, "left")
            k = np.searchsorted(self.values[b], v, "right") - lo
            at = np.flatnonzero(k)
            for a in range(0, len(at), 200_000):
                part = at[a : a + 200_000]
                kk = k[part]
                i = np.repeat(part, kk)
                inner = np.arange(len(i)) - np.repeat(np.cumsum(kk) - kk, kk)
                j = self.order[b][np.repeat(lo[part], kk) + inner]
                near = np.bitwise_count(prints[i] ^ self.prints[j]) < self.blocks
                left.append(i[near])
                right.append(j[near])
        if not left:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        return np.concatenate(left), np.concatenate(right)


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    n: int = 12, blocks: int = 3, max_windows: int = 200_000, shingle: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """One row (doc_id, item_id, n_words, similarity) per document and item with a window of that similarity;
    n_words counts the item's words that stand in shared runs of n words, 0 where windows are only similar."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= 2 * n - 1)
    docs = spread(docs)
    its = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", its.schema["item_id"].dataType), T.StructField("n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    # The items are the stated query set: taken in blocks of bounded size, against all documents.
    blocks_of_items: list[list[tuple[int, str]]] = [[]]
    held = 0
    for r in its.orderBy("item_id", "text").toLocalIterator():
        size = max(1, len(r.text) // 2)
        if held + size > max_windows * 3 and blocks_of_items[-1]:
            blocks_of_items.append([])
            held = 0
        blocks_of_items[-1].append((r.item_id, r.text))
        held += size
    spark = documents.sparkSession
    passes = [docs.mapInPandas(_search(spark.sparkContext.broadcast(WindowIndex(b, n, blocks, shingle)), n, similarity), schema) for b in blocks_of_items]
    return reduce(DataFrame.unionByName, passes).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("similarity").alias("similarity"))


def _search(shared, n: int, similarity: float):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for whole in batches:
            for a in range(0, len(whole), 1000):
                yield _leaks_of(index, whole.iloc[a : a + 1000], n, similarity)

    return run


def _leaks_of(index: WindowIndex, batch: pd.DataFrame, n: int, similarity: float) -> pd.DataFrame:
    vocabulary = _Vocabulary()
    texts = [words(t) for t in batch["text"]]
    sizes = np.array([len(t) for t in texts])
    flat = [w for t in texts for w in t]
    prints = simhashes(vocabulary.codes(flat), n)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(prints)]
    inside = np.arange(len(prints)) + n <= (first + sizes)[owner]
    at = np.flatnonzero(inside)
    i, j = index.candidates(prints[at])
    i = at[i]
    held: dict[tuple[int, int], set[int]] = {}
    best: dict[tuple[int, int], float] = {}
    for p, w in dict.fromkeys(zip(i.tolist(), j.tolist())):
        k, s = int(index.item[w]), int(index.start[w])
        pair = (int(owner[p]), k)
        here, there = flat[p : p + n], index.words[k][s : s + n]
        if here == there:
            best[pair] = 1.0
            held.setdefault(pair, set()).update(range(s, s + n))
        elif (alike := index.similarity(here, there)) >= similarity:
            best[pair] = max(best.get(pair, 0.0), alike)
            held.setdefault(pair, set())
    ids = batch["doc_id"].tolist()
    return pd.DataFrame({
        "doc_id": [ids[d] for d, _ in held], "item_id": [index.ids[k] for _, k in held], "n_words": np.array([len(v) for v in held.values()], dtype="int32"), "similarity": np.array([best[k] for k in held], dtype=float),
    })
