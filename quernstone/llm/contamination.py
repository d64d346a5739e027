"""Evaluation items in corpus documents: suffix arrays over shards of the corpus, binary-searched by every item suffix.

A shard is a bounded number of documents inside one task. Its words become numbers of the items' vocabulary (0 for any other
word and between documents, so that no match spans two), and its suffixes up to the next 0 are sorted by prefix doubling. Every
suffix of every item is searched by vectorised binary searches: cut to SHORT and LONG words to find the affected
pairs, whole among the suffixes of an affected document to find the longest verbatim match and all its places there.
Items are broadcast in blocks of at most ITEM_WORDS words; a shard is read and cut into words once and meets all blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import words

LONG, SHORT, SHARE = 12, 5, 0.5
SHARD_DOCUMENTS = 2000
ITEM_WORDS = 2_000_000
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍﻿"))
DIVIDED = re.compile(r"(?<=[^\W\d_])-(?:\r\n|\n|\r)[ \t]*(?=[^\W\d_])")


def normalised_words(text: str | None) -> list[str]:
    """Words after dropping invisible marks, NFKC, and joining words divided at a line end."""
    return words(DIVIDED.sub("", unicodedata.normalize("NFKC", text.translate(INVISIBLE)))) if text else []


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes that begin with a known word, in the order of their words up to the next 0."""
    stops = np.flatnonzero(np.r_[seq, 0] == 0)
    left = stops[np.searchsorted(stops, np.arange(len(seq)))] - np.arange(len(seq))  # words before the next 0
    rank, step, longest = seq.astype(np.int64), 1, int(left.max()) if len(left) else 0
    while step < longest:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        ahead[left <= step] = 0
        rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1].reshape(-1)
        step *= 2
    start = np.flatnonzero(seq)
    return start[np.argsort(rank[start], kind="stable")]


def search(seq: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range [low, high) of each query (a row of words) among the sorted suffixes that start with it."""
    width = queries.shape[1]
    padded = np.r_[seq, np.zeros(width, seq.dtype)]
    found = []
    for upper in (False, True):
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            there = padded[at[:, None] + np.arange(width)]
            differs = there != queries
            first = differs.argmax(1)
            rows = np.arange(len(queries))
            equal = ~differs[rows, first]
            less = np.where(equal, upper, there[rows, first] < queries[rows, first])
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        found.append(low)
    return found[0], found[1]


class Items:
    """The items' words as numbers, their runs of SHORT words, and their runs of LONG words (or the whole item, if shorter)."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.ids = [i for i, ws in items if ws]
        lists = [ws for _, ws in items if ws]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for ws in lists for w in ws), 1)}
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in lists]
        self.short = self._runs(SHORT, [n for n, ws in enumerate(self.words) if len(ws) >= SHORT], SHORT)
        self.need = np.array([len({tuple(ws[k : k + SHORT]) for k in range(len(ws) - SHORT + 1)}) for ws in self.words])
        self.whole = [self._runs(size, [n for n, ws in enumerate(self.words) if (len(ws) == size if size < LONG else len(ws) >= LONG)], size) for size in range(1, LONG + 1)]

    def _runs(self, size: int, which: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct runs, and for each the items that hold it as a CSR pair)."""
        owners = np.concatenate([np.full(len(self.words[n]) - size + 1, n) for n in which]) if which else np.empty(0, np.int64)
        if not which:
            return np.empty((0, width), np.int32), np.zeros(1, np.int64), owners.astype(np.int64)
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(self.words[n], size) for n in which])
        runs, inverse = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.c_[inverse.reshape(-1), owners], axis=0)
        return runs, np.searchsorted(pairs[:, 0], np.arange(len(runs) + 1)), pairs[:, 1]


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())


def _pairs(seq: np.ndarray, order: np.ndarray, owner: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """(document * n_items + item, number of the item's distinct runs that the document holds) over one shard."""
    queries, starts, items = runs
    if not len(queries) or not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = search(seq, order, queries)
    hit = np.flatnonzero(high > low)
    spans = high[hit] - low[hit]
    docs = owner[order[_expand(low[hit], spans)]]
    seen = np.unique(np.c_[docs, np.repeat(hit, spans)], axis=0)  # each run once per document
    counts = starts[seen[:, 1] + 1] - starts[seen[:, 1]]
    which = items[_expand(starts[seen[:, 1]], counts)]
    return np.unique(np.repeat(seen[:, 0], counts) * n_items + which, return_counts=True)


def longest(seq: np.ndarray, order: np.ndarray, item: np.ndarray, block: int = 512) -> tuple[int, list[int]]:
    """(length, all places in seq) of the longest run of words that the item shares with the suffixes in `order`; the item's first run of several.

    A suffix of the item shares most with one of its two neighbours in the sorted order.
    """
    best, which = 0, 0
    for at in range(0, len(item), block):
        width = len(item) - at
        rows = np.arange(at, min(len(item), at + block))
        queries = np.r_[item, np.full(width, -1, item.dtype)][rows[:, None] + np.arange(width)]
        low, _ = search(seq, order, queries)
        padded = np.r_[seq, np.zeros(width, seq.dtype)]
        for near in (low - 1, low):
            inside = (near >= 0) & (near < len(order))
            there = padded[order[np.clip(near, 0, len(order) - 1)][:, None] + np.arange(width)]
            length = np.where(inside, (np.cumsum(there != queries, 1) == 0).sum(1), 0)
            k = int(length.argmax())
            if length[k] > best:
                best, which = int(length[k]), at + k
    if not best:
        return 0, []
    low, high = search(seq, order, item[None, which : which + best])
    return best, sorted(order[low[0] : high[0]].tolist())


def shard_matches(docs: list[list[str]], items: Items) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(document, item, distinct short runs shared, longest match, its places) of the affected pairs in one shard."""
    known = items.vocabulary.get
    arrays = [np.array([known(w, 0) for w in ws] + [0], np.int32) for ws in docs]
    if not arrays or not items.ids:
        return
    seq = np.concatenate(arrays)
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    first = np.cumsum([0, *map(len, arrays)])
    order = suffix_array(seq)
    n = len(items.ids)
    near, shared = _pairs(seq, order, owner, items.short, n)
    enough = shared >= np.maximum(items.need[near % n], 1) * SHARE if len(near) else np.zeros(0, bool)
    pairs = set(near[enough].tolist())
    for runs in items.whole:
        pairs.update(_pairs(seq, order, owner, runs, n)[0].tolist())
    count = dict(zip(near.tolist(), shared.tolist()))
    place = owner[order]
    by_document = order[np.argsort(place, kind="stable")]  # each document's suffixes, still in their order
    bounds = np.searchsorted(np.sort(place), np.arange(len(arrays) + 1))
    for p in sorted(pairs):
        d = p // n
        size, at = longest(seq, by_document[bounds[d] : bounds[d + 1]], items.words[p % n])
        yield d, p % n, count.get(p, 0), size, [x - int(first[d]) for x in at]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "item_text", item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, shared_runs, longest, places): every document with every item it leaks.

    A pair counts if min(LONG, words of the item) consecutive words of the item occur consecutively in the document, or at
    least SHARE of its distinct runs of SHORT words do. longest: words of the longest verbatim match; places: where it begins in
    the document, in words from 0. Items or documents without words, or null, match nothing; repeated rows under one id count
    as one text each, and a pair is reported once. Columns other than ids and texts are not read.
    """
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t"))
    source = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).cast("string").alias("t"))
    spark = docs.sparkSession
    total = wanted.select(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = 1 + total // (2 * item_words)  # a word and its separator are two characters at least
    shared = []
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else wanted
        shared.append(spark.sparkContext.broadcast(Items([(i, normalised_words(t)) for i, t in sorted(map(tuple, block.collect()))])))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, SHARD_DOCUMENTS):
                ids = batch.column(0).slice(at, SHARD_DOCUMENTS).to_pylist()
                texts = [normalised_words(t) for t in batch.column(1).slice(at, SHARD_DOCUMENTS).to_pylist()]
                for items in (s.value for s in shared):
                    rows = [(ids[d], items.ids[i], *rest) for d, i, *rest in shard_matches(texts, items)]
                    cols = list(zip(*rows)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "shared_runs", "longest", "places"])

    found = source.mapInArrow(batches, "doc_id bigint, item_id bigint, shared_runs int, longest int, places array<int>")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("longest", "shared_runs", "places")).alias("m"))
    return best.select("doc_id", "item_id", "m.shared_runs", "m.longest", "m.places")


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that leak no item, whole and in their own columns."""
    return docs.join(found.select(F.col("doc_id").alias("_leaking")).distinct(), docs[doc_id] == F.col("_leaking"), "left_anti")
