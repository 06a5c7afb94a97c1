"""Evaluation texts inside training texts.

The test items are the indexed side: a BM25 inverted index with block maxima. Every passage of every training text is
a query, answered by block-max WAND; weights are divided by the item's own threshold, the least score that any n-word
window of the item reaches with its distinct words, so an item that shares n consecutive words with the passage
always scores at least 1 and retrieval loses nothing. What is retrieved is verified on the words themselves.

The workers build the index in shards of about `shard_words` item words, which bounds what a worker or the driver holds
of it at a time; more items make more shards, each queried by all passages. The items have one text each, no question
and answer apart, so what is verified is the run of n words.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.session import cut

_WORD = re.compile(r"[^\W_]+")
BLOCK = 16


class _Marks(dict):
    """str.translate table that deletes combining marks."""

    def __missing__(self, at: int) -> int | None:
        self[at] = kept = None if unicodedata.combining(chr(at)) else at
        return kept


_MARKS = _Marks()


def plain_words(text: str) -> list[str]:
    """Runs of letters or digits after lower-casing and removing accents."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_MARKS)
    return _WORD.findall(text)


class WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs of word hashes, in order; a shorter text has none."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of each span, one span after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Index:
    """BM25 postings of items by term, with the maxima of blocks of BLOCK items; weights in units of each item's threshold.

    Terms are hashed sequences of `term` words: n words in a row hold n - term + 1 of them, so thresholds stay exact, and they
    are in far fewer items than words are. Two sequences of one hash only add candidates.
    """

    def __init__(self, items: list[tuple[int, list[str]]], n: int, term: int = 4, k1: float = 1.2, b: float = 0.75):
        self.term, self.n = min(term, n), n
        hashes = WordHashes()
        whole = [(i, w, np.array([hashes[x] for x in w], dtype=np.uint64)) for i, w in items if len(w) >= n]
        terms = [runs_of(h, self.term).tolist() for *_, h in whole]
        self.ids = [i for i, *_ in whole]
        documents = Counter(t for found in terms for t in set(found))
        mean = sum(map(len, terms)) / max(1, len(terms))
        idf = {t: log(1 + (len(terms) - d + 0.5) / (d + 0.5)) for t, d in documents.items()}
        lines: list[tuple[int, int, float]] = []
        self.runs: list[frozenset] = []
        self.hashed: list[np.ndarray] = []
        for place, (found, (_, plain, _)) in enumerate(zip(terms, whole, strict=True)):
            norm = k1 * (1 - b + b * len(found) / mean)
            score = {t: idf[t] * f * (k1 + 1) / (f + norm) for t, f in Counter(found).items()}
            windows = [found[i : i + n - self.term + 1] for i in range(len(plain) - n + 1)]
            least = min(sum(score[t] for t in set(w)) for w in windows) * (1 - 1e-9)
            self.runs.append(frozenset(" ".join(plain[i : i + n]) for i in range(len(plain) - n + 1)))
            self.hashed.append(np.unique(runs_of(whole[place][2], n)))
            lines += [(t, place, s / least) for t, s in score.items()]
        lines.sort()
        terms_of = np.array([t for t, *_ in lines], dtype=np.uint64)
        self.places, self.weights = np.array([p for _, p, _ in lines], dtype=np.int64), np.array([w for *_, w in lines])
        self.known, self.first, self.count = np.unique(terms_of, return_index=True, return_counts=True)
        # Of each term, the blocks that it is in and its largest weight there.
        block = self.places // BLOCK
        edge = np.ones(len(lines), dtype=bool)
        edge[1:] = (terms_of[1:] != terms_of[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(edge)
        self.blocks, self.most = block[starts], np.maximum.reduceat(self.weights, starts) if len(starts) else np.zeros(0)
        _, self.block_first, self.block_count = np.unique(terms_of[starts], return_index=True, return_counts=True)

    @classmethod
    def of(cls, blob: bytes) -> Index:
        index = cls.__new__(cls)
        vars(index).update(pickle.loads(blob))
        return index

    def retrieve(self, terms: np.ndarray) -> list[int]:
        """All item places that score at least 1 for distinct known terms, given by their position in `known`.

        Block-max WAND, a block at a time: only blocks in which the terms' block maxima can add up to the threshold
        are scored, and in them only items that these terms hold.
        """
        at = _spans(self.block_first[terms], self.block_count[terms])
        bound = np.bincount(self.blocks[at], weights=self.most[at])
        open_blocks = bound >= 1
        if not open_blocks.any():
            return []
        at = _spans(self.first[terms], self.count[terms])
        at = at[open_blocks[self.places[at] // BLOCK]]
        return np.flatnonzero(np.bincount(self.places[at], weights=self.weights[at]) >= 1).tolist()

    def leaked(self, words: list[str], hashes: WordHashes, passage: int) -> dict[int, int]:
        """Item place -> number of its n-word runs found, over all passages of a text."""
        n = self.n
        if len(words) < n or not len(self.known):
            return {}
        own_hashes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        terms = runs_of(own_hashes, self.term)
        number = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        held = self.known[number] == terms
        if not held.any():
            return {}
        out: dict[int, set[str]] = defaultdict(set)
        for start in range(0, len(words) - n + 1, passage):
            size = min(passage + n - 1, len(words) - start)
            own = slice(start, start + size - self.term + 1)
            query = np.unique(number[own][held[own]])
            places = self.retrieve(query) if len(query) else ()
            if places:
                runs = runs_of(own_hashes[start : start + size], n)
                for place in places:
                    mine = self.hashed[place]
                    # Where the hashes meet, the words decide.
                    for i in np.flatnonzero(mine[np.minimum(np.searchsorted(mine, runs), len(mine) - 1)] == runs).tolist():
                        run = " ".join(words[start + i : start + i + n])
                        if run in self.runs[place]:
                            out[place].add(run)
        return {place: len(runs) for place, runs in out.items()}


def item_indexes(items: DataFrame, item_id: str, text: str, n: int, shard_words: int) -> DataFrame:
    """(shard, blob): the indexes of the items, built by the workers; a shard holds about shard_words words."""
    rows = items.where(F.col(f"`{item_id}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    shards = 1 + size // (6 * shard_words)  # a word takes some six characters

    def build(group: pa.Table) -> pa.Table:
        held = sorted((i, plain_words(t)) for i, t in zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True))
        return pa.table({"shard": group.column("shard")[:1], "blob": pa.array([pickle.dumps(vars(Index(held, n)))], pa.binary())})

    return rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, blob binary")


def leaks(documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, n: int = 12, passage: int = 160, shard_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, runs): documents that hold at least n consecutive words of an item, and how many of its n-word runs.

    Defined results: null ids and null or blank texts neither leak nor are leaked; items of fewer than n words have no
    run; repeated rows of one document or item give one row; empty tables give none; texts of any length are read in
    passages that overlap by n - 1 words; other columns of any name are not looked at.
    """
    texts = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{doc_text}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for row in cut(item_indexes(items, item_id, item_text, n, shard_words)).toLocalIterator():
        shared = documents.sparkSession.sparkContext.broadcast(bytes(row.blob))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = Index.of(shared.value), WordHashes()
            for batch in batches:
                rows = [(d, index.ids[p], c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, c in index.leaked(plain_words(t), hashes, passage).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["doc_id", "item_id", "runs"])

        part = texts.mapInArrow(search, "doc_id long, item_id long, runs long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.where("false").selectExpr("doc_id", "doc_id AS item_id", "doc_id AS runs")
    return found.groupBy("doc_id", "item_id").agg(F.max("runs").alias("runs"))
