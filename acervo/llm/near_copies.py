"""Near-copies: documents whose sets of five-word sequences have a Jaccard similarity above a threshold, exactly.

The parts of a document (block rows) are range-partitioned by document and order, so that a document of any size is
spread over tasks; a task turns its run of each document into sequences, and the sequences across task borders are
made from the few words that each run leaves at its ends. Equal sets become one class. Classes meet in the regions of
their rarest sequences: two sets of similarity t share SHARED of the first n - ceil(t n) + SHARED sequences of any common
order, here the order of rising frequency by counters in SLOTS slots, counted over all documents. Pairs of similar
size that do share as many are verified on the whole sets, so no pair is lost and none is wrong. A region that more
than CROWD sets share is divided: there, sets meet only where they share two such sequences.

Pivots with Voronoi regions and triangle windows cannot give this result here: sets of five-word sequences of unrelated
documents lie at a distance near 1 from each other and from every pivot, so the windows hold nearly all pivots (the
README has the measured figures). The rarest sequences take the place of the pivots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.pairs import pair_blocks
from acervo.operators.graph import connected_components
from acervo.session import cut

SLOTS = 1 << 16
SHARED = 4
CROWD = 1000
_WORD = re.compile(r"\w+")
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0xD6E8FEB86659FD93)]


class WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """48-bit hashes of the n-word sequences of word hashes; a shorter text has none."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(words) - n + 1 + i]) * _ODD[i % len(_ODD)]
        out ^= out >> np.uint64(29 + i % 3)
    return out >> np.uint64(16)


def pack(values: np.ndarray) -> bytes:
    """Sorted 48-bit hashes in six bytes each."""
    return values.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def sequence_sets(parts: DataFrame, n: int) -> DataFrame:
    """(doc, size, hashes): the distinct n-word sequences of each document, as sorted hashes in one binary value.

    `parts` has doc (long), part_no, part_id and text. Parts of equal number and id are one part; their texts are
    joined by line ends. A document of fewer than n words has no sequence and no row.
    """
    ordered = parts.where("doc IS NOT NULL").repartitionByRange(F.col("doc"), F.col("part_no")).sortWithinPartitions("doc", "part_no", "part_id")

    def run_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task = WordHashes(), TaskContext.get().partitionId()
        rows: list[tuple] = []
        doc, words, last, first_run = None, [], None, True

        def close(at_end: bool) -> None:
            nonlocal words
            if doc is None:
                return
            w = np.fromiter((x for part in words for x in part), dtype=np.uint64)
            found = np.unique(sequence_hashes(w, n))
            edge = first_run or at_end
            rows.append((doc, task, edge, len(found), pack(found), len(w), w[: n - 1].tobytes() if edge else b"", w[max(0, len(w) - n + 1) :].tobytes() if edge else b""))

        def flush() -> pa.RecordBatch:
            names = ["doc", "task", "edge", "size", "hashes", "words", "head", "tail"]
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for d, no, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "part_no", "part_id", "text")), strict=True):
                if d != doc:
                    close(False)
                    first_run = doc is None
                    doc, words, last = d, [], None
                if (no, part) != last and text:
                    words.append([hashes[x] for x in _WORD.findall(text.lower())])
                last = (no, part)
            if len(rows) > 256:
                yield flush()
        close(True)
        if rows:
            yield flush()

    runs = cut(
        ordered.select("doc", "part_no", "part_id", "text").mapInArrow(
            run_sets, "doc long, task int, edge boolean, size long, hashes binary, words long, head binary, tail binary"
        )
    )
    split_docs = runs.where("edge").groupBy("doc").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").select("doc")
    whole = runs.join(F.broadcast(split_docs), "doc", "left_anti").select("doc", "size", "hashes").where("size > 0")

    def stitched(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        sets = [unpack(x) for x in group.column("hashes").to_pylist()]
        open_words = np.empty(0, dtype=np.uint64)
        for count, head, tail in zip(*(group.column(c).to_pylist() for c in ("words", "head", "tail")), strict=True):
            h, t = np.frombuffer(head, dtype=np.uint64), np.frombuffer(tail, dtype=np.uint64)
            sets.append(sequence_hashes(np.concatenate([open_words, h]), n))
            open_words = np.concatenate([open_words, h])[-(n - 1) :] if count < n - 1 else t
        found = np.unique(np.concatenate(sets))
        return pa.table({"doc": group.column("doc")[:1], "size": [len(found)], "hashes": pa.array([pack(found)], pa.binary())})

    torn = runs.join(F.broadcast(split_docs), "doc", "left_semi").groupBy("doc").applyInArrow(stitched, "doc long, size long, hashes binary")
    return whole.unionByName(torn.where("size > 0"))


def frequency_slots(sets: DataFrame) -> np.ndarray:
    """How often the sequences of each slot occur in all documents: SLOTS numbers whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            values = unpack(b"".join(batch.column("hashes").to_pylist()))
            total += np.bincount((values >> np.uint64(32)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    out = np.zeros(SLOTS, dtype=np.int64)
    for r in sets.select("hashes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.slot] = r.n
    return out


def prefix_postings(sets: DataFrame, threshold: float, slots: np.ndarray) -> DataFrame:
    """(token, node, size): the rarest sequences of each set, as many as hold SHARED that a partner of the threshold has too. One row for each set of a task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for node, blob in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                values = unpack(blob)
                size = len(values)
                keep = min(size, size - int(np.ceil(threshold * size - 1e-9)) + SHARED)
                order = np.lexsort((values, slots[(values >> np.uint64(32)).astype(np.int64)]))[:keep]
                tokens.append(values[order])
                nodes.append(np.full(keep, node))
                sizes.append(np.full(keep, size, dtype=np.int32))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["token", "node", "size"])

    return sets.select("node", "hashes").mapInArrow(emit, "token long, node long, size int").repartition("token").distinct()


def _only_wanted(sets: DataFrame, wanted: DataFrame, bits: int = 20) -> DataFrame:
    """Sets whose node may be wanted, by a map of 2^bits bits: it spares the shuffle of sets that no pair asks for."""
    slot = F.expr(f"node & {(1 << bits) - 1}")
    words = wanted.select(F.shiftright(slot, 5).alias("word"), F.expr("cast(1 as bigint) << cast(node & 31 as int)").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    map_ = np.zeros(1 << (bits - 5), dtype=np.uint32)
    for r in words.toLocalIterator():
        map_[r.word] = r.bits

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("node").to_numpy() & ((1 << bits) - 1)
            yield batch.filter(pa.array(((map_[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1).astype(bool)))

    return sets.select("node", "hashes").mapInArrow(pick, "node long, hashes binary")


def _meeting(regions: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, shared, smaller): pairs of similar size with the number of regions they share."""
    left, right = (regions.select(key, F.col("node").alias(s), F.col("size").alias(f"size_{s}")) for s in "ab")
    near = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9
    met = left.join(right, key).where((F.col("a") < F.col("b")) & near)
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.least(F.min("size_a"), F.min("size_b")).alias("smaller"))


def candidate_pairs(postings: DataFrame, threshold: float, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs that share as many rarest sequences as a pair of the threshold must."""
    need = F.least(F.lit(SHARED), F.ceil(threshold * F.col("smaller") - 1e-9))
    crowded = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("token")
    if crowded.isEmpty():
        return _meeting(postings, "token", threshold).where(F.col("shared") >= need).select("a", "b")
    loud = postings.join(crowded, "token", "left_semi").groupBy("node", "size").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    counts = loud.select("node", F.size("tokens").alias("n"))
    met = _meeting(postings.join(crowded, "token", "left_anti"), "token", threshold)
    for end in ("a", "b"):
        met = met.join(counts.select(F.col("node").alias(end), F.col("n").alias(f"loud_{end}")), end, "left").na.fill(0, [f"loud_{end}"])
    quiet_pairs = met.where(F.col("shared") + F.least("loud_a", "loud_b") >= need).select("a", "b")
    # Of pairs that share crowded sequences only, both hold two of them (a set of one sequence equals its partner).
    twos = F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.xxhash64(x, y))))
    divided = loud.where(F.size("tokens") >= 2).select("node", "size", F.explode(twos).alias("region"))
    return quiet_pairs.unionByName(_meeting(divided, "region", threshold).select("a", "b")).distinct()


def similar_sets(sets: DataFrame, threshold: float, block_pairs: int = 4000, crowd: int = CROWD) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs of different sets, by node, with at least the threshold."""
    pairs = candidate_pairs(prefix_postings(sets, threshold, frequency_slots(sets)), threshold, crowd)
    placed, wanted = pair_blocks(pairs, block_pairs)
    one = _only_wanted(sets, wanted).dropDuplicates(["node"])
    held = wanted.join(one, "node").select(F.col("block").alias("set_block"), F.col("node").alias("member"), "hashes")

    def verify(pairs_table: pa.Table, sets_table: pa.Table) -> pa.Table:
        own = {k: unpack(v) for k, v in zip(sets_table.column("member").to_pylist(), sets_table.column("hashes").to_pylist(), strict=True)}
        a, b = pairs_table.column("a").to_pylist(), pairs_table.column("b").to_pylist()
        out = []
        for x, y in zip(a, b, strict=True):
            shared = len(np.intersect1d(own[x], own[y], assume_unique=True))
            out.append(shared / (len(own[x]) + len(own[y]) - shared))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(out, pa.float64())})

    checked = placed.groupBy("pair_block").cogroup(held.groupBy("set_block")).applyInArrow(verify, "a long, b long, similarity double")
    return checked.where(F.col("similarity") >= threshold)


def near_copies(parts: DataFrame, threshold: float = 0.8, n: int = 5, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """((doc, class_doc), (a, b, similarity)): classes of equal sets, named by their smallest document, and all linked pairs of classes.

    Defined results: null documents, null or blank texts and documents of fewer than n words have no sequence and
    appear in neither result; repeated parts count once; an empty table gives none.
    """
    sets = sequence_sets(parts, n).withColumn("node", F.xxhash64("hashes"))
    names = sets.groupBy("node").agg(F.min("doc").alias("class_doc"))
    members = sets.select("doc", "node").join(names, "node").select("doc", "class_doc")
    links = cut(similar_sets(sets, threshold, crowd=crowd))
    for end in ("a", "b"):
        links = links.join(names.select(F.col("node").alias(end), F.col("class_doc").alias(f"class_{end}")), end)
    return members, links.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "similarity")


def copy_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class_id, group_id, links): one row for each document: its class of equal texts, its connected group, and how many other documents it is linked to."""
    links = cut(links)
    sizes = members.groupBy("class_doc").agg(F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("class_doc"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_doc"), F.col("a").alias("other")))).alias("e")).select("e.*")
    linked = ends.join(sizes.withColumnRenamed("class_doc", "other"), "other").groupBy("class_doc").agg(F.sum("copies").alias("elsewhere"))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "class_doc")
    out = members.join(sizes, "class_doc").join(linked, "class_doc", "left").join(groups, "class_doc", "left")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("class_doc").alias("class_id"),
        F.coalesce("component", "class_doc").alias("group_id"),
        (F.col("copies") - 1 + F.coalesce("elsewhere", F.lit(0))).alias("links"),
    )


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): every pair of documents that the classes and their links stand for, smaller id first."""
    a, b = (members.select(F.col("doc").alias(f"doc_{s}"), F.col("class_doc").alias(s)) for s in "ab")
    across = links.select("a", "b").join(a, "a").join(b, "b").select("doc_a", "doc_b")
    within = a.join(b, F.col("a") == F.col("b")).where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within).select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))
