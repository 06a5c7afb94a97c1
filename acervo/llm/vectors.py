"""Most similar vectors for every vector: multiprobe p-stable hashing with exact reranking.

Vectors of one dimension are scaled to unit length and projected on Gaussian directions (2-stable for the Euclidean
distance, which on unit vectors orders as cosine does). A table's bucket is the tuple of floor((a.x + b) / width).
A vector is indexed in its own bucket of each table and queries that bucket and the `probes` perturbed buckets that
are likeliest to hold its neighbours: perturbation sets of one or two coordinates, ordered by the summed squared
distances to the crossed bucket borders. Within a bucket, codes (rotated, in 5-bit steps, with their error) bound each cosine from both
sides: what can be among a query's k best goes on. Where that is more than `keep`, the query is decided by the exact
cosines of the bucket. Survivors of all tables are merged and reranked by their exact cosine.

Equal vectors are one node; of each node the k + 1 smallest ids are kept, which decides every list exactly. A bucket
that holds more than `cap` nodes is dealt into blocks of about `cap`, as are its queries, and each
block of queries meets each block of nodes, so that `cap` limits the memory of a meeting only. Bucket sizes are known from counters
in SLOTS slots, so what the driver and the workers hold of them is bounded by SLOTS, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.pairs import pair_blocks
from acervo.session import cut

SLOTS = 1 << 18
#: Bits of a step of a code, and the largest step.
BITS, HALF = 5, 15


@dataclass(frozen=True)
class Plan:
    """Parameters of the index; `hashes` follows from the number of nodes."""

    hashes: int = 6
    tables: int = 3
    probes: int = 4
    width: float = 2.0
    cap: int = 4096
    keep: int = 16
    seed: int = 20240117


def hashes_for(nodes: int, bucket: int = 1024, far: float = 0.486) -> int:
    """Hash functions that leave about `bucket` unrelated vectors together; `far` is the chance that two orthogonal unit vectors agree in one."""
    return int(np.clip(np.round(np.log(max(nodes, bucket) / bucket) / -np.log(far)), 3, 24))


_FAMILIES: dict[tuple[Plan, int], dict] = {}


def _family(plan: Plan, dimension: int) -> dict:
    """The hash functions of a dimension, made once in each process."""
    if (plan, dimension) not in _FAMILIES:
        if len(_FAMILIES) > 64:
            _FAMILIES.clear()
        _FAMILIES[plan, dimension] = _new_family(plan, dimension)
    return _FAMILIES[plan, dimension]


def _new_family(plan: Plan, dimension: int) -> dict:
    rng = np.random.default_rng([plan.seed, dimension])
    singles = [((i, d),) for i in range(plan.hashes) for d in (-1, 1)]
    doubles = [(x[0], y[0]) for x, y in combinations(singles, 2) if x[0][0] != y[0][0]]
    sets = singles + doubles
    member = np.zeros((len(sets), 2 * plan.hashes), dtype=np.float32)
    for row, chosen in enumerate(sets):
        for i, d in chosen:
            member[row, 2 * i + (d > 0)] = 1
    return {
        "a": rng.standard_normal((plan.tables, dimension, plan.hashes)).astype(np.float32),
        "b": rng.random((plan.tables, plan.hashes)).astype(np.float32),
        "mix": rng.integers(1, 1 << 63, size=(plan.tables, plan.hashes), dtype=np.int64).view(np.uint64) | np.uint64(1),
        "salt": rng.integers(1, 1 << 63, size=plan.tables, dtype=np.int64).view(np.uint64),
        "sets": member,
        "code": np.linalg.qr(rng.standard_normal((dimension, dimension)))[0].astype(np.float32),
    }


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(46)).astype(np.int64)


def _sums(plan: Plan, dimension: int, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one table: the sums of the bucket numbers and the border distances."""
    family = _family(plan, dimension)
    at = (x @ family["a"][table]) / np.float32(plan.width) + family["b"][table]
    floor = np.floor(at)
    borders = np.empty((len(x), 2 * plan.hashes), dtype=np.float32)
    borders[:, 0::2], borders[:, 1::2] = at - floor, 1 - (at - floor)
    return (floor.astype(np.int64).view(np.uint64) * family["mix"][table]).sum(axis=1, dtype=np.uint64), borders


def _keys(plan: Plan, dimension: int, sums: np.ndarray, table: int) -> np.ndarray:
    return _scramble(sums + _family(plan, dimension)["salt"][table])


def _meetings(bucket: np.ndarray, blocks: np.ndarray, nodes: np.ndarray, indexed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """(rows, places, indexed, asks): a block of a divided bucket's nodes meets each block of its queries, a bucket of one block is one place."""
    whole = np.flatnonzero(blocks == 1)
    yield whole, bucket[whole], indexed, True
    split = np.flatnonzero(blocks > 1)
    own = _scramble(nodes.view(np.uint64)) % blocks.astype(np.uint64)
    for other in range(int(blocks[split].max(initial=0))):
        rows = split[blocks[split] > other]
        n, mine, step = blocks[rows].astype(np.uint64), own[rows], np.uint64(other)
        yield rows, _scramble(bucket[rows] + step * n + mine + np.uint64(1)), False, True
        if indexed:
            yield rows, _scramble(bucket[rows] + mine * n + step + np.uint64(1)), True, False


def _packed(steps: np.ndarray) -> np.ndarray:
    """Numbers below 2^BITS, eight of them in BITS bytes."""
    eights = steps.reshape(len(steps), -1, 8).astype(np.uint64) << (np.uint64(BITS) * np.arange(8, dtype=np.uint64))
    return np.ascontiguousarray(eights.sum(axis=2, dtype=np.uint64)).view(np.uint8).reshape(len(steps), -1, 8)[:, :, :BITS].reshape(len(steps), -1)


def encode(plan: Plan, dimension: int, x: np.ndarray) -> np.ndarray:
    """Codes of unit vectors: rotated, in steps of BITS bits of the largest element, then one byte for how far the vector lies from what its code stands for."""
    y = x @ _family(plan, dimension)["code"]
    top = np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-30)
    steps = np.full((len(x), -(-dimension // 8) * 8), HALF, dtype=np.uint8)
    steps[:, :dimension] = np.rint(y * (HALF / top)).astype(np.int8) + HALF
    codes = np.zeros((len(x), steps.shape[1] // 8 * BITS + 1), dtype=np.uint8)
    codes[:, :-1] = _packed(steps)
    off = np.linalg.norm(y - decode(codes)[:, :dimension], axis=1) if len(x) else np.zeros(0)
    codes[:, -1] = np.ceil(off * 127 + 1e-3).clip(0, 255)
    return codes


def decode(codes: np.ndarray) -> np.ndarray:
    """Unit vectors that codes of one dimension stand for."""
    if not len(codes):
        return np.empty((0, 1), dtype=np.float32)
    groups = np.zeros((len(codes), (codes.shape[1] - 1) // BITS, 8), dtype=np.uint8)
    groups[:, :, :BITS] = codes[:, :-1].reshape(len(codes), -1, BITS)
    eights = groups.view(np.uint64)[:, :, 0]
    steps = ((eights[:, :, None] >> (np.uint64(BITS) * np.arange(8, dtype=np.uint64))) & np.uint64(2 * HALF + 1)).reshape(len(codes), -1).astype(np.float32) - HALF
    return steps / np.maximum(np.linalg.norm(steps, axis=1, keepdims=True), 1e-30)


def doubt(codes: np.ndarray) -> np.ndarray:
    """How far, at most, a vector lies from what its code stands for: measured when it was made, rounded up."""
    return codes[:, -1].astype(np.float32) / 127 + 1e-5


def _unit(vectors: pa.Array, dimension: int, kind: type = np.float32) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, nodes, unit vectors); of a task's equal vectors the first is kept."""
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        fresh = [i for i, n in enumerate(nodes.tolist()) if not (n in seen or seen.add(n))]
        batch = batch.take(pa.array(fresh, pa.int32()))
        nodes, sizes = batch.column("node").to_numpy(), batch.column("dimension").to_numpy()
        for dimension in np.unique(sizes).tolist():
            mask = sizes == dimension
            yield dimension, nodes[mask], _unit(batch.column("vector").filter(pa.array(mask)), dimension)


def usable_nodes(df: DataFrame, id_col: str, vector: str, dimension: str) -> DataFrame:
    """(id, node, dimension, vector) of usable rows: as many elements as stated, all finite, not all zero. Equal vectors share their node."""
    v = F.col(f"`{vector}`").cast("array<float>")
    size = F.col(f"`{dimension}`").cast("int")
    finite: Column = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= 3.4028235e38))
    picked = df.where(F.col(f"`{id_col}`").isNotNull() & (size > 0) & (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0))
    return picked.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(v).alias("node"), size.alias("dimension"), v.alias("vector"))


def bucket_counts(nodes: DataFrame, plan: Plan) -> np.ndarray:
    """Nodes in each counter slot, over the buckets of all tables; SLOTS numbers whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for dimension, _, x in _by_dimension(batches):
            for table in range(plan.tables):
                keys = _keys(plan, dimension, _sums(plan, dimension, x, table)[0], table)
                total += np.bincount(_slot(keys), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    counted = nodes.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, dtype=np.int64)
    for r in counted.where(F.col("n") > plan.cap).toLocalIterator():
        counts[r.slot] = r.n
    return counts


def candidate_pairs(nodes: DataFrame, plan: Plan, min_cosine: float, k: int = 10) -> DataFrame:
    """(a, b) with a < b: nodes that met in a bucket and of which one can be among the k best of the other there; distinct."""
    counts = bucket_counts(nodes, plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dimension, ids, x in _by_dimension(batches):
            codes = encode(plan, dimension, x)
            sets = _family(plan, dimension)["sets"]
            for table in range(plan.tables):
                first, borders = _sums(plan, dimension, x, table)
                mix = _family(plan, dimension)["mix"][table]
                step = np.empty(2 * plan.hashes, dtype=np.uint64)
                step[0::2], step[1::2] = np.uint64(0) - mix, mix
                cost = (borders**2) @ sets.T
                order = np.argpartition(cost, plan.probes, axis=1)[:, : plan.probes] if plan.probes < cost.shape[1] else np.argsort(cost, axis=1)
                moves = (sets.astype(np.uint64) * step).sum(axis=1, dtype=np.uint64)
                for probe in range(-1, order.shape[1]):
                    at = first if probe < 0 else first + moves[order[:, probe]]
                    bucket = _keys(plan, dimension, at, table)
                    blocks = np.maximum(1, -(-counts[_slot(bucket)] // plan.cap))
                    for rows, keys, indexed, asks in _meetings(bucket, blocks, ids, probe < 0):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys.view(np.int64)),
                                pa.array(ids[rows], pa.int64()),
                                pa.array(np.full(len(rows), indexed)),
                                pa.array(np.full(len(rows), asks)),
                                pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(codes[rows]))]).cast(pa.binary()),
                            ],
                            names=["bucket", "node", "indexed", "asks", "code"],
                        )

    def meet(group: pa.Table) -> pa.Table:
        """Pairs a, b; of a bucket with undecided queries, these as `a` and what they have to be compared with as `b`."""
        ids, own, asks = (group.column(c).to_numpy() for c in ("node", "indexed", "asks"))
        blob = group.column("code").combine_chunks()
        codes = np.frombuffer(b"".join(blob.to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        nodes, first = np.unique(ids, return_index=True)
        x, off = decode(codes[first]), doubt(codes[first])
        held, asks = np.isin(nodes, ids[own]), np.isin(nodes, ids[asks])
        there, index, farthest = nodes[held], x[held], off[held].max(initial=0)
        asking, x, off = nodes[asks], x[asks], off[asks]
        found, open_queries, open_index = [np.empty((0, 2), dtype=np.int64)], [np.empty(0, dtype=np.int64)], np.zeros(len(there), dtype=bool)
        for start in range(0, len(asking), 2048) if len(there) else ():
            some = asking[start : start + 2048]
            bound = off[start : start + 2048]
            bound = bound + farthest * (1 + bound)
            near = x[start : start + 2048] @ index.T
            at = np.minimum(np.searchsorted(there, some), len(there) - 1)
            same = np.flatnonzero(there[at] == some)
            near[same, at[same]] = -4
            least = (min_cosine - bound).astype(near.dtype)
            many = np.flatnonzero(np.count_nonzero(near >= least[:, None], axis=1) > k)
            if len(many):
                kth = np.partition(near[many], -k, axis=1)[:, -k]
                least[many] = np.maximum(least[many], kth - 2 * bound[many])
            hits = near >= least[:, None]
            undecided = np.count_nonzero(hits, axis=1) > max(k, plan.keep)
            if undecided.any():
                open_queries.append(some[undecided])
                open_index |= hits[undecided].any(axis=0)
                hits[undecided] = False
            q, c = np.nonzero(hits)
            found.append(np.stack([np.minimum(some[q], there[c]), np.maximum(some[q], there[c])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        asks, index_ids = np.concatenate(open_queries), there[open_index]
        bucket, none = group.column("bucket")[0].as_py(), lambda n: pa.nulls(n, pa.int64())
        return pa.table(
            {
                "bucket": pa.concat_arrays([none(len(pairs)), pa.array(np.full(len(asks) + len(index_ids), bucket))]),
                "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(asks), none(len(index_ids))]),
                "b": pa.concat_arrays([pa.array(pairs[:, 1]), none(len(asks)), pa.array(index_ids)]),
            }
        )

    placed = nodes.mapInArrow(place, "bucket long, node long, indexed boolean, asks boolean, code binary")
    met = cut(placed.groupBy("bucket").applyInArrow(meet, "bucket long, a long, b long"))
    pairs, undecided = met.where("bucket IS NULL").select("a", "b"), met.where("bucket IS NOT NULL")
    if not undecided.isEmpty():
        pairs = pairs.unionByName(_decided(undecided, nodes, min_cosine, k))
    return pairs.distinct()


def _decided(undecided: DataFrame, nodes: DataFrame, min_cosine: float, k: int) -> DataFrame:
    """(a, b) with a < b: of each query `a` of a bucket, the k best `b` of that bucket by the exact cosine, equal ones included."""

    def decide(group: pa.Table) -> pa.Table:
        asks, ids = group.column("asks").to_numpy(), group.column("node").to_numpy()
        x = _unit(group.column("vector").combine_chunks(), group.column("dimension")[0].as_py(), np.float64)
        there, index, some, queries = ids[~asks], x[~asks], ids[asks], x[asks]
        found = [np.empty((0, 2), dtype=np.int64)]
        for start in range(0, len(some), 1024):
            mine = some[start : start + 1024]
            near = queries[start : start + 1024] @ index.T
            near[mine[:, None] == there[None, :]] = -4
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(mine), -2.0)
            q, c = np.nonzero(near >= np.maximum(least, min_cosine)[:, None] - 1e-12)
            found.append(np.stack([np.minimum(mine[q], there[c]), np.maximum(mine[q], there[c])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sides = undecided.select("bucket", F.coalesce("a", "b").alias("node"), F.col("a").isNotNull().alias("asks"))
    vectors = nodes.select("node", "dimension", "vector").dropDuplicates(["node"])
    return sides.join(vectors, "node").groupBy("bucket").applyInArrow(decide, "a long, b long")


def rerank(pairs: DataFrame, nodes: DataFrame, block_pairs: int = 20_000) -> DataFrame:
    """(a, b, cosine), exact, of candidate pairs."""
    left, wanted = pair_blocks(pairs, block_pairs)
    vectors = wanted.join(nodes.select("node", "dimension", "vector").dropDuplicates(["node"]), "node")

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sizes = right.column("node").to_numpy(), right.column("dimension").to_numpy()
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        out = np.full(len(a), -2.0)
        column = right.column("vector").combine_chunks()
        for dimension in np.unique(sizes).tolist():
            mask = sizes == dimension
            order = np.argsort(ids[mask])
            mine = ids[mask][order]
            x = column.filter(pa.array(mask)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)[order]
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            p, q = np.searchsorted(mine, a), np.searchsorted(mine, b)
            ok = (p < len(mine)) & (q < len(mine))
            ok[ok] = (mine[p[ok]] == a[ok]) & (mine[q[ok]] == b[ok])
            out[ok] = np.einsum("ij,ij->i", x[p[ok]], x[q[ok]])
        return pa.table({"a": a, "b": b, "cosine": out})

    return left.groupBy("pair_block").cogroup(vectors.select(F.col("block").alias("vector_block"), "node", "dimension", "vector").groupBy("vector_block")).applyInArrow(exact, "a long, b long, cosine double").where("cosine > -2")


def most_similar(df: DataFrame, id_col: str, vector: str, dimension: str, k: int = 10, min_cosine: float = 0.9, plan: Plan | None = None) -> DataFrame:
    """(id, neighbour_id, cosine, place): the k most similar rows of equal dimension, of those with at least min_cosine.

    Ties go to the smaller id. Defined results: unusable rows (null, wrong number of elements, not finite, all zero)
    neither ask nor answer; equal vectors are neighbours with cosine 1; a repeated id counts once for each different
    vector it has; an empty table gives none; other columns of any name are not looked at. Pairs of less than
    min_cosine are not searched for; lists may miss a neighbour with the small probability that no table joins them.
    """
    rows = usable_nodes(df, id_col, vector, dimension)
    if plan is None:
        plan = Plan(hashes=hashes_for(rows.count()))
    ids = rows.select("id", "node").distinct()
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("n") <= k + 1)
    members = ranked.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    exact = rerank(candidate_pairs(rows, plan, min_cosine, k), rows).where(F.col("cosine") >= min_cosine)
    edges = exact.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "cosine"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "cosine"))).alias("e")).select("e.*")
    reach = edges.join(members.withColumnRenamed("node", "other"), "other")
    nearest = Window.partitionBy("node").orderBy(F.col("cosine").desc(), F.col("ids")[0])
    reach = reach.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).select("node", "cosine", F.explode("ids").alias("neighbour_id"))
    own = members.where(F.size("ids") > 1).select("node", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour_id"))
    line = Window.partitionBy("node").orderBy(F.col("cosine").desc(), "neighbour_id")
    lists = reach.unionByName(own).withColumn("n", F.row_number().over(line)).where(F.col("n") <= k + 1)
    packed = lists.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour_id", "cosine"))).alias("list"))
    kept = F.slice(F.filter("list", lambda x: x["neighbour_id"] != F.col("id")), 1, k)
    return ids.join(packed, "node").select("id", F.posexplode(kept).alias("place", "x")).select("id", "x.neighbour_id", "x.cosine", (F.col("place") + 1).alias("place"))
