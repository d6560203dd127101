"""The most similar vectors of every vector, by multiprobe p-stable hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

#: Width of a hash slot on unit vectors, and the chance that two orthogonal ones share it.
WIDTH, FAR_CHANCE = 3.0, 0.629
#: Vectors that a bucket should hold; the number of hash functions follows from it and the collection.
BUCKET = 50
#: Perturbed buckets that each table probes besides the vector's own.
PROBES = 8
#: Tables for up to 100,000 vectors; more vectors need more hash functions and so more tables.
TABLES, TABLES_UP_TO = 4, 100_000
#: Rows of a bucket that one task compares with as many others; larger buckets are cut into such tiles.
TILE = 4096
#: Rows that may ask in one task; a bucket asked by more is cut along the asking side, too.
ASKERS = 65_536
#: Rows compared with a tile at a time, which bounds the memory of a task.
QUERY_ROWS = 2048
#: Copies of a vector spread over so many partial lists.
SALT = 16
SEED = 20240229


def plan_size(n: int) -> tuple[int, int]:
    """(hash functions, tables) for a collection of ``n`` vectors."""
    k = max(4, round(math.log(max(n, 1) / BUCKET) / -math.log(FAR_CHANCE))) if n > BUCKET else 4
    tables = TABLES if n <= TABLES_UP_TO else math.ceil(TABLES * (n / TABLES_UP_TO) ** (1 / 3))
    return k, tables


@lru_cache(maxsize=256)
def _functions(table: int, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, k, dims])
    return (
        rng.standard_normal((dims, k)).astype(np.float32),
        rng.uniform(0, WIDTH, k).astype(np.float32),
        rng.integers(1, 2**62, k).astype(np.int64) * 2 + 1,
    )


@lru_cache(maxsize=8)
def _perturbations(m: int) -> list[tuple[int, ...]]:
    return [s for size in (1, 2, 3) for s in combinations(range(m if size < 3 else min(m, 5)), size)]


def hash_buckets(unit: np.ndarray, scope: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """Bucket keys (n, 1 + probes): the own bucket first, then perturbed ones in order of estimated success.

    Moving one slot down costs the square of the distance to the lower border, up to the upper one; the
    cost of a set of moves is the sum, and the sets of least cost are the likeliest to hold a neighbour.
    """
    a, b, mult = _functions(table, k, unit.shape[1])
    at = (unit @ a + b) / np.float32(WIDTH)
    slot = np.floor(at)
    inside = at - slot
    with np.errstate(over="ignore"):
        own = (slot.astype(np.int64) * mult).sum(1) + scope * np.int64(2 * table + 3) + np.int64(table * 1_000_003)
        if not probes:
            return own[:, None]
        cost = np.concatenate([inside**2, (1 - inside) ** 2], axis=1)
        m = min(2 * k, 8)
        order = np.argpartition(cost, m - 1, axis=1)[:, :m] if m < 2 * k else np.tile(np.arange(2 * k), (len(unit), 1))
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(cost, order, 1), 1), 1)
        least = np.take_along_axis(cost, order, 1)
        shift = np.where(order < k, -1, 1) * mult[order % k]
        which = order % k
        sets = _perturbations(m)
        total = np.empty((len(unit), len(sets)), np.float32)
        moved = np.empty((len(unit), len(sets)), np.int64)
        for s, members in enumerate(sets):
            total[:, s] = least[:, list(members)].sum(1)
            moved[:, s] = shift[:, list(members)].sum(1)
            for x, y in combinations(members, 2):
                total[which[:, x] == which[:, y], s] = np.inf
        best = np.argsort(total, axis=1, kind="stable")[:, :probes]
        return np.concatenate([own[:, None], own[:, None] + np.take_along_axis(moved, best, 1)], axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Binary column of little-endian float32 vectors as a matrix."""
    column = column.cast(pa.large_binary())
    flat = np.frombuffer(column.buffers()[2], np.float32) if len(column) else np.empty(0, np.float32)
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset] // 4 if len(column) else 0
    return flat[first : first + len(column) * dims].reshape(len(column), dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(rows: DataFrame, key: str, vector: str, scope: str, dims: int) -> DataFrame:
    """(id, scope, vec): vectors with ``dims`` finite values, not all zero, and a non-null scope.

    ``vec`` is the little-endian float32 image, so equal vectors are equal bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(len(lists), dims)
            with np.errstate(over="ignore", invalid="ignore"):
                squares = (values.astype(np.float64) ** 2).sum(1)
            good = np.isfinite(squares) & (squares > 0)
            values = np.ascontiguousarray(values[good]) + np.float32(0)
            image = pa.array([r.tobytes() for r in values], pa.binary())
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask), image], ["id", "scope", "vec"]
            )

    return (
        rows.where((F.size(vector) == dims) & F.col(scope).isNotNull() & ~F.exists(vector, lambda v: v.isNull()))
        .select(F.col(key).cast("long").alias("id"), F.xxhash64(scope).alias("scope"), vector)
        .mapInArrow(run, "id bigint, scope bigint, vec binary")
    )


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """(rep, scope, vec, ids, n): each distinct vector with the ``keep`` smallest of its ids.

    Every batch of rows first keeps that many ids of each of its vectors, so of any number of copies only a
    few per batch are ever gathered.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[int, bytes], list[int]] = {}
            for i, scope, vec in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault((scope, vec), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in held], pa.int64()),
                    pa.array([k[1] for k in held], pa.binary()),
                    pa.array([sorted(own)[:keep] for own in held.values()], pa.list_(pa.int64())),
                    pa.array([len(own) for own in held.values()], pa.int64()),
                ],
                ["scope", "vec", "ids", "n"],
            )

    least = lambda: F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")
    return (
        vectors.mapInArrow(combine, "scope bigint, vec binary, ids array<bigint>, n bigint")
        .groupBy("scope", "vec", F.pmod(F.col("ids")[0], F.lit(SALT)).alias("_salt"))
        .agg(least(), F.sum("n").alias("n"))
        .groupBy("scope", "vec")
        .agg(least(), F.sum("n").alias("n"))
        .withColumn("rep", F.col("ids")[0])
    )


def sketch(unit: np.ndarray) -> np.ndarray:
    """One signed byte per coordinate, the largest of a vector at 127."""
    return np.round(unit * (127.0 / np.abs(unit).max(1, keepdims=True))).astype(np.int8)


def _compare(own: np.ndarray, rep: np.ndarray, marks: np.ndarray, at_least: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (q, i) of rows of one bucket that may be among the ``keep`` best of either.

    A byte is off by half a step at most, so a sketch of length L is turned by at most sqrt(dims) / 2L from its vector
    and a cosine of two sketches is off by no more than the sum of both: nothing that could count is left out.
    """
    index = np.flatnonzero(own)
    if not len(index):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    length = np.linalg.norm(marks.astype(np.float32), axis=1)
    unit = marks.astype(np.float32) / length[:, None]
    off = np.float32(1.02 * 0.5 * math.sqrt(marks.shape[1])) / length
    right_side, right_off = unit[index].T, off[index]
    found = []
    for lo in range(0, len(own), QUERY_ROWS):
        query = slice(lo, lo + QUERY_ROWS)
        cosine = unit[query] @ right_side
        cosine[rep[query][:, None] == rep[index][None, :]] = -2
        x, y = np.nonzero(cosine + off[query][:, None] + right_off[None, :] >= np.float32(at_least - 1e-4))
        found.append((x + lo, index[y], cosine[x, y], off[x + lo] + right_off[y]))
    a, b, cosine, slack = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(a):
        return a, b
    kept = np.zeros(len(a), bool)
    for left in (a, b):
        # Beyond the keep-th surely reached cosine of its row no pair can count.
        order = np.lexsort((-(cosine - slack), left))
        l = left[order]
        start = np.r_[0, np.flatnonzero(np.diff(l)) + 1]
        size = np.diff(np.r_[start, len(l)])
        floor = np.where(size >= keep, (cosine - slack)[order][np.minimum(start + keep - 1, len(l) - 1)], -2.0)
        kept[order] |= (cosine + slack)[order] >= np.repeat(floor, size)
    return a[kept], b[kept]


def similar_vectors(
    rows: DataFrame,
    key: str = "feature_id",
    vector: str = "vec_values",
    scope: str = "producer_hash",
    dims: int = 64,
    k: int = 5,
    at_least: float = 0.85,
    probes: int = PROBES,
) -> DataFrame:
    """(a, b) with a < b: b is among the ``k`` most similar vectors of a, or a among those of b.

    Only vectors of equal non-null ``scope`` with ``dims`` finite values, not all zero, take part. The
    similarity is the cosine of at least ``at_least``; it ranks by its value rounded to 6 decimals, ties
    by the smaller id. Ids are unique. Other columns are ignored, an empty table gives an empty table.

    Copies of a vector are hashed and compared once, whatever their number, and every copy gets its rows.
    Each table sends a sketch of a vector, a byte per coordinate, to its own bucket and to the ``probes`` perturbed
    ones likeliest to hold a neighbour; what meets there and may count by the bounds of the sketches becomes a pair of
    ids, and each pair meets its two vectors once, for the exact cosine. The numbers of hash functions
    and tables follow from the size of the collection. A bucket beyond ``TILE`` owners or ``ASKERS`` rows is
    cut into tiles that meet pairwise in different tasks, so nothing in it is left out.
    """
    keep = k + 1
    vectors = usable_vectors(rows, key, vector, scope, dims)
    distinct = cut(_distinct(vectors, keep))
    n = distinct.count()
    functions, tables = plan_size(n)

    def bucket_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), dims)).astype(np.float32)
            codes = batch.column(0).to_numpy()
            for t in range(tables):
                buckets = hash_buckets(unit, codes, t, functions, probes)
                keys, which = np.unique(buckets, return_inverse=True)
                which = which.reshape(buckets.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.bincount(which[:, 0], minlength=len(keys))), pa.array(np.bincount(which.ravel(), minlength=len(keys)))], ["bucket", "owners", "all"]
                )

    hot = cut(
        distinct.select("scope", "vec")
        .mapInArrow(bucket_sizes, "bucket bigint, owners bigint, all bigint")
        .groupBy("bucket")
        .agg(F.sum("owners").alias("_owners"), F.sum("all").alias("_all"))
        .where((F.col("_owners") > 0) & ((F.col("_owners") > TILE) | (F.col("_all") > ASKERS)))
    )

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                unit = _unit(_matrix(part.column(2), dims))
                marks = pa.array([row.tobytes() for row in sketch(unit)], pa.binary())
                codes = part.column(1).to_numpy()
                for t in range(tables):
                    buckets = hash_buckets(unit.astype(np.float32), codes, t, functions, probes)
                    take = pa.array(np.repeat(np.arange(len(part)), buckets.shape[1]))
                    own = np.zeros(buckets.shape, bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(own.ravel()), part.column(0).take(take), marks.take(take)], ["bucket", "own", "rep", "mark"])

    schema = "bucket bigint, own boolean, rep bigint, mark binary"
    sent = distinct.select("rep", "scope", "vec").mapInArrow(scatter, schema)
    if hot.isEmpty():
        placed = sent.select("*", F.lit(0).alias("_tile_q"), F.lit(0).alias("_tile_i"))
    else:
        sent = sent.join(hot, "bucket", "left")
        parts_i = F.greatest(F.coalesce(F.ceil(F.col("_owners") / TILE), F.lit(1)), F.lit(1)).cast("int")
        parts_q = F.greatest(F.coalesce(F.ceil(F.col("_all") / ASKERS), F.lit(1)), F.lit(1)).cast("int")
        mine = lambda parts: F.pmod(F.xxhash64("rep"), parts).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
        asks = sent.select(*schema_names(schema), mine(parts_q).alias("_tile_q"), every(parts_i).alias("_tile_i")).withColumn("own", F.lit(False))
        answers = sent.where("own").select(*schema_names(schema), every(parts_q).alias("_tile_q"), mine(parts_i).alias("_tile_i"))
        placed = asks.unionByName(answers)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def bounds(table: pa.Table) -> np.ndarray:
            keys = [table.column(c).to_numpy() for c in ("bucket", "_tile_q", "_tile_i")]
            change = np.zeros(len(table), bool)
            change[0] = True
            for x in keys:
                change[1:] |= x[1:] != x[:-1]
            return np.flatnonzero(change)

        def work(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            chunk = table.combine_chunks().to_batches()[0]
            own, rep, mark = (chunk.column(chunk.schema.names.index(c)) for c in ("own", "rep", "mark"))
            own, rep = own.to_numpy(zero_copy_only=False), rep.to_numpy()
            flat = mark.cast(pa.large_binary())
            first = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset]
            marks = np.frombuffer(flat.buffers()[2], np.int8)[first : first + len(chunk) * dims].reshape(len(chunk), dims)
            has = np.add.reduceat(own, edges)
            ends = np.r_[edges[1:], len(table)]
            low, high = [], []
            for lo, hi, owners in zip(edges, ends, has, strict=True):
                if owners and hi - lo > 1:
                    q, i = _compare(own[lo:hi], rep[lo:hi], marks[lo:hi], at_least, keep)
                    if len(q):
                        x, y = rep[lo + q], rep[lo + i]
                        low.append(np.minimum(x, y))
                        high.append(np.maximum(x, y))
            if low:
                pairs = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < 8192:
                continue
            table = pa.Table.from_batches(held)
            edges = bounds(table)
            if len(edges) > 1:
                yield from work(table.slice(0, edges[-1]), edges[:-1])
                table = table.slice(edges[-1])
            held = table.to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from work(table, bounds(table))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_unit(_matrix(batch.column(c), dims)) for c in (2, 3))
            cosine = np.einsum("ij,ij->i", left, right)
            good = np.flatnonzero(cosine >= at_least)
            away, take = -np.round(cosine[good], 6), pa.array(good)
            for a, b, ids in ((0, 1, 5), (1, 0, 4)):
                yield pa.RecordBatch.from_arrays([batch.column(a).take(take), pa.array(away), batch.column(b).take(take), batch.column(ids).take(take)], ["rep", "away", "other", "ids"])

    order = ["bucket", "_tile_q", "_tile_i"]
    candidates = placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(meet, "x bigint, y bigint").distinct()
    side = lambda end, n: distinct.select(F.col("rep").alias(end), F.col("scope").alias(f"_s{n}"), F.col("vec").alias(f"_v{n}"), F.col("ids").alias(f"_i{n}"))
    pairs = (
        candidates.join(side("x", 0), "x")
        .join(side("y", 1), "y")
        .where("_s0 = _s1")
        .select("x", "y", "_v0", "_v1", "_i0", "_i1")
        .mapInArrow(exact, "rep bigint, away double, other bigint, ids array<bigint>")
    )
    itself = distinct.select("rep", F.lit(-1.0).alias("away"), F.col("rep").alias("other"), "ids")
    best = (
        pairs.unionByName(itself)
        .groupBy("rep")
        .agg(F.slice(F.sort_array(F.collect_set(F.struct("away", "other", "ids"))), 1, keep + 1).alias("near"))
        .withColumn(
            "near",
            F.slice(
                F.sort_array(F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["away"].alias("away"), i.alias("id")))))),
                1,
                keep,
            ),
        )
        .select("rep", F.transform("near", lambda x: x["id"]).alias("near"))
    )
    copies = distinct.select("rep", "scope", "vec", "ids", "n")
    joined = cut(best.join(copies.select("rep", "ids", "n"), "rep"))
    members = joined.select("near", F.explode("ids").alias("a"))
    many = distinct.where(F.col("n") > keep).select("rep", "scope", "vec")
    if not many.isEmpty():
        lists = (
            joined.join(many, "rep")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            .select("scope", "vec", "_salt", "near")
        )
        rest = vectors.withColumn("_salt", F.pmod("id", F.lit(SALT)).cast("int"))
        members = members.unionByName(rest.join(lists, ["scope", "vec", "_salt"]).select("near", F.col("id").alias("a")))
    return (
        members.select("a", F.explode(F.slice(F.array_remove("near", F.col("a")), 1, k)).alias("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .dropDuplicates(["a", "b"])
    )


def schema_names(schema: str) -> list[str]:
    """The column names of a flat schema string."""
    return [part.split()[0] for part in schema.split(", ")]
