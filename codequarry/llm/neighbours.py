"""The most similar vectors for every vector, by cross-polytope hashing.

Unit vectors go through fast Hadamard pseudo-rotations; the nearest signed axis is the hash.
A table joins ``hashes`` of them to a bucket. Each vector is stored in its own bucket and also
asks the buckets of its next best axes (multiprobe). Within a bucket candidates are compared
exactly and each keeps its best ``k``; the best over all tables are the result. Copies of a
vector are one class, and only as many of them as can be needed are named.

Hashes, tables and probes follow from the recall that is asked for: pairs that must be found
are hashed on the driver, and of all settings that find enough of them the one with the least
estimated work is taken. With a floor the pairs lie exactly at the floor, the hardest case;
without one they are the exact neighbours of a sample of vectors among all vectors. One bucket
with everything in it is the last resort, so any recall can be had at any size.

Buckets with more than ``BUCKET`` vectors are split into blocks, and every vector that asks
such a bucket asks all its blocks, so no task holds more and nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.vectors import usable
from codequarry.session import cut

SEED = 20240229
#: Stored vectors of one block; also rows of one comparison.
BUCKET = 4096
#: Share of the true pairs that should be found, unless another is asked for.
RECALL = 0.98
#: Most hashes of a table, tables, and probes that are considered.
MOST_HASHES, MOST_TABLES, MOST_PROBES = 3, 24, 16
#: Vectors on which the settings are fitted, and vectors from which sizes of buckets are estimated (bounded samples; every row is indexed).
SAMPLE, SIZES = 256, 4096
#: Seconds for a copy of a vector sent to a bucket, and for a comparison; they only weigh settings against each other.
COPY_COST, PAIR_COST = 2e-5, 1.5e-8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns; their length is a power of two."""
    d, n = x.shape
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        x = np.empty_like(y)
        np.add(y[:, 0], y[:, 1], out=x[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=x[:, 1])
        h *= 2
    return x.reshape(d, n)


def signs(dim: int, table: int, j: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, j]).choice(np.array([-1, 1], np.float32), (3, dim))


def rotated(x: np.ndarray, table: int, j: int) -> np.ndarray:
    d = x.shape[1]
    y = np.ascontiguousarray(x.T)
    for s in signs(d, table, j):
        y = hadamard(y * (s / np.float32(math.sqrt(d)))[:, None])
    return y.T


def axes(unit: np.ndarray, table: int, j: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers of its ``probes`` + 1 nearest signed axes, and how much nearer the first is than each."""
    n, d = unit.shape
    m = min(probes + 1, d)
    y = np.ascontiguousarray(rotated(unit, table, j))
    a = np.abs(y)
    best = a.argmax(axis=1)[:, None] if m == 1 else np.argpartition(-a, m - 1, axis=1)[:, :m] if m < d else np.tile(np.arange(d), (n, 1))
    if m > 1:
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(a, best, 1), axis=1, kind="stable"), 1)
    top = np.take_along_axis(a, best, 1)
    return (2 * best + (np.take_along_axis(y, best, 1) < 0)).astype(np.int64), top[:, :1] - top


def joined(found: list[tuple[np.ndarray, np.ndarray]], dim: int, probes: int) -> np.ndarray:
    """For each row the numbers of its own bucket and of ``probes`` others, nearest first, from the axes of each hash."""
    base = [(2 * dim) ** j for j in range(len(found))]
    home = sum(c[:, 0] * b for (c, _), b in zip(found, base))
    if not probes:
        return home[:, None]
    other = np.concatenate([home[:, None] + (c[:, 1:] - c[:, :1]) * b for (c, _), b in zip(found, base)], axis=1)
    order = np.argsort(np.concatenate([x[:, 1:] for _, x in found], axis=1), axis=1, kind="stable")[:, :probes]
    return np.concatenate([home[:, None], np.take_along_axis(other, order, 1)], axis=1)


def buckets(unit: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    if not hashes:
        return np.zeros((len(unit), 1), np.int64)
    return joined([axes(unit, table, j, probes) for j in range(hashes)], unit.shape[1], probes)


def units(column: pa.ChunkedArray | pa.Array, pad: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    if pad is not None and x.shape[1] < pad:
        x = np.concatenate([x, np.zeros((len(x), pad - x.shape[1]), np.float32)], axis=1)
    return x


class _Best:
    """The best ``k`` of each row over blocks of similarities, as (source, target, similarity)."""

    def __init__(self, k: int, least: float):
        self.k, self.least, self.out = k, least, []

    def take(self, a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        for lo in range(0, len(a), 1024):
            sim = a[lo : lo + 1024] @ b.T
            sim[ids_a[lo : lo + 1024, None] == ids_b[None, :]] = -2
            k = min(self.k, sim.shape[1])
            near = sim >= np.float32(max(self.least, -1.5) - 1e-5)
            if self.least <= 0 or near.sum(axis=1).max(initial=0) > k:
                # candidates at the k-th value stay in, so that ties are decided by the exact figures
                near &= sim >= (-np.partition(-sim, k - 1, axis=1)[:, k - 1] - np.float32(1e-5))[:, None]
            i, j = np.nonzero(near)
            if len(i):
                exact = np.einsum("ij,ij->i", a[lo + i].astype(np.float64), b[j].astype(np.float64))
                self.out.append((ids_a[lo + i], ids_b[j], exact))

    def batch(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        src, dst, sim = (np.concatenate(c) for c in zip(*self.out))
        self.out = []
        # pairs that met in several tables count once
        order = np.lexsort((-sim, dst, src))
        once = order[np.concatenate(([True], (src[order][1:] != src[order][:-1]) | (dst[order][1:] != dst[order][:-1])))]
        src, dst, sim = src[once], dst[once], sim[once]
        order = np.lexsort((dst, -sim, src))
        src, dst, sim = src[order], dst[order], sim[order]
        start = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
        rank = np.arange(len(src)) - np.repeat(start, np.diff(np.append(start, len(src))))
        keep = (rank < self.k) & (sim >= self.least)
        return pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep]), pa.array(sim[keep])], ["src", "dst", "sim"])


def _pad(dim: int) -> int:
    return 1 << (dim - 1).bit_length()


def _hashed(reps: DataFrame, dim: int, tables: int, hashes: int, probes: int) -> DataFrame:
    """(id, vec, asks, own, other): the unit vector, its buckets, one a table, and for vectors that ask ``probes`` others a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = units(b.column("vec"), _pad(dim))
            n = len(x)
            if not n:
                continue
            raw = pa.Array.from_buffers(pa.binary(dim * 4), n, [None, pa.py_buffer(np.ascontiguousarray(x[:, :dim]).tobytes())]).cast(pa.binary())
            asks = b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            own, other = np.zeros((n, tables), np.int64), np.zeros((int(asks.sum()), tables, probes), np.int64)
            for t in range(tables):
                codes = buckets(x, t, hashes, probes)
                own[:, t] = codes[:, 0]
                other[:, t] = codes[asks, 1:]
            ends = pa.array(np.arange(0, own.size + 1, tables, dtype=np.int32))
            step = np.concatenate(([0], np.cumsum(asks * tables * probes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), raw, b.column("asks"), pa.ListArray.from_arrays(ends, pa.array(own.reshape(-1))), pa.ListArray.from_arrays(pa.array(step), pa.array(other.reshape(-1)))], ["id", "vec", "asks", "own", "other"])

    return reps.select("id", "vec", "asks").mapInArrow(run, "id long, vec binary, asks boolean, own array<long>, other array<long>")


def _nearest_of_sample(sample: pa.Table, reps: DataFrame, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact ``k`` nearest vectors of each sampled one: its row in the sample, and the neighbour's vector."""
    shared = reps.sparkSession.sparkContext.broadcast((sample.column("id").to_numpy(), units(sample.column("vec").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            if b.num_rows:
                x, own = units(b.column("vec")), b.column("id").to_numpy()
                sim = q @ x.T
                sim[ids[:, None] == own[None, :]] = -2
                m = min(k, sim.shape[1])
                best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                at = np.repeat(np.arange(len(q)), m)
                best = best.reshape(-1)
                raw = [r.tobytes() for r in x[best]]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sim[at, best].astype(np.float64)), pa.array(own[best]), pa.array(raw, pa.binary())], ["q", "sim", "id", "vec"])

    got = reps.select("id", "vec").mapInArrow(run, "q long, sim double, id long, vec binary").where("sim > -2")
    w = Window.partitionBy("q").orderBy(F.col("sim").desc(), "id")
    rows = got.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "vec").collect()  # at most SAMPLE * k
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    return np.array([r["q"] for r in rows]), np.stack([np.frombuffer(r["vec"], np.float32) for r in rows])


def _widened(x: np.ndarray, dim: int) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), _pad(dim) - x.shape[1]), np.float32)], axis=1) if x.shape[1] < _pad(dim) else x


def fitted(reps: DataFrame, n: int, n_asking: int, dim: int, k: int, least: float, recall: float, most_hashes: int = MOST_HASHES) -> tuple[int, int, int]:
    """(hashes, tables, probes) with the least estimated work that find the share ``recall`` of the pairs they are fitted on."""
    rng = np.random.default_rng(SEED)
    some = reps.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SIZES).toArrow()
    if some.num_rows < 2:
        return 0, 1, 0
    asking = some.slice(0, SAMPLE)
    stored = units(some.column("vec").combine_chunks(), _pad(dim))
    q = stored[: asking.num_rows]
    if least > 0:
        src = np.repeat(np.arange(len(q)), 8)
        w = rng.normal(size=(len(src), dim))
        u = q[src, :dim].astype(np.float64)
        w -= (w * u).sum(1, keepdims=True) * u
        w /= np.linalg.norm(w, axis=1, keepdims=True) + 1e-30
        near = (min(least, 1.0) * u + math.sqrt(max(0.0, 1 - least * least)) * w).astype(np.float32)
    else:
        src, near = _nearest_of_sample(asking, reps, dim, k)
        if not len(src):
            return 0, 1, 0
    near = _widened(near, dim)
    share = n_asking / n
    best = (math.inf, (0, 1, 0))
    ways_of = [[[axes(x, t, j, MOST_PROBES) for j in range(most_hashes)] for t in range(MOST_TABLES)] for x in (q, near)]
    for hashes in range(1, most_hashes + 1):
        ranks = np.full((len(src), MOST_TABLES), MOST_PROBES + 1, np.int64)
        scanned = np.zeros(MOST_PROBES + 1)
        for t in range(MOST_TABLES):
            a, b = (joined(w[t][:hashes], _pad(dim), MOST_PROBES) for w in ways_of)
            ways = [a[src] == b[:, :1]] + ([b == a[src, :1]] if share == 1 else [])
            for same in ways:
                ranks[:, t] = np.minimum(ranks[:, t], np.where(same.any(1), same.argmax(1), MOST_PROBES + 1))
            if t < 4:  # sizes of the buckets that a vector asks, from the sample
                code, count = np.unique(buckets(stored, t, hashes, 0)[:, 0], return_counts=True)
                at = np.minimum(np.searchsorted(code, a), len(code) - 1)
                scanned[: a.shape[1]] += np.where(code[at] == a, count[at], 0).mean(0) / 4 * n / len(stored)
        for probes in sorted({0, 1, 2, 3, 4, 6, 8, 12, 16} & set(range(a.shape[1]))):
            got = np.maximum.accumulate(ranks <= probes, axis=1).mean(0)
            enough = np.flatnonzero(got >= recall)
            if len(enough):
                tables = int(enough[0]) + 1
                copies = n * tables * ((1 + probes) if share == 1 else (1 + share * (1 + probes)))
                pairs = n * share * tables * (scanned[0] + (2 if share == 1 else 1) * scanned[1 : probes + 1].sum())
                best = min(best, (copies * COPY_COST + pairs * PAIR_COST, (hashes, tables, probes)))
    return best[1]


def _compared(asked: DataFrame, dim: int, k: int, least: float, both: bool) -> DataFrame:
    """Walks the rows of each block, stored vectors first; ``both``: stored vectors look for asking ones, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, least)
        now, held, held_ids, ready = None, [], [], None

        def close_stored() -> tuple[np.ndarray, np.ndarray]:
            if held:
                return np.concatenate(held), np.concatenate(held_ids)
            return np.zeros((0, dim), np.float32), np.zeros(0, np.int64)

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("tab", "bucket", "salt")], axis=1).astype(np.int64)
            role, split = b.column("role").to_numpy(), b.column("split").to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy()
            vec = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float32).reshape(len(ids), dim)
            edge = np.flatnonzero(np.concatenate(([True], np.any(key[1:] != key[:-1], axis=1) | (role[1:] != role[:-1])))).tolist() + [len(ids)]
            for lo, hi in zip(edge, edge[1:]):
                here = tuple(key[lo])
                if here != now:
                    if ready is None and len(held) and not now_split:
                        s, si = close_stored()
                        if len(si) > 1:
                            best.take(s, s, si, si)
                    now, now_split, held, held_ids, ready = here, bool(split[lo]), [], [], None
                if role[lo] == 0:
                    held.append(vec[lo:hi])
                    held_ids.append(ids[lo:hi])
                    continue
                if ready is None:
                    ready = close_stored()
                    if len(ready[1]) > 1 and not now_split:
                        best.take(ready[0], ready[0], ready[1], ready[1])
                if len(ready[1]):
                    best.take(vec[lo:hi], ready[0], ids[lo:hi], ready[1])
                    if both:
                        best.take(ready[0], vec[lo:hi], ready[1], ids[lo:hi])
            if (out := best.batch()) is not None:
                yield out
        if ready is None and len(held) and not now_split:
            s, si = close_stored()
            if len(si) > 1:
                best.take(s, s, si, si)
        if (out := best.batch()) is not None:
            yield out

    return asked.mapInArrow(run, "src long, dst long, sim double")


def class_neighbours(reps: DataFrame, dim: int, k: int, least: float, recall: float = RECALL, settings: tuple[int, int, int] | None = None) -> DataFrame:
    """(src, dst, sim, rank) of the best ``k`` of each distinct vector that asks; ``reps`` has id, vec and asks.

    ``settings`` (hashes, tables, probes) are fitted to the recall if they aren't given.
    """
    r = reps.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)).alias("asking")).first()
    n, asking = r["n"], r["asking"]
    hashes, tables, probes = settings or (fitted(reps, n, asking, dim, k, least, recall) if n and asking else (0, 1, 0))
    both = asking == n
    once = cut(_hashed(reps, dim, tables, hashes, probes))  # one row a vector; copies for the buckets are made after it
    at = lambda tab, bucket, role: F.struct(tab.cast("int").alias("tab"), bucket.alias("bucket"), F.lit(role).alias("role"))
    places = [F.transform("own", lambda x, i: at(i, x, 0))]
    if probes:
        places.append(F.transform("other", lambda x, i: at(F.floor(i / F.lit(probes)), x, 1)))
    if not both:
        places.append(F.when(F.col("asks"), F.transform("own", lambda x, i: at(i, x, 1))).otherwise(F.array().cast("array<struct<tab:int,bucket:bigint,role:int>>")))
    hashed = once.select("id", "vec", F.explode(F.concat(*places)).alias("at")).select("at.tab", "at.bucket", "at.role", "id", "vec")
    hot = once.select(F.posexplode("own").alias("h_tab", "h_bucket")).groupBy("h_tab", "h_bucket").agg(F.count("*").alias("m")).where(F.col("m") > BUCKET).select("h_tab", "h_bucket", F.ceil(F.col("m") / (BUCKET / 2)).cast("int").alias("blocks"))
    hot = cut(hot)
    if hot.limit(1).count():
        got = hashed.join(hot, (F.col("tab") == F.col("h_tab")) & (F.col("bucket") == F.col("h_bucket")), "left").withColumn("split", F.col("blocks").isNotNull())
        mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        one = F.array(F.struct(F.lit(0).alias("salt"), F.col("role").alias("role")))
        asks = F.transform(every, lambda s: F.struct(s.alias("salt"), F.lit(1).alias("role")))
        stored = F.array(F.struct(mine.alias("salt"), F.lit(0).alias("role")))
        got = got.withColumn("to", F.explode(F.when(~F.col("split"), one).when(F.col("role") == 0, F.concat(stored, asks) if both else stored).otherwise(asks)))
        asked = got.select("tab", "bucket", "to.salt", "to.role", "split", "id", "vec")
    else:
        asked = hashed.select("tab", "bucket", F.lit(0).alias("salt"), "role", F.lit(False).alias("split"), "id", "vec")
    if not both:  # stored vectors don't look for each other
        asked = asked.withColumn("split", F.lit(True))
    placed = asked.repartition("tab", "bucket", "salt").sortWithinPartitions("tab", "bucket", "salt", "role")
    found = _compared(placed, dim, k, least, both).groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 10, least: float = -1.0, recall: float = RECALL, queries: DataFrame | None = None, settings: tuple[int, int, int] | None = None) -> DataFrame:
    """(src, dst, similarity, rank): for every usable vector its ``k`` most similar others, ties by id.

    Vectors that are NULL, of another length, not finite or all zero are left out, as are NULL ids.
    Length means nothing. ``least`` leaves out what is less similar. Repeated ids count once
    (the greatest vector). An empty table gives no rows. ``queries`` (a table with the id column)
    names the vectors whose neighbours are wanted, else all are. Approximate: ``recall`` is the
    share of the true pairs that the settings are fitted to; it is measured in the tests.
    """
    v = F.col(f"`{vec_col}`").cast("array<float>")
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec")).where(usable(F.col("vec"), dim))
    rows = rows.groupBy("id").agg(F.max("vec").alias("vec"))
    if queries is None:
        rows = rows.withColumn("asks", F.lit(True))
    else:
        wanted = queries.select(F.col(f"`{id_col}`").cast("long").alias("q_id")).where("q_id is not null").distinct()
        rows = rows.join(wanted, F.col("id") == F.col("q_id"), "left").withColumn("asks", F.col("q_id").isNotNull()).drop("q_id")
    rows = cut(rows)
    classes = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.bool_or("asks").alias("asks"))
    classes = cut(classes)
    best = class_neighbours(classes.select(F.col("rep").alias("id"), "vec", "asks"), dim, k, least, recall, settings).select("src", "dst", "sim")
    many = classes.where("n > 1")
    copies = cut(rows.join(many.drop("asks"), "vec").select("id", "rep", "asks"))
    first = Window.partitionBy("rep").orderBy("id")
    named = copies.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select(F.col("rep").alias("n_rep"), F.col("id").alias("named"))
    # a class's own copies, then the copies of the classes near it
    own = many.where("asks").select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(1.0).alias("sim")) if least <= 1 else best.limit(0)
    wide = best.unionByName(own).join(named, F.col("dst") == F.col("n_rep"), "left").select("src", F.coalesce("named", "dst").alias("dst"), "sim")
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    ranked = wide.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    each = ranked.join(copies.where("asks"), F.col("src") == F.col("rep"), "left")
    each = each.select(F.coalesce("id", "src").alias("src"), "dst", "sim").where(F.col("src") != F.col("dst"))
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", F.col("sim").alias("similarity"), "rank")
