"""Nearest neighbours by few stable projections, a kd-tree over them and a chi-square stop (Sun et al., 2014).

A Gaussian projection to ``m`` numbers turns a distance D into a projected one whose square is D**2 times a
chi-square variable of m degrees. Neighbours are taken in the order of their projected distance r and
verified on the original vectors. The search ends once ``r**2 >= q * best**2`` for the best distance that
the k-th neighbour has so far, q being the chi-square quantile of ``certainty``: what is left could be
nearer with a chance of at most 1 - ``certainty`` each.

The kd-tree has two storeys. Its top is fitted on a bounded sample of projections and deals all vectors to
shards; inside a shard (and slice, where a shard is crowded) a task builds the lower storey over the
vectors it holds. A query first searches its own shard, which bounds its k-th distance; then it visits the
shards whose boxes the stopping test does not rule out. Queries and vectors of a shard meet in tiles of
bounded sides.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .scratch import Scratch
from .tokens import lean

#: Projections of a vector; an even number, for the quantile's closed form.
M = 8
#: Vectors of a shard or slice, queries of a tile, and vectors of a bucket of the lower storey.
SHARD, QUERIES, BUCKET = 8192, 16_384, 64
#: Sampled projections that the top of the tree is fitted on, and the fewest of them for each shard.
SAMPLE, LEAST = 20_000, 16
SOUND = "id long, key string, d int, x binary"
PROJECTED = f"{SOUND}, z array<double>"
FOUND = "key string, id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number of degrees of freedom, by bisection."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(m // 2))
    lo, hi = 0.0, 1.0
    while tail(hi) > 1 - p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return hi


def matrix(d: int) -> np.ndarray:
    """The projection of vectors of length d: the same in every task."""
    return np.random.default_rng([11, d]).normal(size=(d, M))


def sound_vectors(batches):
    """``id, x`` to rows of the vectors that take part, with a digest by which equal ones are known."""
    for batch in batches:
        column = batch.column(1)
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths[lengths > 0]).tolist():
            part = batch.filter(pa.array(lengths == d))
            flat = part.column(1).flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, d) + 0.0  # -0 becomes 0; a null is not a number
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            raw = [v.tobytes() for v in x[good]]
            ids = part.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([hashlib.sha256(v).hexdigest() for v in raw], pa.string()), pa.array([d] * len(raw), pa.int32()), pa.array(raw, pa.binary())], names=["id", "key", "d", "x"])


def project(batches):
    """Adds the projections ``z`` to batches of ``key, d, x, ids``."""
    for batch in batches:
        d = batch.column("d").to_numpy()
        z = np.empty((len(d), M))
        raw = batch.column("x").to_pylist()
        for size in np.unique(d).tolist():
            own = np.flatnonzero(d == size)
            z[own] = np.stack([np.frombuffer(raw[i]) for i in own]) @ matrix(size)
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * M, pa.int32()), pa.array(z.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "z"])


class Top:
    """The upper storey: a complete tree of median splits over sampled projections."""

    def __init__(self, z: np.ndarray, depth: int):
        self.depth, self.dim, self.cut = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        parts = {1: z}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            axis = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            self.dim[node], self.cut[node] = axis, cut
            above = own[:, axis] > cut
            parts[2 * node], parts[2 * node + 1] = own[~above], own[above]

    def shard(self, z: np.ndarray) -> np.ndarray:
        node = np.ones(len(z), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (z[np.arange(len(z)), self.dim[node]] > self.cut[node])
        return node - (1 << self.depth)


def buckets(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower storey: rows in the order of a kd-tree's leaves, and where each leaf begins."""
    order, cuts, todo = np.arange(len(z)), [0], [(0, len(z))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= BUCKET:
            continue
        own = z[order[lo:hi]]
        axis, mid = int(np.ptp(own, axis=0).argmax()), (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
        cuts.append(lo + mid)
        todo += [(lo, lo + mid), (lo + mid, hi)]
    return order, np.sort(np.array(cuts))


def box_distance(low: np.ndarray, high: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared projected distance of a point to each box."""
    gap = np.maximum(np.maximum(low - z, z - high), 0)
    return (gap * gap).sum(1)


def searcher(k: int, q: float):
    """Of a tile: up to ``k`` nearest ids of each query, ids of equal vectors included."""

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            z = np.stack(points["z"].to_list())
            order, first = buckets(z)
            z, x = z[order], np.stack([np.frombuffer(v) for v in points["x"]])[order]
            ids = [np.asarray(v, np.int64) for v in points["ids"].to_numpy()[order]]
            last = np.append(first[1:], len(z))
            low, high = np.minimum.reduceat(z, first), np.maximum.reduceat(z, first)
            for r in queries.itertuples():
                at, own = np.asarray(r.z), np.frombuffer(r.x)
                ahead = box_distance(low, high, at)
                turn = np.argsort(ahead, kind="stable")
                best, who, bound = np.empty(0), np.empty(0, np.int64), float(r.bound)
                i, step = 0, 1
                # the rest is farther than the nearest box that is left: the stopping test, leaf by leaf
                while i < len(turn) and ahead[turn[i]] <= q * bound * bound:
                    rows = np.concatenate([np.arange(first[b], last[b]) for b in turn[i : i + step]])
                    i, step = i + step, min(2 * step, 32)
                    near = z[rows] - at
                    rows = rows[(near * near).sum(1) <= q * bound * bound]
                    apart = x[rows] - own
                    score = np.sqrt((apart * apart).sum(1))
                    close = score <= bound
                    if not close.any():
                        continue
                    rows, score = rows[close], score[close]
                    best = np.concatenate([best, np.repeat(score, [len(ids[j]) for j in rows])])
                    who = np.concatenate([who, *(ids[j] for j in rows)])
                    kept = np.lexsort((who, best))[:k]
                    best, who = best[kept], who[kept]
                    if len(best) == k:
                        bound = min(bound, float(best[-1]))
                out.append((r.key, who, best))
        keys = np.repeat(np.array([o[0] for o in out], object), [len(o[1]) for o in out])
        join = lambda i, kind: np.concatenate([np.empty(0, kind), *(o[i] for o in out)])
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "id": join(1, np.int64), "score": join(2, float)})

    return run


def tiles(points: DataFrame, visits: DataFrame, k: int, q: float) -> DataFrame:
    """``FOUND`` of queries ``key, d, shard, x, z, bound`` in the shards they visit."""
    place = ["d", "shard"]
    sides = points.groupBy(*place).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("s")).join(visits.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("p")), place)
    number = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = [*place, "i", "j"]
    own = points.join(sides, place).withColumn("i", number("s")).withColumn("j", every("p")).select(*tile, "x", "z", "ids")
    guests = visits.join(sides, place).withColumn("j", number("p")).withColumn("i", every("s")).select(*tile, "key", "x", "z", "bound")
    search = searcher(k, q)
    return own.groupBy(*tile).cogroup(guests.groupBy(*tile)).applyInPandas(lambda a, b: search(a, b), FOUND)


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, certainty: float = 0.95) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides, up to ``k`` nearest other rows
    by Euclidean distance in double precision, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do rows
    without an id. Vectors meet others of their length only; ``certainty`` is the least chance by which each
    true neighbour is found. Equal vectors are searched once, and keep their smallest ids, as no query can
    reach more of them. Rows that repeat an id and a vector count once; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "nearest")
    q = chi_square_quantile(certainty, M)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and x is not null")
    sound = scratch.save(rows.mapInArrow(lean(sound_vectors), SOUND), "sound")
    # k + 1 ids of a class: its own members ask for others; the limit acts before rows are shuffled
    ahead = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    few = sound.withColumn("n", ahead).where(F.col("n") <= k + 1).groupBy("key").agg(F.first("d").alias("d"), F.first("x").alias("x"), F.sort_array(F.collect_set("id")).alias("ids"))
    classes = scratch.save(few.mapInArrow(lean(project), "key string, d int, x binary, ids array<long>, z array<double>"), "classes")

    sizes = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row per length
    tops: dict[int, Top] = {}
    for d, n in sizes.items():
        if n > SHARD:
            part = min(1.0, SAMPLE / n)
            seen = classes.where((F.col("d") == d) & (F.pmod(F.xxhash64("key", F.lit("top")), F.lit(1_000_003)) < part * 1_000_003)).select("z").collect()  # some SAMPLE rows of M numbers
            depth = int(max(0, min(math.ceil(math.log2(n / SHARD)), math.floor(math.log2(max(1, len(seen) / LEAST))))))
            tops[d] = Top(np.array([r["z"] for r in seen]).reshape(-1, M), depth)

    @F.pandas_udf(LongType())
    def shard(d: pd.Series, z: pd.Series) -> pd.Series:
        out = np.zeros(len(d), np.int64)
        for size in d.unique():
            own = np.flatnonzero(d.to_numpy() == size)
            if size in tops:
                out[own] = tops[size].shard(np.stack(z.iloc[own].to_list()))
        return pd.Series(out)

    points = classes.withColumn("shard", shard("d", "z"))
    ends = [f(F.col("z")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(M)]
    boxes: dict[int, tuple[list, np.ndarray, np.ndarray]] = {}
    for r in points.groupBy("d", "shard").agg(*ends).collect():  # a row per shard of the top, SAMPLE / LEAST at most for each length
        own = boxes.setdefault(r["d"], ([], [], []))
        own[0].append(r["shard"])
        own[1].append([r[f"low{i}"] for i in range(M)])
        own[2].append([r[f"high{i}"] for i in range(M)])
    boxes = {d: (np.array(s), np.array(lo), np.array(hi)) for d, (s, lo, hi) in boxes.items()}

    def others(batches):
        """Queries to the shards that their bound does not rule out, their own left out."""
        for batch in batches:
            d, home, bound = (batch.column(c).to_numpy() for c in ("d", "shard", "bound"))
            row, at = [], []
            for i, z in enumerate(batch.column("z").to_pylist()):
                shards, low, high = boxes[int(d[i])]
                seen = shards[(box_distance(low, high, np.array(z)) <= q * bound[i] * bound[i]) & (shards != home[i])]
                row.append(np.full(len(seen), i))
                at.append(seen)
            if row:
                out = batch.take(pa.array(np.concatenate(row)))
                yield out.set_column(out.schema.get_field_index("shard"), "shard", pa.array(np.concatenate(at), pa.int64()))

    asked = sound.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "key")
    queries = scratch.save(points.join(asked.select("key").distinct(), "key", "left_semi").select("key", "d", "shard", "x", "z"), "queries")
    at_home = scratch.save(tiles(points, queries.withColumn("bound", F.lit(math.inf)), k + 1, q), "home")
    ranked = at_home.groupBy("key").agg(F.sort_array(F.collect_list("score")).alias("scores"))
    bounds = ranked.select("key", F.coalesce(F.get("scores", F.lit(k)), F.lit(math.inf)).alias("bound"))
    going = queries.join(bounds, "key").select("key", "d", "shard", "x", "z", "bound")
    visits = scratch.save(going.mapInArrow(others, going.schema), "visits")
    away = scratch.save(tiles(points, visits, k + 1, q), "away")
    best = Window.partitionBy("key").orderBy("score", "id")
    top = at_home.union(away).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    met = asked.distinct().join(top, "key").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
