"""Embedding near-dedup over an inverted multi-index (Babenko and Lempitsky, 2012).

Two codebooks, one for each half of the normalised vectors, span a grid of cells. A vector lies in the
cell of its nearest codewords and visits the cells nearest to it in the order of the multi-sequence
algorithm: of the sorted distances to both codebooks, cell (i, j) can be among the first T only if
``(i + 1) (j + 1) <= T``. T follows from ``recall``: sampled vectors and neighbours at the similarity
limit tell how far the traversal has to go until one of the two visits the other's cell. Vectors that
meet in a visited cell and have equal labels are compared by their exact cosine in double precision.

Only vectors of one length can link. The commonest length and every length of many vectors have an
index of their own; of rarer lengths, all vectors of a label meet.

Equal vectors of a label are one class with a weight. A grid row of a label is dealt out in tiles of
bounded sides, so a crowded one is many tasks. Tiles return counts and a spanning forest of the links
they find, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .tokens import lean

MEMBERS, PROBES = 2048, 8192
#: Classes from which on a length has an index of its own.
INDEXED = 20_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(near, x[:, d], len(c)) / np.maximum(n, 1), c[:, d])
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class MultiIndex:
    """Codebooks of both halves and the traversal's depth."""

    def __init__(self, sample: np.ndarray, codewords: int, limit: float, recall: float, seed: int = 17):
        x = unit(sample)
        self.half = x.shape[1] // 2
        self.books = [kmeans(x[:, : self.half], codewords, seed=seed), kmeans(x[:, self.half :], codewords, seed=seed + 1)]
        self.k = [len(b) for b in self.books]
        rng = np.random.default_rng(seed)
        q = x[rng.integers(0, len(x), 1000)]
        noise = rng.normal(size=q.shape)
        noise = unit(noise - (noise * q).sum(1, keepdims=True) * q) if x.shape[1] > 1 else np.zeros_like(q)
        near = limit * q + np.sqrt(max(0.0, 1 - limit**2)) * noise
        ranks = np.minimum(self._rank(q, self.cells(near)), self._rank(near, self.cells(q)))
        self.depth = int(np.clip(np.quantile(ranks, recall) + 1, 1, self.k[0] * self.k[1]))

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        halves = (x[:, : self.half], x[:, self.half :])
        return [np.maximum(0, (h**2).sum(1)[:, None] - 2 * h @ b.T + (b**2).sum(1)) for h, b in zip(halves, self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.k[1] + b.argmin(1)

    def _rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells each vector's traversal visits before the given one."""
        a, b = self.distances(x)
        b.sort(1)
        at = np.arange(len(x))
        own = a[at, cell // self.k[1]] + self.distances(x)[1][at, cell % self.k[1]]
        return np.array([np.searchsorted(b[r], own[r] - a[r], "left").sum() for r in at])

    def visited(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The first ``depth`` cells of each vector's traversal, nearest first."""
        a, b = self.distances(x)
        i = np.repeat(np.arange(min(self.k[0], depth)), [min(self.k[1], depth // (r + 1)) for r in range(min(self.k[0], depth))])
        j = np.arange(len(i)) - np.searchsorted(i, i)
        oa, ob = a.argsort(1, kind="stable")[:, : i.max() + 1], b.argsort(1, kind="stable")[:, : j.max() + 1]
        sums = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        best = sums.argsort(1, kind="stable")[:, :depth]
        return np.take_along_axis(oa[:, i] * self.k[1] + ob[:, j], best, 1)


class OneCell:
    """For lengths of few vectors: a grid of one cell, in which all of a label meet."""

    k, depth = (1, 1), 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), np.int64)

    def visited(self, x: np.ndarray, depth: int) -> np.ndarray:
        return np.zeros((len(x), 1), np.int64)


def vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]) if len(column) else np.empty((0, 0))


DEALT = "label string, grid int, role int, id long, weight long, cell int, visits binary, x binary"


def by_length(batch: pa.RecordBatch):
    """Parts of a batch whose vectors have one length, with that length."""
    lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
    present = np.unique(lengths).tolist()
    for d in present:
        yield d, batch if len(present) == 1 else batch.filter(pa.array(lengths == d))


def _deal(indexes: dict[int, tuple[MultiIndex, int]]):
    """Each vector once as a member of its grid row, and once as a probe of each row it visits. An index
    comes with the number of its first grid row; rows below 0 are the lengths without one."""
    names = [c.split()[0] for c in DEALT.split(", ")]

    def run(batches):
        for batch in batches:
            for d, part in ((d, part) for i in range(0, batch.num_rows, 1024) for d, part in by_length(batch.slice(i, 1024))):
                index, base = indexes.get(d) or (OneCell(), -d)
                x = vectors(part.column(2))
                n = unit(x)
                cell, visits = index.cells(n), index.visited(n, index.depth).astype(np.int32)
                grid = base + np.concatenate([cell[:, None] // index.k[1], visits // index.k[1]], axis=1)
                label, ids, weight = part.column(1), part.column(0).to_numpy(), part.column(3).to_numpy()
                rows, role, at = [], [], []
                for r in range(len(x)):
                    lines = np.unique(grid[r, 1:])
                    rows.append(np.full(len(lines) + 1, r))
                    role.append(np.append(0, np.ones(len(lines), int)))
                    at.append(np.append(grid[r, 0], lines))
                rows, role, at = np.concatenate(rows), np.concatenate(role), np.concatenate(at)
                raw, seen = [v.tobytes() for v in x], [v.tobytes() for v in visits]
                yield pa.RecordBatch.from_arrays(
                    [label.take(pa.array(rows)), pa.array(at, pa.int32()), pa.array(role, pa.int32()), pa.array(ids[rows], pa.int64()), pa.array(weight[rows], pa.int64()), pa.array(cell[rows], pa.int32()), pa.array([seen[r] for r in rows], pa.binary()), pa.array([raw[r] for r in rows], pa.binary())],
                    names=names,
                )

    return lean(run)


FOUND = "id long, linked long, other long"


def _among(visits: np.ndarray, rows: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """Which of the ascending ``cells`` each row visits."""
    out = np.zeros((n, len(cells)), bool)
    at = np.minimum(np.searchsorted(cells, visits), len(cells) - 1)
    row, col = np.nonzero(cells[at] == visits)
    out[rows[row], at[row, col]] = True
    return out


def _meet(limit: float):
    """Of one tile: each vector's new links by weight, and a spanning forest of the links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out_id, out_n, edge_a, edge_b = [], [], [], []
        m, q = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if len(m) and len(q):
            get = lambda f, c, t: np.stack([np.frombuffer(v, t) for v in f[c]])
            mx, mv, mc, mi, mw = get(m, "x", np.float64), get(m, "visits", np.int32), m["cell"].to_numpy(), m["id"].to_numpy(), m["weight"].to_numpy()
            mn = np.linalg.norm(mx, axis=1)
            by_cell = np.argsort(mv, axis=None, kind="stable")
            cells, who = mv.ravel()[by_cell], by_cell // mv.shape[1]
            gained = np.zeros(len(m), np.int64)
            for i in range(0, len(q), 1024):
                p = q.iloc[i : i + 1024]
                x, v, c, ids, w = get(p, "x", np.float64), get(p, "visits", np.int32), p["cell"].to_numpy(), p["id"].to_numpy(), p["weight"].to_numpy()
                close = (x @ mx.T) >= limit * np.linalg.norm(x, axis=1)[:, None] * mn
                # of the probes' visited cells, those of members; and the members that visit a probe's cell
                seen = _among(v, np.arange(len(p)), np.unique(mc), len(p))
                sees = np.zeros((len(np.unique(c)), len(m)), bool)
                for k, cell in enumerate(np.unique(c)):
                    sees[k, who[np.searchsorted(cells, cell) : np.searchsorted(cells, cell, "right")]] = True
                link = close & seen[:, np.searchsorted(np.unique(mc), mc)] & (ids[:, None] != mi)
                # a member that does not itself visit the probe's cell learns of the link here
                back = link & ~sees[np.searchsorted(np.unique(c), c)]
                out_id.append(ids)
                out_n.append(link @ mw)
                gained += w @ back
                a, b = np.nonzero(link)
                if not len(a):
                    continue
                rows, cols = np.unique(a), np.unique(b)
                part = link[np.ix_(rows, cols)]
                la, lb = ids[rows].copy(), mi[cols].copy()
                top = np.iinfo(np.int64).max
                while True:  # smallest id along links within the tile
                    na = np.minimum(la, np.where(part, lb, top).min(1))
                    nb = np.minimum(lb, np.where(part, na[:, None], top).min(0))
                    if (na == la).all() and (nb == lb).all():
                        break
                    la, lb = na, nb
                edge_a += [ids[rows], mi[cols]]
                edge_b += [la, lb]
            out_id.append(mi)
            out_n.append(gained)
        one = np.concatenate(out_id) if out_id else np.empty(0, np.int64)
        n = np.concatenate(out_n).astype(np.int64) if out_n else np.empty(0, np.int64)
        a = np.concatenate(edge_a) if edge_a else np.empty(0, np.int64)
        b = np.concatenate(edge_b) if edge_b else np.empty(0, np.int64)
        some, apart = n > 0, a != b
        return pd.DataFrame({"id": np.concatenate([one[some], a[apart]]), "linked": np.concatenate([n[some], np.zeros(apart.sum(), np.int64)]), "other": pd.array([None] * int(some.sum()) + b[apart].tolist(), dtype="Int64")})

    return run


def fit(valid: DataFrame, total: int, limit: float, recall: float, sample: int = 20_000, per_cell: int = 640) -> MultiIndex | None:
    """Codebooks from at most some ``sample`` vectors, picked by a hash of their ids; their size grows
    with the square root of the number of vectors, from 8 on, as far as the sample can fill them."""
    share = min(1.0, sample / max(total, 1))
    rows = valid.where(F.pmod(F.xxhash64("id", F.lit("index")), F.lit(1_000_003)) < share * 1_000_003).select("id", "x").collect()
    if not rows:
        rows = valid.select("id", "x").limit(1).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["id"])
    return MultiIndex(np.array([r["x"] for r in rows], np.float64), int(np.clip(np.sqrt(total / per_cell), 8, max(8, len(rows) // 10))), limit, recall)


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = 0.93, recall: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per vector.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
    label, link with nothing; labels may be of any type that has a text form. Vectors link only with others of their length; ``recall`` holds for the
    lengths that have an index, of the others every link is found. Equal vectors of a label are linked.
    Rows with a null id are left out, ids must be distinct; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).cast("string").alias("label")).where("id is not null")
    sound = F.expr("x is not null and label is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('inf')) and exists(x, v -> v <> 0)")
    every = rows.select("id")
    # rows at the largest float magnitudes overflow a norm unless they are scaled; a cosine does not change
    valid = rows.where(sound).withColumn("x", F.expr("transform(x, v -> v / array_max(transform(x, u -> abs(u))))"))
    classes = scratch.save(valid.groupBy("label", "x").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "classes")
    sizes = classes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.sum("weight").alias("rows")).orderBy(F.desc("rows"), "d").collect()
    if not sizes:
        return every.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    members = scratch.save(valid.join(classes.select("label", "x", F.col("id").alias("rep"), "weight"), ["label", "x"]).select("id", "rep", "weight"), "members")
    indexes, base = {}, 0
    for r in [sizes[0], *(r for r in sizes[1:] if r["n"] >= INDEXED)]:
        index = fit(classes.where(F.size("x") == r["d"]), r["n"], limit, recall)
        indexes[r["d"]] = (index, base)
        base += index.k[0]
    dealt = scratch.save(classes.select("id", "label", "x", "weight").mapInArrow(_deal(indexes), DEALT), "dealt")
    sides = dealt.groupBy("label", "grid").agg(F.ceil(F.sum(F.expr("int(role = 0)")) / MEMBERS).cast("int").alias("s"), F.ceil(F.sum("role") / PROBES).cast("int").alias("p")).where("s > 0 and p > 0")
    own, other = F.expr("pmod(xxhash64(id), if(role = 0, s, p))"), F.expr("sequence(0, if(role = 0, p, s) - 1)")
    tiles = dealt.join(sides, ["label", "grid"]).withColumn("own", own.cast("int")).withColumn("other", F.explode(other))
    tiles = tiles.withColumn("i", F.expr("if(role = 0, own, other)")).withColumn("j", F.expr("if(role = 0, other, own)"))
    found = scratch.save(tiles.select("label", "grid", "i", "j", "role", "id", "weight", "cell", "visits", "x").groupBy("label", "grid", "i", "j").applyInPandas(_meet(limit), FOUND), "found")
    scratch.drop(dealt)
    linked = found.where("other is null").groupBy("id").agg(F.sum("linked").alias("linked"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    reps = classes.select("id").join(linked, "id", "left").join(comp, F.col("id") == F.col("node"), "left").select(F.col("id").alias("rep"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "id").alias("component"))
    placed = members.join(reps, "rep").select(F.col("id").alias("member"), (F.col("linked") + F.col("weight") - 1).alias("n_links"), "component")
    return every.join(placed, F.col("id") == F.col("member"), "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )
