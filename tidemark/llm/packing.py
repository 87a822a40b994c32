"""Sequence packing by non-negative least squares over a histogram of piece lengths.

A document's ids are cut into full windows and one rest. The rests' histogram has fewer bins than a
window has tokens, whatever the input's size: shallow combinations of lengths that fill a window are
enumerated, ``min ||A x - h||`` over ``x >= 0`` gives their repeat counts, and these are rounded: whole
parts first, then one more each by the largest remainder, as far as the lengths last. What is left of
the histogram is solved again, until a turn places next to nothing; the residual is packed greedily. The
plan says which ranks of each length take which slot, so each piece finds its place from its length and
its rank alone.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, input_bytes
from .substring_dedup import sized
from .tokens import encoder, lean, slices


#: Lengths in a combination at most.
DEPTH = 5


def combinations(h: np.ndarray, window: int, most: int = 20_000, seed: int = 0) -> np.ndarray:
    """Rows of two to ``DEPTH`` lengths that fill the window but for 1 in 128 (0: no length), some ``most``
    of them. Every length that exists leads rows of each depth; what joins it is drawn as often as the
    histogram has it, and the last one is the largest that still fits."""
    there = np.flatnonzero(h)
    if not len(there):
        return np.zeros((0, DEPTH), np.int64)
    rng = np.random.default_rng(seed)
    below = np.zeros(window + 1, np.int64)  # the largest length that exists, up to each size
    below[there] = there
    below = np.maximum.accumulate(below)
    share = h[there] / h.sum()
    first = np.repeat(there, max(1, most // (len(there) * (DEPTH - 1))))
    out = []
    for depth in range(2, DEPTH + 1):
        rows, left = np.zeros((len(first), DEPTH), np.int64), window - first
        rows[:, 0] = first
        for k in range(1, depth - 1):
            rows[:, k] = np.minimum(rng.choice(there, len(first), p=share), below[left])
            left = left - rows[:, k]
        rows[:, depth - 1] = below[left]
        out.append(rows)
    out = np.unique(-np.sort(-np.concatenate(out), axis=1), axis=0)
    return out[out.sum(1) >= window - window // 128]


def nnls(columns: np.ndarray, h: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Repeat counts of the columns by accelerated projected gradient on ``||W (A x - h)||^2 / 2``."""
    n = len(columns)
    x = np.zeros(n)
    if not n:
        return x
    row, lengths = np.repeat(np.arange(n), columns.shape[1]), columns.ravel()
    row, lengths = row[lengths > 0], lengths[lengths > 0]
    forward = lambda v: weight * np.bincount(lengths, v[row], len(h))
    back = lambda r: np.bincount(row, (weight * r)[lengths], n)
    v = np.ones(n)
    for _ in range(10):  # the largest eigenvalue of A'A, from below
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    norm *= 1.05
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - weight * h) / norm)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


Shapes = list[tuple[list[int], int]]


def turns_of(h: np.ndarray, window: int, turns: int = 12) -> Iterator[tuple[Shapes, np.ndarray]]:
    """Filled windows ``(lengths, times)`` by the rounded solution, and the histogram that is left, after
    each turn."""
    left, shapes = h.copy(), []
    weight = np.arange(len(h)) / window  # a token more or less weighs the same at every length
    for turn in range(turns):
        columns = combinations(left, window, seed=turn)
        x = nnls(columns, left.astype(float), weight)
        whole = np.floor(x + 1e-9).astype(np.int64)
        ones, placed = np.ones(len(x), np.int64), 0
        for wanted, by in ((whole, x), (ones, x - whole)):
            for k in np.argsort(-by, kind="stable").tolist():
                if by[k] <= 1e-6 or not wanted[k]:
                    break
                lengths = columns[k][columns[k] > 0]
                own, uses = np.unique(lengths, return_counts=True)
                times = min(int(wanted[k]), int((left[own] // uses).min()))
                if times:
                    left[own] -= times * uses
                    shapes.append((lengths.tolist(), times))
                    placed += times * len(lengths)
        yield list(shapes), left.copy()
        if placed <= 0.01 * h.sum():
            break


def greedy(h: np.ndarray, window: int) -> Shapes:
    """Windows filled from the largest length that still fits, again and again."""
    left, shapes = h.copy(), []
    there = np.flatnonzero(left).tolist()
    while there:
        gap, lengths = window, []
        take: dict[int, int] = {}
        i = len(there)
        while i:
            i = bisect.bisect_right(there, gap, 0, i)
            if not i:
                break
            k = there[i - 1]
            fit = min(gap // k, int(left[k]))
            if fit:
                take[k] = fit
                lengths += [k] * fit
                gap -= k * fit
            i -= 1
        times = min(int(left[k]) // n for k, n in take.items())
        shapes.append((lengths, times))
        for k, n in take.items():
            left[k] -= n * times
            if not left[k]:
                there.remove(k)
    return shapes


def solve(h: np.ndarray, window: int) -> tuple[Shapes, Shapes]:
    """Windows of the solution and of the greedy residual, after as many turns as need the fewest
    windows together, so never more than the greedy packing alone needs."""
    best = ([], greedy(h, window))
    count = lambda shapes: sum(n for _, n in shapes)
    for shapes, left in turns_of(h, window):
        rest = greedy(left, window)
        if count(shapes) + count(rest) <= count(best[0]) + count(best[1]):
            best = (shapes, rest)
    return best


def plan(h: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Slots ``(length, first rank, ranks, first sequence, offset)``, by length and first rank, and
    the number of sequences. ``h[k]`` counts the pieces of length k; every piece gets a slot."""
    left = h.astype(np.int64).copy()
    full = int(left[window])
    left[window] = 0
    solved, rest = solve(left, window)
    shapes = [([window], full)] * (full > 0) + solved + rest
    rank = np.zeros(window + 1, np.int64)
    slots, sequence = [], 0
    for lengths, times in shapes:
        offset = 0
        for k in lengths:
            slots.append((k, rank[k], times, sequence, offset))
            rank[k] += times
            offset += k
        sequence += times
    out = np.array(slots, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequence


def _pieces(path: str, end_id: int, window: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, counts = enc.encode(batch.column(1).slice(a, b - a))
                raw, at = ids.astype("<u4"), np.concatenate([[0], np.cumsum(counts)])
                out, owner = [], []
                for i in range(b - a):
                    own = np.append(raw[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s : s + window].tobytes()
                        owner.append(a + i)
                        out.append((s, len(piece) // 4, zlib.crc32(piece), len(own), piece if with_ids else None))
                # the id column is taken as it is: a null stays null, and large ids keep their digits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:], strict=True))], schema=schema)

    return lean(run, keep=True)


def _placed(slots: np.ndarray, window: int):
    def run(batches):
        key = slots[:, 0] * (1 << 44) + slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            s = slots[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])], names=[*names, "sequence_id", "offset"])

    return lean(run)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and
    ``ids`` (little-endian unsigned 32-bit) if ``with_ids``.

    A null or empty text is its end id alone. Equal texts and ids are packed row by row; rows with a
    null id keep it. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = source.mapInArrow(_pieces(tokenizer, end_id, window, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = scratch.save(cut if with_ids else cut.drop("ids"), "pieces")
    # ranks of a length are counted within shares of it, so that no length is one task's
    shares = 16 + input_bytes(pieces) // (16 << 20)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)))
    cells = scratch.save(dealt.groupBy("length", "share").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")), "cells")
    h = np.zeros(window + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row per length
        h[r["length"]] = r["n"]
    slots, _ = plan(h, window)
    order = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(sized(cells.select("length", "share", "before"), 48), ["length", "share"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = ranked.select(*names, (F.col("rank") - 1 + F.col("before")).cast("long").alias("rank"))
    kinds = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return ranked.mapInArrow(_placed(slots, window), f"{kinds}, sequence_id long, offset long")
