"""Correlations from partial Gram matrices, rank correlations, and drift of pairs.

Partitions of a wide table give sums over each pair of columns (over rows where both are present), so
the shuffle is one row per pair and partition, whatever the number of rows. A partition's sums are about
its own first row of each run, and are moved to the run's common centre when they are added up.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.expressions import ess
from ..functions.stats import normal_p
from ..sources.tables import written
from .obs import to_wide
from .positions import positions

#: Of a pair of columns: rows with both, and their means, sums of squares and of products about the means.
MOMENTS = "n double, mx double, my double, sxx double, syy double, sxy double"
GRAM = f"run_id string, i int, j int, {MOMENTS}"


def _gram(width: int, by_run: bool):
    upper = np.triu_indices(width, 1)

    def run(batches):
        sums: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            x = np.where(np.isfinite(x), x, np.nan)  # an infinite value counts as missing
            coded = batch.column("run_id").dictionary_encode() if by_run else None
            keys = coded.indices.fill_null(-1).to_numpy() if by_run else None
            for code in np.unique(keys) if by_run else [None]:
                key = coded.dictionary[code].as_py() if by_run and code >= 0 else None
                own = x[keys == code] if by_run else x
                if key not in sums:
                    with np.errstate(all="ignore"):
                        centre = np.nan_to_num(np.array([c[~np.isnan(c)].mean() if (~np.isnan(c)).any() else 0.0 for c in own.T]))
                    sums[key] = (centre, np.zeros((6, len(upper[0]))))
                centre, total = sums[key]
                valid = ~np.isnan(own)
                v, m = np.where(valid, own - centre, 0.0), valid.astype(float)
                total += np.stack([(m.T @ m)[upper], (v.T @ m)[upper], (m.T @ v)[upper], ((v * v).T @ m)[upper], (m.T @ (v * v))[upper], (v.T @ v)[upper]])
        for key, (centre, (n, sx, sy, sxx, syy, sxy)) in sums.items():
            some = np.maximum(n, 1)
            out = (n, sx / some + centre[upper[0]], sy / some + centre[upper[1]], sxx - sx * sx / some, syy - sy * sy / some, sxy - sx * sy / some)
            yield pa.record_batch({"run_id": pa.array([key] * len(n), pa.string()), "i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), **dict(zip(("n", "mx", "my", "sxx", "syy", "sxy"), out, strict=True))})

    return run


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments added up by key: each part's are moved to the common means."""
    n = F.nullif(F.sum("n"), F.lit(0.0))
    centre = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mx")) / n).alias("cx"), (F.sum(F.col("n") * F.col("my")) / n).alias("cy"))
    dx, dy, w = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy"), F.col("n")
    return parts.join(centre, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("cx").alias("mx"), F.max("cy").alias("my"), F.sum(F.col("sxx") + w * dx * dx).alias("sxx"), F.sum(F.col("syy") + w * dy * dy).alias("syy"), F.sum(F.col("sxy") + w * dx * dy).alias("sxy")
    )


def variables_of(obs: DataFrame) -> list[str]:
    """Variables in column order; there are as many as columns."""
    return [r["variable"] for r in obs.select("variable", "var_pos").distinct().orderBy("var_pos", "variable").collect()]


def gram_table(arrays: DataFrame, names: list[str], by_run: bool = False) -> DataFrame:
    """From ``run_id, x`` (an array with a value or null per name): ``[run_id,] var_a, var_b`` and moments."""
    parts = arrays.select("run_id", "x").mapInArrow(_gram(len(names), by_run), GRAM)
    keys = ["run_id"] * by_run
    label = F.array(*map(F.lit, names))
    named = parts.select(*keys, label[F.col("i")].alias("var_a"), label[F.col("j")].alias("var_b"), "n", "mx", "my", "sxx", "syy", "sxy")
    return merged(named, [*keys, "var_a", "var_b"])


def pearson_of(gram: DataFrame) -> DataFrame:
    """Moments to ``[run_id,] var_a, var_b, r, n_pair``; r is null without spread."""
    vx, vy = F.col("sxx"), F.col("syy")
    moves = lambda v, m: v > F.greatest(1e-28 * F.col("n") * F.col(m) * F.col(m), F.lit(1e-300))  # noqa: E731 (beyond rounding of the mean)
    spread = (F.col("n") > 1) & moves(vx, "mx") & moves(vy, "my")
    r = F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))), F.lit(0.0)))))
    return gram.select(*[c for c in ("run_id",) if c in gram.columns], "var_a", "var_b", r.alias("r"), F.col("n").cast("long").alias("n_pair"))


def gram_pearson(arrays: DataFrame, names: list[str], by_run: bool = False) -> DataFrame:
    """From ``run_id, x`` to ``[run_id,] var_a, var_b, r, n_pair``."""
    return pearson_of(gram_table(arrays, names, by_run))


def run_gram(obs: DataFrame) -> DataFrame:
    """Moments of each run's pairs, in one pass over the observations."""
    names = variables_of(obs)
    if not names:
        return obs.sparkSession.createDataFrame([], f"run_id string, var_a string, var_b string, {MOMENTS}")
    return gram_table(arrays_of(obs, names), names, by_run=True)


def gram_pearson_parts(grams: DataFrame) -> DataFrame:
    """Pooled moments from those of the runs."""
    return merged(grams, ["var_a", "var_b"])


def arrays_of(obs: DataFrame, names: list[str]) -> DataFrame:
    wide = to_wide(obs.withColumn("sample", F.col("seq")), names)
    return wide.select("run_id", F.array(*(F.col(f"`{v}`") for v in names)).alias("x"))


def pearson(obs: DataFrame, by_run: bool = False) -> DataFrame:
    """Pairwise-complete Pearson correlations, pooled over runs or of each run; none without a row."""
    names = variables_of(obs)
    if not names:
        return obs.sparkSession.createDataFrame([], "run_id string, " * by_run + "var_a string, var_b string, r double, n_pair long")
    return gram_pearson(arrays_of(obs, names), names, by_run)


#: A value is common that as large a share of all values equals: there are as many at most.
COMMON = 10_000


def average_ranks(obs: DataFrame, parts: int = 64) -> DataFrame:
    """Values replaced by their average rank within their variable. Equal values cost one row, and each
    variable's distinct values are dealt by approximate quantiles, so a variable is ranked by many tasks: a rank is
    a running count inside its part after the counts of the parts before it. The ranks of common values are a
    small table that the planner knows to be small; only rows of the others, each of which few rows hold, are
    shuffled by their values."""
    counts = obs.where("value is not null").groupBy("variable", "value").agg(F.count("*").alias("k"))
    counts = written(counts, "counts")
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    bounds = written(counts.groupBy("variable").agg(F.percentile_approx("value", shares, 1000).alias("bounds")), "bounds")
    dealt = counts.join(bounds, "variable").withColumn("part", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds")
    sizes = dealt.groupBy("variable", "part").agg(F.sum("k").alias("n"))
    before = sizes.select("variable", "part", (F.sum("n").over(Window.partitionBy("variable").orderBy("part")) - F.col("n")).alias("before"))
    before = written(before, "before")
    upto = Window.partitionBy("variable", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = dealt.withColumn("upto", F.sum("k").over(upto)).join(before, ["variable", "part"]).select("variable", "value", (F.col("before") + F.col("upto") - (F.col("k") - 1) / 2.0).alias("rank"), "k")
    ranks = written(ranks, "ranks")
    common = F.col("k") >= (counts.agg(F.sum("k")).first()[0] or 0) / COMMON
    found = obs.join(written(ranks.where(common).drop("k"), "common"), ["variable", "value"], "left")
    rest = found.where("rank is null").drop("rank").join(ranks.where(~common).drop("k"), ["variable", "value"], "left")
    return found.where("rank is not null").unionByName(rest).withColumn("value", F.col("rank")).drop("rank")


def spearman(obs: DataFrame) -> DataFrame:
    """Pairwise-complete rank correlations, pooled. With missing values each pair is ranked anew."""
    obs = written(obs.select("run_id", "seq", "variable", "var_pos", "value"), "obs")
    names = variables_of(obs)
    if not names:
        return pearson(obs)
    if not obs.where("value is null").isEmpty():
        a = obs.select("run_id", "seq", F.col("variable").alias("var_a"), F.col("var_pos").alias("pa"), F.col("value").alias("x")).where("x is not null")
        b = obs.select("run_id", "seq", F.col("variable").alias("var_b"), F.col("var_pos").alias("pb"), F.col("value").alias("y")).where("y is not null")
        both = a.join(b, ["run_id", "seq"]).where("pa < pb")
        rank = lambda c: F.rank().over(Window.partitionBy("var_a", "var_b").orderBy(c)) + (F.count("*").over(Window.partitionBy("var_a", "var_b", c)) - 1) / 2.0
        ranked = both.select("var_a", "var_b", rank("x").alias("x"), rank("y").alias("y"))
        sums = ranked.groupBy("var_a", "var_b").agg((F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))).alias("r"), F.count("*").alias("n_pair"))
        return sums
    return gram_pearson(arrays_of(average_ranks(obs), names), names)


#: Points of a task that counts inversions.
SPAN = 1 << 18


def inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Of a sequence of distinct ranks: the sum of products of weights over pairs that stand the wrong way
    round, by merging sorted runs of doubling length."""
    n, width, total = len(rank), 1, 0
    order = np.arange(n)
    rank, weight = rank.copy(), weight.astype(object if float(weight.sum()) ** 2 > 2**62 else np.int64)
    while width < n:
        block = order // (2 * width)
        # ranks sorted within each pair of runs; a member of the right run passes all larger ones of the left
        left = (order // width) % 2 == 0
        merged = np.lexsort((rank, block))
        ahead = np.where(left[merged], weight[merged], 0)
        upto = np.cumsum(ahead)
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        ends = np.repeat(upto[edges[1:] - 1], np.diff(edges))
        right = ~left[merged]
        total += int(((ends - upto)[right] * weight[merged][right]).sum())
        rank, weight = rank[merged], weight[merged]
        width *= 2
    return total


def _wrong_way(order: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        found = inversions(pdf["py"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64))
        return pd.DataFrame({"var_a": [pdf["var_a"].iloc[0]], "var_b": [pdf["var_b"].iloc[0]], "wrong": [Decimal(found)]})

    return run


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a pair's counts by part of x and part of y: pairs of an earlier x part and a later y part."""
    cells = np.zeros((pdf["i"].max() + 1, pdf["j"].max() + 1), object)
    cells[pdf["i"], pdf["j"]] = [int(w) for w in pdf["w"]]
    beyond = np.cumsum(np.cumsum(cells[::-1], axis=0)[::-1], axis=1)  # counts of i or later, j or earlier
    found = int((cells[:-1, 1:] * beyond[1:, :-1]).sum())
    return pd.DataFrame({"var_a": [pdf["var_a"].iloc[0]], "var_b": [pdf["var_b"].iloc[0]], "wrong": [Decimal(found)]})


WRONG = "var_a string, var_b string, wrong decimal(38,0)"


def kendall(obs: DataFrame) -> DataFrame:
    """Kendall's tau-b of each pair of variables, pooled, over values that both have.

    Equal points count once with a weight. Points have a place in the order of (x, y) and one in that of
    (y, x), so ties never stand the wrong way round; both orders are cut in parts of ``SPAN``. Discordant
    pairs inside a part of x are counted there, those of different parts of x and one part of y there, and
    the rest follows from the counts of points by both parts, so a pair of variables is many tasks'."""
    pair = ["var_a", "var_b"]
    a = obs.where("value is not null").select("run_id", "seq", F.col("variable").alias("var_a"), F.col("var_pos").alias("pa"), F.col("value").alias("x"))
    b = obs.where("value is not null").select("run_id", "seq", F.col("variable").alias("var_b"), F.col("var_pos").alias("pb"), F.col("value").alias("y"))
    points = a.join(b, ["run_id", "seq"]).where("pa < pb").groupBy(*pair, (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.count("*").alias("w"))
    placed = positions(positions(points, pair, ["x", "y"], "px"), pair, ["y", "x"], "py")
    placed = written(placed.withColumn("i", F.floor(F.col("px") / SPAN)).withColumn("j", F.floor(F.col("py") / SPAN)), "places")
    columns = [*pair, "i", "px", "py", "w"]
    inside = placed.groupBy(*pair, "i").applyInPandas(lambda pdf: _wrong_way(["px"])(pdf), WRONG)
    beside = placed.select(*columns, "j").groupBy(*pair, "j").applyInPandas(lambda pdf: _wrong_way(["i", "py"])(pdf), WRONG)
    across = placed.groupBy(*pair, "i", "j").agg(F.sum("w").alias("w")).groupBy(*pair).applyInPandas(_across, WRONG)
    wrong = inside.union(beside).union(across).groupBy(*pair).agg(F.sum("wrong").alias("wrong"))
    two = F.sum(F.col("w").cast("decimal(18,0)") * (F.col("w") - 1).cast("decimal(18,0)") / 2).cast("double")
    ties = lambda name, *by: placed.groupBy(*pair, *by).agg(F.sum("w").alias("w")).groupBy(*pair).agg(two.alias(name))
    every = ties("all").join(placed.groupBy(*pair).agg(F.sum("w").alias("n_pair")), pair)
    for name, by in (("tx", ["x"]), ("ty", ["y"]), ("txy", ["x", "y"])):
        every = every.join(ties(name, *by), pair)
    c = F.col
    below = F.sqrt((c("all") - c("tx")) * (c("all") - c("ty")))
    tau = (c("all") - c("tx") - c("ty") + c("txy") - 2 * c("wrong").cast("double")) / F.nullif(below, F.lit(0.0))
    return every.join(wrong, pair).select(*pair, tau.alias("tau"), "n_pair")


def both_ways(corr: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    return corr.select("var_a", "var_b", "r").union(corr.select(F.col("var_b"), F.col("var_a"), "r"))


def top_partners(corr: DataFrame, most: int = 8) -> DataFrame:
    ranked = both_ways(corr).where("r is not null").withColumn("rank", F.row_number().over(Window.partitionBy("var_a").orderBy(F.desc(F.abs("r")), "var_b")))
    return ranked.where(F.col("rank") <= most)


def strongest_pairs(corr: DataFrame, most: int = 15) -> DataFrame:
    return corr.where("r is not null").orderBy(F.desc(F.abs("r")), "var_a", "var_b").limit(most)


def heatmap_variables(corr: DataFrame, n_vars: int, most: int = 30) -> DataFrame:
    """Variables by their mean absolute correlation; a variable's own cell counts as 0."""
    return both_ways(corr).groupBy(F.col("var_a").alias("variable")).agg((F.sum(F.abs("r")) / n_vars).alias("mean_abs_r")).orderBy(F.desc("mean_abs_r"), "variable").limit(most)


def distances(corr: DataFrame) -> DataFrame:
    return corr.select("var_a", "var_b", F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col("r")))).alias("distance"))


def undefined_variables(corr: DataFrame) -> DataFrame:
    """Variables with an undefined correlation."""
    return both_ways(corr).where("r is null").select(F.col("var_a").alias("variable")).distinct()


def pair_drift(run_corr: DataFrame, pooled: DataFrame, sizes: DataFrame, base: DataFrame, t: Thresholds = Thresholds(), p_values: bool = False) -> DataFrame:
    """Fisher's z test of each run's pairs against the pooled ones. Effective sizes use the product of
    both variables' lag-1 correlations. In a run, rows count whether missing or not, and a variable with a
    missing value has lag-1 correlation 0, as in the results to match; counts are the first variable's."""
    from ..functions.stats import z_critical

    pair = run_corr.join(pooled.select("var_a", "var_b", F.col("r").alias("r0")), ["var_a", "var_b"])
    own = sizes.select("run_id", "variable", F.when(F.col("n") == F.col("n_rows"), F.col("rho1")).otherwise(0.0).alias("rho1"), F.col("n_rows").alias("n"))
    pair = pair.join(own.select("run_id", F.col("variable").alias("var_a"), F.col("rho1").alias("ra"), F.col("n").alias("n_run")), ["run_id", "var_a"]).join(own.select("run_id", F.col("variable").alias("var_b"), F.col("rho1").alias("rb")), ["run_id", "var_b"])
    known = base.select("variable", "mean_rho1", "pooled_n")
    pair = pair.join(known.select(F.col("variable").alias("var_a"), F.col("mean_rho1").alias("ma"), F.col("pooled_n").alias("n0")), "var_a").join(known.select(F.col("variable").alias("var_b"), F.col("mean_rho1").alias("mb")), "var_b")
    e1, e0 = ess(F.col("n_run"), F.col("ra") * F.col("rb")), ess(F.col("n0"), F.col("ma") * F.col("mb"))
    fisher = lambda r: F.atanh(F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col(r))))
    pair = pair.withColumn("e1", e1).withColumn("e0", e0)
    usable = (F.col("e1") > 3) & (F.col("e0") > 3)
    z = F.when(usable, (fisher("r") - fisher("r0")) / F.sqrt(1 / F.nullif(F.col("e1") - 3, F.lit(0.0)) + 1 / F.nullif(F.col("e0") - 3, F.lit(0.0))))
    out = pair.where("r is not null and r0 is not null").withColumn("z_stat", z).withColumn("drifted", F.coalesce(F.abs("z_stat") > z_critical(t.corr_alpha), F.lit(False)))
    out = out.select("run_id", "var_a", "var_b", "r", "r0", "z_stat", "drifted")
    return out.withColumn("p_value", F.coalesce(normal_p("z_stat"), F.lit(1.0))) if p_values else out


def frobenius(pairs: DataFrame) -> DataFrame:
    """Per run: distance of the correlation matrices over the pairs that both define."""
    return pairs.groupBy("run_id").agg(F.sqrt(2 * F.sum(F.pow(F.col("r") - F.col("r0"), F.lit(2)))).alias("frobenius"), F.count("*").alias("n_pairs")).withColumn("per_pair", F.col("frobenius") / F.col("n_pairs"))


def top_drifted(pairs: DataFrame, most: int = 20) -> DataFrame:
    ranked = pairs.where("z_stat is not null").withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(F.round(F.abs("z_stat"), 4)), "var_a", "var_b")))
    return ranked.where(F.col("rank") <= most)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramér's V of two categorical columns (rows with both present): ``col_a, col_b, v``; null where a
    column has one value."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    sides = cells.join(cells.groupBy("a").agg(F.sum("n").alias("na")), "a").join(cells.groupBy("b").agg(F.sum("n").alias("nb")), "b")
    found = sides.agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.least(F.countDistinct("a"), F.countDistinct("b")).alias("k"))
    return found.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / F.nullif(F.col("k") - 1, F.lit(0))).alias("v"))
