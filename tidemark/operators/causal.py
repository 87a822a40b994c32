"""Lagged causal links (PCMCI with partial correlations) and their aggregation over runs.

The algorithm follows Runge et al., Science Advances 5 (2019): a PC step finds each variable's lagged
parents, the MCI step tests every link given both sides' parents. All its tests are partial correlations
of lagged variables, so it needs no rows: parts of runs give sums of products of the lagged variables,
which are added up by run (or over all runs), and the search works on those sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.stats import t_two_sided
from ..sources.tables import written
from .series import with_places_before

LINKS = "run_id string, src string, tgt string, tau int, val double, pval double"


class Moments:
    """Correlations of variables at lags from 0 to ``2 * tau_max``, from sums over places."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, n_vars: int):
        self.n, self.n_vars = n, n_vars
        cov = products - np.outer(sums, sums) / max(n, 1)
        size = np.sqrt(np.maximum(np.diag(cov), 0))
        self.flat = size <= 1e-10 * np.sqrt(np.maximum(np.diag(products), 1e-300))
        size = np.where(self.flat, 1.0, size)
        self.corr = cov / np.outer(size, size)

    def partial(self, target: int, others: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Partial correlations of lagged variable ``target`` with each of ``others``, given the same variables:
        one factorisation serves them all. 0 where nothing is left of a side."""
        at = np.concatenate([[target], others]).astype(np.int64)
        cov, var = self.corr[target, others], np.ones(len(at))
        if len(given):
            within, across = self.corr[np.ix_(given, given)], self.corr[np.ix_(given, at)]
            try:
                half = np.linalg.cholesky(within)
                sound = half.diagonal().min() > 1e-5
            except np.linalg.LinAlgError:
                sound = False
            if sound:
                y = np.linalg.solve(half, across)
                var, cov = var - (y * y).sum(0), cov - y[:, 0] @ y[:, 1:]
            else:
                fit = np.linalg.lstsq(within, across, rcond=1e-12)[0]
                var, cov = var - (across * fit).sum(0), cov - across[:, 0] @ fit[:, 1:]
        lost = (var[1:] < 1e-12) | (var[0] < 1e-12) | self.flat[others] | self.flat[target]
        r = cov / np.sqrt(np.where(lost, 1.0, np.maximum(var[0] * var[1:], 1e-300)))
        return np.where(lost, 0.0, np.clip(r, -1, 1))

    def p_values(self, r: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Two-sided, for partial correlations given so many variables."""
        r, df = np.broadcast_arrays(np.asarray(r, float), self.n - 2 - np.asarray(given))
        exact = np.abs(r) >= 1 - 1e-15
        t = np.where(exact, 0.0, r) * np.sqrt(np.maximum(df, 1) / (1 - np.where(exact, 0.0, r) ** 2))
        return np.where((df < 1) | (r == 0), 1.0, np.where(exact, 0.0, t_two_sided(t, np.maximum(df, 1))))


def parents(panel: Moments, j: int, tau_max: int, alpha: float) -> np.ndarray:
    """Lagged parents of a variable (as ``tau * n_vars + i``), strongest first.

    In the round of size s a candidate is tested given the s strongest others: for all candidates that are
    not among these, that is one set, and one factorisation."""
    left = np.array([tau * panel.n_vars + i for i in range(panel.n_vars) for tau in range(1, tau_max + 1)], np.int64)
    weakest, size = np.full(len(left), np.inf), 0
    while len(left) > size:
        val = np.empty(len(left))
        val[size:] = panel.partial(j, left[size:], left[:size])
        for k in range(size):
            val[k] = panel.partial(j, left[k : k + 1], np.delete(left[: size + 1], k))[0]
        weakest = np.minimum(weakest, np.abs(val))
        kept = panel.p_values(val, size) <= alpha
        left, weakest = left[kept], weakest[kept]
        order = np.argsort(-weakest, kind="stable")
        left, weakest, size = left[order], weakest[order], size + 1
    return left


def momentary(panel: Moments, j: int, known: list[np.ndarray], tau_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every link into a variable, given both sides' parents: sources, lags, values and p-values."""
    n, last = panel.n_vars, 2 * tau_max
    source, lag, val, given = [], [], [], []
    for i in range(n):
        for tau in range(tau_max + 1):
            if i == j and tau == 0:
                continue
            own = tau * n + i
            shifted = known[i] + tau * n
            sets = np.concatenate([known[j], shifted[(shifted // n <= last) & (shifted != j)]])
            sets = np.unique(sets[sets != own])
            source.append(i)
            lag.append(tau)
            given.append(len(sets))
            val.append(panel.partial(j, np.array([own]), sets)[0])
    val, given = np.array(val), np.array(given)
    return np.array(source), np.array(lag), val, panel.p_values(val, given)


#: Places of a run that one task turns into sums, and sums that one task adds up.
PART, FAN_IN = 1 << 16, 256
#: Places whose lagged values are laid out at a time, and targets of a task of the search.
CHUNK, TARGETS = 4096, 8
SUMS = "run_id string, part long, n long, sums binary, products binary"


def usable(obs: DataFrame) -> list[str]:
    """The variables in column order, without those that have five values or fewer, or no spread over all runs."""
    sizes = obs.groupBy("variable").agg(F.min("var_pos").alias("var_pos"), F.count("value").alias("n"), F.stddev_pop("value").alias("sd"))
    return [r["variable"] for r in sizes.where("n > 5 and sd > 1e-12").orderBy("var_pos", "variable").collect()]  # a row per variable


def _arrays(obs: DataFrame, names: list[str]) -> DataFrame:
    """``run_id, seq, x``: a row per place, its values in the names' order."""
    x = F.array(*(F.max(F.when(F.col("variable") == v, F.col("value"))) for v in names))
    return obs.where(F.col("variable").isin(names)).groupBy("run_id", "seq").agg(x.alias("x"))


def _usable_arrays(arrays: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """``arrays`` with the usable ones of its variables, and their names."""
    at = [F.col("x")[i] for i in range(len(names))]
    row = arrays.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(at)), *(F.stddev_pop(v).alias(f"sd{i}") for i, v in enumerate(at))).first()
    kept = [i for i in range(len(names)) if row[f"n{i}"] > 5 and (row[f"sd{i}"] or 0) > 1e-12]
    return arrays.select("run_id", "seq", F.array(*(at[i] for i in kept)).alias("x")), [names[i] for i in kept]


def lagged_sums(obs: DataFrame, names: list[str], tau_max: int, impute: bool = True) -> DataFrame:
    """``lagged_sums_of`` the variables ``names`` of ``obs``."""
    return lagged_sums_of(_arrays(obs, names), len(names), tau_max, impute)


def lagged_sums_of(arrays: DataFrame, width: int, tau_max: int, impute: bool = True) -> DataFrame:
    """``run_id, part, n, sums, products`` of the variables at lags 0 to ``2 * tau_max``, about their means
    in the run. A missing value takes the run's mean, or (not ``impute``) leaves out the places whose lags
    reach it. A part brings the places before it along, so parts and runs add up.

    The means are written, so that their size is known before they are joined: while it is small, rows are
    dealt to parts of runs and never to whole runs."""
    back = 2 * tau_max
    means = written(arrays.groupBy("run_id").agg(F.array(*(F.avg(F.col("x")[i]) for i in range(width))).alias("__mean"), F.count("*").alias("__n")), "means")
    n_rows = means.agg(F.sum("__n")).first()[0] or 0  # of a row per run
    apart = (F.col("x")[i] - F.col("__mean")[i] for i in range(width))
    centred = F.array(*(F.coalesce(v, F.lit(0.0)) for v in apart)) if impute else F.array(*apart)
    rows = arrays.join(means, "run_id").select("run_id", "seq", centred.alias("x"))

    def sums(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["seq"].to_numpy())
        first = rows["part"][0].as_py() * PART
        v = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), width)[order]
        begin = max(back, int((rows["seq"].to_numpy() < first).sum()))
        n, total, products = 0, np.zeros(width * (back + 1)), np.zeros((width * (back + 1),) * 2)
        for lo in range(begin, len(v), CHUNK):
            hi = min(lo + CHUNK, len(v))
            z = np.concatenate([v[lo - lag : hi - lag] for lag in range(back + 1)], axis=1)
            z = z[~np.isnan(z).any(1)]
            n, total, products = n + len(z), total + z.sum(0), products + z.T @ z
        return pa.table({"run_id": rows["run_id"][:1], "part": rows["part"][:1], "n": pa.array([n], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary()), "products": pa.array([products.tobytes()], pa.binary())})

    return with_places_before(rows, back, PART, n_rows).groupBy("run_id", "part").applyInArrow(sums, SUMS)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums added up by key, ``FAN_IN`` or so at a time, so that no task holds many."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: np.sum([np.frombuffer(b) for b in pdf[c]], axis=0).tobytes()
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [pdf["n"].sum()], "sums": [total("sums")], "products": [total("products")]})

    few = parts.withColumn("part", F.pmod(F.xxhash64("run_id", F.floor(F.col("part") / FAN_IN)), F.lit(FAN_IN)) if not keys else F.floor(F.col("part") / FAN_IN))
    some = few.groupBy(*keys, "part").applyInPandas(add, SUMS)
    return some.groupBy(*keys).applyInPandas(add, SUMS) if keys else some.withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInPandas(add, SUMS)


def _search(added: DataFrame, names: list[str], t: Thresholds) -> DataFrame:
    """The sums of a run go to a task for each ``TARGETS`` variables: first for their parents, then, with the
    parents of all variables, for the links into them."""
    n, size = len(names), len(names) * (2 * t.tau_max + 1)
    shares = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // TARGETS)))
    added = written(added.where(F.col("n") + 2 * t.tau_max >= t.tau_max + 5).select("run_id", "n", "sums", "products"), "lagged")
    dealt = added.withColumn("share", shares)

    def panel(r) -> Moments:
        return Moments(int(r.n), np.frombuffer(r.sums), np.frombuffer(r.products).reshape(size, size), n)

    def targets(r) -> range:
        return range(r.share * TARGETS, min(n, (r.share + 1) * TARGETS))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.run_id, j, parents(own, j, t.tau_max, t.pc_alpha).tobytes()) for r in pdf.itertuples() for own in [panel(r)] for j in targets(r)]
        return pd.DataFrame(rows, columns=["run_id", "j", "parents"])

    def links_into(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            own, known = panel(r), [np.frombuffer(p["parents"], np.int64) for p in sorted(r.known, key=lambda p: p["j"])]
            for j in targets(r):
                source, lag, val, p = momentary(own, j, known, t.tau_max)
                rows += [(r.run_id, names[source[k]], names[j], int(lag[k]), float(val[k]), float(p[k])) for k in np.flatnonzero(p < t.link_alpha)]
        return pd.DataFrame(rows, columns=["run_id", "src", "tgt", "tau", "val", "pval"])

    found = dealt.groupBy("run_id", "share").applyInPandas(find, "run_id string, j int, parents binary")
    known = found.groupBy("run_id").agg(F.collect_list(F.struct("j", "parents")).alias("known"))
    return added.join(written(known, "parents"), "run_id").withColumn("share", shares).groupBy("run_id", "share").applyInPandas(links_into, LINKS)


def links(obs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Significant links of each run: ``run_id, src, tgt, tau, val, pval``. Missing values take the
    run's mean; variables with five values or fewer, or without spread over all runs, are left out;
    runs shorter than ``tau_max + 5`` give no row."""
    names = usable(obs)
    return _found(_arrays(obs, names) if names else obs, names, t, by_run=True)


def links_of(arrays: DataFrame, names: list[str], t: Thresholds = Thresholds()) -> DataFrame:
    """As ``links``, from the wide form ``run_id, seq, x`` (an array with a value or null per name), which saves
    a pivot."""
    return _found(*_usable_arrays(arrays, names), t, by_run=True)


def pooled_links(obs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Links of all runs as one series: ``src, tgt, tau, val, pval``. No place is tested whose lags reach
    over the start of a run or a missing value, so runs are masked from one another."""
    names = usable(obs)
    return _found(_arrays(obs, names) if names else obs, names, t, by_run=False)


def pooled_links_of(arrays: DataFrame, names: list[str], t: Thresholds = Thresholds()) -> DataFrame:
    """As ``pooled_links``, from the wide form."""
    return _found(*_usable_arrays(arrays, names), t, by_run=False)


def _found(arrays: DataFrame, names: list[str], t: Thresholds, by_run: bool) -> DataFrame:
    if names:
        sums = lagged_sums_of(arrays, len(names), t.tau_max, impute=by_run)
        found = _search(_added(sums, ["run_id"] if by_run else []), names, t)
    else:
        found = arrays.sparkSession.createDataFrame([], LINKS)
    return found if by_run else found.drop("run_id")


def run_status(obs: DataFrame, found: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    sizes = obs.groupBy("run_id").agg((F.max("seq") + 1).alias("n_samples"))
    counts = found.groupBy("run_id").agg(F.count("*").alias("n_significant"))
    short = F.col("n_samples") < t.tau_max + 5
    return sizes.join(counts, "run_id", "left").select("run_id", F.when(short, "skipped").otherwise("ok").alias("status"), "n_samples", F.coalesce("n_significant", F.lit(0)).alias("n_significant"))


def link_frequency(found: DataFrame) -> DataFrame:
    """Per link: runs where it is significant, and its mean value and p-value over those."""
    return found.groupBy("src", "tgt", "tau").agg(F.count("*").alias("n_runs"), F.avg("val").alias("mean_val"), F.avg("pval").alias("mean_pval"))


def lag_profile(found: DataFrame) -> DataFrame:
    """Per pair and lag: frequency, mean and spread of the absolute value."""
    return found.groupBy("src", "tgt", "tau").agg(F.count("*").alias("freq"), F.avg(F.abs("val")).alias("mean_abs"), F.stddev_pop(F.abs("val")).alias("sd_abs"))


def top_links(freq: DataFrame, most: int = 20) -> DataFrame:
    """The links of most runs."""
    return freq.orderBy(F.desc("n_runs"), "src", "tgt", "tau").limit(most)


def top_lag_profiles(found: DataFrame, most: int = 10) -> DataFrame:
    """The pairs whose most frequent lag most runs have."""
    return lag_arrays(found).orderBy(F.desc("max_freq"), "src", "tgt").limit(most)


def lag_arrays(found: DataFrame) -> DataFrame:
    return lag_profile(found).groupBy("src", "tgt").agg(F.sort_array(F.collect_list(F.struct("tau", "freq", "mean_abs", "sd_abs"))).alias("lags"), F.max("freq").alias("max_freq"))


def consensus(freq: DataFrame, n_runs: int, share: float = 1.0) -> DataFrame:
    """Links of at least ``share`` of the runs."""
    return freq.withColumn("consensus", F.col("n_runs") >= math.ceil(share * n_runs))


def summary(links: DataFrame) -> DataFrame:
    """Counts of a ``consensus`` table."""
    return links.agg(F.count("*").alias("n_links"), F.count_if("consensus").alias("n_consensus"), F.count_if(~F.col("consensus")).alias("n_other"))


def majority(freq: DataFrame, total: int) -> DataFrame:
    return freq.where((F.col("n_runs") / total >= 0.5) & (F.col("src") != F.col("tgt")))


def degrees(freq: DataFrame) -> DataFrame:
    """Per variable: links out and in (each lag counts), and its partners."""
    out = freq.groupBy(F.col("src").alias("variable")).agg(F.count("*").alias("out_degree"), F.sort_array(F.collect_set("tgt")).alias("targets"))
    into = freq.groupBy(F.col("tgt").alias("variable")).agg(F.count("*").alias("in_degree"), F.sort_array(F.collect_set("src")).alias("sources"))
    both = out.join(into, "variable", "full")
    none = F.array().cast("array<string>")
    return both.select("variable", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("targets", none).alias("targets"), F.coalesce("sources", none).alias("sources"))


def consensus_graph(freq: DataFrame, n_runs: int, least: float = 0.5) -> DataFrame:
    """Edges to draw: links of all runs with a mean of at least ``least``; two lag-0 directions are one
    undirected kind of edge."""
    kept = freq.where((F.col("n_runs") >= n_runs) & (F.abs("mean_val") >= least))
    back = kept.where("tau = 0").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.lit(True).alias("both"))
    return kept.join(back, ["src", "tgt"], "left").select("src", "tgt", "tau", "mean_val", F.when((F.col("tau") == 0) & F.coalesce("both", F.lit(False)), "o-o").otherwise("-->").alias("kind"))


def strongest_self(freq: DataFrame) -> DataFrame:
    """Each variable's strongest link to itself."""
    own = freq.where("src = tgt").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.abs("mean_val")), "tau")))
    return own.where("k = 1").select(F.col("src").alias("variable"), "tau", "mean_val")


def implicated(freq: DataFrame, variables: DataFrame) -> DataFrame:
    """Links whose ends are both among the given variables (two semi joins)."""
    return freq.join(variables.select(F.col("variable").alias("src")), "src", "left_semi").join(variables.select(F.col("variable").alias("tgt")), "tgt", "left_semi")


def implicated_by_run(freq: DataFrame, found: DataFrame) -> DataFrame:
    """Per run of the onsets ``found``: links between two of the variables that raise an alarm in it."""
    hit = found.where("onset is not null")
    src, tgt = hit.select("run_id", F.col("variable").alias("src")), hit.select("run_id", F.col("variable").alias("tgt"))
    return freq.where("src <> tgt").join(src, "src").join(tgt, ["run_id", "tgt"]).select("run_id", *freq.columns)
