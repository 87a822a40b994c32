"""The observation table: one row per run, position and variable.

``obs_long``: run_id string, sample long, seq long, variable string, var_pos int, value double. ``seq``
is the dense position inside a run; a value that is missing is null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import number
from ..sources.tables import parts_for, written
from .positions import positions


def with_seq(df: DataFrame, order: Sequence[Column | str], run_col: str = "run_id") -> DataFrame:
    """Numbers the rows of each run from 0; ``order`` should be total."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy(run_col).orderBy(*order)) - 1).cast("long"))


def with_seq_in_parts(df: DataFrame, order: Sequence[Column | str], run_col: str = "run_id", kept: Sequence[str] | None = None) -> DataFrame:
    """As ``with_seq``, by one range exchange of all runs: a run's rows are many tasks', and each is numbered
    after the rows of the ranges before it. The numbered rows (of them the columns ``kept``, the run among them)
    come from a written table. Keys may be null. Rows are counted first, so that there are as many ranges as they
    need and no task sorts more rows of a larger table."""
    return positions(df, [run_col], order, "seq", kept=kept, parts=parts_for(df.sparkSession, df.count()))


#: Fixed value: how a whole number is written in a run id; other texts, such as 007, stay as they are.
WHOLE = r"^-?(0|[1-9][0-9]*)(\.0+)?$"


def run_key(col: Column | str) -> Column:
    """Run ids as text, so that 1, 1.0 and '1' name one run; ids such as ``1D`` or ``007`` are names of their own."""
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("string")
    whole = c.try_cast("double")
    fraction = F.typeof(c).isin("float", "double") & (whole == F.floor(whole)) & (F.abs(whole) < 1e15)
    return F.when(fraction, F.floor(whole).cast("string")).when(text.rlike(WHOLE), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def to_long(wide: DataFrame, variables: Sequence[str]) -> DataFrame:
    """From ``run_id, sample, seq`` and a column per variable to ``obs_long``; rows without a run go."""
    entries = F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(i).alias("var_pos"), number(f"`{v}`").alias("value")) for i, v in enumerate(variables)))
    rows = wide.where("run_id is not null").select("run_id", F.col("sample").cast("long").alias("sample"), "seq", F.explode(entries).alias("e"))
    return rows.select("run_id", "sample", "seq", "e.variable", "e.var_pos", "e.value")


def to_wide(obs: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The inverse of ``to_long``, one aggregation keyed by run and position."""
    columns = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    return obs.groupBy("run_id", "sample", "seq").agg(*columns)


def run_sizes(obs: DataFrame) -> DataFrame:
    return obs.groupBy("run_id").agg(F.countDistinct("seq").alias("n_samples"))


def varying(obs: DataFrame, least: float = 1e-12, sample_std: bool = True, values: int = 1) -> DataFrame:
    """Variables with some spread over all runs: ``variable, var_pos``."""
    spread = F.stddev_samp("value") if sample_std else F.stddev_pop("value")
    kept = obs.groupBy("variable", "var_pos").agg(spread.alias("sd"), F.count("value").alias("n"))
    return kept.where((F.col("sd") > least) & (F.col("n") >= values)).select("variable", "var_pos")


def sample_runs(run_ids: Sequence[str], n: int, seed: int) -> list[str]:
    """``n`` runs drawn by Python's generator from the sorted ids, sorted again."""
    import random

    key = lambda r: (0, int(r), "") if str(r).lstrip("-").isdigit() else (1, 0, str(r))
    ids = sorted(map(str, run_ids), key=key)
    return sorted(random.Random(seed).sample(ids, min(n, len(ids))), key=key)


def trajectory_band(obs: DataFrame, sketch: int | None = None) -> DataFrame:
    """Mean, spread and median across runs at each position that every run has. With ``sketch`` (a size from 8
    on; 200 is within about 1.3 % of the rank) the median comes from a mergeable sketch, whose size does not
    grow with the runs; without, it is exact and a position's values of all runs come together."""
    shortest = obs.groupBy("variable", "run_id").agg(F.max("seq").alias("last")).groupBy("variable").agg(F.min("last").alias("last"))
    shortest = written(shortest, "shortest")  # small by its files: values are not shuffled by variable
    rows = obs.join(shortest, "variable").where("seq <= last")
    median = F.percentile("value", 0.5) if sketch is None else F.kll_sketch_agg_double("value", F.lit(sketch))
    out = rows.groupBy("variable", "seq").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), median.alias("median"), F.count("value").alias("__n"))
    if sketch is not None:
        out = out.withColumn("median", F.when(F.col("__n") > 0, F.kll_sketch_get_quantile_double("median", F.lit(0.5))))
    return out.drop("__n")
