"""Recursions along a series, split over parts of it.

A series is one variable of one run. Its places are dealt in parts of ``SPAN``; what a part adds to the
recursion (sums, extremes, first and last value) is a row, and the rows of a series' parts are scanned once
more, so a long series is many tasks' work and no task sorts more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import parts_for, written_by

SERIES = ("run_id", "variable")
PART = (*SERIES, "part")
#: Places of a part.
SPAN = 1 << 16


def in_parts(obs: DataFrame, span: int | None = None) -> DataFrame:
    """With the part of each place; a table that is laid out by parts has it already."""
    return obs if "part" in obs.columns and span is None else obs.withColumn("part", F.floor(F.col("seq") / (span or SPAN)))


def with_places_before(rows: DataFrame, back: int, span: int, n_rows: int) -> DataFrame:
    """With ``part``: each part of ``span`` places, and once more the ``back`` places before it. Parts of runs are
    dealt to as many tasks as the number of rows needs, where the session's number does not suffice."""
    part = F.floor(F.col("seq") / span)
    out = rows.withColumn("part", F.explode(F.when(F.col("seq") % span >= span - back, F.array(part, part + 1)).otherwise(F.array(part))))
    parts = parts_for(rows.sparkSession, n_rows)
    return out.repartition(*parts, "run_id", "part") if parts else out


def before_here() -> Window:
    return Window.partitionBy(*SERIES).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _spread(n: Column, mean: Column, squares: Column, centre: str) -> Column:
    """A part's sum of squares about the common mean."""
    return F.sum(squares + n * F.pow(mean - F.col(centre), F.lit(2)))


def laid_out(obs: DataFrame) -> DataFrame:
    """Observations written by parts of series, so that the recursions over them shuffle no rows."""
    return written_by(in_parts(obs.select(*SERIES, "var_pos", "seq", "value")), PART, "obs")


def lag_moments(obs: DataFrame, span: int | None = None) -> DataFrame:
    """``run_id, variable, var_pos, n, n_rows, mean, sd, n_pairs, c, sx, sy``: moments of the values of each
    series, and of its pairs of a value and the one before it (gaps are closed; population moments).

    Pairs inside a part come from a window over it; the pair over each cut is the first value of a part and
    the last one of the parts before. Both kinds add up about their common means."""
    rows = in_parts(obs, span).select(*PART, "var_pos", "seq", "value")
    past = Window.partitionBy(*PART).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last("value", ignorenulls=True).over(past))
    both = F.col("before").isNotNull() & F.col("value").isNotNull()
    x, y = F.when(both, F.col("before")), F.when(both, F.col("value"))
    present = F.when(F.col("value").isNotNull(), F.col("seq"))
    n, k = F.count("value"), F.count(x)
    parts = rows.groupBy(*PART, "var_pos").agg(
        n.alias("n"), F.count("*").alias("n_rows"), F.avg("value").alias("m"), (F.var_pop("value") * n).alias("s"), F.min_by("value", present).alias("first"), F.max_by("value", present).alias("last"),
        k.alias("k"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * k).alias("sx"), (F.var_pop(y) * k).alias("sy"), (F.covar_pop(x, y) * k).alias("c"),
    )
    carried = F.last("last", ignorenulls=True).over(before_here())
    parts = parts.withColumn("carried", carried).withColumn("cut", F.col("carried").isNotNull() & F.col("first").isNotNull())
    # a cut's pair joins its part's pairs: one more pair, at its own distance from their means
    joined = F.when(F.col("cut"), F.col("k") / (F.col("k") + 1)).otherwise(0.0)
    mx, my = F.coalesce("mx", F.lit(0.0)), F.coalesce("my", F.lit(0.0))
    dx, dy = F.when(F.col("cut"), F.col("carried") - mx).otherwise(0.0), F.when(F.col("cut"), F.col("first") - my).otherwise(0.0)
    one = F.col("cut").cast("int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = parts.select(
        *SERIES, "var_pos", "n", "n_rows", zero("m").alias("m"), zero("s").alias("s"),
        (F.col("k") + one).alias("k"), (mx + dx / (F.col("k") + 1)).alias("mx"), (my + dy / (F.col("k") + 1)).alias("my"),
        (zero("sx") + dx * dx * joined).alias("sx"), (zero("sy") + dy * dy * joined).alias("sy"), (zero("c") + dx * dy * joined).alias("c"),
    )
    series = Window.partitionBy(*SERIES)
    centre = lambda w, v: F.sum(F.col(w) * F.col(v)).over(series) / F.nullif(F.sum(w).over(series), F.lit(0))
    parts = parts.withColumn("cm", centre("n", "m")).withColumn("cx", centre("k", "mx")).withColumn("cy", centre("k", "my"))
    total, pairs = F.sum("n"), F.nullif(F.sum("k"), F.lit(0))
    w = F.col("k")
    return parts.groupBy(*SERIES, "var_pos").agg(
        total.alias("n"), F.sum("n_rows").alias("n_rows"), F.max("cm").alias("mean"),
        F.when(total > 1, F.sqrt(_spread(F.col("n"), F.col("m"), F.col("s"), "cm") / F.nullif(total - 1, F.lit(0)))).alias("sd"),
        F.sum("k").alias("n_pairs"), (F.sum(F.col("c") + w * (F.col("mx") - F.col("cx")) * (F.col("my") - F.col("cy"))) / pairs).alias("c"),
        F.sqrt(_spread(w, F.col("mx"), F.col("sx"), "cx") / pairs).alias("sx"), F.sqrt(_spread(w, F.col("my"), F.col("sy"), "cy") / pairs).alias("sy"),
    )


def reflected_sums(rows: DataFrame, step_up: Column, step_down: Column, span: int | None = None) -> DataFrame:
    """``rows`` (with ``run_id, variable, seq``) and ``c_pos, c_neg``: sums of ``step_up`` that never fall
    under 0 and of ``step_down`` that never rise above it.

    Such a sum is a running sum minus its running extreme. A part gives its sum and its own extreme; over the
    parts before, sums add up and extremes shift by them, so each part knows where it starts."""
    rows = in_parts(rows, span)
    here = Window.partitionBy(*PART).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__up", F.sum(step_up).over(here)).withColumn("__down", F.sum(step_down).over(here))
    parts = rows.groupBy(*PART).agg(F.sum(step_up).alias("up"), F.min("__up").alias("low"), F.sum(step_down).alias("down"), F.max("__down").alias("high"))
    sofar = before_here()
    zero = F.lit(0.0)
    parts = parts.withColumn("__u", F.coalesce(F.sum("up").over(sofar), zero)).withColumn("__d", F.coalesce(F.sum("down").over(sofar), zero))
    starts = parts.select(
        *PART, "__u", "__d",
        F.least(zero, F.coalesce(F.min(F.col("__u") + F.col("low")).over(sofar), zero)).alias("__low"),
        F.greatest(zero, F.coalesce(F.max(F.col("__d") + F.col("high")).over(sofar), zero)).alias("__high"),
    )
    lowest, highest = F.least(F.col("__low"), F.col("__u") + F.min("__up").over(here)), F.greatest(F.col("__high"), F.col("__d") + F.max("__down").over(here))
    out = rows.join(starts, list(PART)).withColumn("c_pos", F.col("__u") + F.col("__up") - lowest).withColumn("c_neg", F.col("__d") + F.col("__down") - highest)
    return out.drop("part", "__up", "__down", "__u", "__d", "__low", "__high")
