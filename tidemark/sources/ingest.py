"""Readers: delimited text with sniffed layout, workbooks, R data, Parquet and JSON, to observation tables.

Files are read by Spark (so any file system that Spark reads works); only the first lines of a text file
come to the driver, to sniff its delimiter and header. Column roles (run, sample, labels, time) come
from explicit arguments, then known file names, then heuristics on names, types and counts.
"""

from __future__ import annotations

import csv
import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import number
from ..operators.obs import run_key, to_long, with_seq_in_parts
from .workbooks import read_excel, read_rdata

#: The name hints by which columns are given roles, and file name patterns with known roles.
LABEL_HINTS = ("label", "class", "fault", "target", "status", "category", "group", "type", "source", "split")
RUN_HINTS = ("run", "simulation", "batch", "trial", "experiment", "session", "episode", "group_id")
SAMPLE_HINTS = ("sample", "step", "tick", "time_step", "timestep", "frame", "observation")
TIME_HINTS = ("time", "date", "timestamp", "datetime")
KNOWN = {"te_process": {"labels": ["faultNumber", "source", "fault_status"], "run": "simulationRun", "sample": "sample"}}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class RunSet:
    """What a multi-run table becomes."""

    obs: DataFrame
    labels: DataFrame | None
    variables: list[str]
    run_col: str | None
    sample_col: str | None
    label_cols: list[str]
    metadata: dict = field(default_factory=dict)


def first_lines(spark: SparkSession, path: str, n: int = 11) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The commonest of comma, tab, semicolon and runs of two blanks; the first of equals; none: blanks."""
    lines = [re.sub(r'"(?:[^"]|"")*"', '""', x) for x in lines]  # what stands in quotes delimits nothing
    counts = {",": sum(x.count(",") for x in lines), "\t": sum(x.count("\t") for x in lines), ";": sum(x.count(";") for x in lines), r"\s+": sum(len(re.findall(r" {2,}", x)) for x in lines)}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else r"\s+"


def split_line(line: str, delimiter: str) -> list[str]:
    """The fields of a line; a quoted one may hold the delimiter and, doubled, the quote."""
    return re.split(r"\s+", line.strip()) if delimiter == r"\s+" else [x.strip() for x in next(csv.reader([line], delimiter=delimiter, skipinitialspace=True), [])]


def is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def has_header(names: Sequence[str]) -> bool:
    """False if more than half of the first line's fields are numbers."""
    return sum(map(is_number, names)) <= 0.5 * len(names)


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    lines = first_lines(spark, path)
    if not lines:
        raise ValueError(f"{path} is empty")
    delimiter = delimiter or sniff_delimiter(lines)
    names = split_line(lines[0], delimiter)
    header = has_header(names)
    columns = [n.strip() for n in names] if header else [f"col_{i}" for i in range(len(names))]
    if delimiter == r"\s+":
        rows = spark.read.text(path).where(F.trim("value") != "")
        if header:
            rows = rows.where(F.col("value") != lines[0])
        parts = F.split(F.trim("value"), r"\s+")
        return rows.select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))
    return spark.read.csv(path, sep=delimiter, header=header, inferSchema=False, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).toDF(*columns)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension; an unknown one is an error."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".csv", ".tsv", ".dat", ".txt"):
        return read_delimited(spark, path, options.get("delimiter"))
    if kind in (".xlsx", ".xlsm"):
        return read_excel(spark, path, options.get("sheet", 0))
    if kind in (".rdata", ".rda", ".rds"):
        return read_rdata(spark, path, options.get("rdata_key"))
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".json", ".jsonl"):
        return spark.read.json(path)
    if kind == ".xls":
        raise ValueError("workbooks of the old binary form are not read: save them as .xlsx")
    raise ValueError(f"unknown file type: {kind or path}")


def known_roles(path: str) -> dict:
    return next((roles for part, roles in KNOWN.items() if part in os.path.basename(path)), {})


def column_facts(df: DataFrame) -> tuple[dict[str, dict], int]:
    """Of each column: ``present`` and ``numeric`` values and about how many ``distinct`` ones (a sketch with a
    deviation of 2 %), and the number of rows; one scan, whatever the number of columns."""
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"p{i}"), F.count(number(v)).alias(f"n{i}"), F.approx_count_distinct(v, 0.02).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    return {c: {"present": row[f"p{i}"], "numeric": row[f"n{i}"], "distinct": row[f"d{i}"]} for i, c in enumerate(df.columns)}, row["rows"]


def distinct_exactly(df: DataFrame, column: str) -> int:
    return df.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct().count()


def settle(df: DataFrame, facts: dict[str, dict], limits: dict[str, list[float]]) -> None:
    """Counts exactly the columns whose sketch is too near one of their limits to tell on which side they are."""
    for c, own in limits.items():
        if any(abs(facts[c]["distinct"] - limit) <= max(3, 0.1 * limit) for limit in own):
            facts[c]["distinct"] = distinct_exactly(df, c)


def share_of(fact: dict) -> float:
    """Of a column's present values, the share that converts to a number."""
    return fact["numeric"] / fact["present"] if fact["present"] else 0.0


def hinted(name: str, hints: Sequence[str]) -> bool:
    return any(h in name.lower() for h in hints)


def detect_roles(df: DataFrame, path: str = "", run_col: str | None = None, sample_col: str | None = None, label_cols: Sequence[str] | None = None) -> dict:
    """Explicit arguments, then the file name, then heuristics."""
    known = known_roles(path)
    facts, rows = column_facts(df)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and share_of(facts[f.name]) < 0.5}
    limits = {c: [2, rows / 5] * hinted(c, RUN_HINTS) + [50] * (hinted(c, LABEL_HINTS) and c not in text) + [20] * (c in text) for c in df.columns}
    settle(df, facts, limits)
    counts = {c: f["distinct"] for c, f in facts.items()}
    run = run_col or (known.get("run") if known.get("run") in df.columns else None) or next((c for c in df.columns if hinted(c, RUN_HINTS) and 2 <= counts[c] <= rows / 5), None)
    sample = sample_col or (known.get("sample") if known.get("sample") in df.columns else None) or next((c for c in df.columns if c != run and hinted(c, SAMPLE_HINTS) and c not in text), None)
    if label_cols is not None:
        labels = list(label_cols)
    elif known:
        labels = [c for c in known["labels"] if c in df.columns]
    else:
        labels = [c for c in df.columns if c not in (run, sample) and ((hinted(c, LABEL_HINTS) and (counts[c] <= 50 or c in text)) or (c in text and counts[c] <= 20))]
    return {"run": run, "sample": sample, "labels": labels}


def detect_time(df: DataFrame) -> str | None:
    """In column order, the first time column, text column whose first 20 values mostly parse as times, or
    text column named like one. Numeric columns order rows as numbers, whatever their name."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
        if isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            few = df.select(c.alias("v")).where("v is not null").limit(20).select(F.expr("try_to_timestamp(v)").isNotNull().alias("t"), F.col("v").try_cast("double").isNotNull().alias("n")).collect()
            numeric = bool(few) and all(r["n"] for r in few)
            if not numeric and ((few and sum(r["t"] and not r["n"] for r in few) >= 0.8 * len(few)) or hinted(f.name, TIME_HINTS)):
                return f.name
    return None


def coerce_numeric(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Text columns as numbers where at least ``least`` of their values convert; other text, and columns
    without a value, are dropped; names are trimmed."""
    facts, _ = column_facts(df)
    keep = []
    for f in df.schema.fields:
        fact = facts[f.name]
        fits = isinstance(f.dataType, NUMERIC) or (isinstance(f.dataType, T.StringType) and share_of(fact) >= least)
        if fits and fact["present"]:
            keep.append(number(f"`{f.name}`").alias(f.name.strip()))
    return df.select(*keep)


def load(spark: SparkSession, path: str, **options) -> RunSet:
    """One run: numeric variables in file order, ordered by a sample or time column where there is one."""
    raw = read_table(spark, path, **options)
    time = detect_time(raw)
    sample = options.get("sample_col") or known_roles(path).get("sample") or next((c for c in raw.columns if hinted(c, SAMPLE_HINTS)), None)
    order = sample if sample in raw.columns else None
    numbered = raw.withColumn("__row", F.monotonically_increasing_id())
    key = [F.col(f"`{order}`").try_cast("double")] if order else [F.expr(f"try_to_timestamp(cast(`{time}` as string))")] if time else []
    variables = [c for c in coerce_numeric(raw).columns if c not in {order, time}]
    wide = numbered.select(F.lit("0").alias("run_id"), *(F.col(f"`{c}`").alias(c.strip()) for c in raw.columns), "__row", *(k.alias("__key") for k in key))
    wide = with_seq_in_parts(wide, (["__key"] if key else []) + ["__row"])
    sample_value = F.col(f"`{order}`").try_cast("double").cast("long") if order else F.col("seq")
    obs = to_long(wide.withColumn("sample", F.coalesce(sample_value, F.col("seq"))) if order != "sample" else wide.withColumn("sample", F.col("sample").try_cast("double").cast("long")), variables)
    return RunSet(obs, None, variables, None, order, [], describe(raw, path))


def load_runs(spark: SparkSession, path: str, run_col: str | None = None, sample_col: str | None = None, label_cols: Sequence[str] | None = None, **options) -> RunSet:
    """Several runs in one table, split by nothing: ``run_id`` is a column. Labels are held aside."""
    return split_roles(read_table(spark, path, **options), path, run_col, sample_col, label_cols)


def split_roles(raw: DataFrame, path: str = "", run_col: str | None = None, sample_col: str | None = None, label_cols: Sequence[str] | None = None) -> RunSet:
    roles = detect_roles(raw, path, run_col, sample_col, label_cols)
    run, sample, labels = roles["run"], roles["sample"], roles["labels"]
    variables = [c for c in raw.columns if c not in {run, sample, *labels}]
    key = run_key(F.col(f"`{run}`")) if run else F.lit("0")
    place = F.col(f"`{sample}`").try_cast("double") if sample else F.monotonically_increasing_id().cast("double")
    base = raw.select(key.alias("run_id"), place.alias("__at"), *(F.col(f"`{c}`").alias(f"l_{c}") for c in labels), *(number(f"`{c}`").alias(c) for c in variables))
    base = base.where("run_id is not null")
    numbered = with_seq_in_parts(base, ["__at", *(F.col(f"`{c}`") for c in variables)]).withColumn("sample", F.coalesce(F.col("__at").cast("long"), F.col("seq")) if sample else F.col("seq"))
    held = numbered.select("run_id", "sample", *(F.col(f"`l_{c}`").alias(c) for c in labels)) if labels else None
    return RunSet(to_long(numbered, variables), held, variables, run, sample, labels, describe(raw, path) | {"run_column": run, "sample_column": sample, "label_columns": labels, "variables": variables})


def load_many(spark: SparkSession, paths: Sequence[str], **options) -> dict[str, RunSet]:
    """By file stem; of equal stems the last stays."""
    return {os.path.splitext(os.path.basename(p))[0]: load(spark, p, **options) for p in paths}


def describe(df: DataFrame, path: str) -> dict:
    """Name, shape, types and size in memory (eight bytes a value) of a source."""
    rows = df.count()
    return {"filepath": path, "filename": os.path.basename(path), "rows": rows, "columns": len(df.columns), "dtypes": dict(df.dtypes), "memory_size": 8 * rows * len(df.columns), "index_type": index_type(df)}


def index_type(df: DataFrame) -> str:
    """How rows are ordered: by ``time`` where a column tells it, by a ``sample`` number, or as they ``stand``."""
    if detect_time(df):
        return "time"
    return "sample" if any(hinted(c, SAMPLE_HINTS) for c in df.columns) else "stand"


def text_summary(metadata: dict) -> str:
    types = ", ".join(f"{c}: {t}" for c, t in metadata["dtypes"].items())
    return f"{metadata['filename']}: {metadata['rows']:,} rows x {metadata['columns']} columns ({types})"


def require(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The named columns, or an error that lists up to eight missing ones."""
    gone = [v for v in variables if v not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone[:8])}" + (f" and {len(gone) - 8} more" if len(gone) > 8 else ""))
    return df.select(*(F.col(f"`{v}`") for v in variables))


def common_variables(frames: Sequence[DataFrame]) -> list[str]:
    """Columns that all frames have, sorted."""
    return sorted(set.intersection(*(set(f.columns) for f in frames))) if frames else []


def safe_name(name: str) -> str:
    """A file name's stem of letters, digits and ``-_.`` only."""
    stem = os.path.splitext(os.path.basename(name))[0]
    return re.sub(r"[^A-Za-z0-9\-_.]", "", stem)


def read_json(path: str) -> dict | None:
    """A small JSON artifact of the driver, or None."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


REGISTRY: dict[str, dict] = {}


def register_dataset(key: str, path: str, display: str, description: str = "") -> None:
    REGISTRY[key] = {"path": path, "display": display, "description": description}


AUDIT = "type string, timestamp string, task string, evidence string, response string, model string, run_id string, verdict string, reasons array<string>"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """An append-only JSON-lines log, in the order of its lines."""
    return spark.read.schema(AUDIT).json(path)
