"""Chat formatting by prefix-target expansion: one training example for every assistant turn.

A turn is written ``### <role>: <text></turn>`` and a line feed, with backslashes, ``#`` and ``<`` of
roles and texts escaped by a backslash (and ``:`` in roles), so no control string can occur inside
them and every example can be read back. An example holds all turns before its target as context, and
its loss mask covers the target's text alone. Turns after the last assistant turn, or all turns of a
conversation without one, become an example without a target.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import lean

HEAD, END = "### ", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(column, more: str = ""):
    """A text with its control characters escaped, as a Spark expression."""
    return F.regexp_replace(column, r"([\\#<" + more + "])", r"\\$1")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and the span of the escaped text."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def chat_examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: a row per assistant turn, and one without a
    target (null span) for the turns that no target follows. ``example`` is the target's place among
    the conversation's turns.

    Turns are ordered by number, then role and text, so repeated numbers have a place. Null roles and
    texts are empty; rows with a null id belong to no conversation and are left out. Spans count characters
    of ``text``. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rendered = rows.select(
        "conv_id",
        F.struct(
            F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"),
            "role",
            "text",
            F.concat(F.lit(HEAD), escaped(F.col("role"), ":"), F.lit(": ")).alias("head"),
            escaped(F.col("text")).alias("body"),
        ).alias("t"),
    )
    grouped = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    grouped = grouped.withColumn("n", F.size("t")).withColumn("targets", F.expr(f"filter(sequence(0, n - 1), i -> t[i].role = '{target_role}')"))
    grouped = grouped.withColumn("targets", F.expr("if(size(targets) = 0 or element_at(targets, -1) < n - 1, concat(targets, array(n)), targets)"))
    each = grouped.select("conv_id", "t", "n", F.explode("targets").alias("example"))
    whole = f"concat(x.head, x.body, '{END}')".replace("\n", "\\n")
    return each.select(
        "conv_id",
        "example",
        F.expr(f"array_join(transform(slice(t, 1, example), x -> {whole}), '')").alias("context"),
        F.expr("if(example < n, t[example].head, '')").alias("head"),
        F.expr("if(example < n, t[example].body, '')").alias("body"),
        (F.col("example") < F.col("n")).alias("has"),
    ).select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat("context", "head", "body", F.when(F.col("has"), F.lit(END)).otherwise("")).alias("text"),
        F.when(F.col("has"), (F.length("context") + F.length("head")).cast("long")).alias("loss_start"),
        F.when(F.col("has"), (F.length("context") + F.length("head") + F.length("body")).cast("long")).alias("loss_end"),
    )


READ = "conv_id long, example long, n_turns long, turns_sha256 string, loss string, formatted_chars long"


def _read(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            turns = parse(r["text"])
            loss = None
            if r["loss_start"] is not None:
                _, said, a, b = turns[-1]
                if (a, b) != (r["loss_start"], r["loss_end"]):
                    raise ValueError(f"the mask of {r['conv_id']}, {r['example']} is not its last turn")
                loss = unescape(r["text"][a:b])
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text, _, _ in turns).encode()).hexdigest()
            out.append((r["conv_id"], r["example"], len(turns), digest, loss, len(r["text"])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)


def read_examples(examples: DataFrame) -> DataFrame:
    """From formatted examples alone, per conversation: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``. The example with the most turns has all of them; loss texts follow
    each other in the examples' order; formatted_chars counts the characters of all examples."""
    parts = examples.mapInArrow(lean(_read), READ)
    grouped = parts.groupBy("conv_id").agg(
        F.max(F.struct("n_turns", "turns_sha256")).alias("top"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x.loss), "").alias("loss"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    return grouped.select("conv_id", "top.n_turns", "top.turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
