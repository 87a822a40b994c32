"""How far the sources of each language differ in their terms: an audit by systolic rotation.

Counts of terms by language and source become smoothed shares of a billion. A language's kept terms are
numbered in byte order and cut into shards, its sources into blocks; a seat is a block's packed counts of a
shard's terms. Seats stay where they are: they lie in a bucketed table, which no join shuffles. In each
round of a round-robin tournament every block meets one other block: the lower one's packed vector travels
to the higher one's seat, and the meeting gives the divergence for both directions. The vector of the whole
language visits every seat once; there each source keeps a heap of its most telling terms. What shards say
is added up, so no task holds more than two blocks of one shard, however many terms and sources there are.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import positions
from .kernels import LOWER, text_buffer, words_of
from .scratch import Scratch
from .tokens import lean

#: Terms of a shard, sources of a block at most, and blocks of a language at least (where it has the sources).
SHARD, WIDEST, SEATS = 1 << 12, 64, 4
#: Rounds of the tournament in one job: each block travels once a round.
ROUNDS = 8
#: Bytes of text that a mapper counts at a time.
STEP = 8 << 20
SCALE = 1_000_000_000
#: Bytes between terms: all of ASCII but letters.
GAP = np.zeros(256, bool)
GAP[[x for x in range(128) if not chr(x).isalpha()]] = True

COUNTS = "lang string, source string, term string, n long, docs long"
SEAT = "lang string, shard long, block long, size long, packed binary"
MET = "lang string, part string, a long, b long, value long"


def count_terms(batches):
    """Rows ``lang, source, text`` to counts by language, source and term, and one row without a term for each
    group. A step's counts are exact: terms are told apart by their bytes."""

    def counted(rows: pa.Table) -> pa.RecordBatch:
        lang, source = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        own = lang.indices.to_numpy() * np.int64(len(source.dictionary)) + source.indices.to_numpy()
        groups, group = np.unique(own, return_inverse=True)
        words = words_of(rows.column("text"), lower=True, gap=GAP)
        size = words.end - words.start
        body = words.data[~GAP[words.data]]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        terms = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))).dictionary_encode()
        code, width = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms.dictionary))
        row = np.repeat(np.arange(rows.num_rows), words.counts)
        pairs, times = np.unique(row * width + code, return_counts=True)
        key = group[pairs // width] * width + pairs % width
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.empty(0, np.int64)
        n, docs = (np.add.reduceat(times[order], cuts), np.diff(np.append(cuts, len(key)))) if len(key) else (np.empty(0, np.int64),) * 2
        found = key[order][cuts]
        at = np.concatenate([groups[found // width], groups])
        empty = pa.array([""] * len(groups), pa.large_string())
        return pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(at // len(source.dictionary))),
                source.dictionary.take(pa.array(at % len(source.dictionary))),
                pa.concat_arrays([terms.dictionary.take(pa.array(found % width)), empty]).cast(pa.string()),
                pa.array(np.concatenate([n, np.zeros(len(groups), np.int64)]), pa.int64()),
                pa.array(np.concatenate([docs, np.zeros(len(groups), np.int64)]), pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(text_buffer(batch.column("text"))[0])
        if size >= STEP:
            yield counted(pa.Table.from_batches(held))
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield counted(pa.Table.from_batches(held))


def share(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``floor(10**9 * x / whole)`` for 0 <= x <= whole, by long division where the product is too long."""
    if x.size == 0 or int(x.max()) < (1 << 62) // SCALE:
        return x * SCALE // whole
    out, rest = np.zeros_like(x), x
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Block:
    """Sources of a block (or the language, as source -1) and their counts of a shard's terms."""

    def __init__(self, packed: bytes):
        raw = np.frombuffer(zlib.decompress(packed), np.int64)
        self.terms, groups, entries = raw[:3].tolist()
        self.group, self.whole, self.first = raw[3 : 3 + groups], np.maximum(raw[3 + groups : 3 + 2 * groups], 1), raw[3 + 2 * groups : 4 + 3 * groups]
        self.tid, self.n = raw[4 + 3 * groups : 4 + 3 * groups + entries], raw[4 + 3 * groups + entries :]

    @staticmethod
    def pack(terms: int, group: np.ndarray, whole: np.ndarray, first: np.ndarray, tid: np.ndarray, n: np.ndarray) -> bytes:
        head = np.array([terms, len(group), len(tid)], np.int64)
        return zlib.compress(np.concatenate([head, group, whole, first, tid, n]).astype(np.int64).tobytes(), 1)

    def counts(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.group), len(columns)), np.int64)
        out[np.repeat(np.arange(len(self.group)), np.diff(self.first)), np.searchsorted(columns, self.tid)] = self.n
        return out

    def shares(self, columns: np.ndarray) -> np.ndarray:
        return 1 + share(self.counts(columns) + 2, self.whole[:, None])

    def absent(self) -> np.ndarray:
        """The share of a term that does not occur."""
        return 1 + share(np.full(len(self.group), 2, np.int64), self.whole)


def meeting(host: Block, guest: Block | None) -> list[tuple[int, int, int]]:
    """Divergences of each pair of two blocks, or of a block's own pairs, in both directions."""
    same = guest is None
    guest = guest or host
    columns = np.unique(np.concatenate([host.tid, guest.tid]))
    mine, theirs, rest = host.shares(columns), guest.shares(columns), host.terms - len(columns)
    mine0, theirs0 = host.absent(), guest.absent()
    out = []
    for i, a in enumerate(host.group.tolist()):
        if not host.terms:
            total = np.zeros(len(guest.group), np.int64)
        else:
            total = apart(mine[i], theirs).sum(1) + rest * apart(mine0[i], theirs0)
        for b, value in zip(guest.group.tolist()[i + 1 if same else 0 :], total.tolist()[i + 1 if same else 0 :], strict=True):
            out += [(a, b, value), (b, a, value)]
    return out


def telling(host: Block, lang: Block, whole: int, most: int) -> list[tuple[int, int, int]]:
    """Each source's terms above their share in the language, by a heap of the ``most`` largest divergences."""
    q = 1 + share(lang.n + 2, np.int64(whole))
    out = []
    for i, a in enumerate(host.group.tolist()):
        own = slice(host.first[i], host.first[i + 1])
        tid = host.tid[own]
        p, r = 1 + share(host.n[own] + 2, host.whole[i]), q[np.searchsorted(lang.tid, tid)]
        above = p > r
        value, tid = apart(p[above], r[above]), tid[above]
        if len(value) > most:
            likely = value >= np.partition(value, len(value) - most)[len(value) - most]
            value, tid = value[likely], tid[likely]
        out += [(a, t, -v) for v, t in heapq.nsmallest(most, zip((-value).tolist(), tid.tolist(), strict=True))]
    return out


def rows_met(lang, part: str, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, value = np.array(found, np.int64).reshape(-1, 3).T
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array([part] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)], names=["lang", "part", "a", "b", "value"])


def first_round(most: int):
    """Seats with the language's vector: pairs inside the block, and each source's heap of terms."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                host = Block(r["packed"])
                yield rows_met(r["lang"], "pair", meeting(host, None))
                if r["guest"] is not None:
                    yield rows_met(r["lang"], "term", telling(host, Block(r["guest"]), r["whole"], most))

    return lean(run)


def next_round(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield rows_met(r["lang"], "pair", meeting(Block(r["packed"]), Block(r["guest"])))


def packed_seat(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one seat; those without a term only name a source of the block."""
    group, at = np.unique(pdf["source_no"].to_numpy(np.int64), return_index=True)
    whole = pdf["whole"].to_numpy(np.int64)[at]
    real = pdf[pdf["tid"].notna()]
    order = np.lexsort((real["tid"].to_numpy(np.int64), real["source_no"].to_numpy(np.int64)))
    tid, n, own = (real[c].to_numpy(np.int64)[order] for c in ("tid", "n", "source_no"))
    first = np.append(np.searchsorted(own, group), len(own))
    top = pdf.iloc[0]
    return pd.DataFrame({"lang": [top["lang"]], "shard": [top["shard"]], "block": [top["block"]], "size": [top["size"]], "packed": [Block.pack(int(top["terms"]), group, whole, first, tid, n)]})


def partner(block: Column, turn: Column, seats: Column) -> Column:
    """Whom a block meets in a round of an even number of seats (circle method)."""
    odd = seats - 1
    met = F.pmod(turn - block, odd)
    return F.when(block == odd, F.pmod(turn * (seats / 2).cast("long"), odd)).when(met == block, odd).otherwise(met)


def source_divergence(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources of a source's language
    by their divergence from it, part ``term`` the terms that set it apart from its language.

    Null texts, languages and sources count as ''. Terms are runs of letters and of any characters beyond
    ASCII, with only A-Z lower-cased, of which a language keeps those in ``least_docs`` documents or more. A
    source without a kept term takes part in pairs; in a language without kept terms all pairs are 0 apart.
    A lone source has no pairs. Repeated rows count as often as they occur. All arithmetic is in integers.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = scratch.save(texts.mapInArrow(lean(count_terms), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)
    terms = scratch.save(positions(kept.select("lang", "term", "n"), ["lang"], ["term"], "tid", size="kept"), "terms")
    entries = scratch.save(counts.where("term <> ''").select("lang", "source", "term", "n").join(terms.select("lang", "term", "tid"), ["lang", "term"]).select("lang", "source", "tid", "n"), "entries")
    langs = terms.groupBy("lang").agg(F.max("kept").alias("kept"), F.sum("n").alias("total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(langs.select("lang", "kept"), "lang", "left").join(totals, ["lang", "source"], "left")
    by_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", F.coalesce("kept", zero).alias("kept"), (F.coalesce("n", zero) + 2 * F.coalesce("kept", zero)).alias("whole"), (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("source_no"), F.count("*").over(by_lang).alias("sources"))
    wide = F.least(F.lit(WIDEST), F.ceil(F.col("sources") / SEATS))
    groups = scratch.save(groups.withColumn("block", F.floor(F.col("source_no") / wide)).withColumn("size", F.ceil(F.col("sources") / wide)), "groups")

    shard, own = F.floor(F.col("tid") / SHARD), groups.select("lang", "source", "source_no", "whole", "kept", "block", "size")
    seated = entries.join(own, ["lang", "source"]).select("lang", shard.alias("shard"), "block", "size", "kept", "source_no", "whole", "tid", "n")
    shards = F.explode(F.sequence(zero, F.greatest(zero, F.ceil(F.col("kept") / SHARD) - 1)))
    present = own.select("lang", shards.alias("shard"), "block", "size", "kept", "source_no", "whole", F.lit(None).cast("long").alias("tid"), F.lit(None).cast("long").alias("n"))
    within = F.greatest(zero, F.least(F.lit(SHARD), F.col("kept") - F.col("shard") * SHARD))
    rows = seated.union(present).withColumn("terms", within)
    with scratch.resident(rows.groupBy("lang", "shard", "block").applyInPandas(packed_seat, SEAT), ["lang", "shard", "block"], "seats") as seats:
        lone = terms.select("lang", shard.alias("shard"), zero.alias("block"), zero.alias("size"), "kept", F.lit(-1).cast("long").alias("source_no"), zero.alias("whole"), "tid", "n").withColumn("terms", within)
        vectors = lone.groupBy("lang", "shard", "block").applyInPandas(packed_seat, SEAT).select("lang", "shard", F.col("packed").alias("guest"))
        # what the language has in all comes to the packed vectors, of which there is one a shard
        whole = vectors.join(langs.select("lang", (F.col("total") + 2 * F.col("kept")).alias("whole")), "lang")
        visits = groups.select("lang", "block").distinct().join(whole, "lang").select("lang", "shard", "block", "guest", "whole")
        key = ["lang", "shard", "block"]
        met = [scratch.save(seats.join(visits, key, "left").select("lang", "packed", "guest", "whole").mapInArrow(first_round(most_terms), MET), "round0")]
        even = F.col("size") + F.col("size") % 2
        last = groups.agg(F.max(even)).first()[0] or 0
        for begin in range(0, last - 1, ROUNDS):
            turns = F.explode(F.sequence(F.lit(begin).cast("long"), F.least(F.lit(begin + ROUNDS), even - 1) - 1))
            leaving = seats.where(even - 1 > begin).select("lang", "shard", "block", "size", F.col("packed").alias("guest"), turns.alias("turn"))
            leaving = leaving.withColumn("to", partner(F.col("block"), F.col("turn"), even)).where("block < to and to < size")
            arriving = leaving.select("lang", "shard", F.col("to").alias("block"), "guest")
            met.append(scratch.save(seats.join(arriving, key).select("lang", "packed", "guest").mapInArrow(lean(next_round), MET), f"round{begin + 1}"))
    every = met[0]
    for m in met[1:]:
        every = every.union(m)
    name = lambda c, to: groups.select("lang", F.col("source_no").alias(c), F.col("source").alias(to))
    pairs = every.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    heaps = every.where("part = 'term'").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b"))).where(F.col("rank") <= most_terms)
    said = heaps.join(terms.select("lang", F.col("tid").alias("b"), F.col("term").alias("item")), ["lang", "b"]).join(name("a", "source"), ["lang", "a"])
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(ranked, "pair").union(out(said, "term"))


DIVERGENCE_SQL = r"""with t as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as d,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from t), u as (select lang, source, d, unnest(w) as term from t),
k as (select lang, term, count(*) as n from u group by lang, term having count(distinct d) >= 10),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
c as (select u.lang, u.source, u.term, count(*) as n from u join k on k.lang = u.lang and k.term = u.term group by all),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by all),
p as (select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * cast(coalesce(c.n, 0) + 2 as hugeint)) // (gn.n + 2 * v.v) as p, 1 + (1000000000 * cast(k.n + 2 as hugeint)) // (v.n + 2 * v.v) as q
  from gn join v on v.lang = gn.lang join k on k.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms)) where part = 'pair' or rank <= 10"""
