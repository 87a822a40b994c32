"""Token files with Re-Pair grammars: each segment of documents is replaced by rules and symbols.

Documents are dealt to shards by ranges of ids and encoded in ascending order. A segment is a bounded
run of a shard's documents. Its most frequent id pairs become nonterminals, again and again; pairs
never cross documents. A segment's row in the file holds its documents, their places among the
remaining symbols, the rules, and the length that each rule expands to, so one document or one range
of ids is decoded without its neighbours. The files are Parquet with one row per segment.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import spread
from .scratch import Scratch, input_bytes
from .substring_dedup import sized
from .tokens import encoder, keep_pages, lean, slices

#: First nonterminal; ids are below it.
FIRST_RULE = 1 << 20
#: Ids of a segment at least, before its last document.
SEGMENT = 2_000_000
SHARD_BYTES = 8 << 20


def repair(ids: np.ndarray, doc: np.ndarray, pairs: int = 4096, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one segment: symbols, their documents, and rules as rows (left, right).

    Rounds replace up to ``pairs`` of the most frequent pairs at once, so chosen that no symbol is on the
    left of one and on the right of another, and occurrences do not overlap; in a run of one symbol,
    pairs are taken from the left. Rounds end when no pair occurs ``least`` times.

    Counts are kept up, not taken anew: symbols form a linked list, each place knows the number of its
    pair, and a round looks only at places whose pair is still frequent. A pair that is not frequent can
    only lose occurrences, and every pair that comes up holds a symbol of the latest round, so new pairs
    are counted over the places next to replaced ones.
    """
    n, rules = len(ids), []
    if n < 2:
        return ids.astype(np.int32), doc, np.empty((0, 2), np.int32)
    sym = np.append(ids, 0).astype(np.int32)
    sym[n] = -1  # stands for "no neighbour"
    after = np.arange(1, n + 2)
    after[np.append(np.flatnonzero(doc[1:] != doc[:-1]), [n - 1, n])] = n
    before = np.arange(-1, n)
    before[np.append(0, np.flatnonzero(doc[1:] != doc[:-1]) + 1)] = n
    pair = np.full(n + 1, -1, np.int32)  # of each place with its right neighbour; -1: not frequent, or none
    left_of, right_of, live = [], [], []

    def number(places: np.ndarray) -> np.ndarray:
        """New numbers for the pairs at these (ascending) places; the places of frequent ones."""
        a, b = sym[places], sym[after[places]]
        # hashed bins first: only places whose bin is full enough can hold a frequent pair
        bits = min(20, max(8, len(places).bit_length() - 1))
        spot = ((a.view(np.uint32) * np.uint32(0x9E3779B1)) ^ (b.view(np.uint32) * np.uint32(0x85EBCA77))) >> np.uint32(32 - bits)
        full = np.flatnonzero((np.bincount(spot, minlength=1 << bits) >= least)[spot])
        places, a, b = places[full], a[full].astype(np.int64), b[full].astype(np.int64)
        wide, deep = max(int(a.max(initial=0)), int(b.max(initial=0))).bit_length(), len(places).bit_length()
        if 2 * wide + deep < 64:  # pair and place in one number: sorted without an index
            both = ((a << wide | b) << deep) | np.arange(len(places))
            both.sort()
            key, order = both >> deep, both & ((1 << deep) - 1)
        else:
            key, wide = a << 32 | b, 32
            order = np.argsort(key, kind="stable")
            key = key[order]
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        times = np.diff(np.append(lead, len(key)))
        kept = times >= least
        base = sum(map(len, left_of))
        left_of.append((key[lead[kept]] >> wide).astype(np.int32))
        right_of.append((key[lead[kept]] & ((1 << wide) - 1)).astype(np.int32))
        named = np.full(len(times), -1, np.int32)
        named[kept] = np.arange(base, base + kept.sum(), dtype=np.int32)
        own = np.empty(len(places), np.int32)
        own[order] = np.repeat(named, times)
        pair[places] = own
        return places[own >= 0]

    live = number(np.flatnonzero(after[:n] < n))
    count = 0
    while len(live):
        lefts, rights, own = np.concatenate(left_of), np.concatenate(right_of), pair[live]
        # in a run of one symbol every second pair overlaps the one before it
        blocked = np.empty(0, np.int64)
        if (lefts == rights).any():
            at = np.flatnonzero((lefts == rights)[own])
            at = at[np.argsort(live[at], kind="stable")]
            same, nth = live[at], np.arange(len(at))
            first = np.concatenate([[True], after[same[:-1]] != same[1:]]) if len(at) else np.empty(0, bool)
            blocked = at[(nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 1]
        times = np.bincount(own, minlength=len(lefts)) - np.bincount(own[blocked], minlength=len(lefts))
        order = np.flatnonzero(times >= least)
        if not len(order):
            break
        order = order[np.argsort(-times[order], kind="stable")][:pairs]
        on_left, on_right, chosen = set(), set(), []
        for k, a, b in zip(order.tolist(), lefts[order].tolist(), rights[order].tolist(), strict=True):
            if a not in on_right and b not in on_left:
                on_left.add(a)
                on_right.add(b)
                chosen.append(k)
        rule = np.full(len(lefts), -1, np.int32)
        rule[chosen] = np.arange(count, count + len(chosen), dtype=np.int32)
        count += len(chosen)
        rules.append(np.stack([lefts[chosen], rights[chosen]], axis=1))
        hit = rule[own]
        hit[blocked] = -1
        taken = np.flatnonzero(hit >= 0)
        where = live[taken]
        gone = after[where]
        sym[where] = FIRST_RULE + hit[taken]
        sym[gone] = -1
        pair[gone] = -1
        after[where] = after[gone]
        before[after[where]] = where
        before[n] = n
        near = np.zeros(n + 1, bool)
        near[where] = near[before[where]] = True
        touched = np.flatnonzero(near[:n])
        pair[touched] = -1
        touched = touched[(after[touched] < n) & (sym[touched] >= 0)]
        live = live[(times >= least)[own] & (pair[live] >= 0)]
        live = np.concatenate([live, number(touched)])
    alive = np.flatnonzero(sym[:n] >= 0)
    return sym[alive], doc[alive], np.concatenate(rules).astype(np.int32) if rules else np.empty((0, 2), np.int32)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule refers to ids and to earlier rules only."""
    out = np.ones(len(rules), np.int64)
    todo = np.ones(len(rules), bool)
    parts = rules.astype(np.int64) - FIRST_RULE
    while todo.any():
        side = np.where(parts >= 0, out[np.maximum(parts, 0)], 1) if len(out) else np.ones_like(parts)
        new = side.sum(1)
        todo = new != out
        out = new
    return out


def expansions(rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rules, flat, and where each rule begins. A rule is copied from its two sides, which
    are whole before it, so the work is the ids that are written."""
    start = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.int32)
    inner = rules.astype(np.int64) - FIRST_RULE
    level = np.zeros(len(rules), np.int64)
    while True:
        new = 1 + np.where(inner >= 0, level[np.maximum(inner, 0)], 0).max(1, initial=0)
        if (new == level).all():
            break
        level = new
    order = np.argsort(level, kind="stable")
    for own in np.split(order, np.cumsum(np.bincount(level))[:-1]) if len(rules) else []:
        at = start[own]
        for side in (0, 1):
            child, ids = inner[own, side], rules[own, side]
            plain = child < 0
            flat[at[plain]] = ids[plain]
            size = np.where(plain, 1, lengths[np.maximum(child, 0)])
            row, place = spread(np.where(plain, 0, size))
            flat[at[row] + place] = flat[start[child[row]] + place]
            at = at + size
    return flat, start


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    if not len(rules):
        return symbols
    lengths = rule_lengths(rules)
    flat, start = expansions(rules, lengths)
    is_rule = np.flatnonzero(symbols >= FIRST_RULE)
    size = np.ones(len(symbols), np.int64)
    own = symbols[is_rule].astype(np.int64) - FIRST_RULE
    size[is_rule] = lengths[own]
    out = np.repeat(symbols, size)
    row, place = spread(lengths[own])
    out[(np.cumsum(size) - size)[is_rule][row] + place] = flat[start[own][row] + place]
    return out


def decode_range(segment: dict, doc_index: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start:stop`` of one document of a segment row, expanding only the symbols they lie in."""
    place = np.frombuffer(segment["places"], np.int64)
    rules = np.frombuffer(segment["rules"], np.int32).reshape(-1, 2)
    own = np.frombuffer(segment["symbols"], np.int32)[place[doc_index] : place[doc_index + 1]]
    sizes = np.ones(len(own), np.int64)
    is_rule = own >= FIRST_RULE
    sizes[is_rule] = np.frombuffer(segment["rule_lengths"], np.int64)[own[is_rule] - FIRST_RULE]
    ends = np.cumsum(sizes)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    first = int(ends[a - 1]) if a else 0
    return expand(own[a:b], rules)[start - first : stop - first]


FILE = "shard long, segment long, first_doc long, n_ids long, docs binary, counts binary, places binary, rules binary, rule_lengths binary, symbols binary"


def _segments(path: str, end_id: int):
    types = [pa.int64()] * 4 + [pa.binary()] * 6
    names = [x.split()[0] for x in FILE.split(", ")]

    def run(batches):
        keep_pages()
        enc, shard = encoder(path), TaskContext.get().partitionId()
        held, have, number = [], 0, 0

        def flush():
            nonlocal held, have, number
            docs = np.concatenate([x[0] for x in held])
            counts = np.concatenate([x[2] for x in held])
            ids = np.concatenate([x[1] for x in held])
            symbols, doc, rules = repair(ids, np.repeat(np.arange(len(docs), dtype=np.int32), counts))
            places = np.searchsorted(doc, np.arange(len(docs) + 1))
            row = (shard, number, int(docs[0]), len(ids), docs.astype(np.int64).tobytes(), counts.astype(np.int64).tobytes(), places.astype(np.int64).tobytes(), rules.tobytes(), rule_lengths(rules).tobytes(), symbols.tobytes())
            held, have, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(1)):
                ids, counts = enc.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
                held.append((docs[a:b], ids, counts + 1))
                have += len(ids)
                if have >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    return lean(run, keep=True)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Write token files for ``docs`` under ``path``. Null texts are empty; rows with a null id are
    left out; equal ids follow each other. An empty table gives files without segments."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    shards = int(min(100_000, max(8, input_bytes(docs) // SHARD_BYTES)))
    dealt = source.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_segments(tokenizer, end_id), FILE).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _decoded(batches):
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            docs, counts = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["counts"], np.int64)
            ids = expand(np.frombuffer(row["symbols"], np.int32), np.frombuffer(row["rules"], np.int32).reshape(-1, 2)).astype("<u4").tobytes()
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(n, row["shard"]), np.full(n, row["segment"]), docs, ends - counts, counts, crc)], schema=schema)


def read_tokens(files: DataFrame) -> DataFrame:
    """From token files: ``doc_id, start, n_tokens, ids_crc32``, a row per document; start counts the
    ids of all documents before it."""
    heads = files.select("shard", "segment", "n_ids")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    within = heads.withColumn("in_shard", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids"))
    bases = within.join(shards, "shard").select("shard", "segment", (F.col("in_shard") + F.col("before")).alias("base"))
    bases = sized(bases, 32)  # a row per segment
    rows = files.mapInArrow(lean(_decoded), "shard long, segment long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write token files and read them back; see ``write_tokens`` and ``read_tokens``."""
    spark = docs.sparkSession
    path = path or Scratch(spark, "tokens").path("files")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(spark.read.parquet(path))
