"""Substring dedup over a log-structured fingerprint index.

A window is ``n`` consecutive words of one document. A word goes when a window that covers it also
starts in an earlier document: one of the history, or one with a smaller id among those at hand.

* **Fingerprints.** Each window is stood for by the smallest hash of the ``gram``-word sequences in
  it (winnowing), so equal windows have equal fingerprints, and a document has few distinct ones.
* **Index.** A run is an immutable table of (fingerprint, document), sorted by fingerprint. A batch
  is merge-joined with every run and becomes a run itself; when there are more than ``fanout`` runs,
  they are merged into one. The log lies in a folder: with ``log`` it outlasts the call, and the next
  call's documents are compared with all that it has seen.
* **Verification.** Documents that share a fingerprint give 128-bit digests of the full windows that
  carry it. A mapper keeps each digest once with the first document that has it, so a passage that a
  third of all documents hold costs one entry per mapper block; an equal digest in an earlier document
  marks the window.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import forget_bucketed, open_bucketed, save_bucketed
from .blocks import BLOCK, BLOCK_DOCS, bucket_count, bucket_cuts, counts_of, first_block, gathered, own_key
from .kernels import Roller, spread, words_of
from .scratch import Scratch, delete, folder_exists, list_folder
from .tokens import lean, slices

#: A table goes to every executor only up to this many bytes of rows; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Ids (8 bytes each) that may go to every executor.
FEW_IDS = 1_000_000
BUCKET_BYTES = 4 << 20
#: The rank of a document of the history: before all others.
HISTORY = np.iinfo(np.int64).min


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its rows of about ``row_bytes`` are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def holding(source: DataFrame, table: DataFrame) -> DataFrame:
    """``source`` joined with a written table that has some of its ids. Texts without a row in it do
    not enter the shuffle while the table's ids are few enough for every executor."""
    if table.count() <= FEW_IDS:
        source = source.join(F.broadcast(table.select("doc_id")), "doc_id", "left_semi")
    return source.join(table.hint("merge"), "doc_id")


def without(source: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``source`` without the rows that a written table of ids names; rows with a null id stay."""
    ids = ids.select(F.col("doc_id").alias(id_col))
    return source.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, id_col, "left_anti")


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries (two running minima per block)."""
    count = len(g) - width + 1
    if count <= 0:
        return np.empty(0, g.dtype)
    pad = -len(g) % width
    full = np.concatenate([g, np.full(pad, np.iinfo(g.dtype).max, g.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def window_marks(w: np.ndarray, roller: Roller, n: int, gram: int) -> np.ndarray:
    """The fingerprint of the window that starts at each word of a flat array."""
    return sliding_min(roller.ngrams(w, gram), n - gram + 1)


def _fingerprints(n: int, gram: int, seed: int):
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        roller = Roller(seed)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(batch.column(1), most=512):
                words = words_of(batch.column(1).slice(i, j - i))
                mark = window_marks(roller.words(words.data, words.start, words.end), roller, n, gram)
                row, place = spread(np.maximum(words.counts - n + 1, 0))
                if not len(row):
                    continue
                h = mark[words.first[:-1][row] + place]
                new = np.ones(len(h), bool)  # windows next to each other mostly share theirs
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[i:j][row[new]])], schema=schema)

    return lean(run)


_PACKED = ("ids", "at", "start", "many_at", "many", "h", "more", "least")
WINDOWS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int32()), ("size", pa.int32()), *((c, pa.binary()) for c in _PACKED)])
WINDOWS_SQL = "bucket long, block long, first int, size int, " + ", ".join(f"{c} binary" for c in _PACKED)


def _windows(n: int, gram: int, buckets: int, seed: int):
    """Of each block: a row per bucket with the distinct digests of the windows that carry a shared
    fingerprint and the first document of each, and the block's own row with all these windows."""

    def pack(block, held):
        ids, old = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        row = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
        start, h, more = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
        rank = np.where(old, HISTORY, ids)
        order = np.lexsort((more, h))
        row, start, h, more = row[order], start[order], h[order], more[order]
        lead = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])) if len(h) else np.empty(0, np.int64)
        times = np.diff(np.append(lead, len(h)))
        at = np.flatnonzero(times > 1).astype(np.uint32)
        least = np.minimum.reduceat(rank[row], lead) if len(lead) else rank[:0]
        rows = [(own_key(block), block, 0, len(lead), np.concatenate([ids, rank]).tobytes(), row.astype(np.uint16).tobytes(), start.astype(np.uint32).tobytes(), at.tobytes(), times[at].astype(np.uint32).tobytes(), b"", b"", least.tobytes())]
        h, more = h[lead], more[lead]
        names, cuts = bucket_cuts(h, buckets)
        for k, b in enumerate(names.tolist()):
            s = slice(cuts[k], cuts[k + 1])
            rows.append((b, block, int(cuts[k]), s.stop - s.start, b"", b"", b"", b"", b"", h[s].tobytes(), more[s].tobytes(), least[s].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), WINDOWS.types, strict=True)], schema=WINDOWS)

    def run(batches):
        roller, second, block = Roller(seed), Roller(seed + 1), first_block()
        held, have, docs = [], 0, 0
        for batch in batches:
            ids, olds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            marks = batch.column(2)
            for i, j in slices(batch.column(1), most=256):
                words = words_of(batch.column(1).slice(i, j - i))
                w = roller.words(words.data, words.start, words.end)
                mark = window_marks(w, roller, n, gram)
                full, other = roller.ngrams(w, n), second.ngrams(second.words(words.data, words.start, words.end), n)
                own = marks.slice(i, j - i)
                shared = own.flatten().to_numpy().view(np.uint64)
                cut = np.cumsum([0, *(len(x) for x in own)])
                rows, starts, h, more = [], [], [], []
                for d, (f, c) in enumerate(zip(words.first, words.counts, strict=False)):
                    if c >= n:
                        hit = np.flatnonzero(np.isin(mark[f : f + c - n + 1], shared[cut[d] : cut[d + 1]]))
                        rows.append(np.full(len(hit), d, np.int64))
                        starts.append(hit)
                        h.append(full[f + hit])
                        more.append(other[f + hit])
                if rows:
                    held.append((ids[i:j], olds[i:j], np.concatenate(rows), np.concatenate(starts), np.concatenate(h), np.concatenate(more)))
                    have, docs = have + len(held[-1][2]), docs + j - i
                if have >= BLOCK or docs > BLOCK_DOCS:
                    yield pack(block, held)
                    block, held, have, docs = block + 1, [], 0, 0
        if held:
            yield pack(block, held)

    return lean(run)


EARLIER = "block long, bucket long, size int, ids binary, at binary, start binary, many_at binary, many binary, least binary"


def _earlier(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the digests, by block and place, that an earlier document of another block has."""
    names = ["block", "bucket", "size", "ids", "at", "start", "many_at", "many", "least"]
    if pdf["bucket"].iloc[0] < 0:
        return pdf[names]
    h, more, least = gathered(pdf, "h", np.uint64), gathered(pdf, "more", np.uint64), gathered(pdf, "least", np.int64)
    order = np.lexsort((more, h))
    hs, ms = h[order], more[order]
    lead = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ms[1:] != ms[:-1])])
    first = np.minimum.reduceat(least[order], np.flatnonzero(lead))
    overall = np.empty(len(h), np.int64)
    overall[order] = first[np.cumsum(lead) - 1]
    sizes = pdf["size"].to_numpy()
    ends = np.cumsum(sizes)
    out = []
    for block, begin, s, e in zip(pdf["block"], pdf["first"], ends - sizes, ends, strict=True):
        pick = s + np.flatnonzero(overall[s:e] < least[s:e])
        if len(pick):
            out.append((block, pdf["bucket"].iloc[0], len(pick), b"", (pick - s + begin).astype(np.uint32).tobytes(), b"", b"", b"", overall[pick].tobytes()))
    return pd.DataFrame(out, columns=names)


def _spans(n: int):
    """Of one block: for each new document with marked windows, its covered word spans as int64 pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["bucket"] < 0].iloc[0]
        pdf = pdf[pdf["bucket"] >= 0]
        ids, rank = np.frombuffer(own["ids"], np.int64).reshape(2, -1)
        at, start = np.frombuffer(own["at"], np.uint16).astype(np.int64), np.frombuffer(own["start"], np.uint32).astype(np.int64)
        least = np.frombuffer(own["least"], np.int64).copy()
        least[gathered(pdf, "at", np.uint32)] = gathered(pdf, "least", np.int64)
        entry, _ = spread(counts_of(int(own["size"]), np.frombuffer(own["many_at"], np.uint32), np.frombuffer(own["many"], np.uint32)))
        hit = np.flatnonzero(least[entry] < rank[at])
        at, start = at[hit], start[hit]
        order = np.lexsort((start, at))
        at, start = at[order], start[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] > start[:-1] + n)
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(at)) - 1
        pairs = np.stack([start[lead], start[last] + n], axis=1) if len(lead) else np.empty((0, 2), np.int64)
        who = at[lead]
        cuts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.empty(0, int)
        ends = np.append(cuts[1:], len(who))
        return pd.DataFrame({"doc_id": ids[who[cuts]] if len(who) else np.empty(0, np.int64), "spans": [pairs[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)]})

    return run


class FingerprintIndex:
    """The log in a folder: runs of (fingerprint, document), each a table bucketed by fingerprint and sorted in
    its buckets, and numbered lists of the runs that are valid. A list appears only once its runs are whole,
    so a call that is broken off leaves the log as it was. A run's name tells its number of buckets; joins on
    the fingerprint shuffle the batch to them, and the run not at all."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        done = [n for n in list_folder(spark, f"{self.path}/lists") if folder_exists(spark, f"{self.path}/lists/{n}/_SUCCESS")]
        self.version = max(map(int, done), default=0)
        self.runs = [r["run"] for r in spark.read.schema("run string").parquet(f"{self.path}/lists/{self.version:08d}").collect()] if done else []

    def run(self, name: str) -> DataFrame:
        return open_bucketed(self.spark, f"{self.path}/runs/{name}", ["h"], int(name.rsplit("-", 1)[1]))

    def everything(self) -> DataFrame | None:
        out = None
        for name in self.runs:
            out = self.run(name) if out is None else out.unionAll(self.run(name))
        return out

    def _write(self, df: DataFrame) -> str:
        """A new run; the catalog forgets it again, as calls open runs by their folders."""
        name = f"{uuid.uuid4().hex}-{int(self.spark.conf.get('spark.sql.shuffle.partitions'))}"
        table = f"tidemark_run_{uuid.uuid4().hex}"
        save_bucketed(df, f"{self.path}/runs/{name}", ["h"], table, order=["h"])
        self.spark.sql(f"drop table {table}")
        return name

    def close(self) -> None:
        """Takes the runs out of the catalog; their files stay."""
        for name in self.runs:
            forget_bucketed(self.spark, f"{self.path}/runs/{name}")

    def _list(self, runs: list[str]) -> None:
        self.version += 1
        self.spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(runs)))).alias("run")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{self.version:08d}")
        self.runs = sorted(runs)

    def matches(self, batch: DataFrame) -> DataFrame:
        """``(doc_id, h, old)``, in the batch and in the log, for the fingerprints of the batch that occur
        in another document too. Every run is merge-joined with the batch."""
        twice = batch.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        inside = twice.where("lo <> hi").select("h")
        fresh = batch.select("h", "doc_id", F.lit(False).alias("old"))
        past = None
        for name in self.runs:
            hit = self.run(name).join(twice.select("h").hint("merge"), "h", "left_semi").select("h", "doc_id", F.lit(True).alias("old"))
            past = hit if past is None else past.unionAll(hit)
        if past is None:
            return fresh.join(inside, "h", "left_semi").select("doc_id", "h", "old")
        return fresh.join(past.select("h").unionAll(inside).distinct(), "h", "left_semi").unionAll(past).select("doc_id", "h", "old")

    def append(self, batch: DataFrame) -> None:
        """The batch becomes a run; too many runs become one, and those they came from are deleted after
        the new list is written."""
        new = self._write(batch.select("h", "doc_id"))
        self._list([*self.runs, new])
        if len(self.runs) > self.fanout:
            before = self.runs
            self._list([self._write(self.everything())])
            for name in before:
                forget_bucketed(self.spark, f"{self.path}/runs/{name}")
                delete(self.spark, f"{self.path}/runs/{name}")


def _kept(n_cols):
    """Digest of what stays of each text: with spans, without their words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())] if n_cols == 5 else [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if spans:
                    at, kept = 0, []
                    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                        kept += words[at:a]
                        at = b
                    words = kept + words[at:]
                joined = b" ".join(words)
                row = (i, n, n - len(words), hashlib.sha256(joined).hexdigest())
                out.append((*row[:3], joined.decode(), row[3]) if n_cols == 5 else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return lean(run)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 50, gram: int = 16, batches: int = 4, fanout: int = 2, seed: int = 23, log: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """``(doc_id, spans)`` for the documents that have words to remove; spans are pairs of int64 word
    positions, first and past the last. Documents are ingested in ``batches`` of ascending ids, each
    merge-joined with the runs of those before it.

    ``log`` is the folder of a log that lasts; what earlier calls have put there is history, and
    ``history`` must then hold those documents under the same column names and with ids that are not in
    ``docs``: of it, only the texts that share a fingerprint with a new document are read on.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    shape = lambda df: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    source = shape(docs)
    index = FingerprintIndex(spark, log or scratch.path("log"), fanout)
    if index.runs and history is None:
        raise ValueError("the log has runs: give the documents they come from as history")
    known = bool(index.runs)
    cuts = source.select("doc_id").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(x) for x in cuts}), None]
    prints = scratch.save(source.mapInArrow(_fingerprints(n, gram, seed), "h long, doc_id long"), "prints")
    if known:  # ids that the history and the documents share would be mistaken for one another
        past = shape(history)
    buckets = bucket_count(docs, BUCKET_BYTES)
    spans = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = F.lit(True)
        if lo is not None:
            inside &= F.col("doc_id") >= lo
        upto = F.lit(True)
        if hi is not None:
            upto = F.col("doc_id") < hi
        batch = prints.where(inside & upto)
        shared = scratch.save(index.matches(batch).groupBy("doc_id", "old").agg(F.collect_set("h").alias("marks")), "shared")
        index.append(batch)
        texts = source.where(upto)
        if known:
            texts = texts.unionAll(past)
        windows = holding(texts, shared).select("doc_id", "text", "marks", "old").mapInArrow(_windows(n, gram, buckets, seed), WINDOWS_SQL)
        earlier = windows.groupBy("bucket").applyInPandas(_earlier, EARLIER)
        part = scratch.save(earlier.groupBy("block").applyInPandas(_spans(n), "doc_id long, spans binary"), "spans")
        scratch.drop(shared)
        spans = part if spans is None else spans.unionAll(part)
    spans = scratch.save(spans, "all-spans")
    scratch.drop(prints)
    index.close()
    if log is None:
        delete(spark, index.path)
    return spans


def _cut(marks: str, length_col: str | None, drop_empty: bool):
    def run(batches):
        for batch in batches:
            left = []
            for text, mark in zip(batch.column("text").to_pylist(), batch.column(marks).to_pylist(), strict=True):
                words, at, kept = (text or "").encode().split(), 0, []
                for a, b in np.frombuffer(mark, np.int64).reshape(-1, 2).tolist():
                    kept += words[at:a]
                    at = b
                left.append(b" ".join(kept + words[at:]).decode())
            new = {"text": pa.array(left, pa.string())}
            if length_col:
                new[length_col] = pa.array(map(len, left), batch.schema.field(length_col).type)
            names = [c for c in batch.schema.names if c != marks]
            out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)
            yield out.filter(pa.array([t != "" for t in left], pa.bool_())) if drop_empty else out

    return lean(run)


def cut_texts(docs: DataFrame, spans: DataFrame, length_col: str | None = None, drop_empty: bool = False) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) where the texts that lose words are the words that stay,
    joined by one space; with ``drop_empty``, those that lose all of them go. Other texts and all other
    columns are untouched, but for ``length_col``, which gets the new length of the texts that change."""
    marks = "spans"
    while marks in docs.columns:
        marks += "_"
    found = spans.withColumnRenamed("spans", marks)
    changed = holding(docs, found).select(*docs.columns, marks).mapInArrow(_cut(marks, length_col, drop_empty), docs.schema)
    return without(docs, spans).select(*docs.columns).unionByName(changed)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """Remove repeated windows: ``doc_id, n_words, n_removed, kept_sha256``, and ``kept`` (the words
    that stay, joined by one space) if ``with_text``; a row per document.

    Null and empty texts have no word; texts under n words lose none. Of equal documents the smallest
    id keeps its words. Rows with a null id are left out, ids must be distinct, other columns are
    ignored, whatever their names; an empty table gives an empty result. Options: see ``repeated_spans``.
    """
    spans = repeated_spans(docs, id_col, text_col, **options)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    if spans.count() <= FEW_IDS:
        plain = source.join(F.broadcast(spans.select("doc_id")), "doc_id", "left_anti")
        joined = holding(source, spans).select("doc_id", "text", "spans").union(plain.select("doc_id", "text", F.lit(None).cast("binary")))
    else:
        joined = source.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    kept = "kept string, " if with_text else ""
    return joined.mapInArrow(_kept(5 if with_text else 4), f"doc_id long, n_words long, n_removed long, {kept}kept_sha256 string")
