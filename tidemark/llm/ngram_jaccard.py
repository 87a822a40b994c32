"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact sorted-array checks.

Every text is lower-cased (A-Z) and becomes the set of its distinct n-word shingles. Two documents
link when ``threshold_pct * |union| <= 100 * |intersection|``. The join is exact (up to equality of
hashes of 56 to 64 bits) and has no cap anywhere:

1. One pass packs the distinct shingle hashes of blocks of documents into hash-range buckets. A bucket
   adds up the blocks' counts and answers those hashes that at least two documents hold, with a coarse
   document frequency; a shingle that a third of all documents hold is one entry per block there.
2. A document whose repeated shingles cannot reach the threshold has no link. Of the others, only
   the rarest ``size - ceil(t * size) + 1`` shingles can bring a link (prefix filter); shingles that
   no other document holds fill most prefixes, and passages that many documents share are last.
3. Equal sets become one class. Classes that share a prefix shingle are compared with one leader per
   shingle and size band in each star round, so a group of g near copies costs some g comparisons.
4. Pairs of classes that share a prefix shingle, lie in the same or in neighbouring size bands and are
   still in different components are compared in tiles of at most ``TILE`` members a side: bit counts
   of bitmaps bound the overlap from above, and what passes is intersected exactly. The members of a
   shingle's largest component are never compared with each other. The likeliest pairs of two
   components come first; what is still apart then is asked again, without a limit in the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, BLOCK_DOCS, bucket_count, bucket_cuts, counts_of, first_block, gathered, own_key, repeats
from .components import extended
from .kernels import Roller, U, spread, words_of
from .scratch import Scratch
from .tokens import lean, slices

LOW = U((1 << 48) - 1)
TILE = 256
STAR_ROUNDS = 2
#: Pairs of two components that a tile gives in each round; the last round gives all that are left.
HELD = (4, 256, None)
#: Input bytes for each hash-range bucket; the number of buckets follows the input.
BUCKET_BYTES = 2 << 20


def shingle_sets(words, roller: Roller, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, flat, sorted within each row, and the size of each row's set."""
    w = roller.words(words.data, words.start, words.end)
    counts = words.counts
    grams = roller.ngrams(w, n)
    long = np.maximum(counts - n + 1, 0)
    row, place = spread(long)
    h = grams[words.first[:-1][row] + place] if len(row) else np.empty(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        h = np.concatenate([h, roller.short(w, words.first[:-1][few], counts[few])])
        row = np.concatenate([row, few])
    order = np.argsort(h)
    order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.bincount(row[keep], minlength=len(counts))


POSTING = "bucket long, block long, first int, size int, low binary, high binary, at binary, many_at binary, many binary"
POSTING_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int32()), ("size", pa.int32()), *((c, pa.binary()) for c in ("low", "high", "at", "many_at", "many"))])


def _postings(n: int, buckets: int, seed: int):
    """Of each block: a row per bucket with its distinct hashes and their counts, and the block's own
    row, which passes by the buckets: ids, set sizes and, by ascending hash, the documents that hold it."""

    def pack(block, held):
        ids, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
        h = np.concatenate([x[1] for x in held])
        row = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
        order = np.argsort(h)
        h, row = h[order], row[order]
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        at, many = repeats(np.diff(np.append(lead, len(h))))
        out = [(own_key(block), block, 0, len(lead), ids.astype(np.int64).tobytes(), sizes.astype(np.int32).tobytes(), row.tobytes(), at.tobytes(), many.tobytes())]
        h = h[lead]
        low, high = (h & U(0xFFFFFFFF)).astype(np.uint32), ((h & LOW) >> U(32)).astype(np.uint16)
        names, cuts = bucket_cuts(h, buckets)
        inner = np.searchsorted(at, cuts)
        for k, b in enumerate(names.tolist()):
            s, m = slice(cuts[k], cuts[k + 1]), slice(inner[k], inner[k + 1])
            out.append((b, block, int(cuts[k]), s.stop - s.start, low[s].tobytes(), high[s].tobytes(), b"", (at[m] - np.uint32(cuts[k])).tobytes(), many[m].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), POSTING_ARROW.types, strict=True)], schema=POSTING_ARROW)

    def run(batches):
        roller, block = Roller(seed), first_block()
        held, have, docs = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(batch.column(1), most=512):
                h, sizes = shingle_sets(words_of(batch.column(1).slice(i, j - i), lower=True), roller, n)
                held.append((ids[i:j], h, sizes))
                have, docs = have + len(h), docs + len(sizes)
                if have >= BLOCK or docs > BLOCK_DOCS:
                    yield pack(block, held)
                    block, held, have, docs = block + 1, [], 0, 0
        if held:
            yield pack(block, held)

    return lean(run)


REPEATED = "block long, bucket long, size int, low binary, high binary, at binary, many_at binary, many binary, freq binary"


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the places, in each block, of hashes that occur in two documents or more."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["block", "bucket", "size", "low", "high", "at", "many_at", "many"]].assign(freq=b"")
    sizes, first = pdf["size"].to_numpy(), pdf["first"].to_numpy()
    ends = np.cumsum(sizes)
    low, high = gathered(pdf, "low", np.uint32), gathered(pdf, "high", np.uint16)
    own = np.ones(len(low), np.int64)
    for start, at, many in zip(ends - sizes, pdf["many_at"], pdf["many"], strict=True):
        own[start + np.frombuffer(at, np.uint32)] = np.frombuffer(many, np.uint16)
    h = (high.astype(np.uint64) << U(32)) | low
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    run = np.cumsum(new) - 1
    count = np.empty(len(s), np.int64)
    count[order] = np.bincount(run, own[order]).astype(np.int64)[run]
    freq = np.minimum(255, 8 * np.log2(count)).astype(np.uint8)
    out = []
    for block, f, start, end in zip(pdf["block"], first, ends - sizes, ends, strict=True):
        pick = start + np.flatnonzero(count[start:end] > 1)
        if len(pick):
            out.append((block, pdf["bucket"].iloc[0], len(pick), low[pick].tobytes(), high[pick].tobytes(), (pick - start + f).astype(np.uint32).tobytes(), b"", b"", freq[pick].tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "size", "low", "high", "at", "many_at", "many", "freq"])


DOCS = "doc_id long, n_shingles long, set_key binary, n_repeated int, ids binary, prefix array<long>"


def _survivors(num: int):
    """Of one block: every document; ids and prefix of those that may have a link."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["bucket"] < 0].iloc[0]
        pdf = pdf[pdf["bucket"] >= 0].sort_values("bucket")
        doc = np.frombuffer(own["low"], np.int64)
        size = np.frombuffer(own["high"], np.int32).astype(np.int64)
        holders = np.frombuffer(own["at"], np.uint16)
        counts = counts_of(int(own["size"]), np.frombuffer(own["many_at"], np.uint32), np.frombuffer(own["many"], np.uint16))
        base = np.cumsum(counts) - counts
        place = gathered(pdf, "at", np.uint32).astype(np.int64)
        h = (np.repeat(pdf["bucket"].to_numpy(), pdf["size"].to_numpy()).astype(np.uint64) << U(48)) | (gathered(pdf, "high", np.uint16).astype(np.uint64) << U(32)) | gathered(pdf, "low", np.uint32)
        entry, nth = spread(counts[place])
        at = holders[base[place][entry] + nth]
        ids, freq = h[entry], gathered(pdf, "freq", np.uint8)[entry]
        held = np.bincount(at, minlength=len(doc))
        needed = -(-num * size // 100)
        lives = (size > 0) & (held >= needed)
        pick = np.flatnonzero(lives[at])
        pick = pick[np.lexsort((ids[pick], at[pick]))]
        ids, freq, at = ids[pick], freq[pick], at[pick]
        starts = np.searchsorted(at, np.arange(len(doc) + 1))
        keys, kept, blobs, prefixes = [None] * len(doc), np.zeros(len(doc), np.int32), [None] * len(doc), [None] * len(doc)
        for d in np.flatnonzero(lives).tolist():
            mine, f = ids[starts[d] : starts[d + 1]], freq[starts[d] : starts[d + 1]]
            blobs[d] = mine.tobytes()
            kept[d] = len(mine)
            keys[d] = hashlib.md5(blobs[d]).digest() if len(mine) == size[d] else b"%d" % doc[d]
            lead = int(size[d] - needed[d] + 1 - (size[d] - len(mine)))
            prefixes[d] = mine[np.lexsort((mine, f))[:lead]].view(np.int64)
        return pd.DataFrame({"doc_id": doc, "n_shingles": size, "set_key": keys, "n_repeated": kept, "ids": blobs, "prefix": prefixes})

    return run


def bitmap(ids: np.ndarray) -> np.ndarray:
    """A signature of the size band: as many bits as twice the next power of two, 64 to 8192."""
    bits = min(8192, max(64, 2 << max(0, int(len(ids) - 1).bit_length())))
    out = np.zeros(bits // 64, np.uint64)
    where = (ids & U(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, where >> 6, U(1) << (where & 63).astype(np.uint64))
    return out


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) made narrower: the halves are joined by or."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def bound(m, b, ms, bs) -> np.ndarray:
    """Upper bounds of the overlap of one set (m repeated shingles, bitmap b) with many."""
    words = min(b.shape[-1], bs.shape[-1])
    b, bs = fold(b, words), fold(bs, words)
    return np.minimum(m - np.bitwise_count(b & ~bs).sum(1, dtype=np.int64), ms - np.bitwise_count(bs & ~b).sum(1, dtype=np.int64))


def links_at(overlap, a, b, num):
    return 100 * overlap >= num * (a + b - overlap)


TILED = "a long, b long, h long, slot int, tile string"


def _tile_pairs(num: int, most: int | None):
    """Rows sorted by tile: the pairs of different components whose bound allows a link. A pair has a
    member of the slot's own band, and one of each side where the tile has two.

    Of each two components the ``most`` likeliest pairs come first, as one link is enough to join
    them; a tile that holds pairs back says so in a row without a pair, and is asked again.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("slot", pa.int32()), ("tile", pa.string())])
    keys = ["h", "slot", "tile"]

    def tile(g: pd.DataFrame):
        n, m, comp, side, high, ids = (g[c].to_numpy() for c in ("n", "m", "comp", "side", "high", "id"))
        none = np.empty(0, np.int64)
        if (comp == comp[0]).all():
            return none, none, False
        bits = [np.frombuffer(x, np.uint64) for x in g["bits"]]
        width = np.array([len(x) for x in bits])
        at = {w: np.flatnonzero(width == w) for w in np.unique(width)}
        wide = {w: np.stack([bits[i] for i in k]) for w, k in at.items()}
        crossed = (side != 0).any()
        first, second, score = [], [], []
        for i in range(len(n)):
            for w, k in at.items():
                near = (k > i) & (n[k] * 100 >= num * n[i]) & (n[i] * 100 >= num * n[k]) & (comp[k] != comp[i])
                if high[i]:
                    near &= high[k] == 0
                if crossed:
                    near &= side[k] != side[i]
                if near.any():
                    j = k[near]
                    top = bound(m[i], bits[i], m[j], wide[w][near])
                    ok = links_at(top, n[i], n[j], num)
                    j, top = j[ok], top[ok]
                    first.append(np.full(len(j), i))
                    second.append(j)
                    score.append(top / (n[i] + n[j] - top))
        if not first:
            return none, none, False
        i, j, score = np.concatenate(first), np.concatenate(second), np.concatenate(score)
        kept = False
        if most is not None and len(i) > most:
            x, y = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
            order = np.lexsort((-score, y, x))
            new = np.ones(len(i), bool)
            new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
            lead = np.flatnonzero(new)
            rank = np.arange(len(i)) - lead[np.cumsum(new) - 1]
            pick = order[rank < most]
            kept = len(pick) < len(i)
            i, j = i[pick], j[pick]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), kept

    def emit(pdf):
        out = ([], [], [], [], [])
        for key, g in pdf.groupby(keys, sort=False):
            a, b, kept = tile(g)
            pairs = [*zip(a.tolist(), b.tolist(), strict=True), *([(None, None)] if kept else [])]
            for o, v in zip(out, ([p[0] for p in pairs], [p[1] for p in pairs], *([k] * len(pairs) for k in key)), strict=True):
                o.extend(v)
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, schema.types, strict=True)], schema=schema)

    def run(batches):
        rest = None
        for batch in batches:
            pdf = batch.to_pandas()
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            tail = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1)
            rest = pdf[tail]
            if not tail.all():
                yield emit(pdf[~tail])
        if rest is not None:
            yield emit(rest)

    return lean(run)


def tiles_of(here: DataFrame, marked: DataFrame | None, scratch: Scratch) -> DataFrame:
    """From ``h, id, n, band, comp``: ``h, slot, tile, id, comp, side, high``, the rows of every tile. ``here``
    is read twice, in plans of their own.

    A slot holds the members of a size band and, as ``high``, those of the next one. Of its members, those
    of the component that most of them have (main) are dealt to tiles of their own, and every two tiles
    meet but two of main.
    """
    slots = here.select("h", "id", "comp", F.explode(F.array(F.struct(F.col("band").alias("slot"), F.lit(0).alias("high")), F.struct((F.col("band") - 1).alias("slot"), F.lit(1).alias("high")))).alias("s")).select("h", "id", "comp", "s.slot", "s.high")
    by_comp = slots.groupBy("h", "slot", "comp").agg(F.count("*").alias("k"), F.min("high").alias("high"))
    mixed = by_comp.groupBy("h", "slot").agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("main"), F.min("high").alias("high")).where("k > main.k and high = 0")
    up = lambda c: F.ceil(c / TILE).cast("int")
    mixed = scratch.save(mixed.select("h", "slot", F.col("main.comp").alias("main"), up(F.col("main.k")).alias("mains"), up(F.col("k") - F.col("main.k")).alias("rests")), "mixed")
    spot = F.xxhash64("id")
    dealt = slots.join(mixed, ["h", "slot"]).withColumn("own", F.when(F.col("comp") == F.col("main"), F.col("rests") + F.pmod(spot, F.col("mains"))).otherwise(F.pmod(spot, F.col("rests"))).cast("int"))
    meets = F.when(F.col("own") < F.col("rests"), F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
    dealt = dealt.withColumn("other", F.explode(meets))
    out = dealt.select("h", "slot", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "id", "comp", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "high")
    return out if marked is None else out.join(marked, ["h", "slot", "tile"], "left_semi")


def _verify(num: int):
    """Bitmap bound, then exact intersection of the sorted arrays of each pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])

    def run(batches):
        for batch in batches:
            cols = {k: batch.column(k) for k in batch.schema.names}
            out = ([], [], [])
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(cols[k][i].as_buffer(), np.uint64) for k in ("ids_a", "ids_b"))
                na, nb = cols["n_a"][i].as_py(), cols["n_b"][i].as_py()
                if not links_at(min(len(x), len(y)), na, nb, num):
                    continue
                if not links_at(bound(len(x), bitmap(x), np.array([len(y)]), bitmap(y)[None])[0], na, nb, num):
                    continue
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                if links_at(overlap, na, nb, num):
                    for o, v in zip(out, (cols["a"][i].as_py(), cols["b"][i].as_py(), overlap), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], schema=schema)

    return lean(run)


def _bits(batches):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    for batch in batches:
        ids = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array([len(x) for x in ids], pa.int64()), pa.array([bitmap(x).tobytes() for x in ids], pa.binary()), batch.column("prefix")], schema=schema)


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold_pct: int = 75, seed: int = 11) -> DataFrame:
    """Components of the n-gram Jaccard graph: ``doc_id, n_shingles, component_id``, a row per document.

    Null and empty texts have no shingle and are linked with nothing; fewer than n words are one
    shingle; an empty table gives an empty result. Rows whose id is null are left out; ids must be
    distinct. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard", tidy=True)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    postings = source.mapInArrow(_postings(n, bucket_count(docs, BUCKET_BYTES), seed), POSTING)
    repeated = postings.groupBy("bucket").applyInPandas(_repeated, REPEATED)
    found = scratch.save(repeated.groupBy("block").applyInPandas(_survivors(threshold_pct), DOCS), "docs")

    live = found.where("ids is not null")
    classes = live.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = scratch.save(live.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep"), "members")
    heads = members.where("doc_id = rep").select(F.col("rep").alias("id"))
    reps = scratch.save(found.where("ids is not null").join(heads, F.col("doc_id") == F.col("id")).select("id", F.col("n_shingles").alias("n"), "ids", "prefix"), "reps")
    # a prefix shingle that one class alone holds brings nothing
    every = reps.select("id", "n", F.explode("prefix").alias("h"))
    shared = every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / threshold_pct))).cast("int")
    posts = scratch.save(every.join(shared, "h").select("h", "id", "n", band.alias("band")), "prefix")

    half = reps.select(F.col("id"), F.col("n"), F.col("ids"))

    def check(pairs: DataFrame) -> DataFrame:
        """Links among pairs, which are written first: the plan that finds them and the one that looks up their
        sets are never the driver's at once."""
        pairs = scratch.save(pairs, "pairs")
        both = pairs.join(half.toDF("a", "n_a", "ids_a"), "a").join(half.toDF("b", "n_b", "ids_b"), "b")
        return both.mapInArrow(_verify(threshold_pct), "a long, b long, overlap long")

    def placed(comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return posts.withColumn("comp", F.col("id"))
        return posts.join(comp, F.col("id") == F.col("node"), "left").select("h", "id", "n", "band", F.coalesce("component", "id").alias("comp"))

    comp = None
    for turn in range(STAR_ROUNDS):
        here = placed(comp)
        lead = here.groupBy("h", "band").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("k"), "id", "n", "comp")).alias("lead"))
        pairs = (
            here.join(lead, ["h", "band"])
            .where("comp <> lead.comp")
            .where(f"100 * least(n, lead.n) >= {threshold_pct} * greatest(n, lead.n)")
            .select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
            .distinct()
        )
        comp = scratch.save(extended(comp, scratch.save(check(pairs), f"star{turn}")), "components")
    # what the stars have not joined: tiles of classes that share a prefix shingle
    signed = scratch.save(reps.select("id", "n", "ids", "prefix").mapInArrow(lean(_bits), "id long, n long, m long, bits binary, prefix array<long>").drop("prefix"), "signed")
    marked = None
    for most in HELD:
        tiled = tiles_of(placed(comp), marked, scratch).join(signed, "id").repartition("h", "slot", "tile").sortWithinPartitions("h", "slot", "tile", "n", "id")
        pairs = scratch.save(tiled.select("h", "slot", "tile", "id", "comp", "side", "high", "n", "m", "bits").mapInArrow(_tile_pairs(threshold_pct, most), TILED), "tiles")
        comp = scratch.save(extended(comp, scratch.save(check(pairs.where("a is not null").select("a", "b").distinct()), "tile-links")), "components")
        marked = pairs.where("a is null").select("h", "slot", "tile")
        if marked.isEmpty():
            break
    classed = members.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("member"), F.coalesce("component", "rep").alias("component"))
    return found.join(classed, F.col("doc_id") == F.col("member"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
