"""Language identification by a linear-chain conditional random field over words.

A word is a run of ASCII letters and of bytes above 0x7F. Its features, hashed into one weight table,
are the word itself (lexicon), its prefixes and suffixes of up to three bytes (affixes) and its byte
pairs and triples (n-grams). The chain's transitions are learned with the weights, from whole texts
whose words all carry the document's language, and from code-switched sequences spliced from them.
Forward-backward gives each word's posterior; a document's language has the largest sum of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, Roller, U, spread, text_buffer
from .scratch import small_batches
from .tokens import lean, slices, trim

BITS = 18
#: Bits of the table of words whose evidence is known, up to eight labels.
TABLE = 19


def letter_words(column: pa.Array, digits: bool = False):
    """Lower-cased bytes, word spans and each row's first word; digits make words too on demand."""
    data, at = text_buffer(column)
    data = LOWER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) if len(data) else np.empty(0, int)
    data[upper + 1] += 0x20
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    if digits:
        inside[1:-1] |= (data >= 48) & (data <= 57)
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    cuts = np.unique(at[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    touching = cuts[inside[cuts] & inside[cuts + 1]]
    if len(touching):
        bounds = np.sort(np.concatenate([bounds, touching, touching]))
    start, end = bounds[0::2], bounds[1::2]
    return data, start, end, np.searchsorted(start, at)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, flat, with the word each belongs to."""
    mask = np.uint64((1 << BITS) - 1)
    size = end - start
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint64)

    def code(kind, *parts):
        h = np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for p in parts:
            h = (h ^ p) * U(0x100000001B3)
        return ((h ^ (h >> U(29))) & mask).astype(np.int64)

    n = np.arange(len(start))
    out, who = [code(1, words)], [n]
    for k in (1, 2, 3):
        has = size >= k
        s, e = start[has], end[has]
        out += [code(1 + k, *(pad[s + j] for j in range(k))), code(5 + k, *(pad[e - k + j] for j in range(k)))]
        who += [n[has], n[has]]
    for k in (2, 3):
        row, place = spread(np.maximum(size - k + 1, 0))
        at = start[row] + place
        out.append(code(9 + k, *(pad[at + j] for j in range(k))))
        who.append(row)
    return np.concatenate(out), np.concatenate(who)


def emissions(weights: np.ndarray, feats: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(who, weights[feats, k], n) for k in range(weights.shape[1])], axis=1)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posteriors (time, row, label) of padded rows, and if ``pairs`` the expected transitions."""
    t, d, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    m = np.exp(trans)
    live = np.arange(t)[:, None] < lengths[None]
    e[~live] = 1.0
    a, b = np.empty_like(e), np.empty_like(e)
    a[0] = e[0] / e[0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (a[i - 1] @ m) * e[i]
        a[i] = x / x.sum(1, keepdims=True)
    b[-1] = 1.0
    for i in range(t - 2, -1, -1):
        x = (b[i + 1] * e[i + 1]) @ m.T
        x /= x.sum(1, keepdims=True)
        b[i] = np.where(live[i + 1][:, None], x, 1.0)
    g = a * b
    g /= g.sum(2, keepdims=True)
    if not pairs:
        return g
    x = a[:-1, :, :, None] * m * (e[1:] * b[1:])[:, :, None, :]
    x /= x.sum((2, 3), keepdims=True)
    return g, (x * live[1:, :, None, None]).sum((0, 1))


def train(texts: list[str], langs: list[str], epochs: int = 3, length: int = 60, batch: int = 48, rate: float = 0.2, decay: float = 1e-4, seed: int = 5):
    """Weights, transitions and the labels, by AdaGrad on the conditional likelihood."""
    labels = sorted(set(langs))
    k = len(labels)
    weights, trans = np.zeros((1 << BITS, k), np.float64), np.zeros((k, k))
    if k == 0:
        return weights.astype(np.float32), trans, labels
    data, start, end, first = letter_words(pa.array(texts, pa.string()))
    gold = np.repeat(np.array([labels.index(x) for x in langs]), np.diff(first))
    words = Roller(83).words(data, start, end)
    rng = np.random.default_rng(seed)
    # plain sequences, and as many spliced from short runs of any documents
    plain = [np.arange(s, min(s + length, l)) for f, l in zip(first, first[1:], strict=False) for s in range(f, l, length)]
    runs = [p[i : i + n] for p in plain for i, n in [(int(rng.integers(0, max(1, len(p) - 5))), int(rng.integers(5, 30)))]]
    mixed = [np.concatenate([runs[j] for j in rng.integers(0, len(runs), 4)])[:length] for _ in range(len(plain) // 2)] if runs else []
    sequences = plain + mixed
    sum_w, sum_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(epochs):
        for at in range(0, len(sequences), batch):
            pick = rng.integers(0, len(sequences), batch)
            own = [sequences[j] for j in pick]
            sizes = np.array([len(x) for x in own])
            flat = np.concatenate(own)
            row, place = spread(sizes)
            f, wrow = features(data, start[flat], end[flat], words[flat])
            emit = np.zeros((sizes.max(), len(own), k))
            emit[place, row] = emissions(weights, f, wrow, len(flat))
            g, expected = forward_backward(emit, sizes, trans, pairs=True)
            delta = -g[place, row]
            delta[np.arange(len(flat)), gold[flat]] += 1.0
            touched, inverse = np.unique(f, return_inverse=True)
            grad = emissions(delta, wrow, inverse, len(touched)) - decay * weights[touched]
            sum_w[touched] += grad**2
            weights[touched] += rate * grad / np.sqrt(sum_w[touched])
            same = place[1:] > 0
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[flat[:-1][same]], gold[flat[1:][same]]), 1)
            grad = seen - expected
            sum_t += grad**2
            trans += rate * grad / np.sqrt(sum_t)
    return weights.astype(np.float32), trans, labels


class Tagger:
    """Applies a trained chain to columns of texts."""

    def __init__(self, weights, trans, labels):
        self.weights, self.trans, self.labels = weights, trans, labels
        self.roller = Roller(83)
        self.bits = TABLE - max(0, (len(labels) - 1).bit_length() - 3)  # more labels, fewer cached words
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.emit = np.zeros((1 << self.bits, len(labels)), np.float32)

    def word_emissions(self, data, start, end) -> np.ndarray:
        words = self.roller.words(data, start, end)
        spot = (words & U((1 << self.bits) - 1)).astype(np.int64)
        out = self.emit[spot]
        missed = np.flatnonzero(self.keys[spot] != words)
        if len(missed):
            distinct, where, inverse = np.unique(words[missed], return_index=True, return_inverse=True)
            where = missed[where]
            feats, who = features(data, start[where], end[where], distinct)
            new = emissions(self.weights, feats, who, len(distinct)).astype(np.float32)
            out[missed] = new[inverse]
            self.keys[spot[where]], self.emit[spot[where]] = distinct, new
        return out

    def posteriors(self, column: pa.Array):
        """Each word's label posteriors, flat, and the rows' word counts."""
        data, start, end, first = letter_words(column)
        emit, counts = self.word_emissions(data, start, end), np.diff(first)
        out = np.empty_like(emit, dtype=np.float64)
        order = np.argsort(counts, kind="stable")
        order = order[counts[order] > 0]
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 1024 and counts[order[j]] * (j + 1 - i) <= 80_000:
                j += 1
            rows = order[i:j]
            row, place = spread(counts[rows])
            flat = first[:-1][rows][row] + place
            padded = np.zeros((int(counts[rows].max()), len(rows), emit.shape[1]))
            padded[place, row] = emit[flat]
            out[flat] = forward_backward(padded, counts[rows], self.trans)[place, row]
            i = j
        return out, counts, first

    def languages(self, column: pa.Array):
        """Per row: label number (-1 without a letter), its mean posterior."""
        post, counts, first = self.posteriors(column)
        best, score = np.full(len(counts), -1), np.zeros(len(counts))
        has = np.flatnonzero(counts > 0)
        if len(has):
            sums = np.add.reduceat(post, first[:-1][has], axis=0) / counts[has][:, None]
            best[has], score[has] = sums.argmax(1), np.clip(sums.max(1), 0, 1)
        return best, score, post, counts, first


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _apply(model, spans: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
    if spans:
        schema = schema.append(pa.field("spans", span_type))

    def run(batches):
        tagger = Tagger(*model)
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 19):
                ids, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                best, score, post, counts, first = tagger.languages(texts)
                # bytes above 0x7F need not be letters
                unsure = np.flatnonzero(pa.compute.invert(pa.compute.match_substring_regex(texts.fill_null(""), "[A-Za-z]")).to_numpy(zero_copy_only=False))
                for r in unsure.tolist():
                    if not has_letter(texts[r].as_py()):
                        best[r], score[r] = -1, 0.0
                names = [tagger.labels[b] if b >= 0 else "und" for b in best.tolist()]
                cols = [ids, pa.array(names, pa.string()), pa.array(score)]
                if spans:
                    tags = post.argmax(1)
                    out = []
                    for r, (f, c) in enumerate(zip(first, counts, strict=False)):
                        t = tags[f : f + c] if best[r] >= 0 else tags[:0]
                        lead = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, int)
                        ends = np.append(lead[1:], len(t))
                        out.append([{"first": int(a), "last": int(b) - 1, "lang": tagger.labels[t[a]]} for a, b in zip(lead, ends, strict=False)])
                    cols.append(pa.array(out, span_type))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return lean(run)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, most_bytes: int = 1 << 16, languages: int = 200, **options):
    """Train on at most ``per_lang`` texts of each of the commonest ``languages``, picked by a hash of
    their ids; whole texts of the picked rows are used. Texts over ``most_bytes`` are picked only where a
    language has no shorter one, so the sample is bounded. Rows with a null text or language are left
    out, other columns are ignored; without a row the model knows no language. The driver's memory is given back."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("i is not null and t is not null and l is not null")
    short = F.octet_length("t") <= most_bytes
    known = rows.groupBy("l").agg(F.count("*").alias("n"), F.count_if(short).alias("short")).orderBy(F.desc("n"), "l").limit(languages).collect()
    spot = F.pmod(F.xxhash64("i", F.lit("language")), F.lit(1_000_003))
    share = F.lit(0.0)
    for r in known:
        usable = short if r["short"] else F.lit(True)
        share = F.when((F.col("l") == r["l"]) & usable, F.lit(min(1.0, 1.5 * per_lang / (r["short"] or r["n"])))).otherwise(share)
    picked = rows.withColumn("k", spot).where(F.col("k") < share * 1_000_003)
    found = sorted(((r["l"], r["k"], r["i"], r["t"]) for r in picked.collect()), key=lambda x: x[:3])
    texts, langs, seen = [], [], {}
    for lang, _, _, text in found:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= per_lang:
            texts.append(text)
            langs.append(lang)
    model = train(texts, langs, **options)
    del found, texts
    trim()  # the driver lives on, and should not hold what training needed
    return model


def language_id(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` per document, with ``spans`` (runs of words, first to last, in one
    language) on demand. Null texts and texts without a letter give ``und`` and 0; equal rows give
    equal results; a model without labels gives ``und`` throughout. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not model[2]:
        out = source.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        return out.withColumn("spans", F.expr("cast(array() as array<struct<first:long,last:long,lang:string>>)")) if with_spans else out
    spans = ", spans array<struct<first:long,last:long,lang:string>>" if with_spans else ""
    return source.mapInArrow(_apply(model, with_spans), f"doc_id long, lang_pred string, score double{spans}")
