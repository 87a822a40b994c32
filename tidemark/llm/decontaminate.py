"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit distance.

Texts and items become lower-cased words (letters, digits and bytes above 0x7F). A document leaks an
item of L words if some run of its words is within ``edit_share * L`` word edits of the item, or equal
to it where the item is short.

* **Windows.** An item within k edits of a passage shares one of its k + 1 equal chunks with it, so
  only windows around a chunk that the item also has can match; they start where the chunk would put
  the item, and up to k words to either side. A chunk that many items have (a stem such as "which of the
  following") is not taken for each of them: k edits also leave one of an item's k + 1 rarest words in
  place, so such items are looked up by these words, and then must have their chunk nearby.
* **Embedding.** A random walk (Chakraborty, Goldenberg, Koucky, 2016) copies each window into three
  times its length, staying or stepping by a random bit of the step and the word under it. Few edits
  become few differing places.
* **LSH.** Each walk is sampled at a few places, and an equal sample makes a placed item a candidate. The
  number of repetitions follows from ``recall``, by the differences seen between the items and edited items; for
  items that no affordable number serves, every window that a word sequence places is a candidate.
* **Verification.** The word edit distance of the item and the best run around the window is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Roller, U, mix, spread
from .language_id import letter_words
from .tokens import lean, slices

#: Items and bytes of their texts held in memory at a time; a larger benchmark takes several passes.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
#: Repetitions at most. Items that would need more to reach the recall are compared wherever a seed puts
#: them, without the LSH.
REPETITIONS = 256
SAMPLED = 2
#: Items from which on a chunk counts as a stem, and pairs of places and items held at a time.
HOT, PAIRS = 16, 1 << 19


class Walk:
    """Repeated CGK walks over windows of one length, sampled at ``SAMPLED`` places each."""

    def __init__(self, length: int, repeats: int, seed: int):
        rng = np.random.default_rng((seed, length))
        self.length, self.steps = length, 3 * length
        self.odd = rng.integers(1, 1 << 63, (repeats, self.steps), dtype=np.uint64) * U(2) + U(1)
        self.places = np.stack([rng.choice(self.steps, SAMPLED, replace=False) for _ in range(repeats)])

    def outputs(self, windows: np.ndarray) -> np.ndarray:
        """The embeddings (window, repetition, step) of rows of word hashes."""
        n, repeats = len(windows), len(self.odd)
        pad = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1).ravel()
        base = (np.arange(n) * (self.length + 1))[:, None]
        at = np.zeros((n, repeats), np.int64)
        out = np.empty((self.steps, n, repeats), np.uint64)
        for j in range(self.steps):
            x = np.take(pad, base + at, out=out[j])
            at += ((x * self.odd[:, j]) >> U(63)).view(np.int64)
            np.minimum(at, self.length, out=at)
        return out.transpose(1, 2, 0)

    def samples(self, windows: np.ndarray) -> np.ndarray:
        """A hash of the sampled places, for each window and repetition."""
        walked = self.outputs(windows)
        h = np.zeros(walked.shape[:2], np.uint64)
        for k in range(SAMPLED):
            h = mix(h + walked[:, np.arange(len(self.odd)), self.places[:, k]] + U(k + 1))
        return h


def repetitions(items: np.ndarray, k: int, recall: float, seed: int) -> int | None:
    """Repetitions that reach ``recall`` for items with k random edits, by trial; None if too many."""
    rng = np.random.default_rng((seed, items.shape[1], k))
    length = items.shape[1]
    trial = items[rng.integers(0, len(items), 48)]
    edited = np.zeros_like(trial)
    for n, row in enumerate(trial):
        new = row.tolist()
        for _ in range(k):
            kind, at = rng.integers(3), int(rng.integers(0, max(1, len(new))))
            if kind == 0 and new:
                new[min(at, len(new) - 1)] = int(rng.integers(1, 1 << 62))
            elif kind == 1 and new:
                del new[min(at, len(new) - 1)]
            else:
                new.insert(at, int(rng.integers(1, 1 << 62)))
        new = (new + [int(x) for x in rng.integers(1, 1 << 62, length)])[:length]
        edited[n] = new
    walk = Walk(length, 8, seed + 1)
    same = (walk.outputs(trial) == walk.outputs(edited)).mean(2)
    hit = (same**SAMPLED).mean(1)  # per edited item
    r = 1
    while (1 - (1 - hit) ** r).mean() < recall:
        r += 1 + r // 8
        if r > REPETITIONS:
            return None
    return r


def edit_distance(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Exact word edit distance of each item to the nearest run of its region (Sellers, 1980)."""
    out = np.empty(len(items), np.int64)
    order = np.argsort([len(x) for x in items], kind="stable")
    for i in range(0, len(order), 256):
        rows = order[i : i + 256]
        sizes = np.array([len(items[r]) for r in rows])
        spans = np.array([len(regions[r]) for r in rows])
        a = np.zeros((len(rows), max(1, sizes.max())), np.uint64)
        b = np.ones((len(rows), max(1, spans.max(initial=0))), np.uint64)
        for n, r in enumerate(rows):
            a[n, : sizes[n]], b[n, : spans[n]] = items[r], regions[r]
        step = np.arange(a.shape[1] + 1)
        d = np.tile(step, (len(rows), 1))
        best = sizes.copy()
        for j in range(spans.max(initial=0)):
            new = np.empty_like(d)
            new[:, 0] = 0
            new[:, 1:] = np.minimum(d[:, :-1] + (a != b[:, j : j + 1]), d[:, 1:] + 1)
            d = step + np.minimum.accumulate(new - step, axis=1)
            here = d[np.arange(len(rows)), sizes]
            best = np.where(j < spans, np.minimum(best, here), best)
        out[rows] = best
    return out


class Detector:
    """The benchmark's items, seeds and LSH tables."""

    def __init__(self, ids, texts, edit_share: float, min_words: int, recall: float, seed: int = 37):
        self.roller = Roller(91)
        data, start, end, first = letter_words(pa.array(texts, pa.string()), digits=True)
        w = self.roller.words(data, start, end)
        self.ids, self.items, self.edits = [], [], []
        for i, f, l in zip(ids, first, first[1:], strict=False):
            if l > f:
                self.ids.append(i)
                self.items.append(w[f:l])
                self.edits.append(int(edit_share * (l - f)) if l - f >= min_words else 0)
        sizes = np.array([len(x) for x in self.items])
        self.sizes, self.allowed = sizes, np.array(self.edits, np.int64)
        chunk = sizes // (self.allowed + 1)
        self.seeds: dict[int, tuple] = {}
        self.stems: dict[int, np.ndarray] = {}
        held = []  # stems by item: length, place, hash
        for q in np.unique(chunk).tolist():
            own = np.flatnonzero(chunk == q)
            place = [np.arange(self.edits[n] + 1) * q for n in own]
            h = np.concatenate([self.grams(self.items[n], q)[p] for n, p in zip(own, place, strict=True)])
            who, place = np.repeat(own, [len(p) for p in place]), np.concatenate(place)
            order = np.argsort(h, kind="stable")
            h, who, place = h[order], who[order], place[order]
            times = np.searchsorted(h, h, "right") - np.searchsorted(h, h, "left")
            hot = times > HOT
            self.stems[q] = np.unique(h[hot])
            held.append((np.full(hot.sum(), q), who[hot], place[hot], h[hot]))
            seen = np.zeros(1 << 22, bool)
            seen[(h & U((1 << 22) - 1)).astype(np.int64)] = True
            self.seeds[q] = (h[~hot], who[~hot], place[~hot], seen)
        self.rare_words(*(np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 4)
        self.walks: dict[int, tuple] = {}
        for length in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == length)
            rows = np.stack([self.items[n] for n in own])
            k = self.edits[own[0]]
            repeats = repetitions(rows, k + k // 2, recall, seed)
            if repeats is None:
                self.walks[length] = (None, own, None)
                continue
            walk = Walk(length, repeats, seed)
            self.walks[length] = (walk, own, walk.samples(rows))

    def rare_words(self, q, who, place, h) -> None:
        """The items with stems: their stems, and their k + 1 rarest words."""
        order = np.argsort(who, kind="stable")
        q, self.stem_item, self.stem_place, h = q[order], who[order], place[order], h[order]
        self.stem_number = np.empty(len(q), np.int64)
        base = 0
        for size in sorted(self.stems):
            own = q == size
            self.stem_number[own] = base + np.searchsorted(self.stems[size], h[own])
            base += len(self.stems[size])
        items = np.unique(self.stem_item)
        every = np.concatenate([np.empty(0, np.uint64), *(np.unique(self.items[n]) for n in items)])
        words, times = np.unique(every, return_counts=True)
        word, item, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in items.tolist():
            w = self.items[n]
            rarest = np.argsort(times[np.searchsorted(words, w)], kind="stable")[: self.edits[n] + 1]
            word.append(w[rarest])
            item.append(np.full(len(rarest), n))
            at.append(rarest)
        word, item, at = np.concatenate(word), np.concatenate(item), np.concatenate(at)
        order = np.argsort(word, kind="stable")
        self.rare = (word[order], item[order], at[order])

    def grams(self, w: np.ndarray, q: int) -> np.ndarray:
        """Hashes of q consecutive words, for any q."""
        if q <= 1:
            return mix(w + U(1))
        return self.roller.ngrams(w, q)

    @staticmethod
    def placed(table: np.ndarray, values: np.ndarray):
        """Which entries of a sorted table equal each value, some ``PAIRS`` of them at a time."""
        lo, hi = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
        ends = np.cumsum(hi - lo)
        i = 0
        while i < len(values):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            row, step = spread(hi[i:j] - lo[i:j])
            if len(row):
                yield row + i, lo[i:j][row] + step
            i = j

    def by_rare_words(self, w: np.ndarray, stems: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Items with stems and where they would begin: one of their rarest words is there and, at most twice
        their edits off, one of their stems. ``stems`` are numbers and places, as ascending keys."""
        word, item, place = self.rare
        out, base = [], len(w) + 1
        at = np.flatnonzero(np.isin(w, word))
        for a, m in self.placed(word, w[at]):
            who, origin = item[m], at[a] - place[m]
            first, last = np.searchsorted(self.stem_item, who, "left"), np.searchsorted(self.stem_item, who, "right")
            near = np.zeros(len(who), bool)
            for step in range(int((last - first).max(initial=0))):
                live = np.flatnonzero(~near & (first + step < last))
                e = first[live] + step
                middle, off = origin[live] + self.stem_place[e], 2 * self.allowed[who[live]]
                low = self.stem_number[e] * base + np.maximum(middle - off, 0)
                high = self.stem_number[e] * base + np.minimum(middle + off, base - 1)
                near[live] = np.searchsorted(stems, low, "left") < np.searchsorted(stems, high, "right")
            if near.any():
                out.append(tuple(np.unique(np.stack([who[near], origin[near]], axis=1), axis=0).T))
        return out

    def find(self, column: pa.Array):
        """Rows, items, window starts and exact distances of the matches in a column of texts."""
        data, start, end, first = letter_words(column, digits=True)
        w = self.roller.words(data, start, end)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        keys, stems, base = [], [], 0
        for q, (h, who, place, seen) in self.seeds.items():
            g = self.grams(w, q)
            at = np.flatnonzero(seen[(g & U((1 << 22) - 1)).astype(np.int64)])
            at = at[doc[at] == doc[at + q - 1]] if len(at) else at
            for a, m in self.placed(h, g[at]):
                keys.append((who[m], at[a] - place[m]))
            common = self.stems[q]
            if len(common) and len(at):
                number = np.minimum(np.searchsorted(common, g[at]), len(common) - 1)
                hit = common[number] == g[at]
                stems.append((base + number[hit]) * (len(w) + 1) + at[hit])
            base += len(common)
        keys += self.by_rare_words(w, np.sort(np.concatenate(stems))) if stems else []
        if not keys:
            return []
        keys = np.unique(np.stack([np.concatenate([k[i] for k in keys]) for i in (0, 1)], axis=1), axis=0)
        found = set()
        lengths = self.sizes[keys[:, 0]]
        for length in np.unique(lengths).tolist():
            walk, own, samples = self.walks[length]
            mine = keys[lengths == length]
            if walk is None:
                found.update(map(tuple, mine[:, ::-1].tolist()))
                continue
            k = int(self.edits[own[0]])
            shift = np.unique(np.append(np.arange(-k, k + 1, max(1, k // 2 + k % 2)), 0))
            for i in range(0, len(mine), 128):
                item, origin = mine[i : i + 128].T
                near = origin[:, None] + shift
                begin, which = np.unique(near, return_inverse=True)
                which = which.reshape(near.shape)
                # a window may begin before its text or end after it: what is missing there is no word
                home = doc[np.clip(begin + length // 2, 0, len(w) - 1)]
                at = begin[:, None] + np.arange(length)
                valid = (at >= 0) & (at < len(w))
                at = np.clip(at, 0, len(w) - 1)
                seen = walk.samples(np.where(valid & (doc[at] == home[:, None]), w[at], U(0)))
                theirs = samples[np.searchsorted(own, item)]
                for j in range(len(shift)):
                    hit = (seen[which[:, j]] == theirs).any(1)
                    found.update(zip(near[hit, j].tolist(), item[hit].tolist(), strict=True))
        if not found:
            return []
        # overlapping windows of one item and text become one region
        rows = sorted((it, s) for s, it in found)
        cases = []
        for it, s in rows:
            k, length = self.edits[it], int(self.sizes[it])
            d = int(doc[min(max(s + length // 2, 0), len(w) - 1)])
            a, b = max(int(first[d]), s - k), min(int(first[d + 1]), s + length + k)
            if cases and cases[-1][0] == it and cases[-1][1] == d and a <= cases[-1][3]:
                cases[-1][3] = max(b, cases[-1][3])
            else:
                cases.append([it, d, a, b])
        dist = edit_distance([self.items[c[0]] for c in cases], [w[c[2] : c[3]] for c in cases])
        return [(d, self.ids[it], a - int(first[d]), b - int(first[d]), int(e)) for (it, d, a, b), e in zip(cases, dist, strict=True) if e <= self.edits[it]]


def _search(detector: Detector):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "first_word", "last_word", "edits")])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = []
            for i, j in slices(batch.column(1)):
                rows += [(ids[i + d], it, a, b - 1, e) for d, it, a, b, e in detector.find(batch.column(1).slice(i, j - i))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], schema=schema)

    return lean(run)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_share: float = 0.2, min_words: int = 8, recall: float = 0.99) -> DataFrame:
    """``doc_id, item_id, first_word, last_word, edits``: a row per document and leaked item, with the
    region that holds the best match and its word edits.

    Null and empty texts match nothing, nor do items without a word or with a null id or text; items
    under ``min_words`` words match only word for word; repeated items each match. Rows with a null id are
    left out, other columns are ignored, whatever their names. Items are held ``ITEMS`` or ``ITEM_BYTES``
    at a time, so a large benchmark takes several passes over ``docs``.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    passes = max(1, math.ceil(size["n"] / ITEMS), math.ceil(size["b"] / ITEM_BYTES))
    out = None
    for n in range(passes):
        block = sorted(items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n).collect())
        detector = Detector([r["i"] for r in block], [r["t"] for r in block], edit_share, min_words, recall)
        found = source.mapInArrow(_search(detector), "doc_id long, item_id long, first_word long, last_word long, edits long")
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "last_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.first_word", "b.last_word", "b.edits")
