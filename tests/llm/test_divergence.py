"""The source audit against counts in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence
from tidemark.llm.divergence import partner, share, source_divergence

SCHEMA = "text string, lang string, source string, term string, n int, tid string, block string, kept string"


def expected(rows):
    texts = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), v or "", s or "") for t, v, s in rows]
    out = []
    for lang in {v for _, v, _ in texts}:
        docs = [(w, s) for w, v, s in texts if v == lang]
        df = Counter(t for w, _ in docs for t in set(w))
        kept = sorted((t for t, n in df.items() if n >= 10), key=lambda t: t.encode())
        counts = defaultdict(Counter)
        for w, s in docs:
            counts[s].update(t for t in w if df[t] >= 10)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        whole = p(sum(counts.values(), Counter()))
        shares = {s: p(c) for s, c in counts.items()}
        for s, own in shares.items():
            pairs = [(-sum(f(own[t], q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            terms = [(-f(own[t], whole[t]), t) for t in kept if counts[s][t] and own[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < 10]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "t", "b", "k") for r in rows], SCHEMA)
    got = source_divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["alpha", "Beta", "ÉTÉ", "été", "zeta", "ß", "it's", "a1b", "x_y", "日本", "rare%d"]
    out = []
    for k in range(400):
        text = " ".join(rng.choice(words[: 3 + k % 8]) for _ in range(rng.randint(0, 30)))
        out.append((text, rng.choice(["en", "en", None, "de"]), rng.choice(["a", "b", "é", None, "", "c", "d", "e", "f"])))
    out += [(None, None, None), ("", "en", "only empty"), ("unique words here", "fr", "x"), ("more", "fr", "y"), ("1 2 3", "nl", "alone")]
    return out + out[:20] + [("lorem Ipsum " * 30_000, "en", "long")]


def test_whole(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize(("shard", "widest", "rounds"), [(2, 1, 2), (3, 2, 1), (1, 1, 3)])
def test_many_shards_seats_and_rounds(spark, rows, monkeypatch, shard, widest, rounds):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "WIDEST", widest)
    monkeypatch.setattr(divergence, "ROUNDS", rounds)
    check(spark, rows[:120])


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_block_meets_each_other_once(spark):
    for seats in (2, 4, 6, 10):
        df = spark.range(seats).selectExpr("id as b", f"explode(sequence(0L, {seats - 2}L)) as r")
        from pyspark.sql import functions as F

        met = [(r["b"], r["p"]) for r in df.select("b", partner(F.col("b"), F.col("r"), F.lit(seats).cast("long")).alias("p")).collect()]
        assert len(set(met)) == len(met) == seats * (seats - 1)
        assert all((p, b) in set(met) and p != b for b, p in met)


def test_shares_are_exact():
    x, whole = np.array([1, 5, 10**13, 10**15]), np.array([3, 5, 3 * 10**13 + 1, 10**15 + 7])
    assert share(x, whole).tolist() == [10**9 * a // b for a, b in zip(x.tolist(), whole.tolist(), strict=True)]
