"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm.merkle import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, pos int, n string, key string, payload string, __part int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """All levels, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        out.append((level[first:at], level[at + 1 : first + 8]))
        at //= 8
    return out


def expected(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    order = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang, own in by_lang.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = tree([leaf(*r) for r in own])
    crown = tree([trees[v][-1][0] for v in order])
    root, out = crown[-1][0], []
    for k, lang in enumerate(order):
        for at, r in enumerate(by_lang[lang]):
            steps = path(trees[lang], at) + path(crown, k)
            h = own = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                h = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for before, after in steps:
                h = sha(*before, h, *after)
            out.append((r[0], own, trees[lang][-1][0], root, sha(*(x for b, a in steps for x in b + a)), h, h == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y", "z", 2) for r in rows], SCHEMA)
    got = merkle(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    return got


def test_nulls_ties_repeats_and_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", "ABC abc", "ÄÖ Ünïcode ÀB", "x\u0000Y", "Ab " * 40_000]
    rows = [(i, rng.choice(texts[:5]), rng.choice([None, "", "en", "de", "é"]), rng.choice([None, "", "s:1"]), rng.choice([None, 0, 12])) for i in range(90)]
    rows += [rows[4], rows[4], (5, "Other", *rows[5][2:]), (None, "No id", "en", None, None), (None, "No id", None, None, None), (-3, texts[5], "en", "s", 7)]
    got = check(spark, rows)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512, 513, 1025])
def test_every_height(spark, n):
    check(spark, [(i, f"Text {i}", "en", "s", i) for i in range(n)])


def test_many_languages(spark):
    check(spark, [(i, "Same", f"l{i % 530}", "s", 4) for i in range(700)])


def test_empty(spark):
    assert merkle(spark.createDataFrame([], SCHEMA)).count() == 0
