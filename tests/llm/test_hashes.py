"""Words and sequences made to collide under sums of powers: no operator may take them for one another."""

import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import tokens  # noqa: E402
from tidemark.llm.kernels import Roller, same_bytes, words_of  # noqa: E402
from tidemark.llm.ngram_jaccard import ngram_jaccard  # noqa: E402
from tidemark.llm.substring_dedup import substring_dedup  # noqa: E402


def thue_morse(n: int, letters: str = "ab") -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


PAIRS = [thue_morse(n) for n in (64, 1024, 4096)]


def hashes(texts, seed=1):
    w = words_of(pa.array(texts))
    return Roller(seed).words(w.data, w.start, w.end)


@pytest.mark.parametrize("seed", [5, 11, 23, 24, 71])
def test_words_and_sequences_differ(seed):
    for a, b in PAIRS:
        assert len(set(hashes([a, b], seed).tolist())) == 2
        roller = Roller(seed)
        w = [roller.words(x.data, x.start, x.end) for x in (words_of(pa.array([" ".join(t)])) for t in (a, b))]
        for n in (5, 16, 50, len(a)):
            assert roller.ngrams(w[0], n)[0] != roller.ngrams(w[1], n)[0]


def test_hashes_depend_on_every_byte_and_on_nothing_else():
    rng = random.Random(1)
    texts = {"".join(rng.choice("abé") for _ in range(n)) for n in [*range(1, 90), 500] for _ in range(6)}
    one = hashes(sorted(texts))
    assert len(set(one.tolist())) == len(texts)
    two = [hashes([f"x {t} y"])[1] for t in sorted(texts)]
    assert one.tolist() == two
    roller, w = Roller(3), np.random.default_rng(0).integers(0, 9, 3000).astype(np.uint64)
    for n in (5, 9, 16, 50, 64):
        want = {}
        for i, h in enumerate(roller.ngrams(w, n).tolist()):
            assert want.setdefault(tuple(w[i : i + n].tolist()), h) == h
        assert len(set(want.values())) == len(want)


def test_same_bytes():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 3, 7, 8, 9, 16, 17, 63, 64, 65, 200) for _ in range(4)]
    words += [w[:-1] + "c" for w in words] + ["c" + w[1:] for w in words]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w) for w in words])
    at = np.cumsum(size) - size
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    i, j = i[size[i] == size[j]], j[size[i] == size[j]]
    assert same_bytes(data, at[i], data, at[j], size[i]).tolist() == [words[a] == words[b] for a, b in zip(i, j, strict=True)]


def test_jaccard_keeps_them_apart(spark):
    rows = [(2 * k + s, t) for k, pair in enumerate(PAIRS) for s, t in enumerate(pair)]
    rows += [(10 + k, " ".join(t)) for k, t in enumerate(PAIRS[0])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    assert all((got[i] == got[j]) == (100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in sets for j in sets if i != j)


def test_no_word_goes_for_a_foreign_text(spark):
    rows = []
    for k, (a, b) in enumerate(PAIRS):
        rows += [(4 * k, " ".join([a] * 60)), (4 * k + 1, " ".join([b] * 60)), (4 * k + 2, " ".join([b] * 55))]
    one, two = thue_morse(64)
    rows += [(100, " ".join(one)), (101, " ".join(two).replace("b", "c"))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 55 if i % 4 == 2 and i < 100 else 0 for i, _ in rows}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name, monkeypatch):
    own = tokens.UnitEncoder(public_tokenizers.path(name))
    texts = [t for pair in PAIRS for t in pair] + ["ab abb b a", "a ab abb"]
    for forged in (False, True):
        if forged:  # even if all hashes were equal
            monkeypatch.setattr(Roller, "words", lambda self, data, start, end: np.full(len(start), 7, np.uint64))
            own = tokens.UnitEncoder(public_tokenizers.path(name))
        for _ in range(2):
            ids, counts = own.encode(pa.array(texts))
            want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
