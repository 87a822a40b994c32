"""Benchmark items that share a stem: found as by brute force, at a bounded cost."""

import random
import resource
import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import Detector

STEM = "which of the following"


def distance(item, text):
    """Word edits of the item to the nearest run of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(6)
    out = []
    for k in range(60):
        tail = [f"w{rng.randrange(300)}" for _ in range(rng.randint(6, 24))]
        out.append(STEM.split() + tail if k % 5 else tail[:4] + STEM.split() + tail[4:])
    return out + [STEM.split() * 3, ["is", "it"] * 6, out[0], STEM.split()]


@pytest.mark.parametrize("pairs", [1, 50, 1 << 19])
def test_stems_equal_brute_force(items, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = random.Random(7)
    texts = []
    for k in range(90):
        item = list(items[rng.randrange(len(items))])
        for _ in range(rng.randint(0, int(0.2 * len(item)) + 1)):  # edits fall on the tail, the stem stays
            at = rng.randrange(4, len(item)) if len(item) > 4 and k % 3 else rng.randrange(len(item))
            kind = rng.randrange(3)
            if kind == 0:
                item[at] = f"x{k}"
            elif kind == 1:
                del item[at]
            else:
                item.insert(at, f"y{k}")
        around = [f"z{rng.randrange(50)}" for _ in range(12)]
        texts.append(" ".join(around[:6] + STEM.split() * (k % 4) + item + around[6:]))
    texts += [" ".join([STEM] * 40), "", None]
    detector = Detector(range(len(items)), [" ".join(x) for x in items], 0.2, 8, 0.99)
    got = {(d, i): e for d, i, _, _, e in sorted(detector.find(pa.array(texts)), key=lambda r: -r[4])}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            k = int(0.2 * len(item)) if len(item) >= 8 else 0
            if t and (e := distance(item, t.split())) <= k:
                want[d, i] = e
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want) and len(want) > 100


def test_thousands_of_items_with_one_stem():
    rng = np.random.default_rng(8)
    items = [f"{STEM} " + " ".join(f"w{x}" for x in rng.integers(0, 50_000, 12)) for _ in range(4000)]
    plain = " ".join([STEM] * 45_000)
    mixed = " ".join(f"{STEM} w{x}" for x in rng.integers(0, 50_000, 30_000))
    leak = f"{STEM} {items[77]} and so on"
    detector = Detector(range(4000), items, 0.2, 8, 0.99)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    found = detector.find(pa.array([plain, mixed, leak]))
    assert time.process_time() - began < 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10
    assert {(d, i) for d, i, *_ in found if d != 1} == {(2, 77)}
