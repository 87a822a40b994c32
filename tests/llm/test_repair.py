"""Re-Pair goes on until no pair is frequent, runs of one id included."""

import numpy as np

from tidemark.llm.token_output import expand, repair


def most_frequent(seq, doc):
    """Of the pairs within documents, the most occurrences; in a run of one symbol, each second one counts."""
    counts, skip = {}, -1
    for i in range(len(seq) - 1):
        if doc[i] != doc[i + 1] or i == skip:
            continue
        pair = (seq[i], seq[i + 1])
        skip = i + 1 if pair[0] == pair[1] else -1
        counts[pair] = counts.get(pair, 0) + 1
    return max(counts.values(), default=0)


def test_runs_of_one_id():
    ids, doc = np.full(4096, 7, np.int32), np.repeat(np.arange(4, dtype=np.int32), 1024)
    seq, owner, rules = repair(ids, doc)
    assert (expand(seq, rules) == ids).all() and len(seq) < 64 and rules[0].tolist() == [7, 7]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 300, rng.integers(2, 200)) for _ in range(40)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 40, 1500)] + [np.full(301, 9), rng.integers(0, 300, 2000)]).astype(np.int32)
    doc = np.sort(rng.integers(0, 30, len(ids))).astype(np.int32)
    seq, owner, rules = repair(ids, doc)
    assert (expand(seq, rules) == ids).all()
    assert most_frequent(seq.tolist(), owner.tolist()) < 16


def test_freed_arrays_keep_their_pages():
    """A task's large arrays come and go without being mapped anew each time."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tidemark.llm.tokens import keep_pages
keep_pages()
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
arrays = lambda: len([np.ones(1 << 18) for _ in range(60)])
arrays()
before = faults()
for _ in range(20):
    arrays()
assert faults() - before < 40_000, faults() - before
"""
    subprocess.run([sys.executable, "-c", code], check=True)
