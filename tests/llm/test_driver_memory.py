"""What the driver holds at a time: plans stay small, and training gives its pages back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from tidemark.llm import language_id
from tidemark.llm import ngram_jaccard as op
from tidemark.llm.scratch import Scratch

#: Tables that one plan reads at most; what is read again counts again.
MOST = 8


def test_plans_of_jaccard_stay_small(spark, monkeypatch):
    """The star rounds read their edges 18 times in one plan, and the driver held it and all versions of it."""
    sizes = []

    def seen(f):
        def run(self, *args, **kw):
            df = args[0] if isinstance(self, Scratch) else self
            sizes.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
            return f(self, *args, **kw)

        return run

    frame = type(spark.range(1))
    assert issubclass(frame, DataFrame)
    monkeypatch.setattr(frame, "checkpoint", seen(frame.checkpoint))
    monkeypatch.setattr(Scratch, "save", seen(Scratch.save))
    # texts of 40 words, each with one word other than its neighbour's: chains of links
    words = [f"w{i}" for i in range(40)]
    rows = []
    for k in range(12):
        if k % 4 == 0:
            words = [f"{w}x" for w in words]
        words[3 * k] = f"new{k}"
        rows.append((100 - k, " ".join(words)))
    found = {r.doc_id: r.component_id for r in op.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {100 - k: 100 - (k // 4 * 4 + 3) for k in range(12)}
    assert max(sizes) <= MOST, sizes


def test_fit_gives_memory_back(spark, monkeypatch):
    """Free pages went back to the system only by chance: some 60 MB stayed with the driver."""
    calls = []
    monkeypatch.setattr(language_id, "train", lambda *a, **k: calls.append("train") or (None, None, ["en"]))
    monkeypatch.setattr(language_id, "trim", lambda: calls.append("trim"), raising=False)
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    assert language_id.fit(docs)[2] == ["en"]
    assert calls == ["train", "trim"]
