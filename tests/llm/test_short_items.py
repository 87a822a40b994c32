"""Benchmark items of a few words are found word for word."""

from tidemark.llm.decontaminate import contamination


def test_short_items_match_exactly(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 8)] + [(20, "..."), (21, "")]
    docs = []
    for n, text in items[:7]:
        docs.append((n, f"before, {text.upper().replace(' ', ', ')} after"))
        docs.append((n + 100, f"before {text.replace(f'w{n}x{n - 1}', 'other')} after"))  # one edit
        docs.append((n + 200, text))
    docs += [(300, items[6][1][: items[6][1].rindex(" ")]), (301, "..."), (302, None)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(n + k, n) for n in range(1, 8) for k in (0, 200)}
    assert all(r["edits"] == 0 for r in got)
    assert {(r["first_word"], r["last_word"]) for r in got if r["doc_id"] == 5} == {(1, 5)}
