"""Each training-data operator against brute force, round trips and held-out rows, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import decontaminate, html_extract, language_id, packing, quality, token_output, tokens  # noqa: E402
from tidemark.llm.chat_format import chat_examples, parse, read_examples  # noqa: E402
from tidemark.llm.components import components  # noqa: E402
from tidemark.llm.decontaminate import Detector, contamination, edit_distance  # noqa: E402
from tidemark.llm.embedding_dedup import embedding_dedup  # noqa: E402
from tidemark.llm.kernels import Roller, words_of  # noqa: E402
from tidemark.llm.ngram_jaccard import ngram_jaccard  # noqa: E402
from tidemark.llm.substring_dedup import FingerprintIndex, sliding_min, substring_dedup  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, bucket int, h string, size long, rep string"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats, tiny, empty, null, very long and odd texts."""
    rng = random.Random(4)
    base = words(rng, 120)
    passage = words(rng, 70)
    texts = [" ".join(base)] * 3 + [" ".join(base).upper()]
    for k in range(40):
        near = list(base)
        for _ in range(1 + k % 9):
            near[rng.randrange(len(near))] = "x%d" % rng.randrange(9)
        texts.append("\n".join(near))
    texts += [" ".join(words(rng, 30) + passage + words(rng, 20)) for _ in range(6)]
    texts += [" ".join(words(rng, 60)) for _ in range(12)]
    texts += [None, "", " \t\n", "one", "one", "One two", "one two three four five", "a b c d", "é ü x", "  ".join(["la"] * 200), " ".join(words(rng, 9000)), " ".join(passage * 3)]
    return [(i * 7 % 97 + (i // 97) * 97, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "h", 2, None) for i, t in rows], DOCS)


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_and_hashes():
    texts = ["a bb\tc", None, "", "ab", "ab ", " x y\x0b", "c"]
    w = words_of(pa.array(texts))
    got = [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t or "")] and w.counts.tolist() == [3, 0, 0, 1, 1, 2, 1]
    r = Roller(1)
    h = r.words(w.data, w.start, w.end)
    assert h[3] == h[4] and h[2] == h[7] and len(set(h.tolist())) == 6
    g = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    assert sliding_min(g, 35).tolist() == [g[i : i + 35].min() for i in range(166)]


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (1, 2), (3, 2), (5, 5), (None, 4), (6, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 6, 8: 6, 7: 6, 6: 6, 1: 1, 2: 1, 3: 1}


def test_ngram_jaccard(spark, corpus):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in corpus:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(links, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard(frame(spark, corpus)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert ngram_jaccard(frame(spark, [])).count() == 0


def window_dedup(corpus):
    """Brute force: word count, removed words, digest and text of what stays, by document."""
    w = {i: WORD.findall(t or "") for i, t in corpus}
    first: dict = {}
    for i in sorted(w):
        for k in range(len(w[i]) - 49):
            first.setdefault(tuple(w[i][k : k + 50]), i)
    want = {}
    for i, ws in w.items():
        gone = set()
        for k in range(len(ws) - 49):
            if first[tuple(ws[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [x for k, x in enumerate(ws) if k not in gone]
        want[i] = (len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return want


def test_substring_dedup(spark, corpus):
    rows = substring_dedup(frame(spark, corpus), with_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in rows} == window_dedup(corpus)
    assert substring_dedup(frame(spark, [])).count() == 0


def test_log_outlasts_a_call(spark, corpus, tmp_path):
    """Two calls on one log give what one call on all documents gives."""
    log, ids = str(tmp_path / "log"), sorted(i for i, _ in corpus)
    old, new = ([(i, t) for i, t in corpus if (i < ids[len(ids) // 2]) == early] for early in (True, False))
    got = {r["doc_id"]: r["kept"] for r in substring_dedup(frame(spark, old), with_text=True, log=log, batches=1).collect()}
    with pytest.raises(ValueError, match="history"):
        substring_dedup(frame(spark, new), log=log)
    got |= {r["doc_id"]: r["kept"] for r in substring_dedup(frame(spark, new), with_text=True, log=log, history=frame(spark, old), batches=2, fanout=1).collect()}
    assert got == {i: r[3] for i, r in window_dedup(corpus).items()}
    assert len(FingerprintIndex(spark, log).runs) == 1


def test_fingerprint_log(spark, tmp_path):
    log = str(tmp_path / "log")
    make = lambda rows: spark.createDataFrame(rows, "h long, doc_id long")
    seen = lambda rows: sorted(map(tuple, FingerprintIndex(spark, log, 1).matches(make(rows)).collect()))
    add = lambda rows: FingerprintIndex(spark, log, 1).append(make(rows))
    assert seen([(1, 10), (2, 10), (2, 11)]) == [(10, 2, False), (11, 2, False)]
    add([(1, 10), (2, 10), (2, 11)])
    assert seen([(1, 20), (3, 20)]) == [(10, 1, True), (20, 1, False)]
    add([(1, 20), (3, 20)])
    index = FingerprintIndex(spark, log, 1)
    assert len(index.runs) == 1 and index.everything().count() == 5
    assert [f for f in (tmp_path / "log" / "runs").iterdir() if f.is_dir()] == [tmp_path / "log" / "runs" / index.runs[0]]
    assert seen([(9, 30)]) == []


def test_edit_distance():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    cases = [([9, 1, 2, 3, 4, 5, 9], 0), ([1, 2, 7, 4, 5], 1), ([1, 2, 4, 5], 1), ([1, 2, 3, 8, 4, 5], 1), ([7, 7], 5), ([], 5)]
    assert edit_distance([a] * len(cases), [np.array(c, np.uint64) for c, _ in cases]).tolist() == [d for _, d in cases]


def test_contamination(spark):
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, rng.randint(15, 40)))) for k in range(8)] + [(90, "too short"), (91, None), (92, "")]
    docs, want = [], set()
    for n in range(60):
        filler = words(rng, rng.randint(0, 80))
        body = []
        if n % 3 == 0:
            k, text = items[n % 8]
            body = text.upper().split() if n % 2 else [w + "," for w in text.split()]
            for _ in range(n % 4):
                body[rng.randrange(len(body))] = "zzzz"
            want.add((n, k))
        docs.append((n, " ".join(filler + body + words(rng, 10))))
    docs += [(100, None), (101, ""), (102, items[0][1] + " " + items[1][1])]
    want |= {(102, 0), (102, 1)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert contamination(frame(spark, docs), bench.where("item_id >= 90")).count() == 0
    assert contamination(frame(spark, []), bench).count() == 0


def test_recall_at_the_edit_limit():
    rng = random.Random(6)
    items = [" ".join(words(rng, 30)) for _ in range(6)]
    d = Detector(range(6), items, 0.2, 8, 0.99)
    texts = []
    for n in range(120):
        w = items[n % 6].split()
        for _ in range(6):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 2)] = [] if kind == 1 else ["new%d" % rng.randrange(99)]
        texts.append(" ".join(words(rng, 40) + w + words(rng, 10)))
    found = {(r, i) for r, i, *_ in d.find(pa.array(texts))}
    assert sum((n, n % 6) in found for n in range(120)) >= 110


SMALL = "/root/testdata/sf0.001"


def test_contamination_against_brute_force(spark):
    """Every document against every item of the smallest tables, by an edit distance of its own."""
    letter = re.compile(r"[a-z0-9\x80-\xff]+")
    lower = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    split = lambda t: letter.findall(re.sub("[À-ÖØ-Þ]", lambda m: m[0].lower(), lower(t)).encode().decode("latin-1"))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [(-1, docs[5][1][:20])]
    code: dict[str, int] = {}
    number = lambda t: [code.setdefault(w, len(code)) for w in split(t)]
    sizes = np.array([len(number(t)) for _, t in items])
    table = np.full((len(items), sizes.max()), -1)
    for k, (_, t) in enumerate(items):
        table[k, : sizes[k]] = number(t)
    step = np.arange(sizes.max() + 1)
    limit = np.where(sizes >= 8, (0.2 * sizes).astype(int), 0)
    want = {}
    for i, text in docs:
        d = np.tile(step, (len(items), 1))
        best = sizes.copy()
        for w in number(text):
            new = np.zeros_like(d)
            new[:, 1:] = np.minimum(d[:, :-1] + (table != w), d[:, 1:] + 1)
            d = step + np.minimum.accumulate(new - step, axis=1)
            best = np.minimum(best, d[np.arange(len(items)), sizes])
        want |= {(i, items[k][0]): int(best[k]) for k in np.flatnonzero((best <= limit) & (sizes > 0))}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in contamination(frame(spark, docs), spark.createDataFrame([(k, t, 1, "x") for k, t in items], "item_id long, text string, doc_id int, edits string")).collect()}
    assert len(want) >= 3 and got.items() <= want.items() and len(got) >= 0.98 * len(want)


def test_items_beyond_the_lsh(monkeypatch):
    """Where no affordable number of repetitions reaches the recall, seeds alone find what can be found."""
    rng = random.Random(9)
    items = [" ".join(words(rng, 30)) for _ in range(4)]
    monkeypatch.setattr(decontaminate, "REPETITIONS", 1)
    d = Detector(range(4), items, 0.2, 8, 0.99)
    assert {w[0] for w in d.walks.values()} == {None}
    texts = []
    for n in range(40):
        w = items[n % 4].split()
        for _ in range(6):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 2)] = [] if kind == 1 else ["new%d" % rng.randrange(99)]
        texts.append(" ".join(words(rng, 40) + w + words(rng, 10)))
    found = {(r, i) for r, i, *_ in d.find(pa.array(texts))}
    assert found >= {(n, n % 4) for n in range(40)}


def test_risk_slopes_are_its_gradient():
    rng = np.random.default_rng(0)
    for prior, shift in ((0.3, 0.0), (0.9, -2.0)):
        gp, gu = rng.normal(size=7), rng.normal(size=11) + shift
        value, dp, du = quality.risk(gp, gu, prior)
        second = quality.sigmoid(gu).mean() - prior * quality.sigmoid(gp).mean()
        assert (second < 0) == (shift < 0)
        # where the second term is negative, steps go along its own gradient, turned round
        f = (lambda p, u: quality.risk(p, u, prior)[0]) if second >= 0 else (lambda p, u: prior * quality.sigmoid(p).mean() - quality.sigmoid(u).mean())
        for g, own, other in ((gp, dp, lambda x: f(x, gu)), (gu, du, lambda x: f(gp, x))):
            for k in range(len(g)):
                e = np.zeros_like(g)
                e[k] = 1e-6
                assert abs((other(g + e) - other(g - e)) / 2e-6 - own[k]) < 1e-8


def test_prior_is_estimated():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.6, 0.9):
        n = int(3000 * share)
        mixed = np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (3000 - n, 4))])
        assert abs(quality.estimate_prior(rng.normal(1.5, 1, (1500, 4)), mixed) - share) < 0.08


def test_held_out_rows_of_the_sample_tables(spark):
    """The registered queries on rows that no model has seen: language and quality."""
    from tidemark.llm import queries

    table = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    told = [(table[r["doc_id"]], r["lang_pred"]) for r in queries.op7_language_id(spark, SMALL).collect() if r["held_out"] and table[r["doc_id"]]]
    assert len(told) > 20 and sum(a == b for a, b in told) >= 0.9 * len(told)
    scored = [(marks[r["doc_id"]], r["predicted"]) for r in queries.op2_quality(spark, SMALL).collect() if r["held_out"] and r["doc_id"] in marks]
    assert len(scored) > 5 and sum(a == b for a, b in scored) >= 0.8 * len(scored)


def test_quality(spark):
    rng = random.Random(3)
    good = [(i, " ".join(words(rng, 60)).capitalize() + ".") for i in range(240)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(rng, 8) * 8)) for i in range(80)]
    docs = frame(spark, good + bad + [(5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:150]] + [(i, 0) for i, _ in bad[:40]] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    s = {r["doc_id"]: r["score"] for r in quality.quality(docs, model).collect()}
    assert len(s) == 322 and all(0 <= x <= 1 for x in s.values()) and s[5000] == s[5001]
    assert np.mean([s[i] >= 0.3 for i, _ in good[150:]]) > 0.95 and np.mean([s[i] < 0.3 for i, _ in bad[40:]]) > 0.85
    assert quality.fit(docs, labels.where("quality = 0")) is None
    assert {r["score"] for r in quality.quality(docs, None).collect()} == {0.5}
    assert quality.quality(frame(spark, []), model).count() == 0


def test_language_id(spark):
    letters = {"aa": "abcde", "bb": "rstuv"}
    rng = random.Random(5)
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, say(("aa", "bb")[i % 2], 30), ("aa", "bb")[i % 2]) for i in range(60)]
    model = language_id.fit(spark.createDataFrame([*rows, (99, None, "aa"), (98, "abc", None)], "doc_id long, text string, lang string"))
    assert model[2] == ["aa", "bb"]
    mixed = say("aa", 20) + " " + say("bb", 10)
    tests = [(1, say("aa", 5)), (2, say("bb", 5)), (3, None), (4, ""), (5, "12 ### 34"), (6, "…—"), (7, mixed), (8, "bad." * 4000)]
    got = {r["doc_id"]: r for r in language_id.language_id(frame(spark, tests), model, with_spans=True).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 9)] == ["aa", "bb", "und", "und", "und", "und", "aa", "aa"]
    assert [(s["first"], s["last"], s["lang"]) for s in got[7]["spans"]] == [(0, 19, "aa"), (20, 29, "bb")]
    assert language_id.language_id(frame(spark, tests[:1]), language_id.train([], [])).first()["lang_pred"] == "und"
    assert language_id.language_id(frame(spark, []), model).count() == 0 and language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))[2] == []
    long = language_id.fit(spark.createDataFrame([(1, "ab " * 40_000, "aa", 2), (2, "cd", "bb", 2)], "doc_id long, text string, lang string, i int"), most_bytes=100)
    assert long[2] == ["aa", "bb"]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, trans, n = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), 3
    total, single, pair = 0.0, np.zeros((3, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3):
        p = np.exp(sum(emit[t, 0, path[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for t in range(n):
            single[t, path[t]] += p
        for a, b in zip(path, path[1:], strict=False):
            pair[a, b] += p
    got, seen = language_id.forward_backward(emit, np.array([3]), trans, pairs=True)
    assert np.allclose(got[:3, 0], single / total) and np.allclose(seen, pair / total)


def test_html_model():
    model = html_extract.fit(rounds=120)
    pages = html_extract.labelled_pages(60, 77)
    wrong = sum(len(set(html_extract.extract_texts([s], model)[0].split("\n\n")) ^ good) for s, good in pages)
    assert wrong <= 0.05 * sum(len(g) for _, g in pages)
    odd = "<body><nav><a href=/x>Home</a></nav><article><h1>A &amp; B</h1><p>one<br>two &lt;x&gt;\n three<script>if (a<b) '</p>'</script><p>four <b>bold</b>s</p><!-- <p>no</p> --><aside>ad here</aside></article><footer>&copy; x"
    assert html_extract.extract_texts([odd, None, "", "<", "<<>>", "a <b", "<p"], model)[0] == "A & B\n\none two <x> three\n\nfour bolds"


def test_small_and_linked_pages():
    model = html_extract.fit()
    menu = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    pages = {
        "<article><p>Some text here.</p><p>End of it.</p></article>": "Some text here.\n\nEnd of it.",
        "<main><p>Hello, this is the first paragraph of a story.</p></main>": "Hello, this is the first paragraph of a story.",
        f"<body>{menu}<article><h1>The title</h1><p>A paragraph of words, as usual.</p><ul><li><a href=x>Linked list item in the article body</a></li></ul></article><footer>&copy; all rights</footer>": "The title\n\nA paragraph of words, as usual.\n\nLinked list item in the article body",
        "<html><body><h1>Title</h1><p>Text text.</p></body></html>": "Title\n\nText text.",
    }
    assert html_extract.extract_texts(list(pages), model) == list(pages.values())


def test_blocks_against_another_parser():
    """Text blocks of random nested pages, as the standard library's parser cuts them."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self, page):
            super().__init__(convert_charrefs=True)
            self.out, self.now = [], []
            self.feed(page)
            self.close()
            self.cut()

        def cut(self, *_):
            text = " ".join("".join(self.now).split())
            self.out += [text] * bool(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in ("b", "a", "em"):
                return
            self.now.append("\n") if tag == "br" else self.cut()

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "em"):
                self.cut()

        def handle_data(self, data):
            self.now.append(data)

    rng = random.Random(12)

    def page(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            word = " ".join(words(rng, rng.randint(1, 5))) + rng.choice(["", " &amp; x", " &lt;b&gt;", "\n\t y"])
            if kind < 0.35 or not depth:
                out.append(word)
            elif kind < 0.5:
                out.append(f"<{(t := rng.choice(['b', 'a', 'em']))} title='a > b'>{word}</{t}>")
            elif kind < 0.6:
                out.append("<br>" + word)
            else:
                out.append(f'<{(t := rng.choice(["div", "section", "blockquote"]))} class="k {rng.randint(0, 9)}">{page(depth - 1)}</{t}><!-- <p>no</p> -->')
        return "".join(out)

    for _ in range(150):
        source = page(4)
        assert [t for t in html_extract.Page(source).texts if t is not None] == Blocks(source).out


@pytest.mark.parametrize("unit", ["<b>", "<div>", "<li><div>", "<p><b>", "<a ", '<a "', "<a '\">", "<", "</b>", "<!--", "<table><tr><td>"])
def test_hostile_pages_take_linear_time(unit):
    import time

    model = (np.zeros(html_extract.N_FEATURES), np.zeros((2, 2, 2)))
    started = time.process_time()
    html_extract.extract_texts([unit * (100_000 // max(1, unit.count("<")))], model)
    assert time.process_time() - started < 8


def test_tree_marginals_are_exact():
    forest = html_extract.Forest([html_extract.Page("<div><p>a</p><p>b</p></div>")])
    rng = np.random.default_rng(1)
    w, e = rng.normal(size=html_extract.N_FEATURES), rng.normal(size=(2, 2, 2))
    n, total, single = len(forest.parent), 0.0, np.zeros(len(forest.parent))
    theta = forest.features @ w
    for y in np.ndindex(*[2] * n):
        p = np.exp(sum(theta[i] * y[i] for i in range(n)) + sum(e[int(forest.leaf[i]), y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += p
        single += p * np.array(y)
    assert np.allclose(forest.passes(w, e)[0], single / total)


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x y</p></article>", "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    rows = sorted(map(tuple, html_extract.html_extract(pages, html_extract.fit(rounds=60)).collect()), key=str)
    assert [r[0] for r in rows] == [1, 2, 2] and rows[1][2:] == ("", 0)
    assert html_extract.html_extract(pages.limit(0), html_extract.fit(rounds=2)).count() == 0


def test_chat(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s#\n</turn>\n### user: x"), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (1, 3, "assistant", ""), (1, 4, "user", None), (2, 0, "user", "q"), (3, 5, "assistant", "first"), (3, 5, "assistant", "again"), (4, 0, None, None), (5, 0, "as:sist<", "\\"), (5, 1, "assistant", "é" * 3), (None, 1, "assistant", "nobody's")]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n int")
    examples = chat_examples(table)
    each = [r for r in examples.collect() if r["conv_id"] == 1]
    assert len(each) == 3 and [parse(r["text"])[-1][1] for r in sorted(each, key=lambda r: r["example"])] == [tricky, "", ""]
    got = {r["conv_id"]: r for r in read_examples(examples).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows[:-1]:
        convs[c].append((t, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_examples(table.limit(0)).count() == 0 and read_examples(chat_examples(table.limit(0))).count() == 0


ODD = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "...", "…", "1", "23", " ", " ", "don't", "<|endoftext|>", "×", "日本", "é", "\r\n", "\x1c", "_", "!!", "İ", "Σ", "\u0085", "😀"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_cache_equals_library(name):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    enc, column, got = tokens.UnitEncoder(public_tokenizers.path(name)), pa.array(texts, pa.string()), []
    for a, b in tokens.slices(column, 4000):
        ids, counts = enc.encode(column.slice(a, b - a))
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want


def test_packing_plan():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2049, 5000), np.array([2048, 1, 1, 2047, 1024, 1024]), np.array([], int), np.full(50, 700)):
        h = np.bincount(lengths, minlength=2049)
        slots, n = packing.plan(h, 2048)
        assert (np.bincount(slots[:, 0], slots[:, 2], 2049) == h).all()
        fill = np.zeros(n, np.int64)
        for length, _, times, seq, offset in sorted(slots.tolist(), key=lambda x: x[4]):
            assert (fill[seq : seq + times] == offset).all()
            fill[seq : seq + times] += length
        assert fill.max(initial=0) <= 2048
        if len(lengths) == 5000:
            assert fill.sum() / (n * 2048) > 0.99


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_solution_places_most_rests(sf):
    """At the sizes of the sample tables the rounded solution, not the greedy residual, packs the rests."""
    import pyarrow.parquet as pq

    sizes = np.array([1 + len(t.split()) * 3 // 2 for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet")["text"].to_pylist() if t]) % 2048
    h = np.bincount(sizes[sizes > 0], minlength=2049)
    shapes, rest = packing.solve(h, 2048)
    assert (h == np.bincount([k for lengths, n in shapes + rest for k in lengths * n], minlength=2049)).all()
    assert all(sum(lengths) <= 2048 for lengths, _ in shapes) and sum(len(x) * n for x, n in shapes) >= 0.8 * h.sum()
    assert sum(n for _, n in shapes + rest) <= sum(n for _, n in packing.greedy(h, 2048))


def test_pack_keeps_ids(spark):
    rows = [(None, "a b"), (None, None), ((1 << 60) + 1, "c"), (-3, ""), (-3, "")]
    got = packing.pack(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["length"]) for r in got) == [(False, -3, 1), (False, -3, 1), (False, (1 << 60) + 1, 2), (True, 0, 1), (True, 0, 3)]
    assert packing.pack(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pack_and_write_tokens(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    path8, path10 = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    lib8, lib10 = Tokenizer.from_file(path8), Tokenizer.from_file(path10)
    want8 = {i: [*lib8.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus}
    rows = packing.pack(frame(spark, corpus), path8, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(ids) == r["length"] and r["doc_tokens"] == len(want8[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in pieces.items()} == want8
    for s in sequences.values():
        ends = 0
        for offset, length in sorted(s):
            assert offset == ends
            ends += length
        assert ends <= 2048
    out = str(tmp_path / "tokens")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.token_output(frame(spark, corpus), path10, out).collect()}
    start = 0
    for i, t in sorted(corpus):
        ids = [*lib10.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    segment = spark.read.parquet(out).orderBy("first_doc").first().asDict()
    first = min(i for i, _ in corpus)
    ids = [*lib10.encode(dict(corpus)[first] or "", add_special_tokens=False).ids, 2]
    assert token_output.decode_range(segment, 0, 3, 17).tolist() == ids[3:17]
    assert token_output.token_output(frame(spark, []), path10, str(tmp_path / "none")).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 30), 60), rng.integers(0, 50, 3000), np.full(500, 7)]).astype(np.int32)
    doc = np.sort(rng.integers(0, 40, len(ids))).astype(np.int32)
    seq, owner, rules = token_output.repair(ids, doc)
    assert len(seq) < 0.7 * len(ids) and (token_output.expand(seq, rules) == ids).all()
    sizes = np.where(seq >= token_output.FIRST_RULE, np.append(token_output.rule_lengths(rules), 1)[np.minimum(np.maximum(seq - token_output.FIRST_RULE, 0), len(rules))], 1)
    assert (np.bincount(owner, sizes, 40) == np.bincount(doc, minlength=40)).all()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([np.repeat(centres, 20, 0) + 0.12 * rng.normal(size=(240, 16)), rng.normal(size=(60, 16))])
    x = np.concatenate([x, x[:5], x[:5]])
    labels = [int(v) for v in rng.integers(0, 2, len(x))]
    labels[300:305], labels[305:] = labels[:5], [1 - v for v in labels[:5]]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, x[0].tolist(), None), (904, [None] * 16, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [], 1), (907, [1.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup(table, recall=1.0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(near, False)
    want = roots(list(zip(*np.nonzero(near), strict=True)), range(len(x)))
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.97 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert sum(got[i]["component_id"] == want[i] for i in range(len(x))) >= 0.97 * len(x)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, *_ in odd)
    assert embedding_dedup(table.where("vec_id >= 904")).count() == 4


def test_embedding_recall_as_registered(spark):
    """At the registered recall, against brute force, with text labels, several lengths and extra columns."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(150, 32))
    x = np.repeat(centres, 8, 0) + 0.1 * rng.normal(size=(1200, 32))
    label = np.array(["red", "blue"])[rng.integers(0, 2, len(x))]
    rows = [(i, v.tolist(), k, "x", 1.0) for i, (v, k) in enumerate(zip(x, label.tolist(), strict=True))]
    rows += [(5000 + i, v[:9].tolist(), k, None, None) for i, (v, k) in enumerate(zip(x[:40], label[:40].tolist(), strict=True))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rep string, weight double")).collect()}
    links = found = 0
    for part, ids in ((x, range(1200)), (x[:40, :9], range(5000, 5040))):
        u = part / np.linalg.norm(part, axis=1, keepdims=True)
        near = (u @ u.T >= 0.93) & (label[: len(u), None] == label[: len(u)])
        np.fill_diagonal(near, False)
        links += near.sum()
        found += sum(got[i] for i in ids)
        assert all(got[i] <= n for i, n in zip(ids, near.sum(1), strict=True))
    assert links > 4000 and found >= 0.95 * links


def test_pipeline(spark, tmp_path):
    """Planted copies, passages and leaks go; clean texts arrive whole."""
    import corpus_pipeline

    rng = random.Random(8)
    docs = "/root/testdata/sf0.001/documents.parquet"
    rows = [r.asDict() for r in spark.read.parquet(docs).orderBy("doc_id").limit(60).collect()]
    clean = [r for r in rows if r["text"] and len(r["text"].split()) > 60][:10]
    item = " ".join(words(rng, 30))
    passage = " ".join(words(rng, 60))
    make = lambda i, t: {"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t) if t else None}
    planted = [make(9001, clean[0]["text"]), make(9002, " ".join(words(rng, 80)) + " " + item + " end"), make(9003, None), make(9004, "123 ###"), make(9005, clean[2]["text"][: len(clean[2]["text"]) // 3] + " " + passage), make(9006, passage + " " + " ".join(words(rng, 90)))]
    spark.createDataFrame(rows + planted, spark.read.parquet(docs).schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in table.collect()}
    assert {9003, 9004} & set(seen["language_id"]) == set() and 9001 in seen["language_id"]
    assert 9001 not in seen["ngram_jaccard"] and clean[0]["doc_id"] in seen["ngram_jaccard"]
    assert passage not in seen["substring_dedup"][9006]["text"]
    assert 9002 in seen["substring_dedup"] and 9002 not in seen["decontamination"]
    assert set(seen["packing"]) == set(seen["decontamination"])
    kept = [r for r in rows if r["doc_id"] in seen["decontamination"]]
    assert len(kept) > 30 and sum(seen["decontamination"][r["doc_id"]]["text"] == r["text"] for r in kept) > 0.8 * len(kept)


def test_pipeline_edge_cases(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, a clashing extra column, and an empty table."""
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(11)
    rows = [r.asDict() for r in source.orderBy("doc_id").limit(30).collect() if r["text"] and len(r["text"].split()) > 60]
    long = " ".join(words(rng, 30_000))
    make = lambda i, t: {"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": None}
    rows += [make(None, rows[0]["text"]), make(None, None), make(None, ""), make(7001, None), make(7002, ""), make(7003, long), make(7004, rows[1]["text"]), make(7004, rows[1]["text"])]
    names = [*source.columns, "spans", "h"]
    schema = source.schema.add("spans", "string").add("h", "long")
    table = spark.createDataFrame([{**r, "spans": "x", "h": 1} for r in rows], schema)
    spark.createDataFrame([(1, " ".join(words(rng, 20))), (None, "a b c"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for case, docs in (("rows", table), ("none", table.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / case / name))
            docs = spark.read.parquet(str(tmp_path / case / name))
            if name != "packing":
                assert docs.columns == names
        if case == "none":
            assert docs.count() == 0
            continue
        kept = {r["doc_id"] for r in docs.collect()}
        # rows without an id are never dropped; copies and texts without a letter go
        assert None in kept and 7003 in kept and not kept & {7001, 7002, 7004}
        assert docs.where("doc_id is null and start = 0").count() == 3
