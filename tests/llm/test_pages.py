"""Hand-written pages, unlike those that the model is trained on: what must stay and what must go."""

import pytest

from tidemark.llm.html_extract import extract_texts, fit

PAGES = {
    "terms": (
        "<body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>Terms used here</h1><p>We explain some words first.</p><dl><dt>Tide</dt><dd>The rise and fall of the sea.</dd><dt>Ebb</dt><dd>The fall after high tide.</dd></dl><p>Then the story goes on.</p></article><footer>(c) 2024 The Harbour Times</footer></body>",
        ["Terms used here", "We explain some words first.", "Tide", "The rise and fall of the sea.", "Ebb", "The fall after high tide.", "Then the story goes on."],
    ),
    "pull quote": (
        "<main><h1>A talk</h1><p>The mayor spoke for an hour about the new bridge.</p><aside class='pullquote'>We will build it by spring.</aside><p>Nobody objected at the end of the meeting.</p></main><aside><h3>Most read</h3><ul><li><a href=1>Fire in the old mill</a></li><li><a href=2>School opens late</a></li></ul></aside>",
        ["A talk", "The mayor spoke for an hour about the new bridge.", "We will build it by spring.", "Nobody objected at the end of the meeting."],
    ),
    "misleading names": (
        "<div id=content><h1>Markets</h1><p class='comment-free'>The market was calm today, said the traders.</p><p class='share-price'>A share cost four euros at noon.</p></div><div class=comments><div class=comment><p>I do not believe a word of it!</p></div></div>",
        ["Markets", "The market was calm today, said the traders.", "A share cost four euros at noon."],
    ),
    "details": (
        "<article><h1>Questions</h1><details><summary>How long does it take?</summary><p>It takes about two days to arrive by post.</p></details></article><form><label>Your mail</label><input><button>Send</button></form>",
        ["Questions", "How long does it take?", "It takes about two days to arrive by post."],
    ),
    "button in a sentence": (
        "<article><p>Press <button>OK</button> to go on.</p><p>Then wait until the light is green again.</p></article><div class='cookie-notice'><p>We use cookies on this site.</p><button>Accept</button></div>",
        ["Press OK to go on.", "Then wait until the light is green again."],
    ),
    "table for a menu": (
        "<body><table><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td><td><a href=/s>Sport</a></td></tr></table><article><h1>Storm</h1><p>The storm hit the coast on Monday evening, and many roofs were lost.</p></article></body>",
        ["Storm", "The storm hit the coast on Monday evening, and many roofs were lost."],
    ),
    "table of figures": (
        "<article><h2>Rain in May</h2><table><tr><th>Town</th><th>mm</th></tr><tr><td>Port Ellen</td><td>61</td></tr></table><p>It rained less than in the year before.</p></article>",
        ["Rain in May", "Town", "mm", "Port Ellen", "61", "It rained less than in the year before."],
    ),
    "unclosed": (
        "<div class=post><h1>List<p>First we took<ul><li>bread<li>salt &amp; oil</ul><p>and set out &mdash; early.</div><div class=sidebar><p>Sign up for our letter today and win.</p></div>",
        ["List", "First we took", "bread", "salt & oil", "and set out — early."],
    ),
}


@pytest.fixture(scope="module")
def model():
    return fit()


@pytest.mark.parametrize("name", PAGES)
def test_page(model, name):
    source, want = PAGES[name]
    assert extract_texts([source], model)[0].split("\n\n") == want
