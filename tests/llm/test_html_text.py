from __future__ import annotations

import itertools

import numpy as np

from tests.llm.helpers import SMALL
from tidemark.llm import html_text as H

CHAIN = H.fitted()


def text(page):
    return H.main_text(page, CHAIN)


def test_blocks_of_broken_html():
    page = "<body>Top<nav><ul><li><a href='/x'>One<li>Two</ul></nav><article><h1>A &amp; b</h1><p><b>First\n  line<br>on<p>Second <i>in</i>line</p><!-- <p>no</p> --><script>var t='</p>';</script><p>Last&nbsp;&copy;</article>"
    found = H.blocks(page)
    assert [b.text for b in found] == ["Top", "One", "Two", "A & b", "First line on", "Second inline", "Last ©"]
    assert [b.linked > 0 for b in found] == [False, True, False, False, False, False, False]
    assert "in=nav" in found[1].path and "in=article" in found[5].path and "in=nav" not in found[5].path
    assert "at=p" in found[6].path and "at=p" not in found[3].path


def test_odd_pages():
    for page in (None, "", "<", "<p", "plain", "</p></div>", "<script>never closed", "<!-- never closed", "<p class='a>b", "<a" * 2000, "<div>" * 5000 + "x", '<p title="a > b">t</p>'):
        assert isinstance(text(page), str)
    assert [b.text for b in H.blocks('<p title="a > b">t</p>')] == ["t"]
    assert [b.text for b in H.blocks("<div>" * 3000 + "x")] == ["x"]


def test_training_pages_are_learnt_and_others_too():
    for seed, least in ((9, 0.97), (77, 0.95)):
        good = total = 0
        for page, main in H.training_pages(150, seed):
            found, labels = H.labelled(page, main)
            assert "\n".join(b.text for b, y in zip(found, labels) if y) == main
            good += sum(a == b for a, b in zip(CHAIN.decode(found), labels))
            total += len(labels)
        assert good >= least * total


def test_layouts():
    parts = {
        "<header><h1>Site</h1></header>": False, "<nav><a href='#'>Home</a></nav>": False, "<div class='cookie-notice'><p>We use cookies on this site.</p></div>": False, "<article><h1>Title</h1><p>Some first paragraph.</p><p>To.</p></article>": True,
        "<div class='ad'>Buy this now.</div>": False, "<aside class='sidebar'><p>Also of interest here.</p></aside>": False, "<section id='comments'><p>I do not agree at all.</p></section>": False, "<form><p>Your mail address</p></form>": False, "<footer><p>&copy; all rights.</p></footer>": False,
    }
    assert text("<html><body>" + "".join(parts) + "</body></html>") == "Title\nSome first paragraph.\nTo."


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(0)
    page = [H.Block(f"{'w ' * int(rng.integers(1, 30))}end.", frozenset({f"f{int(rng.integers(4))}"}), 0) for _ in range(7)]
    for _ in range(50):
        names = {f for i, b in enumerate(page) for f in [*b.path, *H.text_features(b, i, len(page))]}
        chain = H.Chain({f: float(rng.normal()) for f in names}, rng.normal(size=(2, 2)))

        def total(labels, chain=chain):
            said = sum(y * (sum(chain.weights[f] for f in b.path) + sum(chain.weights[f] for f in H.text_features(b, i, len(page)))) for i, (b, y) in enumerate(zip(page, labels)))
            return said + sum(chain.moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=total)
        assert abs(total([int(x) for x in chain.decode(page)]) - total(best)) < 1e-9


def test_expectations_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    said, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    weights, chance, pairs = 0.0, np.zeros(5), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=5):
        w = np.exp(np.dot(said, labels) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        weights += w
        chance += w * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            pairs[a, b] += w
    got_chance, got_pairs = H._expected(said, moves)
    assert np.allclose(got_chance, chance / weights) and np.allclose(got_pairs, pairs / weights)


def reference(page):
    """The article of the synthetic pages, whose layout is one."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    import html
    import re

    lines = (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", inner.replace("<br>", " ").replace("<b>", "")))
    return "\n".join(x for x in lines if x)


def test_query(spark):
    from tidemark.llm.queries import op9_html_extraction

    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op9_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.n_chars, r.text) == (pages[r.page_id].url, len(r.text), reference(pages[r.page_id].html))


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string"
    assert H.extract(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None, "x"), (1, "u", "", None), (1, "u", "", None), (2, "u", "<article><p>Long " + "words " * 60_000 + "end.</p></article>", None)]
    got = sorted(((str(r.page_id), r.url, len(r.text)) for r in H.extract(spark.createDataFrame(rows, schema)).collect()))
    assert got == [("1", "u", 0), ("1", "u", 0), ("2", "u", 360_009), ("None", None, 0)]


def test_broken_pages_take_time_in_proportion():
    import time

    def took(make):
        times = []
        for n in (4000, 32_000):
            page = make(n)
            start = time.process_time()
            H.blocks(page)
            times.append(time.process_time() - start)
        return times

    for make in (lambda n: "<a " * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: "<svg>" * n, lambda n: "<a '" * n + ">", lambda n: "<!--" * n):
        small, large = took(make)
        assert large < 30 * small + 0.3, (make(3), small, large)


def test_what_is_not_seen():
    said = lambda page: [b.text for b in H.blocks(page)]
    assert said("<p>a</p><noscript>enable js</noscript><svg><text>x</text></svg><p>b <math>c</math></p><template><p>t</p></template>") == ["a", "b c"]
    assert said("<p>a<svg><p>b") == ["a", "b"]


def test_a_mark_counts_wherever_it_stands():
    block = lambda text: H.Block(text, frozenset(), 0)
    assert "marks=True" in H.text_features(block("x" * 200 + " ©"), 0, 1) and "marks=False" in H.text_features(block("x" * 200), 0, 1)
