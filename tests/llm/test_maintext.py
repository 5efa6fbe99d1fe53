"""Page extraction: marginals by enumeration, pages of known text, held-out pages."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import maintext
from ledgerloom.llm.maintext import Model, parse, sum_product, trees

WORDS = "ten words that make a line of some text here"


@pytest.fixture(scope="module")
def marked():
    """Pages in the manner of the given table: an article between furniture."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet velit magna quis nulla sunt".split()) for _ in range(n)).capitalize() + "."
    out = []
    for _ in range(60):
        body = [say(rng.randint(2, 60)) for _ in range(rng.randint(1, 9))]
        menu = "".join(f"<li><a href='/x'>{say(1)}</a></li>" for _ in range(rng.randint(3, 7)))
        page = f"<html><head><title>{body[0]}</title><script>var t='</p>';</script></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{say(9)}</div><article><h1>{body[0]}</h1>"
        out.append((page + "".join(f"<p>{html.escape(b)}" + ("<br>" if rng.random() < 0.3 else "</p>") for b in body) + f"</article><footer>&copy; {say(6)}</footer>", [body[0], *body]))
    return out


@pytest.fixture(scope="module")
def model(marked):
    return maintext.fit(*maintext.labelled_pages([h for h, _ in marked[:40]]))


def test_marginals_equal_enumeration():
    page = parse("<body><div><p>one two</p><ul><li>three<li>four</ul></div><nav>five</nav>")
    t = trees([page, parse("<p>x")])
    rng = np.random.default_rng(3)
    weights = Model(rng.normal(size=maintext.N_FEATURES), rng.normal(size=(maintext.N_KINDS, 2, 2)))
    node, joint, total = sum_product(t, weights)
    n = len(page.parent)
    score = t.features @ weights.unary
    states = list(itertools.product((0, 1), repeat=n))
    p = np.array([sum(score[i] * y[i] for i in range(n)) + sum(weights.pair[t.kind[i], y[t.parent[i]], y[i]] for i in range(1, n)) for y in states])
    z = np.log(np.exp(p).sum())
    p = np.exp(p - z)
    for i in range(n):
        assert node[i, 1] == pytest.approx(sum(w for w, y in zip(p, states, strict=True) if y[i]))
        if i:
            assert joint[i, 1, 0] == pytest.approx(sum(w for w, y in zip(p, states, strict=True) if y[t.parent[i]] and not y[i]))
    rest = sum_product(trees([parse("<p>x")]), weights)[2]
    assert total == pytest.approx(z + rest)


def test_gradient_is_observed_minus_expected():
    page = parse("<body><article><p>one two three.</p></article><nav>five</nav>")
    t, y = trees([page]), np.array([0, 1, 1, 0])
    rng = np.random.default_rng(1)
    w = Model(rng.normal(size=maintext.N_FEATURES), rng.normal(size=(maintext.N_KINDS, 2, 2)))
    like = lambda m: float(t.features @ m.unary @ y + sum(m.pair[t.kind[i], y[t.parent[i]], y[i]] for i in range(1, 4)) - sum_product(t, m)[2])
    node, joint, _ = sum_product(t, w)
    for k in np.flatnonzero(t.features.any(0))[:8]:
        step = np.eye(maintext.N_FEATURES)[k] * 1e-6
        assert (like(Model(w.unary + step, w.pair)) - like(Model(w.unary - step, w.pair))) / 2e-6 == pytest.approx(float(t.features[:, k] @ (y - node[:, 1])), abs=1e-5)


def test_held_out_pages(marked, model):
    got = maintext.main_blocks([parse(h) for h, _ in marked[40:]], model)
    assert got == [[" ".join(b.split()) for b in want] for _, want in marked[40:]]
    pages, labels = maintext.labelled_pages([h for h, _ in marked[40:]], seed=77)
    node = sum_product(trees(pages), model)[0][:, 1] >= 0.5
    assert (node == np.concatenate(labels)).mean() > 0.97


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<div></div><p> </p>", ""), ("<script>x</script><style>y</style>", ""),
        (f"<article>A &amp; b&nbsp;c\n d<br>e<b>f</b></article><footer>{WORDS}</footer>", "A & b c d ef"),
        (f"<main><p>{WORDS}.<p>x<ul><li>y<li>z</ul><noscript>{WORDS}</main>", f"{WORDS}.\n\nx\n\ny\n\nz\n\n{WORDS}"),
        (f"<head><title>t</title><article><p>{WORDS}.</p><div class='comments'><p>{WORDS}.</p></div><form><p>name</p></form></article>", f"{WORDS}."),
        (f"<body><div id='header'>site</div><div class='menu'><a>a</a> <a>b</a></div><div id='content'><h2>T</h2>{WORDS}.<p>{WORDS}!</p></div><div id='footer'>{WORDS}</div>", f"T\n\n{WORDS}.\n\n{WORDS}!"),
    ],
)
def test_page_forms(model, page, want):
    assert "\n\n".join(maintext.main_blocks([parse(page or "")], model)[0]) == want


def test_extract(spark, marked):
    rows = [(i, "u", h, "clash") for i, (h, _) in enumerate(marked)] + [(None, None, None, None), (7, "u", "<p>" + "w " * 40_000, None), (8, "u", "<div>" * 3000 + "deep", None), (8, "u", "<div>" * 3000 + "deep", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = maintext.extract(pages, maintext.fit_extractor(pages)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) and r["text"] == "\n\n".join(r["blocks"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r["text"])
    assert all("\n\n".join(" ".join(b.split()) for b in want) in by[i] for i, (_, want) in enumerate(marked)) and by[None] == [""]
    none = spark.createDataFrame([], pages.schema)
    assert maintext.extract(none, maintext.fit_extractor(none)).collect() == []


def test_names():
    assert maintext.name_groups("div", [("class", "PostComments ad-2"), ("id", None)]) == {"body", "comment", "advert"}
    assert not maintext.name_groups("p", []) and re.search("comment", maintext.FURNITURE["comment"])
