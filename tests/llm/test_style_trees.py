"""Site style trees against a plain computation, articles in wrappers, deep pages."""

import math
import random
import time
from collections import Counter

import pytest

from uttermark.llm.htmltext import DECAY, IMPORTANT, PRIOR, Page, main_text

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("name", ["content has-sidebar", "entry-legal", "recommended-reading", "related-layout"])
def test_an_article_in_a_wrapper_stays(name):
    assert Page(f"<h1>T</h1><div class='{name}'><article>the article</article></div>").text() == "T\nthe article"


def test_wrapped_articles_beside_the_articles_of_the_page_go():
    teaser = "<div class=related><article>a longer teaser than that</article></div>"
    assert Page(f"<article>own</article>{teaser}").text() == "own"
    assert Page(f"<p>{'own text ' * 9}</p>{teaser}").text() == ("own text " * 9).strip()
    assert Page("<p>own</p><div class=comments><article>a long comment</article></div>").text() == "own"
    assert Page("<div class='has-sidebar'><p>own</p></div>").text() == "own"


@pytest.mark.parametrize("pages", [4, 5, 20])
def test_repeated_boxes_go_at_any_number_of_pages_also_in_articles(spark, pages):
    box = "<div class='box'>Download our app today and save</div>"
    rows = [(i, "https://a.example/", f"<article><p>own text number {i} of some length</p><p>more {i}</p>{box}</article>") for i in range(pages)]
    rows += [(100 + i, "https://b.example/", f"<div class=b><p>page {i}</p></div><div class=line>Same banner</div>") for i in range(pages)]
    got = texts(spark, rows)
    assert [got[i] for i in range(pages)] == [f"own text number {i} of some length\nmore {i}" for i in range(pages)]
    assert [got[100 + i] for i in range(pages)] == [f"page {i}" for i in range(pages)]


def test_other_hosts_tell_what_two_pages_cannot(spark):
    page = "<div class=b><p>page {}</p></div><div class=line>Banner of {}</div>"
    few = [(i, "https://few.example/", page.format(i, "few")) for i in range(2)]
    many = [(10 + i, f"https://{i % 3}.example/", page.format(i, i % 3)) for i in range(30)]
    assert texts(spark, few) == {i: f"page {i}\nBanner of few" for i in range(2)}
    assert texts(spark, few + many) == {i: f"page {i}" for i in (0, 1)} | {10 + i: f"page {i}" for i in range(30)}


def test_articles_that_a_host_repeats_stay(spark):
    article = "<article><h1>Head</h1>{}</article>"
    rows = [
        (i, "https://c.example/", article.format("".join(f"<p>paragraph {j} {i if j == i else ''}</p>" for j in range(6))))
        for i in range(6)
    ]
    got = texts(spark, rows)
    assert all(got[i].count("\n") == 6 and got[i].startswith("Head\n") for i in range(6))


def brute(rows):
    """Texts of pages, by importance from plain counts of the blocks of ``Page``."""
    trees = [(host, Page(html)) for _, host, html in rows]
    content, style, pages = {}, {}, Counter()
    for host, page in trees:
        for node, text in {(n, t) for n, _, t in page.blocks}:
            content.setdefault((host, node), Counter())[text] += 1
        for node in {n for n, *_ in page.blocks}:
            pages[host, node] += 1
            if node in page.children:
                style.setdefault((host, node), []).append(tuple(page.children[node]))
    own = {}
    for key, counts in content.items():
        m = pages[key]
        own[key] = 1 - sum(map(math.log, counts.values())) / len(counts) / math.log(m) if m > 1 else 1.0
        if seqs := style.get(key):
            n = len(seqs)
            entropy = -sum(c / n * math.log(c / n) for c in Counter(seqs).values()) / math.log(n) if n > 1 else 1.0
            keep = DECAY ** (sum(map(len, seqs)) / n)
            own[key] = (1 - keep) * entropy + keep * own[key]
    out = {}
    for (page_id, host, _), (_, page) in zip(rows, trees):
        low = set()
        for node in {n for n, *_ in page.blocks}:
            told = {k: pages[k] - 1 for k in own if k[1] == node}
            far = (sum(told[k] * own[k] for k in told) + PRIOR) / (sum(told.values()) + PRIOR)
            mine = told[host, node]
            if (mine * own[host, node] + PRIOR * far) / (mine + PRIOR) < IMPORTANT:
                low.add(node)

        def below(node, top):
            while node and node != top:
                node = page.parent[node]
            return node == top

        nodes = {n for n, *_ in page.blocks}
        gone = {n for n in nodes if not any(below(w, n) and w not in low for w in nodes)}
        inside = [(n, len(t)) for n, o, t in page.blocks if o]
        whole = 2 * sum(k for n, k in inside if n in gone) > sum(k for _, k in inside)
        out[page_id] = "\n".join(t for n, o, t in page.blocks if n not in gone or o and whole)
    return out


def test_equals_brute_force_on_small_hosts(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        words = lambda k: " ".join(rng.choices("ab cd ef gh ij kl mn".split(), k=k))
        parts = [
            f"<div class=top>{rng.choice(['Same top', 'Same top', words(3)])}<p>Low</p></div>",
            f"<article><p>{words(9)}</p><div class=box>{rng.choice(['Get it', 'Get it', words(2)])}</div></article>",
            f"<section><h2>{words(1)}</h2><p>{words(6)}</p></section>",
            f"<div class=end><span>End {i % 2}</span></div>",
        ]
        rows.append((i, f"h{i % 7 if i % 3 else 0}", "".join(p for p in parts if rng.random() < 0.8)))
    got = texts(spark, [(i, f"https://{host}/x", html) for i, host, html in rows])
    want = brute(rows)
    assert got == want
    assert any(want[i] != Page(html).text() for i, _, html in rows)


def test_deep_and_long_pages_take_time_by_their_size(spark):
    start = time.time()
    deep = "<div>" * 100_000 + "x" + "</b></td>" * 100_000
    assert Page(deep).text() == "x"
    assert Page(deep, frozenset([1])).text() == "x"
    assert time.time() - start < 20
    long = "<article>" + "<p>word word</p>" * 100_000 + "</article>"
    got = texts(spark, [(1, "https://x/", long), (2, "https://x/", deep), (3, "https://x/", None)])
    assert got[1].count("\n") == 99_999 and got[2] == "x" and got[3] == ""
