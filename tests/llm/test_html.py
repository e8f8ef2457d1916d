"""Pages against a plain restatement of the scoring, names that only sound foreign, and markup that is hard to parse."""

import random
import time

import pytest

from glyphsift.llm import html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Text, here.</p></article>', "Title\nText, here."),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Text, here.</p></article>', "Title\nText, here."),
        ('<article><p>A, b.</p><section id="related-work"><p>Of others.</p></section></article>', "A, b.\nOf others."),
        ('<article><p>A, b.</p><p class="social-impact">Impact.</p></article>', "A, b.\nImpact."),
        ('<article><p class="lead menu-item">Lead.</p><p>A, b.</p></article>', "Lead.\nA, b."),
        ('<article><p class="lead menu-item"><a href=x>Lead.</a></p><p>A, b.</p></article>', "A, b."),
        ('<article><p>A, b.</p><div class="reader-comments"><p>no, no, no, much longer than all the rest</p></div></article>', "A, b."),
        ('<article><p>A, b.</p><p class="ad">Buy</p><div class="cookieNotice">c</div><div role="alert">a</div></article>', "A, b."),
        ('<div class="ad">Buy, buy, buy, all of this, today.</div><article><p>Own.</p></article>', "Own."),
        ('<article><p>Own.</p></article><div class="related"><article><p>' + "Other, longer. " * 99 + "</p></article></div>", "Own."),
        ('<p>a<a title="x > y" href=\'"\'>b</a> c', "ab c"),
        ("<p>x<textarea><p>no</textarea >y", "xy"),
        ("<p>x<script>never closed", "x"),
        ("1 < 2 <3 <p>x</p> a <- b", "1 < 2 <3\nx\na <- b"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def tree(r, depth=0):
    """A random element as (tag, class, children)."""
    tag = r.choice(["div", "p", "section", "ul", "li", "a", "b", "aside", "h2", "blockquote"]) if depth else "body"
    name = r.choice(["", "", "", "menu", "comments", "lead ad", "related-work"])
    children = [tree(r, depth + 1) if depth < 5 and r.random() < 0.6 else r.choice(["one, two ", "three ", "a, b, c, d " * 9]) for _ in range(r.randint(0, 4))]
    return tag, name, children


def shown(t):
    return t if isinstance(t, str) else f'<{t[0]} class="{t[1]}">' + "".join(map(shown, t[2])) + f"</{t[0]}>"


def nodes(root, above=()):
    yield root, above
    for c in root.children:
        if isinstance(c, html.Node):
            yield from nodes(c, (root, *above))


def letters(node, linked=None):
    """Characters of the texts below a node, or of those in links."""
    linked = node.tag == "a" if linked is None else linked or node.tag == "a"
    total = [0, 0]
    for c in node.children:
        n = [len(" ".join(c.split()))] * 2 if isinstance(c, str) else letters(c, linked)
        total = [total[0] + n[0], total[1] + (n[1] if not isinstance(c, str) or linked else 0)]
    return total


def plain_points(root):
    """Points by their definition, each paragraph for each of its ancestors."""
    every, points = list(nodes(root)), {}
    share = lambda n: letters(n)[1] / letters(n)[0] if letters(n)[0] else 0
    for n, _ in every:
        points[n] = 0.0
    for n, above in every:
        own = " ".join(" ".join(c.split()) for c in n.children if isinstance(c, str)).strip()
        size = letters(n)[0]
        if not size or not (n.tag in html.PARAGRAPHS or own and n.tag in html.BLOCK):
            continue
        w = 1.0
        for x in (n, *above):
            w *= html.WEIGHTS[x.kind] if x is not root else 1
        got = above if n.tag in html.PARAGRAPHS else (n, *above)
        length = size if n.tag in html.PARAGRAPHS else len(own)
        for level, x in enumerate(got[:5], 1):
            points[x] += (1 + own.count(",") + length / 100) * (1 - share(n)) * w / level
    return {n: p * (1 - share(n)) for n, p in points.items()}


@pytest.mark.parametrize("seed", range(60))
def test_points_are_brute_force(seed):
    page = shown(tree(random.Random(seed)))
    root = html.parse(page)
    want = plain_points(root)
    got = html.measure(root)
    assert {id(n) for n in got} == {id(n) for n in want}
    assert all(abs(n.score - want[n]) < 1e-9 for n in got)
    assert all([n.size, n.links] == letters(n) if n.tag != "a" else n.links == n.size for n in got)
    # Every word of the result is the page's, in its order.
    words = iter("".join(c if isinstance(c, str) else " " for c in page.replace("<", " <").replace(">", "> ")).split())
    assert all(any(w == x for x in words) for w in html.main_text(page).split())


HARD = {
    "inline ends over a block": "<i><div>" + "<b>" * 150_000 + "</i>" * 100_000,
    "items after inline starts": "<b>" * 150_000 + "<li>" * 150_000,
    "quoted ends": '<a b=">" ' * 100_000,
    "raw ends without an end": "<script>" + "</script " * 100_000,
    "comments": "<!--" * 250_000,
    "deep": "<div>" * 90_000 + "x" + "</div>" * 90_000,
    "headings": "<h1>" * 250_000,
    "paragraphs": "<p>x" * 250_000,
    "signs": "<" * 1_000_000,
    "references": "&amp" * 250_000,
}


@pytest.mark.parametrize("kind", HARD)
def test_hard_pages_take_time_with_their_length(kind):
    took = []
    for part in (8, 1):
        page = HARD[kind][: len(HARD[kind]) // part]
        began = time.process_time()
        html.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)
