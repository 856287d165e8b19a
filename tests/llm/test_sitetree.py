from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tabloom.llm import sitetree
from tabloom.llm.markup import keyed, read_page
from tests.llm.fixtures import prose

SCHEMA = "page_id bigint, url string, html string, text int, layout string"


def plain_page(rnd, i, notice=""):
    """A page without landmarks: menu, title, paragraphs, closing line in bare divs."""
    menu = "".join(f"<div><a href='/{w}'>{w}</a> now</div>" for w in ("home", "news", "about"))
    body = "".join(f"<p>{prose(rnd, 40)}" for _ in range(1 + i % 3))
    return f"<html><body><div>{menu}</div><div><h1>{prose(rnd, 6)}</h1>{body}{notice}</div><div>All rights reserved by the site</div></body></html>"


def visible(html):
    return [t for _, state, t in keyed(read_page(html), "h")[1] if state]


def test_site_without_landmarks_loses_what_its_pages_repeat(spark):
    rnd = random.Random(1)
    rows = [(i, f"https://site.example/{i}", plain_page(rnd, i), None, None) for i in range(12)]
    rows += [(100, "https://alone.example/", rows[0][2], 1, "x"), (101, "https://copies.example/1", rows[1][2], 1, "x")]
    rows += [(102 + i, "https://copies.example/2", rows[1][2], 1, "x") for i in range(4)]
    got = {r.page_id: r for r in sitetree.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for page_id, _, html, *_ in rows:
        everything = visible(html)
        article = [t for t in everything if "now" not in t.split() and not t.startswith("All rights")]
        assert got[page_id].text.split("\n") == (article if page_id < 100 else everything)
        assert got[page_id].n_chars == len(got[page_id].text)


def test_article_keeps_its_text_though_pages_are_near_copies(spark):
    rnd = random.Random(2)
    words = prose(rnd, 80).split()
    rows = []
    for i in range(30):
        words[i] = f"edit{i}"
        html = f"<nav>menu {i}</nav><article><h1>Same title</h1><p>{' '.join(words)}</p></article><footer>x</footer>"
        rows.append((i, "http://copies.example/a", html, None, None))
    got = sitetree.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.text == "Same title\n" + re.search("<p>(.*)</p>", rows[r.page_id][2])[1] for r in got)


def test_repeated_branch_inside_a_varied_article_goes(spark):
    rnd = random.Random(3)
    html = "<article><h1>{}</h1><p>{}</p><div>Read more of this kind in our weekly letter</div></article>"
    rows = [(i, "http://blog.example/", html.format(prose(rnd, 5), prose(rnd, 60)), None, None) for i in range(25)]
    got = sitetree.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(len(r.text.split("\n")) == 2 and "weekly" not in r.text for r in got)


def test_importance_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, f"https://u:p@Site{i % 3}.example:80/{i}", plain_page(rnd, i, "<div>notes <b>here</b></div>" * (i % 2)), None, None) for i in range(20)]
    read = sitetree.read_pages(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r.node: r for r in sitetree.importances(sitetree.fitted(read)).collect()}

    styles, words, parents, pages = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), {}, Counter()
    for i, _, html, *_ in rows:
        nodes, blocks = keyed(read_page(html), f"site{i % 3}.example")
        for node, parent, within, _, style, _ in nodes:
            styles[node][style] += 1
            parents[node] = (parent, within)
        for leaf, state, text in blocks:
            if state:
                for word in [*re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()), ("whole", text)]:
                    words[leaf][word][i] += 1

    def entropy(counts):
        return -sum(n / sum(counts) * math.log(n / sum(counts)) for n in counts)

    def importance(node):
        m = sum(styles[node].values())
        if node in words:
            return 1 - sum(entropy(c.values()) for c in words[node].values()) / len(words[node]) / math.log(m) if m > 1 else 1.0
        own = entropy(styles[node].values()) / math.log(m) if m > 1 else 1.0
        lower, any_text = 0.0, False
        for style, n in styles[node].items():
            below = [x for x in (importance(c) for c, key in parents.items() if key == (node, style)) if x is not None]
            if below:
                any_text = True
                lower += n / m * sum(below) / len(below)
        weight = sitetree.GAMMA ** len(styles[node])
        return (1 - weight) * own + weight * lower if any_text else None

    assert set(got) == set(styles)
    for node, row in got.items():
        want = importance(node)
        assert (row.composite is None and want is None) or row.composite == pytest.approx(want, abs=1e-9)


LANDMARKS = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>"</p>"</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookieNotice">We use cookies</div>
<main><div class="ad">Buy</div><article class="post"><header><h1>The &quot;Title&quot; &amp more</h1></header>
<p>First <b>bold</b> and&nbsp;<a href="x>y">link</a><br>line<p>Second<!-- <p>no</p> --> half &lt;x&gt;
<span class="advert">Buy now</span> end<form><input value=a><label>Mail</label></form><ul><li>One<li>Two<ul><li>Inner</ul></ul>
<table><tr><td>a<td>b</table><aside>Side</aside><figure><img src=a><figcaption>Caption</figcaption></figure>
<section class="comments"><h2>Comments</h2><article class="comment">I think</article></section></article></main>
<aside>More</aside><footer>&copy; x</footer><script>document.write("<p>late</p>")"""


def test_landmarks_and_markup(spark):
    rows = [(1, None, LANDMARKS, None, None), (2, "u", None, None, None), (3, "", "", 1, "x"), (4, "u", "just text < 5 &am; more", 1, "x")]
    rows += [(5, "u", "<form id=aspnet><div class=login>in</div><main><p>kept</p></main></form>", 1, None), (5, "u", "<p>" * 3, 1, None)]
    rows += [(6, "u", "<div class='page-sidebar menu'>only text</div>", 1, None), (7, "u", "<article><p>cut <b>her", 1, None), (None, None, "<a", 1, None)]
    rows += [(8, "http://h/", "<article>" + "<div>" * 500 + "deep" + "</div>after" * 3, 1, None), (9, "http://h/", f"<p>{'long ' * 100_000}</p>", 1, None)]
    got = sitetree.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert found[1] == ['The "Title" & more\nFirst bold and link line\nSecond half <x> end\nOne\nTwo\nInner\na\nb\nCaption']
    assert found[2] == found[3] == found[None] == [""] and found[4] == ["just text < 5 &am; more"] and sorted(found[5]) == ["", "kept"]
    assert found[6] == ["only text"] and found[7] == ["cut her"] and found[8] == ["deep\nafter\nafter\nafter"]
    assert found[9] == [("long " * 100_000).strip()]


def test_empty_table(spark):
    assert sitetree.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
