"""Operator 13: pages of known main text, in marked articles and in plain markup that only their neighbours tell apart."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("xxhash")

from tests.llm.fixtures import sentence  # noqa: E402
from tidemark.llm import main_text  # noqa: E402
from tidemark.llm.page_blocks import blocks, lines  # noqa: E402


def extract(spark, rows):
    """rows of (url, html)."""
    pages = spark.createDataFrame([(i, u, h, "t", [1]) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, lines array<long>")
    got = main_text.main_texts(pages.repartition(4)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


MARKED = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header><a href="/">Home</a> Site name</header><nav><ul><li>One<li>Two</ul></nav><div id="cookie-notice">We use cookies.</div>
<div class="layout sidebar-left"><article class="post"><header><h1>{title}</h1></header><p>First&nbsp;&eacute; <b>bold
text</b>.<br><p>Second &lt;b&gt; <a href="x">link</a>.</p><div class="ad">Buy now</div><ul><li>Point one<li>Point <i>two</i></ul>
<form><input name=q> Subscribe</form><footer>Filed under x</footer></article><aside>Related</aside></div>
<section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>&copy; Site</footer></body></html>"""
MAIN = "{title}\n\nFirst é bold text.\n\nSecond <b> link.\n\nPoint one\n\nPoint two"


def test_marked_articles(spark):
    rows = [(f"http://a.example.com/{i}", MARKED.format(title=f"Title {i}")) for i in range(3)]
    assert extract(spark, rows) == [MAIN.format(title=f"Title {i}") for i in range(3)]


def plain(rng, host, body):
    """A page without marked parts: the same lines around each article of a host."""
    top = [f"{host} top", "Start Products Prices", "Delivered daily since 1990"]
    bottom = [f"Written for {host}", "All prices without tax", "Contact us by mail"]
    parts = [*top, *body, *bottom]
    return "<html><body>" + "".join(f"<div>{p}</div>" if i % 2 else f"<p>{p}" for i, p in enumerate(parts)) + "</body></html>"


def test_lines_of_a_host_go(spark):
    rng = random.Random(3)
    rows, want = [], []
    for host in ("one.example.com", "two.example.org", "hot.example.net"):
        for i in range(150 if host.startswith("hot") else 20):
            body = [sentence(rng, rng.randint(8, 40)) + f" {host}{i}-{j}" for j in range(rng.randint(1, 6))]
            rows.append((f"https://{host}/{rng.choice(['a', 'b'])}/{i}.html?x={i}", plain(rng, host, body)))
            want.append("\n\n".join(body))
    order = list(range(len(rows)))
    rng.shuffle(order)
    assert extract(spark, [rows[i] for i in order]) == [want[i] for i in order]


def test_copies_and_shared_passages_stay(spark):
    rng = random.Random(4)
    passage = sentence(rng, 60)
    article = "<html><body><nav>Menu</nav><article>" + "".join(f"<p>{sentence(rng, 30)}</p>" for _ in range(5)) + "</article></body></html>"
    copies = [(f"http://c.example.com/{i}", article) for i in range(40)]
    quoted = [(f"http://q.example.com/{i}", f"<article><p>{passage}</p><p>{sentence(rng, 40)} {i}</p></article>") for i in range(5)]
    got = extract(spark, copies + quoted)
    assert set(got[:40]) == {"\n\n".join(lines(article)[0])}
    assert all(t.startswith(passage + "\n\n") for t in got[40:])


def test_edges(spark):
    assert extract(spark, []) == []
    rows = [(None, None), ("", ""), ("/relative", "<p>a"), ("http://x", "no markup at all"), ("http://x", "<script>never closed <p>x"), ("http://x/", "a < b & c <3 <p>d &amp; e <"), ("http://x", "<p title='open>lost</p><p>kept</p>")]
    assert extract(spark, [*rows, rows[2], rows[2]]) == ["", "", "a", "no markup at all", "", "a < b & c <3\n\nd & e <", "lost\n\nkept", "a", "a"]


def test_blocks_of_odd_markup():
    assert blocks("<div hidden>no</div><p class=x>a<p>b</div></div><table><tr><td>c<td>d</table>") == [("a", 0, False), ("b", 0, False), ("c", 0, False), ("d", 0, False)]
    assert [t for t, *_ in blocks("<span class='advert'>no</span>yes<p class=\"cookie-banner\">no<p>also")] == ["yes", "also"]
    assert lines("<div class=wrapper><div class='post-content'><p>x</p><div class=shareButtons>no</div></div><p>y</p></div>") == (["x"], True)
    deep = "<div>" * 20_000 + "x" + "<a " * 20_000
    assert [t for t, *_ in blocks(deep)] == ["x"]
    assert [t for t, *_ in blocks("<a '" * 50_000 + "><p>x")] == ["x"]


@pytest.mark.parametrize("seed", range(3))
def test_longest_common_lines(seed):
    rng = random.Random(seed)
    for _ in range(100):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        got = main_text.common_lines(a, b)
        assert got == sorted(set(got))
        assert len(got) == size[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_too_many_equal_lines(monkeypatch):
    monkeypatch.setattr(main_text, "MOST_PAIRS", 10)
    assert main_text.common_lines([1, 0, 0, 0, 0, 2], [3, 0, 0, 0, 0, 0, 4]) == [1, 2, 3, 4]


def test_alignments_are_the_same_at_any_size(monkeypatch):
    """Pairs and rows of bits give the same places, and lines that repeat by the thousand are aligned in full."""
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randint(0, rng.choice([1, 4, 30])) for _ in range(rng.randint(0, 60))] for _ in range(2))
        monkeypatch.setattr(main_text, "MOST_PAIRS", 10**6)
        want = main_text.common_lines(a, b)
        monkeypatch.setattr(main_text, "MOST_PAIRS", -1)
        assert main_text.common_lines(a, b) == want
    monkeypatch.undo()
    # Lines that met their like by number alone (the k-th with the k-th) would be 1500.
    a, b = [3, *[0] * 1500, *[1] * 1400, 4], [5, *[1] * 1400, *[0] * 1500, *[1] * 700, 6]
    assert main_text.common_lines(a, b) == [*range(1, 1501), *range(2201, 2901)]
