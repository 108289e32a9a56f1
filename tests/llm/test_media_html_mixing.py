import hashlib
import math
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import html_density, media, mixing

TEXTS = [(1, "plain"), (2, None), (3, ""), (4, "é中" * 100), (5, "x" * 64), (6, "plain"), (7, "long " * 60_000), (None, "no id"), (1, "plain")]


def test_media_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "c") for r in TEXTS], "doc_id long, text string, digest string").repartition(3)
    rows = media.media_columns(docs, folder=f"file://{tmp_path}/shards").collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    for doc_id, text in TEXTS:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = by[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.bit_depth) == (64, len(payload) // 64, 8)
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 6)}) == 1
    for shard in (tmp_path / "shards").glob("*.tar"):  # ordinary tar files, members named by content
        with tarfile.open(shard) as tar:
            for member in tar.getmembers():
                assert member.name == hashlib.sha256(tar.extractfile(member).read()).hexdigest() + ".png"
    assert media.media_columns(docs.limit(0)).count() == 0


PARTS = {
    "plain": ("<p>One two three four five six seven eight nine ten.</p><p>And &amp; more\n  text&nbsp;here, with <b>bo</b>ld.</p>", "One two three four five six seven eight nine ten. And & more text here, with bold."),
    "nested": ("<h1>Title here</h1><section><p>First part of it, long enough to count.</p></section><section><p>Second part of it.</section>", "Title here First part of it, long enough to count. Second part of it."),
    "list": ("<ul><li>a item<li>b item</ul><table><tr><td>c1<td>c2</table>", "a item b item c1 c2"),
}
AROUND = [
    ("<nav><a href=/>Home</a></nav>", "<footer>&copy; site</footer>"),
    ('<header><h2>Site name of some length to be read</h2></header><div class="sidebar"><p>Some side text that is long, long, long.</p></div>', '<section id="comments"><p>A reader says something at length here, really.</p></section>'),
    ("<aside>x</aside><div class='cookie-notice'>We use cookies</div><form>Search <input></form>", "<div class=\"ad\"><p>Buy this now, it is very good and cheap.</p></div><script>var t = '<p>no</p>';</script>"),
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("holder", ["article", "main"])
def test_main_text(part, around, holder):
    inner, text = PARTS[part]
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{around[0]}<{holder}>{inner}</{holder}>{around[1]}</body></html>"
    assert html_density.main_text(page) == text


def naive(page):
    """Densities of a page straight from their definition, node by node; pages of plain blocks and links only."""
    tree = html_density.parse(page)
    n, gone = len(tree.tag), html_density._dropped(tree)
    inside = lambda x: range(x, tree.end[x] or n)
    up = lambda x: [] if not x else [tree.parent[x], *up(tree.parent[x])]
    size = lambda nodes: sum(len("".join(t.split())) for x, t in tree.pieces if x in nodes and not gone[x])
    linked = {x for x in range(n) if "a" in [tree.tag[y] for y in [x, *up(x)]]}
    ratio = size(linked) / max(1, size(range(n)))
    density = []
    for x in range(n):
        below = [y for y in inside(x) if y != x and not gone[y]]
        c, lc = size(inside(x)), size(linked & set(inside(x)))
        t, lt = max(1, len(below)), max(1, sum(tree.tag[y] == "a" for y in below))
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        density.append(0.0 if not c or gone[x] else c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base))
    return density, [sum(density[y] for y in range(1, n) if tree.parent[y] == x) for x in range(n)]


def test_densities_against_the_definition():
    rnd = random.Random(9)
    for _ in range(30):
        block = lambda depth: f"<div>{''.join(block(depth - 1) for _ in range(rnd.randint(1, 3)))}</div>" if depth else rnd.choice([f"<p>{'word ' * rnd.randint(1, 60)}</p>", "<p>" + "<a href=/x>link here</a> " * rnd.randint(1, 5) + "and text </p>", "<ul><li><a href=/>one</a><li><a href=/>two</a></ul>"])  # noqa: E731, B023
        page = f"<body>{block(3)}{block(2)}</body>"
        tree = html_density.parse(page)
        got, expected = html_density.densities(tree, html_density._dropped(tree)), naive(page)
        assert got[0] == pytest.approx(expected[0]) and got[1] == pytest.approx(expected[1])


BLOCKS = "<body><div><p>{links}</p><p>Two words. {links}</p></div><{holder}><h1>Some title</h1><p>{words}</p><div><p>{words} <i>so</i> <b>it</b> is</p></div></{holder}><div><p>{links} more</p></div></body>"


def test_densities_decide(monkeypatch):
    words, links = "word " * 59 + "end", "".join(f"<a href=/{i}>link {i}</a> " for i in range(30))
    pages = [BLOCKS.format(words=words, links=links, holder=x) for x in ("article", "main", "div", "section")]
    assert {html_density.main_text(p) for p in pages} == {f"Some title {words} {words} so it is"}
    monkeypatch.setattr(html_density, "composite", lambda *_: 1.0)
    assert all(html_density.main_text(p) != f"Some title {words} {words} so it is" for p in pages)


def test_very_long_page():
    words = "word " * 59 + "end"
    page = "<body><nav>" + "<a href=/>x</a>" * 2000 + "</nav><div>" + f"<p>{words}</p>" * 20_000 + "</div><footer>end</footer></body>"
    assert html_density.main_text(page) == " ".join([words] * 20_000)


def test_several_articles():
    text = lambda name: f"<p>{name} " + f"some words of the text called {name}, to be read. " * 8 + "</p>"
    plain = lambda *names: " ".join(f"{x} " + " ".join([f"some words of the text called {x}, to be read."] * 8) for x in names)
    links = "".join(f"<a href=/{i}>link {i}</a> " for i in range(30))
    siblings = f"<article>{text('A')}{text('B')}</article><article>{text('C')}</article><article>{text('D')}</article>"
    assert html_density.main_text(f"<body><div>{links}</div>{siblings}</body>") == plain(*"ABCD")
    nested = f"<article>{text('A')}<article>{text('B')}{text('C')}</article><article>{text('D')}</article></article>"
    assert html_density.main_text(f"<body><div>{links}</div>{nested}</body>") == plain(*"ABCD")
    assert html_density.main_text(f"<body><div>{links}</div><main>{text('A')}<article>{text('B')}</article>{text('C')}</main></body>") == plain(*"ABC")


def test_dense_block_without_hints():
    words = " ".join("word" for _ in range(60))
    links = "".join(f"<a href=/{i}>link {i}</a> " for i in range(30))
    page = f"<body><div>{links}</div><div><p>{words}</p><p>{words}</p></div><div>{links}</div></body>"
    assert html_density.main_text(page) == f"{words} {words}"


def test_odd_pages(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "just text", "k"), (4, "<p>a<p>b", "k"), (5, "<div" * 50 + "<" * 50, "k"), (6, "<p title=it's>x &#233;</p>", "k"), (7, "<div>" * 3000 + "deep", "k")]
    pages = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    got = {r.page_id: r.main_text for r in html_density.extract(pages).collect()}
    assert got[1] == got[2] == "" and got[3] == "just text" and got[4] == "a b" and got[6] == "x é" and got[7] == "deep" and len(got) == 7
    assert html_density.extract(pages.limit(0)).count() == 0


def test_knapsack_is_exact():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted({rnd.randint(1, 40) for _ in range(4)}))
        supply = np.array([rnd.randint(0, 4) for _ in lengths])
        budget = rnd.randint(0, 120)
        sums = {0}
        for length, n in zip(lengths, supply, strict=True):
            sums = {s + int(length) * k for s in sums for k in range(n + 1)}
        counts = mixing.knapsack(lengths, supply, budget)
        assert (counts <= supply).all() and int(counts @ lengths) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("scale", [1, 37, 30_011, 3_000_017])
def test_fit_finds_the_nearest_sum_of_long_documents(scale):
    rnd = random.Random(scale)
    for _ in range(8):
        lengths = np.array(sorted({scale * rnd.randint(1, 12) + rnd.randint(0, scale // 10) for _ in range(3)}))
        supply = np.array([rnd.randint(1, 3) for _ in lengths])
        budget = rnd.randint(1, int(lengths @ supply) - 1)
        sums = {0}
        for length, n in zip(lengths, supply, strict=True):
            sums = {s + int(length) * k for s in sums for k in range(n + 1)}
        counts = mixing.fit(lengths, supply, budget)
        miss = min(abs(s - budget) for s in sums)
        assert (counts <= supply).all() and abs(int(counts @ lengths) - budget) == miss or scale > 1e6 and abs(int(counts @ lengths) - budget) <= miss + 100
    assert mixing.fit(np.array([100_000]), np.array([3]), 105_000).tolist() == [1]
    assert mixing.fit(np.array([70_000, 100_000]), np.array([4, 4]), 210_000).tolist() == [3, 0]
    assert mixing.fit(np.array([100_000]), np.array([2]), 70_000).tolist() == [1]


def test_targets_are_shared_again():
    assert mixing.targets([("a", 10), ("b", 100), ("c", 100)]) == [20, pytest.approx(295 * 2 / 3), pytest.approx(295 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [0]


@pytest.mark.parametrize("partitions", [1, 6])
def test_mix_meets_targets(spark, partitions):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["s1", "s1", "s1", "s2", "s3", None]), " ".join("w" for _ in range(rnd.choice([0, 3, 7, 7, 7, 50, 211])))) for i in range(900)]
    rows += [(5, "s1", "one row"), (5, "s1", "one row"), (None, "s2", None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int").repartition(partitions)
    got = mixing.mix(docs, mixing.word_count(F.col("text"))).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r["size"] * r.times
        target[r.source] = r.target
        assert 0 <= r.times <= 2 and r.source_size > 0
    expected = dict(zip(["s1", "s2", "s3", None], mixing.targets([(s, size[s]) for s in ["s1", "s2", "s3", None]]), strict=True))
    for s in size:
        assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 3
    again = mixing.mix(docs.repartition(2), mixing.word_count(F.col("text"))).collect()
    pick = lambda rs: sorted((r.doc_id, r.times) for r in rs if r.doc_id not in (5, None))
    assert pick(got) == pick(again)
    assert mixing.mix(docs.limit(0), mixing.word_count(F.col("text"))).count() == 0


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a b ", "a\tb\nc\x0b\x0cd", "é f", "x  y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 1, 2, 4, 1, 2]


@pytest.mark.parametrize("scale", [10**7, 10**10])
def test_mix_of_ten_trillion_tokens(scale):
    lengths = np.array([7, 200, 1000, 20_000])
    supply = np.array([12 * scale, scale, 1200 * scale // 1000, scale // 1000])
    total = int((lengths * supply).sum())
    for budget in (total // 2, total // 3 + 5):
        counts = mixing.fit(lengths, supply, budget)
        assert ((counts >= 0) & (counts <= supply)).all()
        assert abs(int((counts * lengths).sum()) - budget) <= 1000
        assert abs(counts / supply - budget / total).max() < 0.01


def test_densities_decide_on_given_pages(monkeypatch):
    """With no name and no telling element left, the largest sum alone gives the article; with equal densities it does not."""
    import re

    import pyarrow.parquet as pq

    pages = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    whole = [html_density.main_text(p) for p in pages]
    for page, text in zip(pages, whole, strict=True):
        assert text == html_density.main_text("<body>" + page[page.index("<article>") : page.index("</article>")])
    monkeypatch.setattr(html_density, "NAMES", frozenset())
    bare = [re.sub(r"<(/?)(?:nav|footer|aside|header|article|main)\b", r"<\1div", p) for p in pages]
    assert sum(html_density.main_text(b) == t for b, t in zip(bare, whole, strict=True)) >= 0.98 * len(pages)
    monkeypatch.setattr(html_density, "composite", lambda *_: 1.0)
    assert sum(html_density.main_text(b) == t for b, t in zip(bare, whole, strict=True)) < 0.5 * len(pages)


def test_names_do_not_take_an_article_away():
    text = " ".join(["This is one sentence of the text."] * 50)
    menu, end = "<nav><ul><li><a href=/>x</a><li><a href=/y>y</a></ul></nav>", "<footer>&copy; site, all rights reserved</footer>"
    assert html_density.main_text(f'<body>{menu}<div class="share"><p>{text}</p></div><footer>c</footer></body>') == text
    assert html_density.main_text(f'<body>{menu}<div id="related-work"><h1>Title</h1><p>{text}</p><p>{text}</p></div>{end}</body>') == f"Title {text} {text}"
    readers = '<section id="comments">' + "<div class=comment><p>A reader says here at some length what they think of it.</p></div>" * 30 + "</section>"
    for page in (f"<article><h1>Title</h1><p>{text}</p>{readers}</article>", f"<article><h1>Title</h1><p>{text}</p></article>{readers}", f"<div class=page><div><h1>Title</h1><p>{text}</p></div>{readers}</div>"):
        assert html_density.main_text(f"<body>{menu}{page}{end}</body>") == f"Title {text}"
    assert html_density.main_text(f"<body>{menu}<article><header><h1>Title</h1><p>By X</p></header><div><p>{text}</p><p>{text}</p></div></article>{end}</body>") == f"Title {text} {text}"


def test_comments_and_depth():
    assert html_density.main_text("<p>a</p><!--> b --><p>c</p>") == "a b --> c"
    assert html_density.main_text("<p>a</p><!-- > b --!><p>c</p><!-- d") == "a c"
    deep = "<div>" * 100_000 + "deep" + "</div></span></p>" * 1000
    assert html_density.main_text(deep) == "deep"
