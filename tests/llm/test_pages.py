import numpy as np
import pytest

from tagweave.llm import pages


@pytest.fixture(scope="module")
def net():
    return pages.trained()


def test_blocks():
    html = """<!doctype html><title>No &amp; no</title><script>var a = "<p>no</p>";</script><body class="home page-1"><!-- <p>no</p> -->
    <nav id=menu><ul><li><a href="x>y">One</a><li><a href='/'>Two&nbsp; words</a></ul></nav><p><b>Bold</b> and
    plain<br>line<p>Next &lt;p&gt;<div>Inner</div>1 < 2 & 3 &copy; x<STYLE>p{}</STYLE>tail</body>"""
    got = pages.blocks_of(html)
    assert [b.text for b in got] == ["One", "Two words", "Bold and plain line", "Next <p>", "Inner", "1 < 2 & 3 © x", "tail"]
    assert got[0].path == ("body", ".home", ".page-1", "-home", "-page", "-1", "nav", ".menu", "-menu", "ul", "li", "<ul", "<li")
    assert got[0].linked == 1 and got[2].linked == 0 and got[3].path[-1] == "<p"


@pytest.mark.parametrize(
    ("html", "want"),
    [  # expected by hand
        ("<p>one<video src=a></p><p>two</p>", ["one", "two"]),
        ("<p>one</p><object data=x><p>two</p>", ["one", "two"]),
        ("<p>one</p><object><object>in</object>still in</object><p>two</p>", ["one", "two"]),
        ("<p>one</p><object><object>in</object>text<p>two</p>", ["one", "text", "two"]),
        ("<p>a<svg><title>no</title><text>no</text></svg>b<p>two", ["ab", "two"]),
        ("<p>a<select><option>no</select>b</p><audio controls/><p>two", ["a", "b", "two"]),
        ("<p>one<textarea>rest <p>two", ["one"]),
        ("<p>one<VIDEO>no</Video>x<p>two", ["one", "x", "two"]),
    ],
)
def test_elements_without_text_end_with_their_own_tag(html, want):
    assert [b.text for b in pages.blocks_of(html)] == want


@pytest.mark.parametrize("html", ["", "<", "<p", "plain", "<p>a<p", "</p></p>a", "<script>never closed <p>a", "<!-- never closed", "<a b='c>d", "<p>" * 3000 + "deep", "&#xD800;&#0;&bogus;", "<p>\x00a�"])
def test_broken_pages(html, net):
    assert isinstance(pages.main_text(html, net), str)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = pages.Labeller(size=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sizes = np.array([4, 2])
    x, y = rng.normal(size=(4, 2, pages.PATH_SIZE + pages.WORD_SIZE + pages.MEASURES)), rng.integers(0, 2, (4, 2))
    _, grads = net.learn(x, y, sizes)
    for name in net.p:
        for at in [tuple(rng.integers(0, s) for s in net.p[name].shape) for _ in range(4)]:
            kept, losses = net.p[name][at], []
            for step in (1e-3, -1e-3):
                net.p[name][at] = kept + step
                losses.append(net.learn(x, y, sizes)[0])
            net.p[name][at] = kept
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grads[name][at], abs=2e-4)


def test_invented_pages_that_were_not_taught(net):
    rng = np.random.default_rng(12345)
    whole, right = 0, []
    for _ in range(150):
        page, main = pages.invented_page(rng)
        got = pages.main_text(page, net).split("\n")
        whole += got == main
        right.append(len(set(got) & set(main)) / max(1, len(set(got) | set(main))))
    assert np.mean(right) > 0.97 and whole > 0.85 * 150


def test_given_pages_give_their_article(spark, net):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in pages.extract(given, net=net).collect()}
    rows = given.collect()
    assert len(got) == len(rows)
    for row in rows:
        article = "\n".join(b.text for b in pages.blocks_of(row["html"] or "") if "article" in b.path)
        assert got[row["page_id"]]["text"] == article and got[row["page_id"]]["n_chars"] == len(article)


def test_nulls_repeats_and_clashing_columns(spark, net):
    page = "<body><nav><a href=x>menu</a></nav><article><h1>Title</h1><p>Some main text of it.</p></article>"
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", page, "t"), (3, "u", page, "t"), (3, "u", page, "t"), (4, "u", page + "<p>word " * 20_000, "t")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(docs, net=net).collect()
    assert len(got) == 6 and [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert [r["text"] for r in got if r["page_id"] == 3] == ["Title\nSome main text of it."] * 2
    assert pages.extract(docs.limit(0), net=net).count() == 0
