import html
import random
import re
import time

import numpy as np
import pytest

from sightline.llm import catalog
from sightline.llm import html_blocks as hb


def texts(page):
    return [b.text for b in hb.blocks_of(page)]


def test_blocks_of_broken_pages():
    assert texts("") == [] and texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>a<p>b <b>c<i>d</p></div>e<br>f") == ["a", "b cd", "e f"]
    assert texts('<script>var x="</p>";</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><script>open') == ["yes"]
    assert texts("<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>") == ["1", "2", "x", "y"]
    assert texts("<p title='a>b'>q &lt;p&gt; &nbsp; &#233;&copy</p><p a=\"unclosed>r") == ["q <p> é©", "r"]
    assert texts("<" * 2000 + "a") == ["<" * 2000 + "a"]


TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[A-Za-z][^\s/>]*+(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^>]*>", re.S
)


def test_tags_end_as_one_pattern_says():
    """Random broken markup without block tags: the text between tags, read with one pattern."""
    rng = random.Random(5)
    for _ in range(4000):
        page = "".join(rng.choice(["<", "<a", "</b", " ", ">", '"', "'", "x", "!", "--", "<!--", "-->", "/", "<?"]) for _ in range(rng.randint(0, 24)))
        want = " ".join(TAG.sub("", page).split())
        assert texts(page) == ([want] if want else []), page


def test_broken_pages_take_one_scan():
    n = 200_000
    for page in ("<a " * n, '<a "' * n, '<a ">" ' * n, "<a<" * n, "<a '>" * n, "<!" * n, "<ul>" * n + "</p>" * n, "x" + "<p>" * n):
        start = time.perf_counter()
        hb.blocks_of(page)
        assert time.perf_counter() - start < 10, page[:20]


def test_path_and_links():
    block = hb.blocks_of('<div class="side-bar bigBox" id=x1><a href="/">go</a> on')[0]
    assert block == hb.Block(("div", ".side", ".bar", ".big", ".box", ".x"), "go on", 2)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    pages = [hb.blocks_of(hb.made_page(rng, ["One line of text.", "Other words, too"])) for _ in range(3)] + [[]]
    x = hb.features(pages)
    target = rng.integers(0, 2, len(x.measures)).astype(float)
    weights = hb._new_weights(rng)

    def loss():
        p = hb.probabilities(weights, x)
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    gradient = hb._gradients(weights, x, target)
    for name, values in weights.items():
        flat, g = values.reshape(-1), gradient[name].reshape(-1)
        for at in np.argsort(-np.abs(g))[:3]:
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5, name


@pytest.fixture(scope="module")
def weights(spark):
    return hb.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_held_out_layouts(weights):
    rng = np.random.default_rng(99)
    lines = [f"Sentence number {i} tells of something, at some length." for i in range(50)] + ["Short one", "No"]
    made = [hb.labelled_by_mark(hb.made_page(rng, lines)) for _ in range(200)]
    right = np.concatenate([(hb.probabilities(weights, hb.features([b])) > 0.5) == t for b, t in made])
    assert right.mean() > 0.97


def test_pages_as_cut_by_hand(spark, weights):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in hb.extract(pages, weights).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        pieces = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in pieces if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_edge_cases(spark, weights):
    big = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(8000)) + "</article>"
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (2, None, "", "t"), (None, "v", "<article><p>Some words, here.</p></article>", "t"), (3, "w", big, "t")]
    got = hb.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), weights).collect()
    assert [r["n_chars"] for r in got if r["page_id"] in (1, 2)] == [0, 0, 0]
    assert next(r for r in got if r["page_id"] is None)["text"] == "Some words, here."
    assert next(r for r in got if r["page_id"] == 3)["text"].count("\n") == 7999
    assert hb.extract(spark.createDataFrame([], "page_id long, url string, html string"), weights).count() == 0


def test_sample_holds_a_repeated_page_once(spark):
    rows = [(1, "<p>hot</p>")] * 500 + [(i, f"<p>page {i}</p>") for i in range(2, 60)] + [(None, "<p>no id</p>"), (70, None), (71, ""), (72, "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(7)
    all_ = hb.sampled(pages, 1000, 100)
    assert sorted(all_) == sorted({h for _, h in rows if h and len(h) <= 100})
    some = hb.sampled(pages, 20, 100)
    assert some == all_[:20] and hb.sampled(pages.limit(0), 20, 100) == []


def test_query(spark, sf):
    got = catalog.QUERIES["op10_html_extraction"](spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.where("n_chars = 0").count() == 0
