import html
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_extract
from tidemark.llm.html_tree import parse
from tidemark.llm.page_model import MAIN, PageModel, labelled_page, labels


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(html_extract.labelled_pages(spark))


def test_marginals_equal_the_sum_over_all_labellings(model):
    nodes = parse("<body><nav><a href=x>Home</a></nav><div class=post><p>Some words, and more of them.</p></div></body>")
    from itertools import product

    from tidemark.llm.page_model import _DAMP, _FLOW, features, tie

    import math

    weights = []
    for own in features(nodes):
        damp = _DAMP if own[0].startswith("text ") or own[0] in _FLOW else 1.0
        weights.append([damp * sum(model.weight[f][s] for f in own if f in model.weight) for s in range(3)])
    total, main = 0.0, [0.0] * len(nodes)
    base = sum(max(w) for w in weights)
    for states in product(range(3), repeat=len(nodes)):
        log = sum(w[s] for w, s in zip(weights, states, strict=True)) - base
        for k in range(1, len(nodes)):
            log += math.log(model.ties[tie(nodes, k)][states[nodes[k].parent]][states[k]])
        chance = math.exp(log)
        total += chance
        for k, s in enumerate(states):
            main[k] += chance * (s == MAIN)
    assert model.marginals(nodes) == pytest.approx([m / total for m in main], rel=1e-6, abs=1e-9)


def test_held_out_layouts(model):
    perfect = 0
    for number in range(20_000, 20_300):
        nodes = parse(labelled_page(number))
        truth, chance = labels(nodes), model.marginals(nodes)
        perfect += all((chance[k] > 0.5) == (truth[k] == MAIN) for k, n in enumerate(nodes) if not n.tag and n.seen)
    assert perfect >= 285


def test_whole_table_equals_the_article_element(spark, folder, model):
    """The given pages hold their text in one article element with headings, paragraphs and bold text."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.extract(pages, model).collect()}
    for row in pages.collect():
        inner = re.search("<article>(.*)</article>", row.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:h1|p|br)>", re.sub("</?b>", "", inner))
        assert found[row.page_id] == " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())


SHELL = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{}<article><h1>Head</h1>{}</article>{}</body></html>"


@pytest.mark.parametrize(
    "before, inside, after, text",
    [
        ("<nav><a href=x>Home</a></nav>", "<p>One &eacute;&nbsp; two,\n three.<p>Four <b>fi</b>ve.", "<footer>&copy; 2020 Site</footer>", "Head One é two, three. Four five."),
        ("<header><h1>Site</h1></header>", "<p>Text here, of some length.</p><aside>Read this too</aside><p>More of it.</p>", "", "Head Text here, of some length. More of it."),
        ("<div class='cookie-banner'>We use cookies, do you mind?</div>", "<p>a<br>b</p><div class=ad>Buy now, it is cheap.</div><p>c</p>", "<form><label>Name</label><p>Write to us.</p></form>", "Head a b c"),
        ("", "<p>Long words of an author, who goes on.</p>", "<section id=comments><h2>Comments</h2><p>I do not agree with that, my friend, it is wrong.</p></section>", "Head Long words of an author, who goes on."),
        ("", "<ul><li>one point, here<li>another</ul><!-- <p>no</p> --><table><tr><td>cell a<td>cell b</table>", "", "Head one point, here another cell a cell b"),
    ],
)
def test_parts_of_a_page(model, before, inside, after, text):
    assert model.text(SHELL.format(before, inside, after)) == text


def test_any_string_is_read(model):
    for page in ("<", "</p>", "<p", "<a href='x", "<!--", "<script>", "<p></div></b>text, of a kind.", "&#0;&bad;&amp", "<div " * 50, "<b>" * 3000 + "x"):
        assert isinstance(model.text(page), str)
    assert len(model.text("<article>" + "<p>Some words, here and there.</p>" * 5000 + "</article>")) > 100_000


def test_awkward_rows(spark, model):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<article><p>Words, in a page.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit("x")})
    found = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_extract.extract(pages, model).collect())
    assert found == [(0, "v", "Words, in a page.", 17), (1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0)]
    assert html_extract.extract(pages.limit(0), model).count() == 0


def test_a_model_without_pages_still_answers(spark):
    model = html_extract.train(spark.createDataFrame([], "html string"))
    assert isinstance(model, PageModel) and isinstance(model.text("<p>x</p>"), str)
