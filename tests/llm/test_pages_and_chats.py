import random

import pytest

from compare import differences, oracle
from frostline.llm.oracles import ORACLES
from frostline.llm.queries import QUERIES
from frostline.llm.snapshot_collapse import maximal_conversations, rendered
from frostline.llm import wrapper_induction as wi
from frostline.llm.wrapper_induction import align, blocks, main_text, numbered, parse

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head>
<body><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="side ad">Buy</div>
<article class="post"><h1>Title &amp; more</h1><p><b>One  two
three<br><p>Four &lt; <i>five</i>&nbsp;six</p><form>Mail</form><ul><li>a<li>b</ul>
<div id="comments"><p>First!</p></div><p>a < b &copy</p></article><aside>Other</aside><footer>End</footer></body></html>"""


def test_article_of_a_page():
    assert blocks(parse(PAGE)) == [
        "Title & more", "One two three", "Four < five six", "a", "b", "a < b ©",
    ]


def test_names_of_the_page_do_not_hide_it():
    page = '<body class="has-sidebar"><main class="no-menu"><article class="post has-comments"><p>Text</p><article class="comment"><p>me</p></article></article></main></body>'
    assert blocks(parse(page)) == ["Text"]


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></p>", "plain", "<p>a<table><tr><td>b<td>c", "<script>x", "<a b='>'>t</a>", "<!--"])
def test_broken_pages_do_not_fail(page):
    blocks(parse(page))


def test_alignment_matches_in_order():
    a, b = parse("<div><p>1</p><h2>x<i>!</i></h2><p>2</p></div>"), parse("<div><h2>y<i>!</i></h2><p>3</p><p>4</p></div>")
    left, right = numbered(a), numbered(b)
    found = align(a, b)
    pairs = [(left[i].tag, right[j].tag) for i, j in sorted(found.items())]
    assert pairs == [("#page", "#page"), ("div", "div"), ("h2", "h2"), ("i", "i"), ("p", "p")]


def test_template_goes_where_no_article_is_marked(spark):
    page = "<body><div><p>Site of facts</p><div><p>Story {} begins</p><p>and ends {}</p></div><p>Call us</p></div></body>"
    rows = [(i, "http://h.example/%d" % i, page.format(i, i)) for i in range(8)]
    rows += [(90, None, None), (91, "http://h.example/x", ""), (92, "not a url", "<p>alone</p>")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df.selectExpr("*", "1 AS host", "2 AS node")).collect()}
    assert got[3] == "Story 3 begins\nand ends 3"
    assert (got[90], got[91], got[92]) == ("", "", "alone")
    assert main_text(df).count() == len(rows)


def test_template_and_names_within_articles(spark):
    page = """<body><article><h1>Title {0}</h1><div class="search-notice"><p>Found in {0} places</p></div>
<p>Story {0} begins</p><div class="box"><h4>About us</h4><p>We write since 1990</p></div><div class="share"><p>Tell all</p></div>
<div class="related notice"><p>See {0}</p></div></article></body>"""
    rows = [(i, "http://h.example/%d" % i, page.format(i)) for i in range(8)]
    same = "<body><p>{}</p><article><p>Same for all</p></article></body>"
    rows += [(20 + i, "http://same.example/%d" % i, same.format(i)) for i in range(6)]
    rows.append((90, "http://few.example/", page.format(90)))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nFound in 3 places\nStory 3 begins"
    assert got[21] == "Same for all"
    assert got[90] == "Title 90\nStory 90 begins\nAbout us\nWe write since 1990"


def test_template_of_a_second_layout_and_of_few_pages(spark):
    first = "<body><div id='post-{0}'><p>Site of facts</p><div><p>Story {0} begins</p></div><p>Call us</p></div></body>"
    second = "<body><table><tr><td>Shop of facts</td><td>Offer {0}</td></tr></table><div><p>Call us</p></div></body>"
    third = "<body><div><p>Site of facts</p><ul><li>Item {0}</li></ul><p>Call us</p></div></body>"
    pages = [*[(i, first) for i in range(9)], *[(20 + i, second) for i in range(6)], (40, third), (41, third)]
    rows = [(i, "http://h.example/%d" % i, page.format(i)) for i, page in pages]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), share=0.6).collect()}
    assert got[3] == "Story 3 begins"
    assert got[22] == "Offer 22"
    assert got[40] == "Item 40"


def test_constant_headings_of_what_varies_stay(spark):
    page = """<body><div><h3>Site of facts</h3><p>Since 1990</p></div><article><h1>Dish {0}</h1><h2>Ingredients</h2><p>Salt {0}</p>
<h2>Method</h2><h3>First</h3><p>Stir {0}</p><dl><dt>Time</dt><dd>{0} h</dd></dl><h2>About us</h2><p>We cook</p></article></body>"""
    for body in (page, page.replace("article", "div")):
        rows = [(i, "http://h.example/%d" % i, body.format(i)) for i in range(8)]
        got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id = 3").first().text
        assert got.split("\n") == ["Dish 3", "Ingredients", "Salt 3", "Method", "First", "Stir 3", "Time", "3 h"]


def plain_matching(a, b):
    """The weight of the best matching of two trees, by the definition."""
    if a.tag != b.tag:
        return 0
    left, right = a.elements(), b.elements()
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, p in enumerate(left):
        for j, q in enumerate(right):
            both = plain_matching(p, q)
            table[i + 1][j + 1] = max(table[i][j] + both, table[i][j + 1], table[i + 1][j])
    return (3 if a.kind == b.kind else 2) + table[-1][-1]


@pytest.mark.parametrize("cells", [wi.CELLS, 4])
def test_alignment_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(wi, "CELLS", cells)
    pick = random.Random(8)

    def tree(depth):
        tag = pick.choice(["b", "i"])
        inner = "".join(tree(depth - 1) for _ in range(pick.randint(0, 4))) if depth else "x"
        return f"<{tag} class={pick.choice('uv')}>{inner}</{tag}>"

    for _ in range(150):
        a, b = (parse("<div>" + "".join(tree(2) for _ in range(pick.randint(0, 5))) + "</div>") for _ in range(2))
        left, right = numbered(a), numbered(b)
        found = align(a, b)
        up = [{c.number: n.number for n in t for c in n.elements()} for t in (left, right)]
        assert len(set(found.values())) == len(found)
        for i, j in found.items():
            assert left[i].tag == right[j].tag and (not i or found[up[0][i]] == up[1][j])
        order = sorted(found)
        for i, k in zip(order, order[1:]):
            assert up[0].get(i) != up[0].get(k) or found[i] < found[k]
        weight = sum(3 if left[i].kind == right[j].kind else 2 for i, j in found.items())
        assert weight == plain_matching(a, b)


def test_many_unlike_siblings_are_matched_by_what_they_hold():
    """By tag and class alone, the first on the left would match the first on the right."""
    for n in (3, 150):
        rows = lambda c: "".join(f"<p class={c}{i}><b></b><u></u></p>" for i in range(n))
        full = "<p><i></i><s></s><q></q></p>"
        left, right = numbered(parse(full + rows("c"))), numbered(parse("<p></p>" + full + rows("d")))
        found = align(left[0], right[0])
        weight = sum(3 if left[i].kind == right[j].kind else 2 for i, j in found.items())
        assert weight == 3 + 12 + n * 8


def test_deep_and_wide_pages(spark):
    deep = lambda n: "<div>" * n + "Deep text" + "</div>" * n
    wide = lambda n, k: "".join(f"<p class=c{(i * k) % n}><b>Row {i}</b></p>" for i in range(n))
    rows = [(k, "http://deep.example/", deep(100_000 + k)) for k in range(5)]
    rows += [(10 + k, "http://wide.example/", wide(10_000 + k, 2 * k + 1)) for k in range(5)]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 10 and {got[k].text for k in range(5)} <= {"Deep text", ""}


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, p in zip(main_text(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        own = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        assert r.text == "\n".join(blocks(parse(f"<article>{own}</article>"))) and r.n_chars == len(r.text)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text(empty).collect() == []


def test_conversations_against_sql(spark):
    query = QUERIES["op7_snapshot_collapse"]
    assert differences(query(spark, SF), oracle(SF), ORACLES["op7_snapshot_collapse"]) == []


def test_snapshots_collapse(spark):
    def talk(conv, *texts):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]

    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "b", "c") + talk(4, "b")
    rows += talk(5, "a", None) + talk(6, None) + talk(7, "") + talk(None, "z") + talk(8, "a", "x") + talk(9, "a")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.n_turns, r.copies) for r in maximal_conversations(df).collect()}
    assert got == {(2, 3, 2), (4, 1, 1), (5, 2, 1), (6, 1, 1), (7, 1, 1), (None, 1, 1), (8, 2, 1)}
    chats = {r.conv_id: r.chat for r in rendered(df).collect()}
    assert chats[2] == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n"
    assert chats[None] == "<|user|>\nz\n"
    assert rendered(df.where("false")).collect() == []
