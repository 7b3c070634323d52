"""Wrapper inference: expressions hold their pages, slots are found without article tags, and pages of any shape are read."""

import html
import json
import os
import random
import re
import time

import pytest

from tidemark.llm import wrappers

DATA = "/root/testdata/sf0.01"
PAGE = "page_id long, url string, html string, text string"


def extracted(spark, pages, url="http://h.example/{}"):
    rows = [(k, url.format(k), p, "t") for k, p in enumerate(pages)]
    return [r["text"] for r in wrappers.with_main_text(spark.createDataFrame(rows, PAGE)).orderBy("page_id").collect()]


def random_tree(rng, depth=0):
    tags = ["<h2>{}</h2>", "<p>{}</p>", "<div class=a>{}</div>", "<ul><li>{}</li></ul>", "<div class=b>{}</div>"]
    inside = lambda: random_tree(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else f"x{rng.randrange(3)}"
    return "".join(rng.choice(tags).format(inside()) for _ in range(rng.randrange(1, 5)))


def test_an_expression_holds_all_pages_it_was_inferred_from():
    for seed in range(400):
        rng = random.Random(seed)
        pages = [random_tree(rng) for _ in range(rng.randint(1, 5))]
        found = wrappers.infer(pages)
        for p in pages:
            assert re.fullmatch(wrappers.expression(found), wrappers.stream(wrappers.tree(p))), (seed, pages)
        whole = wrappers.Wrapper(wrappers.unpacked(wrappers.packed(found)))
        for p in pages:  # matching gives every text once, in order
            assert [leaf.text for leaf, _ in whole.match(wrappers.tree(p))] == re.findall(r"x\d", p)


def test_options_repeats_and_slots():
    item = "<li><b>n</b> {}<p>{}</p></li>"
    one = "<div class=w><h2>T1</h2><ul>" + item.format(1, "a") + item.format(2, "b") + "</ul><p>end</p></div>"
    two = "<div class=w><h2>T2</h2><div class=extra>only here</div><ul>" + "".join(item.format(k, k) for k in range(5)) + "</ul><p>end</p></div>"
    found = wrappers.infer([one, two])
    assert wrappers.expression(found) == r"(?:(?:<div\.w>(?:<h2>#</>)(?:<div\.extra>#</>)?(?:<ul>(?:<li>#(?:<p>#</>)</>)+</>)(?:<p>#</>)</>))".replace(r"<div\.", r"<div\.")
    texts = [n.text for n in wrappers.Wrapper(found).parts if n.sig == "#"]
    assert texts == [None, "only here", None, None, "end"]
    pair = wrappers.infer(["<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>", "<h2>a</h2><p>b</p>"])
    assert wrappers.expression(pair) == "(?:(?:(?:<h2>#</>)(?:<p>#</>))+)"
    nested = wrappers.infer(["<div><p>a</p><div><p>b</p><p>c</p></div></div>", "<div><p>a</p><div><p>b</p><h2>q</h2></div></div>"])
    assert re.fullmatch(wrappers.expression(nested), wrappers.stream(wrappers.tree("<div><p>z</p><div><p>1</p><p>2</p><h2>3</h2></div></div>")))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_given_pages_need_no_article_tags(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    bare = rows.withColumn("html", wrappers.F.regexp_replace("html", "</?article>", ""))
    several = {r["page_id"] for r in rows.join(rows.groupBy(wrappers.host_of(rows["url"]).alias("h")).count().where("count > 1"), wrappers.host_of(rows["url"]) == wrappers.F.col("h")).select("page_id").collect()}
    with_tags, without = ({r["page_id"]: r["text"] for r in wrappers.with_main_text(d).collect()} for d in (rows, bare))
    assert len(several) > 150 and all(with_tags[k] == without[k] for k in several)
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert with_tags[r["page_id"]] == "\n".join(b for b in blocks if b)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_pages_without_any_mark_are_read_by_their_host(spark):
    """Without tags or classes that mark parts all pages come out right, and some of them only by their host's expression."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = rows.withColumn("html", wrappers.F.regexp_replace(wrappers.F.regexp_replace("html", r"<(/?)(?:nav|article|footer)\b[^>]*>", "<$1div>"), ' class="[^"]*"', ""))
    marked, plain = ({r["page_id"]: (r["text"], r["by_host"]) for r in wrappers.with_main_text(d).collect()} for d in (rows, bare))
    assert {k: v[0] for k, v in plain.items()} == {k: v[0] for k, v in marked.items()}
    pages = {r["page_id"]: r["html"] for r in bare.collect()}
    by_host = [k for k, v in plain.items() if v[1]]
    assert len(by_host) > 2300 and sum(wrappers.main_text(pages[k], None) != plain[k][0] for k in by_host) > 50


def test_names_that_only_contain_a_mark_lose_no_text():
    page = "<article><p class=share-price>x</p><p>y</p><section id=related-work>z</section><div class='comment-list'>no</div><div class=ad-box>no</div><div id=newsletter>no</div></article>"
    assert wrappers.main_text(page, None) == "x\ny\nz"


def test_the_container_is_the_lowest_of_all_slots(spark):
    site = "<body><div>Shop of {2}</div><div class=content><h1>Title {0}</h1><p>Words of page {0}.</p><ul>{1}</ul><p>Standard sentence.</p><p>More {0}</p></div><div>Footer Inc.</div></body>"
    pages = [site.format(k, "".join(f"<li>a long entry {k} {j} of this list" for j in range(12)), "Ann") for k in range(7)]
    got = extracted(spark, pages)
    for k, text in enumerate(got):  # heading, list and the sentence that all pages share
        assert text == "\n".join([f"Title {k}", f"Words of page {k}.", *[f"a long entry {k} {j} of this list" for j in range(12)], "Standard sentence.", f"More {k}"])


def test_a_layout_without_containers_loses_its_edges_only(spark):
    got = extracted(spark, [f"<body><div>Top line</div><h1>T{k}</h1><p>Same on all.</p><p>Own {k}</p><div>Bottom line</div></body>" for k in range(5)])
    assert got == [f"T{k}\nSame on all.\nOwn {k}" for k in range(5)]


def test_counts_come_from_all_pages(spark):
    pages = [f"<body><div class=x>{'Rare ' + str(k) if k == 37 else 'Usual'}</div><p>Own {k}</p></body>" for k in range(40)]
    got = extracted(spark, pages)  # a part that differs on one page in forty is no layout
    assert got[37] == "Rare 37\nOwn 37" and got[3] == "Usual\nOwn 3"


def fits(wrapper, page):
    return re.fullmatch(wrappers.expression(wrappers.unpacked(json.loads(wrapper)[0])), wrappers.stream(wrappers.tree(page))) is not None


@pytest.mark.parametrize("together", [3, wrappers.TOGETHER])
def test_a_hosts_expression_holds_all_of_its_pages(spark, together):
    """also forms that only one page of a host has, however many are aligned at once."""
    pages = [f"<body><div class=top>Shop</div><div class=c{'xyz'[k % 3]}{'abcdefgh'[k // 3 % 8]}><p>a {k}</p></div>{'<h2>rare</h2>' * (k == 31)}<div class=w><h1>T{k}</h1><p>b {k}</p></div></body>" for k in range(60)]
    df = spark.createDataFrame([(k if k else None, f"http://h.example/{k}", p, "t") for k, p in enumerate(pages)], PAGE)
    (found,) = wrappers.host_wrappers(df, together=together).collect()
    assert found["host"] == "h.example" and all(fits(found["wrapper"], p) for p in pages)


BLOCKS = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<div class=a><p>{}</p></div>", "<div class=b><p>{}</p></div>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>"]


@pytest.mark.parametrize("flat", [False, True])
def test_expressions_do_not_grow_with_the_orders_of_blocks(spark, flat):
    """of 400 pages with blocks in any order, inside a container and without one."""
    rng = random.Random(3)
    pages, want = [], []
    for k in range(400):
        texts = [f"text {k} {j} of many words" for j in range(rng.randint(3, 30))]
        blocks = "".join(rng.choice(BLOCKS).format(t) for t in texts)
        pages.append(f"<body><div class=top><span>Shop</span></div>{'' if flat else '<div class=inside>'}<h1>T{k}</h1>{blocks}{'' if flat else '</div>'}<div class=last>Imprint</div></body>")
        want.append("\n".join([f"T{k}", *texts]))
    df = spark.createDataFrame([(k, "http://h.example/", p, "t") for k, p in enumerate(pages)], PAGE)
    (found,) = wrappers.host_wrappers(df).collect()
    whole = wrappers.Wrapper(wrappers.unpacked(json.loads(found["wrapper"])[0]))
    assert len(whole.parts) < 120 and all(fits(found["wrapper"], p) for p in pages)
    for p in pages[:50]:  # matching gives every text once, in order
        top = wrappers.tree(p)
        assert [leaf.text for leaf, _ in whole.match(top)] == [n.text for n in wrappers.Wrapper(top).parts if n.sig == "#"]
    got = {r["page_id"]: r for r in wrappers.with_main_text(df).collect()}
    assert [got[k]["text"] for k in range(400)] == want and all(r["by_host"] for r in got.values())


def test_every_host_of_two_pages_has_an_expression(spark):
    """whatever the hashes of the two ids."""
    rows = [(k, f"http://h{k // 2}.example/{k}", f"<body><div class=w><h1>T{k}</h1><p>a {k}</p></div></body>", "t") for k in range(60)]
    got = wrappers.with_main_text(spark.createDataFrame(rows, PAGE)).collect()
    assert all(r["by_host"] and r["text"] == f"T{r['page_id']}\na {r['page_id']}" for r in got) and len(got) == 60


def test_pages_without_a_common_form_are_read_alone(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "LARGE", 40)
    pages = [f"<body><div class=a{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}><h1>T{k}</h1><p>x{k}</p></div></body>" for k in range(100)]
    got = {r["page_id"]: r for r in wrappers.with_main_text(spark.createDataFrame([(k, "http://h.example/", p, "t") for k, p in enumerate(pages)], PAGE)).collect()}
    assert all(not got[k]["by_host"] and got[k]["text"] == f"T{k}\nx{k}" for k in range(100))


def test_pages_that_do_not_fit_are_read_alone(spark):
    pages = [f"<body><div class=a><h1>T{k}</h1><p>x{k}</p></div></body>" for k in range(6)] + ["<body><section><h2>Other</h2><p>kind of page</p></section></body>", "", None]
    got = extracted(spark, pages)
    assert got[6] == "Other\nkind of page" and got[0] == "T0\nx0" and got[7] == got[8] == ""


def test_marked_and_hidden_boilerplate_goes():
    page = "<body><header>site</header><main><article><h1>T</h1><p>a<span class=ad>buy</span>b</p><aside>side</aside><div class=comments><p>bad</p></div><p hidden>no</p><p style='display: none'>no</p></article><form>f</form></main><footer>f</footer></body>"
    assert wrappers.main_text(page, None) == "T\nbuy\na b".replace("buy\n", "").replace("a b", "ab")


def test_hostile_pages_take_linear_time():
    for page in ("<div>" * 100_000 + "x", "<p>a<div class=b>c</div>" * 20_000, "<" * 200_000, "<b>" * 100_000, "<li>" * 50_000, "</p>" * 100_000, "<!--" * 50_000):
        began = time.time()
        wrappers.main_text(page, None)
        assert time.time() - began < 8
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["<h2>a</h2>", "<p>b</p>", "<ul><li>x</ul>", "<div class=q>c</div>"]) for _ in range(5000)) for _ in range(4)]
    began = time.time()
    found = wrappers.infer(mixed)
    assert time.time() - began < 15 and len(wrappers.Wrapper(found).match(wrappers.tree(mixed[0]))) == 5000


def test_odd_rows(spark):
    rows = [(None, None, None, "t"), (1, "x", "", None), (1, "x", "", None), (2, "http://o.example/", "<p>alone<br>b &nbsp; c", "t"), (None, "http://h.example/", "<script>x", "t"), (3, "http://o.example/", "text only & more", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = wrappers.with_main_text(df)
    assert sorted(r["text"] for r in got.collect()) == ["", "", "", "", "alone\nb c", "text only & more"] and got.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "by_host"]
    assert wrappers.with_main_text(spark.createDataFrame([], PAGE)).count() == 0
