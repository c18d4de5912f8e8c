import random
import time
import tracemalloc

from ledgerloom.llm import html_text

PAGES = "page_id long, url string, html string"


def texts(spark, sources, parts=1, host="a.example"):
    rows = [(i, f"http://{host}/{i}", s) for i, s in enumerate(sources)]
    got = html_text.extract(spark.createDataFrame(rows, PAGES).repartition(parts)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_large_templates_are_kept_whole(spark):
    def page(i):
        body = "".join(f"<h2>head {i} {k}</h2><p>text {i} {k}</p>" for k in range(230))
        return f"<body><ul><li>Home<li>News</ul><div>{body}</div><span>Legal note</span></body>"

    for parts in (1, 4):
        got = texts(spark, [page(i) for i in range(16)], parts)
        assert all("Home" not in t and "Legal note" not in t for t in got)
        assert all(f"head {i} 229" in t and f"text {i} 0" in t for i, t in enumerate(got))


def test_first_page_of_a_task_does_not_decide(spark):
    menus = ["Other"] + ["Menu"] * 39
    rnd = random.Random(6)
    pages = [f"<body><ul><li>{m}</ul><div>{' '.join(str(rnd.random()) for _ in range(9))}</div></body>" for m in menus]
    got = texts(spark, pages)
    assert "Other" in got[0] and not any("Menu" in t for t in got)


def near_copies(wrap):
    def page(i):
        changed = f"changed {i}" if i < 95 else " ".join(f"own{i}w{k}" for k in range(30))
        lead = "<h1>Shared head</h1><p>Shared lead of the story, with many words.</p><table><tr><td>Shared cell</table>"
        return f"<body>{wrap[0]}{lead if i < 95 else f'<h1>Head {i}</h1>'}<p>{changed}</p>{wrap[1]}</body>"

    return [page(i) for i in range(100)]


def test_near_copies_keep_their_shared_text(spark):
    for wrap in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")):
        got = texts(spark, near_copies(wrap), 3)
        for i in range(95):
            assert got[i] == f"Shared head\nShared lead of the story, with many words.\nShared cell\nchanged {i}"


def test_equal_pages_have_one_vote(spark):
    copy = "<body><div><h2>Copied head</h2></div><p>Copied text of the page that is longer than its head by far.</p></body>"
    others = [f"<body><div><h2>Head {i}</h2></div><p>Text {i}</p></body>" for i in range(4)]
    assert texts(spark, [copy] * 200 + others)[0].startswith("Copied head")


def test_wrappers_with_furniture_words_keep_their_content():
    inner = "<h1>Head</h1><p>Text</p>"
    for attrs in (
        'class="layout has-sidebar"', 'id="content-with-comments"', 'class="no-banner"', 'data-id="related"',
        'data-class="menu"', 'title="a class=menu b"', "title='x hidden y'", 'aria-hidden="false"',
    ):
        assert html_text.main_text(f"<body><div {attrs}>{inner}</div></body>") == "Head\nText", attrs
    for name in ("sidebar", "widget menu", "header", "masthead"):
        for tag in ("article", "main"):
            page = f'<body><div class="{name}"><{tag}>{inner}</{tag}></div><div class="ad">Buy</div></body>'
            assert html_text.main_text(page) == "Head\nText", (name, tag)


def test_furniture_by_whole_words_is_still_dropped():
    for attrs in ('class="ad"', "id=related", 'class="box sidebar"', 'id="cookie-banner"', 'role="navigation"', "hidden", 'class="x"id="menu"'):
        assert html_text.main_text(f"<body><div {attrs}>Out</div><p>Text</p></body>") == "Text", attrs
    comments = '<div class="comments"><article class="comment">Out</article></div>'
    assert html_text.main_text(f"<body><article>Text</article>{comments}</body>") == "Text"


def tree(rnd, depth=3):
    node = html_text.Node("t", rnd.choice("abc"))
    node.text = 0
    if depth:
        node.kids = [tree(rnd, depth - 1) for _ in range(rnd.randrange(5))]
    return node


def matched(a, b):
    """Simple tree matching as it is defined, without any shortcut."""
    if a.sig != b.sig:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + matched(x, y))
    return 1 + m[-1][-1]


def test_matching_equals_its_definition():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = tree(rnd), tree(rnd)
        b.sig = a.sig
        matching = html_text.Matching()
        matching.ROWS = rnd.choice([1, 2, 256])
        assert matching.score(matching.shape(a), matching.shape(b)) == matched(a, b)
        pairs = matching.pairs(a, b)
        assert pairs == sorted(pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert 1 + sum(matched(a.kids[i], b.kids[j]) for i, j in pairs) == matched(a, b)


def test_long_pages_merge_in_little_memory():
    def page(i, n):
        body = "".join(f"<h2>head {i} {k}</h2><p>text {i} {k} with some more words to read</p>" for k in range(n))
        return f"<body><ul><li>Home<li>News</ul><div>{body}</div><span>Legal note</span></body>"

    a, b = (html_text.skeleton(html_text.parse(page(i, 3000 + 9 * i))) for i in (1, 2))
    tracemalloc.start()
    start = time.process_time()
    merged = html_text.merge(a, b)
    took, (_, peak) = time.process_time() - start, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 5 and peak < 100e6  # about 0.5 s and 4 MB
    assert merged.count == 2 and [x.count for x in merged.kids[0].kids] == [2, 2, 2]


def test_template_decides_inside_an_article(spark):
    pages = [f"<body><article><h1>Head {i}</h1><p>{'own words ' * 9}{i}</p><div>Printed by the press</div></article></body>" for i in range(20)]
    for i, text in enumerate(texts(spark, pages, 3)):
        assert text.startswith(f"Head {i}\n") and "Printed" not in text


def test_ordinary_elements_of_an_article_stay():
    page = "<article><p>Let <math><mi>x</mi></math> be <label>a number</label> and <map>so on</map></p></article>"
    assert html_text.main_text(page) == "Let x be a number and so on"


def test_null_ids_and_page_order(spark):
    rows = [(None, "http://a.example/1", "<p>one</p><p>two</p>"), (1, None, "<div>b</div>a"), (1, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id is None, r.text, r.n_chars) for r in got) == [(False, "", 0), (False, "b\na", 3), (True, "one\ntwo", 7)]
