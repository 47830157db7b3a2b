import time

from graphloom.llm import html_text as h

PAGE = "<html><head><title>t</title><script>var a='</p>'</script></head><body><header>site</header><nav><ul>{nav}</ul></nav>{ad}<article><h1>A &amp; B{n}</h1><p><b>One{n}<br><p>two\n  three{n}</p>{more}<div class='comments'><p>no</p></div></article><aside>x</aside><form>f<p>g</form><footer>&copy; f</footer></body></html>"


def page(n, nav=3, ad=False, more=0):
    return PAGE.format(n=n, nav="<li><a href='#'>m</a></li>" * nav, ad="<div class='ad'>buy</div>" * ad, more="<p>more</p>" * more)


def test_main_text(spark):
    rows = [(i, f"http://a.org/{i}", page(i, 2 + i % 4, i % 2, i % 3), 1) for i in range(12)] + [(20, None, None, 1), (21, "http://b.org/", "", 1), (22, "http://b.org/x", "<p>cut <b>off", 1), (0, "http://a.org/0", page(0, 2), 1)]
    got = h.extract(spark.createDataFrame(rows, "page_id int, url string, html string, main int")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 20:
            n = r.page_id
            assert r.main_text == "\n\n".join([f"A & B{n}", f"One{n}", f"two three{n}", *["more"] * (n % 3)])
    assert {r.page_id: r.main_text for r in got if r.page_id >= 20} == {20: "", 21: "", 22: "cut off"}
    assert h.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_wrappers_have_groups_options_and_slots():
    w = h.Wrapper()
    for i in range(6):
        w.learn(page(i, 2 + i % 4, i % 2, i % 3))
    assert "(li a # /a /li)+" in w.expression() and "div.ad?" in w.expression()
    other = h.Wrapper()
    other.learn(page(9, 5, True, 2))
    before = w.expression()
    w.merge(h.Wrapper.load(other.dump()))
    assert "(li a # /a /li)+" in w.expression() and len(w.expression()) < 2 * len(before)


def test_article_without_semantic_elements():
    make = lambda i: f"<body><div class=top>Site</div><div class=c><p>{'word ' * 20}{i}<p>text {i}</div><div class=f>Foot note</div>"
    w = h.Wrapper()
    for i in range(5):
        w.learn(make(i))
    assert h.main_text(make(7), w.rules()) == ("word " * 20 + "7") + "\n\ntext 7"


def test_names_on_content_and_odd_attributes_lose_nothing():
    probes = {
        '<body class="has-sidebar"><article><p>hello world</p></article></body>': "hello world",
        '<html class="page nav-open"><body><article><p>keep</p></article></body></html>': "keep",
        '<article><div class="comment-free"><p>keep</p></div></article>': "keep",
        "<article><p class='banner-quote'>quoted</p></article>": "quoted",
        "<div class=widget><article><p>inside</p></article></div>": "inside",
        "<p data-x=it's>Hello world</p><p>don't stop</p><p>end</p>": "Hello world\n\ndon't stop\n\nend",
        "<article><p>a <math><mi>x</mi></math> b</p><object>o</object><noscript>n</noscript></article>": "a x b\n\non",
        '<article><p title="a > b">text</p><div class="site-footer">no</div><div class="share-buttons">no</div></article>': "text",
        '<div class="user comments"><p>no</p></div><p>yes</p>': "yes",
    }
    for page, want in probes.items():
        assert h.main_text(page) == want, page


def test_long_odd_pages_take_linear_time():
    began = time.process_time()
    h.main_text("<p a='" * 40_000 + "x")
    h.main_text('<a b="' * 20_000 + "<!--" * 20_000)
    assert time.process_time() - began < 20


def test_wrappers_decide_what_is_template():
    """Hosts without article elements or telling names, and labels inside an article: what pages agree on is left out,
    as a comparison of all pages by hand finds."""
    plain = lambda i: f"<body><div>Our site</div><div><p>{'word ' * 20}{i}<p>text {i}</div><div>Call us</div>"
    marked = lambda i: f"<article><h1>Title {i}</h1><div>By our staff</div><p>Body {i}</p><p>More {i}</p></article>"
    for make, want in ((plain, lambda i: ("word " * 20 + f"{i}") + f"\n\ntext {i}"), (marked, lambda i: f"Title {i}\n\nBody {i}\n\nMore {i}")):
        w = h.Wrapper()
        pages = [make(i) for i in range(5)]
        for page in [*pages, pages[0], pages[0]]:
            w.learn(page)
        for i, page in enumerate(pages):
            assert h.main_text(page, w.rules()) == want(i)
            assert h.main_text(page) != want(i)
    copies = h.Wrapper()
    for _ in range(9):  # copies of one page tell nothing apart
        copies.learn(marked(1))
    assert "By our staff" in h.main_text(marked(1), copies.rules())
