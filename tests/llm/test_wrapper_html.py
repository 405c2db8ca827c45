import random

from bitloom.llm import wrapper_html as w


def test_parser_and_regions():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>top</header><nav><ul><li><a>m</a></ul></nav><!-- no --><div class="cookie-notice">ok?</div><div class=adBox>buy</div>
    <article><h1>A&amp;B &lt;x&gt; &eacute;&#8211;</h1><p><b>one<i>two</i>
       three<br>four<p>five &nbsp; six</p><div><ul><li>a<li>b</ul>tail</div><form>no</form><aside>no</aside>
    <section id="comments"><p>first!</p></section><table><tr><td>c1<td>c2</table></article><footer>f</footer>"""
    assert w.extract(page) == "A&B <x> é–\nonetwo three four\nfive six\na\nb\ntail\nc1\nc2"
    assert w.extract(None) == w.extract("") == "" and w.extract("plain  text") == "plain text"
    assert w.extract("<div class='content'><p>x</p></div><div class='side sidebar'>y</div><p>z") == "x\nz"
    assert w.extract("<p>a < b & c</p><article></article>") in ("", "a < b & c")


def pages(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        a, b = text(8), text(30)
        rows.append((i, f"http://h.example/{i}", f"<body><div class=x><p>Read more on our site</p><h1>{a}</h1><p>{b}</p><p>All rights kept</p></div></body>"))
        want[i] = f"{a}\n{b}"
    same = text(40)
    rows += [(100 + i, f"http://copies.example/{i}", f"<article><h1>t</h1><p>{same}</p></article>") for i in range(9)]
    want |= {100 + i: f"t\n{same}" for i in range(9)}
    rows += [(200, None, "<p>x</p>"), (201, "http://one.example/", None), (202, "nonsense", ""), (203, "http://one.example/2", "<p>" + "long " * 50000), (203, "http://one.example/2", "<p>dup")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    return df, want, rows


def test_template_is_dropped_and_copies_stay(spark):
    df, want, rows = pages(spark)
    out = w.main_text(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {k: got[k] for k in want} == want
    assert got[200] == "x" and got[201] == got[202] == ""
    assert w.main_text(df.limit(0)).count() == 0


def plain_worth(a, b):
    """Simple tree matching as it is written down: the whole table for each pair of elements."""
    if a.name != b.name:
        return 0
    if a.text is not None:
        return 1 + (a.text == b.text)
    x, y = a.children, b.children
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x, 1):
        for j, d in enumerate(y, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_worth(c, d))
    return 1 + best[-1][-1]


def random_page(rnd, depth=0):
    parts = []
    for _ in range(rnd.randint(1, 6)):
        kind = rnd.random()
        if kind < 0.5 or depth > 2:
            parts.append(f"<p>{rnd.choice('uvwxyz')}</p>")
        elif kind < 0.7:
            parts.append(f"{rnd.choice('abc')}")
        else:
            tag = rnd.choice(["div", "ul", "section"])
            parts.append(f"<{tag}>{random_page(rnd, depth + 1)}</{tag}>")
    return "".join(parts)


def test_matching_is_optimal(monkeypatch):
    rnd = random.Random(8)
    for halves in (False, True):
        if halves:
            monkeypatch.setattr(w, "CELLS", 4)
        for _ in range(150):
            a, b = (w.outline(w.parse(random_page(rnd)))[0] for _ in range(2))
            assert 1 + w.align(a.children, b.children, {}) == plain_worth(a, b)
            pairs = w.matched(a, b)
            assert all(x < y for p, q in zip(sorted(pairs), sorted(pairs)[1:]) for x, y in ((p[0], q[0]), (p[1], q[1])))  # in order, none twice


def test_constant_node_is_found_behind_any_number_of_siblings():
    ref = w.outline(w.parse("<div>" + "".join(f"<p>r{k}</p>" for k in range(5)) + "<p>Always the same</p></div>"))[0]
    for n in (0, 1, 5, 12, 13, 30, 500):
        page = w.outline(w.parse("<div>" + "".join(f"<p>s{n} {k}</p>" for k in range(n)) + "<p>Always the same</p></div>"))[0]
        assert (5, n, True) in w.matched(ref, page)


def test_titles_in_an_articles_header_stay():
    long = "a long text " * 5
    for page in (f"<article><header><h1>T</h1><p>by me</p></header><p>{long}</p></article>", f'<article><div class="post-header"><h1>T</h1><span>share</span></div><p>{long}</p></article>'):
        assert w.extract(page) == f"T\n{long.strip()}"
    assert w.extract(f"<header><h1>Site</h1></header><article><p>{long}</p></article>") == long.strip()
    assert w.extract("<article><p>a <math>b</math> c</p></article>") == "a b c"


def test_wrappers_tell_what_regions_do_not(spark):
    """Pages without article or telling classes: only the wrapper separates boilerplate and text."""
    rnd = random.Random(9)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        body = [text(15) for _ in range(rnd.choice([5, 12, 14, 30]))]
        rows.append((i, f"http://plain.example/{i}", "<body><div><p>Our site</p><p>Home Shop Contact</p></div><div>" + "".join(f"<p>{t}</p>" for t in body) + "<p>Write to us at any time</p></div></body>"))
        want[i] = "\n".join(body)
    out = {r.page_id: r.text for r in w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == want
    assert all(w.extract(h) != want[i] for i, _, h in rows)


def test_class_words_do_not_take_the_article():
    page = '<html class="no-sidebar"><body class="single has-sidebar comments-open"><div class="sidebar">s</div>%s<div id="comments">first!</div></body></html>'
    text = "a long text " * 5
    for inner in ("<p>{}</p>", '<main class="with-sidebar"><p>{}</p></main>', '<article class="post category-legal"><p>{}</p></article>', '<div class="layout has-sidebar"><div class="ad">buy</div><article class="post"><p>{}</p></article></div>', '<div class="content with-sidebar"><p>{}</p></div>', '<article><div class="post with-comments"><p>{}</p></div><div class="share">x</div></article>', '<div class="has-header"><main><p>{}</p></main></div>'):
        assert w.extract(page % inner.format(text)) == text.strip(), inner
    # Boilerplate stays out, be it longer than the article or made of articles.
    assert w.extract(f"<article><p>short</p></article><div id=comments><p>{text}</p></div>") == "short"
    assert w.extract(f"<div><p>{text}</p></div><div class=related><article>t</article><article>u</article></div>") == text.strip()
    assert w.extract(f"<div class=has-sidebar><article><p>{text}</p></article><div class=related><article>t</article></div></div>") == text.strip()


def test_template_is_learned_from_all_pages_of_each_layout(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    legal = text(120)  # longer than any article
    rows, want = [], {}
    for i in range(60):
        body = [text(12) for _ in range(rnd.randint(10, 30))]
        paragraphs = "".join(f"<p>{t}</p>" for t in body)
        if i % 3:
            page = f"<body><div class=a><p>Start here</p>{paragraphs}<p>Closing words</p><p>{legal}</p></div></body>"
        else:
            page = f"<body><div class=b><span>Other layout</span>{paragraphs}<p>Its end</p></div></body>"
        rows.append((i, f"http://two.example/{i}", page))
        want[i] = "\n".join(body)
    out = w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == want
