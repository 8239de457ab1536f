from lodestone.llm.html_text import blocks, elements, extract_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="page header-x">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div class="promo-box %s"><span>Always the same words</span></div>
<article><header><h1>A &amp; B</h1></header><p><b>First   &eacute;\n one &amp<br><p>Second <i>part</i>.</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>
<p class="tagline">Follow us every day</p><div id="comments"><p>I disagree</p></div><form><input value="q">Go</form></article>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""
BODY = "A & B\nFirst é one &\nSecond part.\nx\ny\n1 2"


def test_blocks_of_one_page():
    assert "\n".join(blocks(parse(PAGE))) == BODY + "\nFollow us every day"
    assert blocks(parse("plain text &lt;b> <i>x</i><p>y")) == ["plain text <b> x", "y"]
    assert blocks(parse("<div>a<div>b</div>c</div><br>d<!-- open")) == ["a", "b", "c", "d"]
    assert blocks(parse(None)) == blocks(parse("")) == []
    assert blocks(parse("<div>" * 5000 + "deep")) == ["deep"]


def test_style_tree_cuts_what_never_changes(spark):
    fresh = lambda i: PAGE.replace("Second", f"Second{i} and its own words")
    rows = [(i, "http://A.example/x", fresh(i), "c") for i in range(30)] + [(100, "http://b.example/y", PAGE, "c")] * 2
    rows += [(101, None, None, "c"), (102, "http://a.example:80", "", "c"), (None, "not a url", "<p>lone", "c")]
    # A host of copies keeps its text.
    rows += [(200 + i, "http://copies.example/", "<html><body><article><h1>H</h1><p>Same</p></article></body></html>", "c") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert len(by[100]) == 2 and by[100][0].text == BODY + "\nFollow us every day"
    assert by[7][0].text == BODY.replace("Second", "Second7 and its own words")
    assert by[101][0].text == by[102][0].text == "" and by[None][0].text == "lone"
    assert all(by[200 + i][0].text == "H\nSame" for i in range(20))
    assert extract_text(pages.limit(0)).count() == 0


def test_hostile_markup_ends_soon():
    import time

    for text, said in (
        ("<div>" * 20_000 + "deep", ["deep"]),
        ("<div>" * 20_000 + "</b>" * 20_000 + "x", ["x"]),
        ("<p><span>" * 20_000 + "y", ["y"]),
        ("<a " * 350_000, []),
        ('<a "' * 8_000 + "'", []),
        ('<a b="' * 30_001, []),
        ("&" * 500_000, ["&" * 500_000]),
        ("<p title=\"a > b\">in</p><p title=it's>out", ["in", "out"]),
    ):
        began = time.perf_counter()
        root = parse(text)
        elements(root)
        assert blocks(root) == said and time.perf_counter() - began < 5, text[:40]


def test_contents_are_equal_where_texts_are():
    content = lambda inner: next(c for _, _, c, _ in elements(parse(f"<body><div class=x>{inner}</div>")) if c)
    inner = [f"<span>{w}  words</span> tail" for w in ("same", "other", "same", "third")]
    found = [content(x) for x in inner]
    assert [[a == b for b in found] for a in found] == [[a == b for b in inner] for a in inner]
    assert content("<span>same words</span>\n  tail") == found[0]
