from assetloom.llm.html_extract import Page, extract

NAV = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now</div>'


def page(i, host, body):
    return (i, f"https://{host}/p/{i}?x=1", f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{NAV}{body}<footer>&copy; foot</footer></body></html>", i)


def test_host_path_decides(spark):
    long = "Plain words of the article. " * 20
    pages = [
        page(i, "one.example", f'<div class="post-{i}"><h1>Title {i}</h1><p>{long}</p></div><div class="extra"><p>side {i}</p></div>') for i in range(8)
    ]
    pages.append(page(8, "one.example", '<div class="post-8"><h1>Short</h1><p>Few.</p></div><div class="extra"><p>Long words that are not the article at all.</p></div>'))
    pages.append(page(9, "two.example", "<article><p>A&amp;B<br>C&#233;&lt;</p><section class=comments><p>first!</p></section></article>"))
    pages += [(10, None, None, 1), (11, "not a url", "", 1), (9, "https://two.example/p/9?x=1", pages[-1][2], 1), (None, "https://x.example/", "<p>only", 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, path long")
    got = [(r.page_id, r.text) for r in extract(frame).collect()]
    expected = [(i, f"Title {i} {long.strip()}") for i in range(8)] + [(8, "Short Few.")] + [(9, "A&B Cé<")] * 2 + [(10, ""), (11, ""), (None, "only")]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert extract(frame.limit(0)).count() == 0


def test_broken_markup():
    cases = {
        "": "", "plain <text": "plain <text", "a<b": "a<b", "<div><div>x": "x", "</div>y": "y", "<!-- open": "", "<script>alert(1)": "",
        '<a href="x>y">z</a>w &#x41;&lt;': "zw A<", "<p>one<p>two<b>three</p>four": "one twothree four",
        "<ul><li>a<li>b</ul>c": "a b c", "<table><tr><td>1<td>2<tr><td>3</table>": "1 2 3", "<p>x&nbsp; \n y</p>": "x y",
        "<article><header><h1>Head</h1></header><p>t</p></article>": "t", "<form><p>f</p></form><p>t</p>": "t",
    }
    assert {source: Page(source).text(None) for source in cases} == cases


def test_left_out_parts():
    body = """<body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">cookies</div><div class="main-col"><article class="post">
    <h1>Head</h1><p>One <b>t</b>wo.</p><div class="newsletter"><p>Subscribe</p></div><aside>aside</aside><p>Three</p></article>
    <div class="comments"><article class="comment"><p>A remark that is much longer than the whole article above it, really.</p></article></div></div>
    <div role="complementary">more</div><div hidden>secret</div><noscript>js</noscript></body>"""
    assert Page(body).text(None) == "Head One two. Three"
    assert Page("<div>" * 3000 + "deep" + "</div>" * 3000).text(None) == "deep"


def test_every_section_of_a_page(spark):
    body = "Plain words of an article that differ from page to page, number {}. "
    pages = [page(i, "one.example", f'<section class="part"><p>{body.format(chr(97 + i)) * 9}</p></section>') for i in range(6)]
    pages.append(page(6, "one.example", "".join(f'<section class="part"><p>{w} {body.format(w)}</p></section>' for w in ("First", "Second", "Third"))))
    pages.append(page(7, "one.example", f'<section class="part"><p>Few.</p></section><div class="rest"><p>{body.format("y") * 9}</p></div>'))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, path long")
    got = {r.page_id: r.text for r in extract(frame).collect()}
    assert got[0] == (body.format("a") * 9).strip()
    assert got[6] == " ".join(f"{w} {body.format(w)}".strip() for w in ("First", "Second", "Third"))
    assert got[7] == f"Few. {(body.format('y') * 9).strip()}"


def test_lead_beside_body(spark):
    long = "Plain words of an article that differ from page to page, number {}. "
    inner = '<div class="lead"><p>Lead of {0}.</p></div><div class="body"><p>{1}</p></div>'
    pages = []
    for i in range(6):
        words = inner.format(chr(97 + i), long.format(chr(97 + i)) * 9)
        pages.append(page(i, "one.example", f"<article>{words}</article>"))
        pages.append(page(10 + i, "two.example", f'<div class="post">{words}</div><div class="extra"><p>The same words {i}</p></div>'))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, path long")
    got = {r.page_id: r.text for r in extract(frame).collect()}
    expected = [f"Lead of {chr(97 + i)}. {(long.format(chr(97 + i)) * 9).strip()}" for i in range(6)]
    assert [got[i] for i in range(6)] == expected and [got[10 + i] for i in range(6)] == expected
