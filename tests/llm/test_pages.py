import base64
import hashlib

from pyspark.sql import functions as F

from ridgework.llm import page_text, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, type string"


def odd_pages(spark):
    rows = [(r["page_id"], r["url"], r["html"], "x") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [
        (900, None, None, None), (901, "http://a/\r\nx", "", "x"), (902, "u", "same\r\n\r\nWARC/1.1 é", "x"), (904, "u", "same\r\n\r\nWARC/1.1 é", "x"),
        (903, "u", "same\r\n\r\nWARC/1.1 é", "x"), (None, "u", "same\r\n\r\nWARC/1.1 é", "x"), (905, "u", "twice", "x"), (905, "u", "twice", "x"),
        (None, "u", "alone", "x"), (None, "u", "alone", "x"), (906, "u", "x" * 300_000, "x"),
    ]
    return spark.createDataFrame(rows, PAGES).repartition(3), rows


def test_warc_round_trip(spark):
    pages, rows = odd_pages(spark)
    largest = {}
    for page, _, html, _ in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", -1))
    wanted = []
    for page, _, html, _ in rows:
        data, first = (html or "").encode(), largest.get(html or "")
        revisit = first is not None and page != first
        wanted.append((str(page), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    found = warc.round_trip(pages, payloads=True)
    got = [(str(r["page_id"]), r["payload_bytes"], r["capture"]["digest"], r["capture"]["type"], r["refers_to"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert found.where("request is null or metadata is null or request.target <> capture.target").count() == 0
    texts = {r["page_id"]: bytes(r["capture"]["payload"]) for r in found.where("capture.type = 'response' and page_id is not null").collect()}
    assert all(texts[page].decode() == html for html, page in largest.items())
    assert warc.round_trip(pages.where("false")).collect() == []


def text_of(html):
    page = page_text.parse(html)
    article = any(main for _, _, main, _ in page.blocks)
    return "\n".join(text for _, noise, main, text in page.blocks if not noise and (main or not article))


def test_blocks():
    assert text_of("<p>a &amp; b<b>c</b>\n d<p>e<br>f</p>g") == "a & bc d\ne f\ng"
    assert text_of("<nav>menu</nav><article><h1>T&amp</h1><p>x &#233;</p><aside>no</aside></article><footer>f</footer>") == "T&\nx é"
    assert text_of("<script>var t='</p>'</script><div class='ad top'>ad</div><div>keep<ul><li>1<li>2</ul></div>") == "keep\n1\n2"
    assert text_of("<article><p>a</p><section id='comments'><article><p>b</p></article></section></article>") == "a"
    assert text_of("<header>h</header><main><header>title</header><form>x</form>t</main><div>outside</div>") == "title\nt"
    assert text_of("<html><head><title>t</title><meta charset=x><body><article><p>Hello world</p></article>") == "Hello world"
    assert text_of("<head><title>t</title><style>p{}</style>") == "" and text_of("<head><title>t</title><p>x") == "x"
    assert text_of("one<svg width=1 />two<math/>three<svg><title>n</title><path/></svg>") == "onetwothree"
    assert text_of("<article><div class='press-notice'>a</div><div class='social-policy'>b</div><div class='cookie-notice'>c</div></article>") == "a\nb"
    assert text_of("<p>a <span class='advert'>buy <span>now</span> <br> it</span>b</p><p><span class='ad-slot'>x</p><p>c</p>") == "a b\nc"
    assert text_of("<a class='promo'><div>x</div></a><div>y</div>") == "y"
    assert text_of(None) == "" and text_of("") == "" and text_of("plain <i>text") == "plain text"


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [(i, f"http://host/{i}", f"<div class='x{i % 2}1'>always</div><div><p>own {i}</p><p>more {i * 7}</p></div>", "x") for i in range(40)]
    rows += [(900, "http://other/", "<div class='x01'>always</div><div><p>own</p></div>", "x"), (901, None, None, "x")]
    got = {r["page_id"]: r["text"] for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "own 3\nmore 21" and got[900] == "always\nown" and got[901] == ""
    assert page_text.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_a_teaser_is_not_the_whole_page(spark):
    story = "<div class='content'>" + "<p>the story goes on and on</p>" * 9 + "</div>"
    rows = [(1, "u", f"<article><p>short teaser</p></article>{story}<nav>menu</nav>", "x"),
            (2, "u", f"<article><p>short teaser</p></article><div>{'x' * 47}</div>", "x"), (3, "u", "<article></article><p>x</p>", "x")]
    got = {r["page_id"]: r["text"] for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "short teaser\n" + "\n".join(["the story goes on and on"] * 9), 2: "short teaser", 3: "x"}


def test_given_pages(spark):
    pages, rows = odd_pages(spark)
    got = page_text.main_text(pages)
    assert got.count() == len(rows)
    found = {r["page_id"]: r["text"] for r in got.where(F.col("page_id") < 900).collect()}
    for page, _, html, _ in rows:
        if page is not None and page < 900:
            inside = html[html.index("<article>"):html.index("</article>")]
            assert found[page] == text_of(inside)


def test_copies_and_recurring_headlines_stay(spark):
    same = "<body><article><h1>Title</h1><p>one</p><p>two</p></article><div class='k9'>foot</div></body>"
    rows = [(i, "http://copies/", same, "x") for i in range(50)]
    near = "<body><article><h1>Title</h1><div class='bar'>always</div><p>one</p><p>own {}</p></article></body>"
    rows += [(100 + i, "http://near/", near.format(i), "x") for i in range(50)]
    got = {r["page_id"]: r["text"] for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[i] for i in range(50)} == {"Title\none\ntwo"}
    assert all(got[100 + i] == f"Title\none\nown {i}" for i in range(50))


def test_menus_of_many_items_go(spark):
    """Items that all share one path are template if every page has them, however many there are."""
    rows = []
    for pages, items in ((10, 4), (40, 5), (100, 6), (300, 10)):
        menu = "<div><ul>" + "".join(f"<li>item {chr(97 + i)}</li>" for i in range(items)) + "</ul></div>"
        foot = "<div class='low'>" + "".join(f"<p>foot {chr(97 + i)}</p>" for i in range(items)) + "</div>"
        rows += [(len(rows) + i, f"http://h{pages}/{i}", f"{menu}<section><p>own {i}</p><p>more {i * 7}</p></section>{foot}", "x") for i in range(pages)]
    got = {r["page_id"]: (r["url"], r["text"]) for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(text == f"own {(i := int(url.rsplit('/', 1)[1]))}\nmore {i * 7}" for url, text in got.values())
    assert len(got) == 450
