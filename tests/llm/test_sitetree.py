import html
import re

from trellis.llm import sitetree as S


def text(x):
    return S.Page(x).text()


def test_article_alone():
    page = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>";</script></head><body>'
            '<header>site</header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">we use</div>'
            '<article><header><h1>A &amp; B</h1></header><p><b>one\n\t two.<br><p>th<i>re</i>e&nbsp;four&#8212;five &lt;six&gt;</p>'
            '<aside>side</aside><form><input value="y">send</form><div id="comments"><article>hm</article></div>'
            '<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><div class="ad">buy</div><footer>&copy; x</footer></body></html>')
    assert text(page) == "A & B one two. three four—five <six> a b c d"


def test_broken_pages():
    assert text("") == "" and text("plain") == "plain" and text("<p>a<p>b") == "a b"
    assert text("<article><p>open <b>text") == "open text"
    assert text("</div></p><p>x</p></body>") == "x"
    assert text('<article><p title="a>b" class=x>y</p><p class="q>z</p></article>') == "y z"
    assert text("<article>a<script>never closed") == "a"
    assert text("<article>1 < 2 & 3 <4</article>") == "1 < 2 & 3 <4"
    assert text('<article><p hidden>h</p><p style="display: none">i</p><p aria-hidden="true">j</p>k</article>') == "k"
    assert text("<main><p>a</p></main><div><p>b</p></div>") == "a"
    assert text("<ul><li><a href=x>menu one</a><li><a href=y>menu two</a></ul><p>text of it</p>") == "text of it"
    many = "<b>" * 30_000 + "<br>x</i>" * 30_000 + "<p><div>" * 30_000 + "</p>" * 30_000
    assert text(many) == "x " * 29_999 + "x"
    assert max(map(len, S.Page(many).children)) <= (S.DEPTH + 1) * (S.LABEL + 18)
    long = "<article>" + "<div>" * 3000 + "deep " * 50_000 + "</article>"
    assert text(long) == ("deep " * 50_000).strip()


def test_branches_that_repeat_go(spark):
    def page(i, n):
        return (f'<body><div><p>Welcome to the site</p><p>Visit {i % 2}</p></div><section><h2>Story {i}</h2><p>Body of number {i}</p></section>'
                f'<div id="b{i}"><span>Write to us</span></div></body>')

    rows = [(i, f"http://Big.example.org:80/{i}", page(i, 40), "x") for i in range(40)]
    rows += [(100 + i, f"http://small.example.org/{i}", page(i, 3), "x") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)
    got = {r.page_id: r.text for r in S.main_texts(pages).selectExpr("row.page_id", "text").collect()}
    assert got[7] == "Story 7 Body of number 7"
    assert got[101] == "Welcome to the site Visit 1 Story 1 Body of number 1 Write to us"  # too few pages to tell
    rated = {(r.host, r.path): r for r in S.importance(S.site_features(pages.drop("host").withColumn("host", S.host_of(S.F.col("url"))))).collect()}
    big = "big.example.org"
    assert rated[big, "/body/section/p"].importance > 0.8 > 0.5 > rated[big, "/body/div/p"].importance


def test_same_page_everywhere_keeps_its_text(spark):
    rows = [(i, "http://one.example.org/", "<article><p>always this</p></article>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in S.main_texts(pages).collect()} == {"always this"}


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in S.main_texts(pages).selectExpr("row.page_id", "text").collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", body))
        assert got[r.page_id] == " ".join(html.unescape(body).split())


def test_edges(spark):
    rows = [(1, None, None), (2, "http://x.org", ""), (2, "http://x.org", ""), (None, "not a url", "<p>t</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", S.F.lit("other"))
    got = S.main_texts(pages).selectExpr("row.page_id", "row.url", "text").collect()
    assert sorted(r.text for r in got) == ["", "", "", "t"]
    assert S.main_texts(pages.limit(0)).count() == 0


def test_article_below_a_marked_wrapper():
    for wrapper in ("class='page has-sidebar'", "class=no-comments", "id='header-and-content'", "role=banner"):
        assert text(f"<div {wrapper}><p>crumbs</p><article><p>real</p><div class=share>to all</div></article></div>") == "real"
        assert text(f"<main><div {wrapper}><article>real</article></div></main>") == "real"
    comments = '<div id="comments"><article class="comment-body">hm</article></div>'
    assert text(f"<article>real</article>{comments}<div class=related><article>next</article></div>") == "real"
    assert text(f"<div><p>real</p></div>{comments}") == "real"


def test_importance_overrules_names(spark):
    def page(i):
        story = f"<h2>Story {i}</h2><p>Body of number {i}</p>"
        if i < 20:
            return f'<body><h1>Title {i}</h1><div class="page has-sidebar"><div class="sidebar"><p>Always here</p></div>{story}</div></body>'
        return f'<body><article>{story}<p>A closing line of {i}</p><div class="comments"><p>Hm {i}</p></div></article></body>'

    rows = [(i, f"http://{'a' if i < 20 else 'b'}.example.org/{i}", page(i)) for i in range(40)]
    rows += [(100, "http://few.example.org/", "<div class=story><p>Here</p></div><div class=ad><p>Buy</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in S.main_texts(pages).selectExpr("row.page_id", "text").collect()}
    assert got[7] == "Title 7 Story 7 Body of number 7"
    assert got[27] == "Story 27 Body of number 27 A closing line of 27"
    assert got[100] == "Here"


def test_copies_count_once(spark):
    def page(i):
        return f"<body><section><p>Body of number {i}</p><p>More of number {i}</p></section>{f'<h2>Story {i}</h2>' if i else ''}</body>"

    rows = [(i, "http://x.example.org/", page(max(0, i - 70))) for i in range(100)]  # 71 rows are the same page
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in S.main_texts(pages).selectExpr("row.page_id", "text").collect()}
    assert got[90] == "Body of number 20 More of number 20 Story 20" and got[3] == "Body of number 0 More of number 0"
    features = S.site_features(pages.withColumn("host", S.host_of(S.F.col("url"))))
    assert features.where("path = '/body/section' AND NOT is_text").agg(S.F.sum("n")).first()[0] == 30


def test_long_labels_and_deep_branches_stay_apart(spark):
    utility = " ".join(f"u{k:03d}-{'x' * 12}".replace("0", "o") for k in range(20))  # a prefix as long as many frameworks make it
    assert len(utility) > 3 * S.LABEL

    def page(i, deep):
        frame = "<div>" * deep
        return (f"<body>{frame}<div class='{utility} zone-a'><p>The same words on every page</p></div>"
                f"<div class='{utility} zone-b'><p>Body of number {i} is here</p></div></body>")

    rows = [(i, f"http://h{deep}.example.org/{i}", page(i, deep)) for deep in (0, 90) for i in range(deep, deep + 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in S.main_texts(pages).selectExpr("row.page_id", "text").collect()}
    assert got[7] == "Body of number 7 is here" and got[97] == "Body of number 97 is here"
