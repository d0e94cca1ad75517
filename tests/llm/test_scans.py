import base64
import hashlib
import html
import random
import time

from candleforge.llm import html_text, secrets, warc
from candleforge.llm.common import shared_dir


def test_trigram_queries():
    queries = {r.kind: secrets.trigram_query(r) for r in secrets.BASE_RULES}
    assert queries["hex"] is None
    assert queries["access"] == ("and", ("aki", "kia"))
    assert secrets.trigrams_of(queries["assign"]) >= {"pas", "tok", "sec", "api"}


def test_secrets_equal_full_scan(spark, docs, empty):
    texts = ["", None, 'PASSWORD = "abcdefgh1" token:short', "AKIA" + "Z" * 12 + " AKIA12", "f" * 40 + " " + "0" * 31, "api_key: 12345678 Apikey=87654321é secret=" + "x" * 20, "tokentoken: abcdefghij", "ghp_" + "a" * 40, "K" + "passwd='" + "p" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secrets.span_digest(secrets.scan_secrets(df)).collect():
        spans = secrets.brute_force(texts[row.doc_id])
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        assert row.base_sha256 == secrets.digest_of(base)
        assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
    assert secrets.scan_secrets(docs).count() == docs.count()
    assert secrets.scan_secrets(empty).count() == 0


PAGE = (
    "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
    "<article><h1>Head &amp; line</h1><p>First   paragraph<br>goes <a href=y>on</a><p>Second.<form><p>Sign up</p></form><ul><li>one<li>two</ul><div class='user-comments'>Nice!</div></article>"
    "<aside>More</aside><div class='cookie-notice'>We use cookies</div><footer>&copy; me</footer></body></html>"
)


def test_html_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain &lt;text&gt; of a page without any markup, which is long enough to be its main text for sure")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert got[1].text == "Head & line\nFirst paragraph goes on\nSecond.\none\ntwo"
    assert (got[2].text, got[3].text) == ("", "")
    assert got[4].text.startswith("plain <text> of") and got[4].n_chars == len(got[4].text)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_text_without_content_region():
    tree = html_text.grow_tree(html_text.LABELLED)
    long = "words of the story " * 12
    page = f"<body><div class=menu><a>x</a><a>y</a></div><p>{long}</p><p>short one</p><p>{long}</p><p><a>all</a> <a>links</a></p></body>"
    assert html_text.main_text(page, tree) == f"{long.strip()}\nshort one\n{long.strip()}"
    assert all(html_text.label_of(tree, row) == row[-1] for row in html_text.LABELLED)


def held_out_page(rng: random.Random) -> tuple[str, str]:
    """A page of one of several templates, and the text of its article."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "&amp;", "light", "of", "caf&eacute;", "a", "the", "7%", "moon."]) for _ in range(n))
    kept, body = [], []
    for _ in range(rng.randrange(1, 8)):
        kind = rng.choice(["p", "p", "p", "h2", "h3", "li", "blockquote", "open"])
        text = words(rng.choice([1, 2, 3, 4, 5, 9, 14, 40, 120]))
        kept.append(text)
        body.append({"li": f"<ul><li>{text}</ul>", "open": f"<p>{text}"}.get(kind, f"<{kind}>{text}</{kind}>"))
        if rng.random() < 0.3:
            body.append(rng.choice([f"<div class='ad'>{words(12)}</div>", f"<form><p>{words(30)}</p><button>go</button></form>", f"<aside>{words(60)}</aside>", f"<section id=comments><p>{words(50)}</p></section>", "<!-- <p>no</p> -->", "<script>if (a<b) x='<p>no</p>'</script>"]))
    outside = [f"<div>{words(rng.choice([3, 20, 80]))}</div>", f"<nav><ul><li><a href=/>{words(2)}</a></ul></nav>", f"<footer>{words(25)}</footer>", f"<div class='cookie-notice'>{words(30)}</div>", f"<header><h1>{words(4)}</h1></header>"]
    around = [rng.sample(outside, rng.randrange(len(outside))) for _ in range(2)]
    region = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=post-content>{}</div>", "<article class='post has-comments with-sidebar'>{}</article>", "<div id=main><article><div>{}</div></article></div>"])
    page = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body class='page-header'>{''.join(around[0])}{region.format(''.join(body))}{''.join(around[1])}</body></html>"
    return page, "\n".join(html.unescape(t) for t in kept)


def test_html_text_of_held_out_pages():
    tree = html_text.grow_tree(html_text.LABELLED)
    rng = random.Random(11)
    for _ in range(600):
        page, text = held_out_page(rng)
        assert html_text.main_text(page, tree) == text, page
    assert html_text.main_text("<article><h2>Two words</h2><p>" + "long " * 60 + "</p><p>" + "more " * 50 + "</p></article><div>" + "junk " * 80 + "</div>", tree).split("\n")[0] == "Two words"


def test_html_text_takes_linear_time():
    tree = html_text.grow_tree(html_text.LABELLED)
    for piece in ("<div>", "<a ", "<a href='", "<!", "<p><b>", "<ul><li>", "</p>", "<a href=\"x"):
        started = time.perf_counter()
        html_text.main_text(piece * 40_000 + "end", tree)
        assert time.perf_counter() - started < 8, piece


def test_warc_round_trip(spark):
    inner = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    pages = [(1, "http://a b\n", ""), (2, None, None), (3, "u", inner), (4, "u", f"x{warc.MAGIC}y{warc.MAGIC}"), (5, "u", inner * 3 + "tail"), (6, "u", inner), (7, "u", "é\r\n\r\nWARC/1.0\nxx"), (8, "u", "z" * 9000 + inner + "q" * 9000), (9, "u", "plain")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        path = shared_dir(spark) + "/warc-test-" + hashlib.sha1(repr(pages).encode()).hexdigest()
        import uuid

        path += uuid.uuid4().hex
        warc.write_warc(df, path)
        got = {r.page_id: tuple(r)[1:] for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", i), i)
    assert len(got) == len(pages)
    for i, _, h in pages:
        data = (h or "").encode()
        first = best[h or ""]
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)


def test_warc_empty(spark):
    import uuid

    path = shared_dir(spark) + "/warc-empty-" + uuid.uuid4().hex
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0

