"""Pages: block rules on hand-written markup, WARC round trips, awkward rows."""

import pytest

from tessel.llm import html, ogg, warc

LONG = "the cat and the dog were in the house with all of the people that had come to see them on that day and it was good "


def test_boilerplate_goes_and_text_stays():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice">We use cookies on the site for all of you.</div>
    <article><header><h1>Head &amp; line</h1></header><p>{LONG}<p>Short.<p>{LONG}<br>tail &lt;b&gt;&nbsp;x</p><aside>See the other</aside>
    <form><p>Subscribe to the letter</p></form><script>var a = "</p><p>no</p>";</script><section class="comments"><p>{LONG}</p></section></article>
    <div class="sidebar"><p>{LONG}</p></div><footer>&copy; 2020 the site</footer>"""
    text = " ".join(LONG.split())
    assert html.main_text(page) == f"Head & line\n{text}\nShort.\n{text} tail <b> x"


def test_pages_without_an_article():
    page = f"<body><div><a href=a>Home</a> | <a href=b>News</a></div><h2>Title</h2><p>{LONG * 3}</p><p>A word.</p><p>{LONG * 2}</p><ul><li><a href=c>more</a></li></ul>"
    assert html.main_text(page).split("\n") == ["Title", " ".join((LONG * 3).split()), "A word.", " ".join((LONG * 2).split())]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>x", "a < b", "<p class='x", "</p></div>", "<a href=\"" + "x" * 50_000])
def test_broken_markup(page):
    assert isinstance(html.main_text(page), str)


SCHEMA = "page_id long, url string, html string, text string, record string, n_chars int"
ROWS = [(1, "http://a/", f"<article><p>{LONG}</p></article>", "t", "r", 0), (1, "http://a/", f"<article><p>{LONG}</p></article>", "t", "r", 0), (2, None, None, None, None, None), (None, "http://b/", "", "", "", 0), (3, "u", "<p>é" * 30_000, "", "", 0)]


def test_rows(spark):
    pages, none = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], SCHEMA)
    got = html.extract(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == " ".join(LONG.split()) for r in got) == 2
    assert html.extract(none).count() == 0 and warc.derived_digests(none).count() == 0
    derived = warc.derive(warc.responses(pages)).collect()
    assert len(derived) == 10
    for r in derived:
        named, block = warc.read_record(bytes(r.record))
        assert named["warc-refers-to"] == r.refers_to and named["warc-type"] == r.record_type and warc.digest(block) == r.block_digest == named["warc-block-digest"]
    pairs = {r.refers_to: {x.record_type for x in derived if x.refers_to == r.refers_to} for r in derived}
    assert all(v == {"conversion", "metadata"} for v in pairs.values())


def test_damaged_records_are_refused():
    record = warc._response("1", "http://a/", "<p>text</p>")
    assert warc.derivatives(record)[0]["content_length"] == 4
    for bad in (record[:-30], record.replace(b"text", b"TEXT"), b"junk"):
        with pytest.raises(warc.WarcError):
            warc.derivatives(bad)


def test_ogg_pages():
    payload = bytes(range(256)) * 300
    media = ogg.encode(payload)
    back, timed = ogg.decode(media)
    assert back == payload and [x[0] for x in timed] == list(range(0, len(payload), ogg.PACKET)) and {x[2] for x in timed} == {1, 2}
    for at in (0, 5, 30, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.decode(media[:-10])


def test_checksum_by_the_book():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
                crc &= 0xFFFFFFFF
        return crc

    assert ogg.checksum(b"OggS and more\x00\xff") == slow(b"OggS and more\x00\xff")


PROSE = {
    "en": "The house by the river was old and it had been there for as long as we could remember, and the people who lived in it were not the ones who had built it. ",
    "de": "Das Haus am Fluss war alt und es stand dort, so lange wir uns erinnern können, und die Leute, die darin wohnten, waren nicht die, die es gebaut hatten. ",
    "it": "La casa sul fiume era vecchia ed era lì da quando abbiamo memoria, e le persone che ci abitavano non erano quelle che la avevano costruita per la famiglia. ",
    "pt": "A casa junto ao rio era velha e estava ali desde que nos lembramos, e as pessoas que nela moravam não eram as que a tinham feito para a família. ",
    "nl": "Het huis aan de rivier was oud en het stond er al zo lang als wij het ons kunnen herinneren, en de mensen die er woonden waren niet degenen die het hadden gebouwd. ",
    "fi": "Joen varrella oleva talo oli vanha ja se oli ollut siellä niin kauan kuin muistamme, eivätkä siinä asuvat ihmiset olleet niitä, jotka sen olivat rakentaneet. ",
    "zh": "河边的房子很旧，从我们记事起它就在那里，住在里面的人并不是当初建造它的人。每到春天，院子里的花都会开，孩子们就在树下玩耍。" * 3,
}


@pytest.mark.parametrize("wrap", ['<article class="post">{}</article>', "<div>{}</div>", '<div class="share-story-body">{}</div>', '<div class="page has-sidebar"><div class="content-sidebar-wrap">{}</div></div>', '<main class="site-main with-comments">{}</main>', '<div class="newsletter-issue">{}</div>'])
@pytest.mark.parametrize("lang", sorted(PROSE))
def test_articles_and_their_surroundings(wrap, lang):
    """Two paragraphs in eight wrappers and seven languages: both come out whole, and nothing of what surrounds them does."""
    one, two = (PROSE[lang] * k for k in (2, 3))
    around = [
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', f'<div class="cookie-notice">{PROSE["en"] * 2}</div>', f'<aside>{PROSE["en"] * 2}</aside>',
        f'<article class="comment" id="c1"><p>{PROSE["en"] * 2}</p></article>', f'<section id="comments"><h3>Comments</h3><div class="comment-body"><p>{PROSE["en"] * 2}</p></div></section>',
        f'<article id="related-posts" class="promo"><p>{PROSE["en"] * 2}</p></article>', '<form><input name="q"><button>Search here</button></form>', f'<div class="sponsored-box">{PROSE["en"] * 2}</div>', "<footer><p>© 2024 Example. All rights reserved.</p></footer>", "<script>var x = 'the of and';</script><style>p { color: red }</style>",
    ]
    page = "<html><body>" + around[0] + around[1] + wrap.format(f"<p>{one}</p><p>{two}</p>") + "".join(around[2:]) + "</body></html>"
    assert html.main_text(page) == "\n".join(" ".join(x.split()) for x in (one, two))


def test_deep_unclosed_markup_takes_time_in_proportion():
    import time

    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        html.blocks_of("<div><span>x</b>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5


def http_record(payload, *headers):
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{h}\r\n" for h in headers) + "\r\n").encode() + payload
    return warc.write_record("response", [("WARC-Record-ID", "<urn:x>"), ("WARC-Date", warc.DATE)], block)


def text_of(record):
    return warc.read_record(warc.derivatives(record)[0]["record"])[1].decode()


def test_payload_codings_and_charsets():
    import gzip
    import zlib

    page = "<p>Grüße aus Köln</p>"
    raw = zlib.compressobj(wbits=-15)
    chunked = b"5\r\n" + page.encode()[:5] + b"\r\n" + f"{len(page.encode()) - 5:x};x=y\r\n".encode() + page.encode()[5:] + b"\r\n0\r\n\r\n"
    for record in (
        http_record(page.encode()), http_record(gzip.compress(page.encode()), "Content-Encoding: gzip"), http_record(zlib.compress(page.encode()), "Content-Encoding: deflate"),
        http_record(raw.compress(page.encode()) + raw.flush(), "Content-Encoding: deflate"), http_record(chunked, "Transfer-Encoding: chunked"), http_record(page.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"),
        http_record(b"<meta charset='latin1'>" + page.encode("latin-1")), http_record(page.encode(), "Content-Type: text/html; charset=nonsense"), gzip.compress(http_record(page.encode())),
    ):
        assert text_of(record) == "Grüße aus Köln"


def test_bad_records_are_rows(spark):
    good = http_record(b"<p>fine</p>")
    rows = [(1, good), (2, b"nonsense"), (3, good[:-30]), (4, http_record(b"x", "Content-Encoding: br")), (5, http_record(b"zz\r\n", "Transfer-Encoding: chunked")), (6, None), (7, b""), (8, b"\x1f\x8bxx")]
    got = sorted((r.page_id, r.record_type, r.error is None) for r in warc.derive(spark.createDataFrame(rows, "page_id long, record binary")).collect())
    assert got == [(1, "conversion", True), (1, "metadata", True), *((i, "error", False) for i in (2, 3, 4, 5, 7, 8))]


def test_record_ids_tell_payloads_apart(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>one</p>"), (1, "http://a/", "<p>two</p>"), (1, "http://a/", "<p>two</p>"), (None, None, None)], "page_id long, url string, html string")
    rows = warc.derived_digests(pages).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.record_id, set()).add(r.record_sha256)
    assert len(rows) == 8 and len(by_id) == 6 and all(len(x) == 1 for x in by_id.values())


def test_media_digests_against_a_plain_computation(spark):
    import hashlib
    import zlib

    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "x" * 64), (6, "é" * 5000), (None, "abc"), (1, "abc")]
    got = ogg.media_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = {}
    for r in got:
        (text,) = {t for i, t in rows if i == r.doc_id}
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = ogg.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert f"crc={zlib.crc32(payload):08x}" in r.feature and f"samples={len(payload)};" in r.feature
        by_text.setdefault(text or "", set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert len(got) == len(rows) and all(len(x) == 1 for x in by_text.values())
