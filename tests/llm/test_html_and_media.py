import hashlib
import random
import re
import zlib

import pytest

from skein.llm import html_text, matroska

SF = "/root/testdata/sf0.001"


def test_blocks_outside_the_article_go():
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy this now.</div><article><h1>Title</h1><p>One <b>wo</b>rd &amp; &#65;.<br>Two\n three.</p><aside>See also</aside><form>Sign up</form><div class="comments"><p>First!</p></div><p>Last.</p></article><footer>&copy; x</footer>'
    assert html_text.main_text(page) == "Title One word & A. Two three. Last."


THIRTY = " ".join(["Ten words are in this plain sentence of the text."] * 3)
TWENTY = " ".join(["Ten words are in this plain sentence of the text."] * 2)
FIFTY = " ".join(["Plain words of a paragraph that goes on,"] * 6)


@pytest.mark.parametrize("page, want", [
    (f"<div><p>{FIFTY}</p></div>", FIFTY),
    (f"<body><p>Short one.</p><p>{FIFTY}</p>", f"Short one. {FIFTY}"),
    (f'<div class="overflow-hidden"><article><p>{FIFTY}</p></article></div>', FIFTY),
    (f'<article data-hidden="false" aria-hidden="false"><p>{FIFTY}</p></article>', FIFTY),
    (f'<div class="content with-sidebar"><article class="has-sidebar comments-enabled social-science"><p>{FIFTY}</p></article></div>', FIFTY),
    (f'<form id="aspnetForm"><div><p>{FIFTY}</p></div></form>', FIFTY),
    (f'<form id="aspnetForm"><article><p>{FIFTY}</p><form class="newsletter"><p>Your mail</p></form></article></form>', FIFTY),
    (f'<div class="sidebar"><article><p>{FIFTY}</p></article></div>', FIFTY),
    (f'<article><p>{FIFTY}</p></article><div class="sidebar"><article><p>Another teaser that should not be here.</p></article></div>', FIFTY),
    (f'<article><p>{FIFTY}</p></article><section class="comments"><article class="comment-body"><p>I do not agree at all.</p></article></section>', FIFTY),
    (f'<article><p>{FIFTY}</p><p hidden>secret</p><div style="display:none"><p>gone</p></div><ul><li><a href=x>One link</a></li><li><a href=y>Other link</a></li></ul></article>', FIFTY),
    (f"<article><p>{FIFTY}</p><p><a href=x>more at this link</a></p><p>{THIRTY}</p></article>", f"{FIFTY} {THIRTY}"),
    (f"<p><a href=x>more at this link</a></p><p>{THIRTY}</p>", THIRTY),
    (f"<p>{FIFTY}</p><p><a href=x>more at this link</a></p><p>{THIRTY}</p>", f"{FIFTY} {THIRTY}"),
    (f"<article><div>{THIRTY} and three more</div><div>{TWENTY}</div></article>", f"{THIRTY} and three more {TWENTY}"),
    (f"<article>{TWENTY}</article>", TWENTY),
    (THIRTY, THIRTY),
    (f"<div>{THIRTY}</div><div>{TWENTY}</div>", f"{THIRTY} {TWENTY}"),
    (f'<article class="share"><p>{THIRTY}</p></article>', THIRTY),
    (f'<article class="post related"><p>{THIRTY}</p><p>{FIFTY}</p></article>', f"{THIRTY} {FIFTY}"),
    (f'<article><p>{FIFTY}</p></article><article class="related"><p>{THIRTY}</p></article>', FIFTY),
    (f'<article><p>{FIFTY}</p><p class="advert">{TWENTY}</p><p>{THIRTY}</p></article>', f"{FIFTY} {THIRTY}"),
    (f'<article><p>{FIFTY}</p><p class=advert>{TWENTY}<p>{THIRTY}<h2 class="related">See these</h2><p>{TWENTY}</article>', f"{FIFTY} {THIRTY} {TWENTY}"),
    (f'<article><p>{FIFTY} <span class="advert">Buy <span>now</span> here.</span>{THIRTY}</p></article>', f"{FIFTY} {THIRTY}"),
    (f'<article><ul><li class="advert">Buy<ul><li>this</li></ul>now</li><li>{TWENTY}</li></ul></article>', TWENTY),
])
def test_missing_and_misleading_regions(page, want):
    assert html_text.main_text(page) == want


def test_the_tree_stands_without_hints(spark):
    """Words, link densities and kinds alone tell nearly all blocks of the pages."""
    right = total = 0
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        found = html_text.blocks(p["html"])
        for (text, b), x in zip(found, html_text.features([b for _, b in found])):
            right += html_text.decide(html_text.tree(False), x) == b[3]
            total += 1
    assert right / total > 0.9


def test_neighbours_decide():
    """A plain text of its own is main text, the same between links is not; without its neighbours' features it would be."""
    links = "<ul><li><a href=x>Home</a></li><li><a href=y>All pages</a></li></ul>"
    page = f"{links}<div>{TWENTY}</div>{links}<p>{FIFTY}</p><p>{FIFTY}</p>"
    assert html_text.main_text(f"<div>{TWENTY}</div>") == TWENTY and html_text.main_text(page) == f"{FIFTY} {FIFTY}"
    found = html_text.blocks(page)
    at = [t for t, _ in found].index(TWENTY)
    own = html_text.features([b for _, b in found])[at]
    assert not html_text.decide(html_text.tree(), own) and html_text.decide(html_text.tree(), own[:2] + (0, 0.0, 0, 0.0) + own[6:])


def test_broken_markup():
    for page in ("", "<", "<p", "<article><p>x", "<script>never closed <p>a</p>", "<article><p title='a>b'>kept words here</p>", "</div></p>text", "<!-- open"):
        html_text.main_text(page)
    assert html_text.main_text("<article><p title='a>b'>kept words here</p>") == "kept words here"


def test_pages_keep_their_articles(spark):
    got = {r["page_id"]: r for r in html_text.op3_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["url"] == p["url"] and got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])
        ends = [re.search(r"<nav>.*?<a [^>]*>([^<]+)</a>", p["html"]), re.search(r"&middot; ([^<]{12,})", p["html"])]
        article = re.search(r"(?s)<article>(.*?)</article>", p["html"])[1]
        words = html_text.html.unescape(re.sub(r"<[^>]*>", " ", article)).split()
        assert got[p["page_id"]]["text"].replace(" ", "") == "".join(words)
        assert ends[1] is None or ends[1][1] not in got[p["page_id"]]["text"]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<article><p>" + "long text " * 20000)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=("url",)).collect()
    assert sorted(r["n_chars"] for r in out) == [0, 0, 0, 199999]


def test_lacing_round_trips():
    rng = random.Random(2)
    for _ in range(300):
        frames = [rng.randbytes(rng.choice([1, 5, 300, rng.randrange(1, 3000)])) for _ in range(rng.randrange(1, 9))]
        b = matroska.block(1, rng.randrange(3000), frames)
        _, _, at, end = next(matroska.elements(b, 0, len(b)))
        track, _, _, parts = matroska.unlace(b, at, end)
        assert track == 1 and [b[a : a + n] for a, n in parts] == frames


def test_every_frame_has_its_time():
    packets, _, facts = matroska.demux(matroska.mux(bytes(range(256)) * 300))
    assert [p[1] for p in packets] == [128 * i for i in range(75)] and facts["laced"] > 5


def test_xiph_lacing_and_unknown_sizes():
    content = b"\x81\x00\x07\x82" + bytes([2, 255, 45, 3]) + b"a" * 300 + b"b" * 3 + b"c" * 9
    assert [n for _, n in matroska.unlace(content, 0, len(content))[3]] == [300, 3, 9]
    payload = bytes(range(256)) * 900
    media = matroska.mux(payload)
    at = media.index(b"\x18\x53\x80\x67")
    size, body = matroska.variable(media, at + 4, False)
    live = media[: at + 4] + b"\x01" + b"\xff" * 7 + media[body : body + size]
    packets, cues, facts = matroska.demux(live)
    assert b"".join(live[a : a + n] for _, _, a, n, _, _ in packets) == payload
    assert facts["clusters"] == len(cues) == 4 and packets[-1][1] == 224 * 128


def test_media_of_documents(spark, docs, odd):
    got = {r["doc_id"]: r for r in matroska.read_back(matroska.to_matroska(docs(odd))).collect()}
    for i, t in odd:
        data = (t or "").encode()
        padded = data + bytes((-len(data)) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
    assert matroska.packet_table(matroska.to_matroska(docs(odd))).where("doc_id = 6").count() == -(-150016 // 1024)


def cluster(time, *blocks, unknown=False):
    body = matroska.number(matroska.TIME, time) + b"".join(blocks)
    return matroska.CLUSTER.to_bytes(4, "big") + (b"\x01" + b"\xff" * 7 + body if unknown else matroska.size_bytes(len(body)) + body)


def test_odd_media():
    m = matroska
    key = m.element(m.GROUP, m.element(m.BLOCK, b"\x81\x00\x05\x00", b"key"))
    other = m.element(m.GROUP, m.element(m.BLOCK, b"\x81\x00\x06\x00", b"other"), m.element(m.REFERENCE, b"\xff"))
    cue = m.element(m.CUE, m.number(m.CUE_TIME, 3), *(m.element(m.CUE_AT, m.number(m.CUE_TRACK, t), m.number(m.CUE_CLUSTER, 10 * t)) for t in (1, 2)))
    clusters = [cluster(10 * i, m.block(1, 1, [b"x"]), unknown=True) for i in range(1500)]
    body = m.element(m.INFO, m.number(m.SCALE, 2_000_000)) + b"".join(clusters) + cluster(100, key, other) + m.element(m.CUES, cue)
    for unknown in (False, True):
        head = b"\x01" + b"\xff" * 7 if unknown else m.size_bytes(len(body))
        packets, cues, facts = m.demux(m.element(m.EBML) + m.SEGMENT.to_bytes(4, "big") + head + body)
        assert facts["clusters"] == 1501 and [p[1] for p in packets[:3]] == [2, 22, 42] and packets[1499][4] == 1500
        assert [(p[1], p[5]) for p in packets[-2:]] == [(210, True), (212, False)]
        assert [c[:2] for c in cues] == [(6, 1), (6, 2)] and cues[1][2] - cues[0][2] == 10


def test_empty_tables(spark, docs, odd):
    none = docs(odd).limit(0)
    assert matroska.read_back(matroska.to_matroska(none)).count() == matroska.packet_table(matroska.to_matroska(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long, key string")
    assert html_text.extract_text(pages, keep=("url",)).count() == 0


def test_the_feature_string(docs):
    got = matroska.read_back(matroska.to_matroska(docs([(1, "ab" * 32)]))).collect()[0]
    assert got["feature"] == "A_PCM/INT/LIT;rate=8000;ms=8.000;packets=1;clusters=1;laced=0;cues=1;last_ms=0;mean=97.500000"
