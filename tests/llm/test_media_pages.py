"""Progressive JPEG and page wrappers."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.llm import media, wrappers


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_store_is_lossless(data):
    payload = media.padded(data)
    frame, _, comment = media.coefficients(media.store(payload))
    assert media.restore(frame, comment) == payload and len(payload) % 64 == 0 and payload


def test_general_scans_agree_with_packed_ones(monkeypatch):
    image = media.store(media.padded(os.urandom(700)))
    fast = media.coefficients(image)[0].planes
    monkeypatch.setattr(media, "_packed_dc", lambda *a: None)
    monkeypatch.setattr(media, "_packed_first", lambda *a: None)
    monkeypatch.setattr(media, "_packed_refine", lambda *a: False)
    assert all((a == b).all() for a, b in zip(fast, media.coefficients(image)[0].planes, strict=True))


def jvm_luma(spark, path):
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.File(str(path))))
    raster = reader.readRaster(0, None)
    w, h = raster.getWidth(), raster.getHeight()
    return np.array(list(raster.getSamples(0, 0, w, h, 0, spark.sparkContext._gateway.new_array(jvm.int, w * h)))).reshape(h, w)


def luma(data):
    frame, quant, _ = media.coefficients(data)
    samples = np.clip(np.floor(((frame.planes[0] * quant[frame.parts[0][3]]).astype(float) @ media._INVERSE) / (1 << 26) + 128.5), 0, 255)
    columns = frame.strides[0]
    return samples.reshape(-1, columns, 8, 8).swapaxes(1, 2).reshape(-1, columns * 8)[: frame.height, : frame.width]


def test_another_decoder_reads_the_store(spark, tmp_path):
    data = media.store(media.padded(os.urandom(3000)))
    (tmp_path / "x.jpg").write_bytes(data)
    assert np.abs(jvm_luma(spark, tmp_path / "x.jpg") - luma(data)).max() <= 1


@pytest.mark.parametrize("shape", [(64, 64), (37, 91)])
def test_another_encoders_progressive_image(spark, tmp_path, shape):
    """Scans, tables and runs as a common encoder writes them, through the general path."""
    jvm = spark._jvm
    rng = np.random.default_rng(2)
    pixels = np.clip(np.cumsum(np.cumsum(rng.normal(0, 4, (*shape, 3)), 0), 1) / 4 + 128, 0, 255).astype(int)
    image = jvm.java.awt.image.BufferedImage(shape[1], shape[0], 1)
    array = spark.sparkContext._gateway.new_array(jvm.int, shape[0] * shape[1])
    for i, (r, g, b) in enumerate(pixels.reshape(-1, 3).tolist()):
        array[i] = (r << 16) | (g << 8) | b
    image.setRGB(0, 0, shape[1], shape[0], array, 0, shape[1])
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    parameters = writer.getDefaultWriteParam()
    parameters.setProgressiveMode(1)
    path = tmp_path / "p.jpg"
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), parameters)
    stream.close()
    data = path.read_bytes()
    assert b"\xff\xc2" in data
    assert np.abs(jvm_luma(spark, path) - luma(data)).max() <= 1
    frame, quant, _ = media.coefficients(data)
    assert np.abs(media.rgb(frame, quant).astype(int) - pixels).mean() < 12


def test_media_columns_of_odd_rows(spark, odd, none):
    rows = media.decoded(media.to_media(odd.select("doc_id", "text"))).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    assert len(rows) == odd.count()
    for r in rows:
        payloads = [media.padded(t) for t in texts[r["doc_id"]] if len(t) == r["n_bytes"]]
        assert r["payload_sha256"] in {hashlib.sha256(p).hexdigest() for p in payloads} and r["tail_crc32"] in {zlib.crc32(p[-64:]) for p in payloads}
        assert len(r["rgb"]) == r["height"] * r["width"] * 3 and r["error"] is None
    by_text = {}
    for r in rows:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.decoded(media.to_media(none)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"\xff\xd8\xff"), (4, media.store(bytes(64))[:300])], "doc_id long, media binary")
    assert all(r["error"] for r in media.decoded(broken).collect() if r["doc_id"] < 4)


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header>Site</header><nav><ul><li><a href=/>Home</a></li><li><a>News {0}</a></li></ul></nav>
<article><h1>Title&nbsp;{0}</h1><p>First &amp; <b>bold</b>
 text {0}<br>more</p><ul><li>one</li><li>two</li></ul><p>Last &lt;tag&gt; &eacute;<div class="ad">Buy {0}</div><form><p>Mail</p></form><aside>Side</aside></article>
<div id="comments"><p>Reader {0}</p></div><footer>&copy; {0}</footer></body></html>"""
TEXT = "Title {0}\nFirst & bold text {0} more\none\ntwo\nLast <tag> é"


def extracted(spark, rows):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")).collect()}


def test_main_text(spark):
    rows = [(i, f"http://Example.com/{i}", PAGE.format(i), "clash", "clash") for i in range(6)]
    assert extracted(spark, rows) == {i: (TEXT.format(i), len(TEXT.format(i))) for i in range(6)}


def test_what_a_host_repeats_goes_where_no_element_marks_the_article(spark):
    page = "<body><div>Welcome to our site</div><div><p>Story {0} begins</p><p>and ends {0}</p></div><div>All rights kept</div></body>"
    rows = [(i, f"https://plain.org/{i}", page.format(i), None, None) for i in range(4)] + [(9, "https://single.org", page.format(9), None, None)]
    found = extracted(spark, rows)
    assert all(found[i][0] == f"Story {i} begins\nand ends {i}" for i in range(4))
    assert found[9][0] == "Welcome to our site\nStory 9 begins\nand ends 9\nAll rights kept"


def test_wrappers_are_union_free_expressions():
    own = None
    for html in ("<ul><li>a<li>b<li>c</ul><p>x</p>", "<ul><li>a</ul><hr><p>y</p>"):
        one = wrappers.wrapper_of(wrappers.parse(html)[0])
        own = wrappers.merged(own, one) if own else one
    assert wrappers.expression(own) == "<ul>(<li>#PCDATA</li>)+</ul>(<hr></hr>)?<p>#PCDATA</p>"
    pairs = wrappers.wrapper_of(wrappers.parse("<dl>" + "<dt>k<dd>v" * 4 + "</dl>")[0])
    assert wrappers.expression(pairs) == "<dl>(<dt>#text</dt><dd>#text</dd>)+</dl>"


@pytest.mark.parametrize("html", [None, "", "plain text", "<", "<p", "<p>open <b>bold", "</div></p>", "<div>" * 3000 + "deep" + "</div>" * 3000, "<script>never closed", "<a href='x>y</a>", "&#0;&bogus;&#x110000;", "<p>" + "word " * 100_000, "<b>" * 500 + "x"])
def test_odd_pages_do_not_crash(html):
    wrapper = wrappers.wrapper_of(wrappers.parse(html or "")[0])
    text = wrappers.main_text(html or "", wrapper)
    assert "<div" not in text and text == "\n".join(line.strip() for line in text.split("\n"))


def accepts(items, tokens):
    """Whether a wrapper, written as a regular expression over tags and text digests, matches a page's own tokens."""

    def pattern(items):
        out = []
        for x in items:
            inner = "" if x[0] not in ("#", "*") else r"#\d+;" if x[0] == "#" and x[3] is None else f"#{x[3]};" if x[0] == "#" else pattern(x[3])
            inner = inner or f"<{re.escape(x[0])}>{pattern(x[3])}</>"
            out.append(f"(?:{inner}){'*' if x[1] and x[2] else '?' if x[1] else '+' if x[2] else ''}")
        return "".join(out)

    return re.fullmatch(pattern(items), tokens) is not None


def tokens(node):
    return "".join((f"#{wrappers._digest(c)};" if c.strip() else "") if isinstance(c, str) else f"<{c.label}>{tokens(c)}</>" for c in node.children)


@pytest.mark.parametrize("seed", range(40))
def test_wrappers_match_every_page_they_come_from(seed):
    """Brute force: pages of one random template with optional and repeated parts, and changing texts."""
    rng = random.Random(seed)
    kinds = ["p", "h2", "table", "pre", "hr", "dl"]

    def template(depth):
        return [(rng.choice(["one", "maybe", "many", "fixed", "slot"]), kind, template(depth - 1) if depth else []) for kind in rng.sample(kinds, rng.randint(1, 4))]

    def fill(parts):
        out = []
        for role, kind, inner in parts:
            if role == "fixed":
                out.append(f"<{kind}>constant {kind}</{kind}>")
            elif role == "slot":
                out.append(f"<{kind}>word{rng.randrange(9)}</{kind}>")
            else:
                for _ in range({"one": 1, "maybe": rng.randint(0, 1), "many": rng.randint(1, 3)}[role]):
                    out.append(f"<div class=c{kind}>{fill(inner)}</div>")
        return "".join(out)

    own = template(2)
    roots = [wrappers.parse(f"<body>{fill(own)}</body>")[0] for _ in range(6)]
    merged = wrappers.wrapper_of(roots[0])
    for root in roots[1:]:
        merged = wrappers.merged(merged, wrappers.wrapper_of(root))
    assert all(accepts(merged, tokens(r)) for r in roots), wrappers.expression(merged)


def test_a_class_is_evidence_not_a_verdict():
    body = "<h1>Head</h1><p>The story itself.</p>"
    for page in (
        f"<article class='post has-comments'>{body}</article>", f"<body class='single no-sidebar'><article>{body}</article></body>", f"<article class='hentry share-on'>{body}</article>",
        f"<div class='widget'><div>{body}</div></div>", f"<main><div data-x='hidden'>{body}</div></main>", f"<div id=comments><article>{body}</article></div>",
    ):
        assert wrappers.main_text(page, None) == "Head\nThe story itself.", page
    for note in ("class='ad'", "class='cookie-notice'", "id=site-footer", "class='post-comments wide'", "role=search", "hidden", "style='display: none'", "class='newsletter signup'"):
        assert wrappers.main_text(f"<article>{body}<div {note}>Go away</div></article>", None) == "Head\nThe story itself.", note
    assert wrappers.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><canvas>chart</canvas></article>", None) == "Let x=2 be.\nchart"


def test_the_wrapper_acts_inside_articles_of_its_own_host_only(spark):
    page = "<body><nav>Top</nav><article><h1>Story {0}</h1><h2>Summary</h2><div class=x>Told by our reporters</div><p>What happened on day {0} is told here at some length for all, and <b>why</b> it is no wonder to anyone who read of day {0} before, as most of the town seems to have done</p><ul><li>one</li><li>two</li></ul><div>Sign our petition</div></article></body>"
    rows = [(f"http://one.test/{i}", page.format(i)) for i in range(5)]
    rows += [(f"http://two.test/{i}", page.format(i).replace("Sign our petition", f"Petition {i}")) for i in range(5)]
    rows += [("http://three.test/0", page.format(0))]
    found = {r["url"]: r["text"].split("\n") for r in wrappers.extract(spark.createDataFrame(rows, "url string, html string").repartition(4)).collect()}
    long = lambda i: [f"What happened on day {i} is told here at some length for all, and why it is no wonder to anyone who read of day {i} before, as most of the town seems to have done", "one", "two"]
    for i in range(5):
        assert found[f"http://one.test/{i}"] == [f"Story {i}", "Summary", *long(i)]
        assert found[f"http://two.test/{i}"] == [f"Story {i}", "Summary", *long(i), f"Petition {i}"]
    assert found["http://three.test/0"] == ["Story 0", "Summary", "Told by our reporters", *long(0), "Sign our petition"]


def test_versions_of_one_article_keep_what_they_share(spark):
    page = "<body><article><h1>Story</h1><div>A first part that all versions of this story have in common</div><pre>Version {0} has this of its own, which is quite long</pre><table>And a last part that stays</table></article></body>"
    rows = [(f"http://one.test/{i}", page.format(i)) for i in range(8)]
    found = [r["text"].count("\n") for r in wrappers.extract(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert found == [3] * 8


def test_a_node_with_many_children_takes_linear_time():
    html = "<body>" + "".join(f"<p class=k{i % 50}>text {i}</p><i>x</i>" for i in range(20_000)) + "</body>"
    wrapper = wrappers.wrapper_of(wrappers.parse(html)[0])
    began = time.time()
    assert wrappers.main_text(html, wrappers.merged(wrapper, wrapper)).count("\n") > 10_000
    assert time.time() - began < 30


def test_odd_page_rows(spark):
    rows = [(1, None, "<p>a</p>", None, None), (2, "no url", None, None, None), (None, "http://h/1", "<p>b", None, None), (3, "http://h/1", "<p>b", None, None), (3, "http://h/1", "<p>b", None, None)]
    found = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")).collect()
    assert sorted(r["text"] for r in found) == ["", "a", "b", "b", "b"]
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_one_article_do_not_make_its_text_the_hosts_own(spark):
    words = lambda n, i: " ".join(f"{n}{i}x{k}" for k in range(12))
    page = lambda i, more, date="": f"<div><p>Own words of this host</p></div><div><h1>{words('h', i)}</h1>{date}<p>{words('p', i)}</p>{more}</div>"
    quoted = f"<blockquote>{words('q', 0)}</blockquote>"
    rows = [(f"http://a.test/{i}", page(min(i, 5), quoted if i >= 5 else "")) for i in range(8)]
    rows += [(f"http://b.test/{i}", page(9, "", f"<b>May {i}</b>")) for i in range(6)]
    found = {r["url"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "url string, html string").repartition(3)).collect()}
    for i in range(8):
        text = found[f"http://a.test/{i}"]
        assert words("h", min(i, 5)) in text and words("p", min(i, 5)) in text and "Own words" not in text
        assert (words("q", 0) in text) == (i >= 5)
    assert all(words("h", 9) in found[f"http://b.test/{i}"] and words("p", 9) in found[f"http://b.test/{i}"] for i in range(6))
