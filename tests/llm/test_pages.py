"""Pages: main text and archives, against brute force and exact round trips."""

import base64
import gzip
import hashlib
import json
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import blocks, html, labelled_pages, warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    long = "<article>" + "<p>Some text &amp; more of it.</p>" * 30_000 + "</article>"
    rows = [
        (3, "http://a", "<p>Same é</p>"), (1, "http://b\r\nX: y", "<p>Same é</p>"), (1, "http://b", "<p>Same é</p>"), (2, None, None), (5, "u", ""),
        (None, "http://n", "<p>Same é</p>"), (None, "u", "alone\r\n\r\nWARC/1.0\r\n"), (7, "u", long), (8, "u", "x"),
    ]
    extra = "kind seq value id digest bytes first payload text tag offset length part n_chars record_type".split()
    return spark.createDataFrame(rows, PAGES).select("*", *[F.lit(1).alias(c) for c in extra])


# archives


def test_archives_round_trip(spark, odd_pages, tmp_path):
    got = Counter(map(tuple, warc.archive_round_trip(odd_pages, str(tmp_path)).collect()))

    def row(page_id, text, kind, first=None):
        data = text.encode()
        return page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first

    rows = [r for r in odd_pages.collect()]
    want = Counter()
    for r in rows:
        text = r.html or ""
        ids = [x.page_id for x in rows if (x.html or "") == text and x.page_id is not None]
        first = min(ids, default=None)
        again = first is not None and r.page_id != first
        want[row(r.page_id, text, "revisit" if again else "response", first if again else None)] += 1
    assert got == want


def test_members_and_index(spark, odd_pages, tmp_path):
    warc.write_archives(odd_pages, f"{tmp_path}/s", records=3)
    streams = sorted(Path(tmp_path, "s").glob("*.gz"))
    whole = [r for f in streams for r in warc.record_bytes([gzip.decompress(f.read_bytes())])]
    warc.normalise_archives(spark, f"{tmp_path}/s", f"{tmp_path}/m")
    archives = {int(f.name.split("-")[1]): f.read_bytes() for f in Path(tmp_path, "m", "kind=warc").glob("part-*")}
    index = warc.read_index(spark, f"{tmp_path}/m").collect()
    found = []
    for e in index:
        member = archives[e.part][e.offset : e.offset + e.length]
        record = gzip.decompress(member)
        found.append(record)
        assert warc.fields(record[: record.find(b"\r\n\r\n")])["warc-record-id"] == e.id
    assert Counter(found) == Counter(whole)
    # The archives are the members and nothing else, and any gzip reader reads them whole.
    for part, data in archives.items():
        assert sum(e.length for e in index if e.part == part) == len(data)
        assert sorted(warc.record_bytes([gzip.decompress(data)])) == sorted(r for e, r in zip(index, found) if e.part == part)
    assert all(json.loads(line)["length"] for f in Path(tmp_path, "m", "kind=index").glob("part-*") for line in f.read_text().split("\0") if line)


def test_records_by_place(spark, odd_pages, tmp_path):
    warc.write_archives(odd_pages, f"{tmp_path}/s", records=3)
    warc.normalise_archives(spark, f"{tmp_path}/s", f"{tmp_path}/m")
    index = warc.read_index(spark, f"{tmp_path}/m")
    whole = Counter(r for f in Path(tmp_path, "m", "kind=warc").glob("part-*") for r in warc.record_bytes([gzip.decompress(f.read_bytes())]))
    rows = warc.read_records(spark, f"{tmp_path}/m", index.withColumn("path", F.lit(1))).collect()
    assert Counter(bytes(r.record) for r in rows) == whole
    for r in rows:
        head = warc.fields(bytes(r.record).partition(b"\r\n\r\n")[0])
        assert (head["warc-record-id"], head["warc-type"]) == (r.id, r.type)
    one = warc.read_records(spark, f"{tmp_path}/m", index.where("id = '<urn:page:7>'")).collect()
    assert len(one) == 1 and bytes(one[0].record).count(b"Some text &amp; more of it.") == 30_000
    assert warc.read_records(spark, f"{tmp_path}/m", index.withColumn("part", F.lit(10**6))).collect() == []
    assert warc.read_records(spark, f"{tmp_path}/m", index.withColumn("offset", F.lit(None).cast("bigint"))).collect() == []


def test_payloads_meet_by_a_second_hash(spark, monkeypatch):
    """Were two payloads of one digest and length, they would still be told apart."""
    monkeypatch.setattr(warc, "base32", lambda digest: F.lit("A" * 32))
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "bb"), (3, "u", "aa")], PAGES)
    kinds = {r.id: r.kind for r in warc.record_texts(df, "page_id", "url", "html", 0, "d").select(
        F.regexp_extract("value", r"Record-ID: <urn:page:(\d)", 1).alias("id"), F.regexp_extract("value", r"WARC-Type: (\w+)", 1).alias("kind")
    ).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit"}


def test_records_are_whole():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nab\r\n\r\nc\r\n\r\n"
    stream = record * 5
    for size in (1, 3, 64, 1000):
        assert list(warc.record_bytes(stream[i : i + size] for i in range(0, len(stream), size))) == [record] * 5
    with pytest.raises(ValueError):
        list(warc.record_bytes([stream[:-5]]))
    packed = gzip.compress(stream)
    assert b"".join(warc.inflated(packed)) == stream
    assert b"".join(warc.inflated(packed + b"\0\0" + packed)) == stream * 2
    with pytest.raises(ValueError):
        list(warc.inflated(packed[:-4]))


def test_member_of_a_long_record():
    for size in (0, 10, (1 << 24) + 5):
        member = warc.member(b"x" * size)
        assert member[-1] == 0 and gzip.decompress(member) == b"x" * size


def test_least_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {r.page_id: r.refers_to for r in warc.archive_round_trip(df, str(tmp_path), least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.archive_round_trip(none, str(tmp_path)).collect() == []
    assert html.extract_text(none).collect() == []


# main text


def test_held_out_blocks():
    model, right, total = html.default_model(), 0, 0
    for page in labelled_pages.labelled_pages(200, 12345):
        found = blocks.leaf_blocks(page)
        for block, on in zip(found, model.decode(found), strict=True):
            right, total = right + (on == (block.label == "1")), total + 1
    assert right > 0.99 * total


def test_viterbi_against_all_paths():
    model, rnd = html.default_model(), np.random.default_rng(1)
    for page in labelled_pages.labelled_pages(40, 6):
        found = blocks.leaf_blocks(page)[: rnd.integers(1, 9)]
        gains = [sum(model.weights.get(f, 0.0) for f in html.features(b, i)) for i, b in enumerate(found)]

        def score(path):
            return sum(g for g, s in zip(gains, path) if s) + sum(model.steps[a][b] for a, b in zip(path, path[1:]))

        paths = [[n >> i & 1 for i in range(len(found))] for n in range(1 << len(found))]
        assert abs(score([int(s) for s in model.decode(found)]) - max(map(score, paths))) < 1e-9
    assert model.decode([]) == []


@pytest.mark.parametrize("page,text", [
    ("", ""),
    ("just words", "just words"),
    ("<article><h1>A&nbsp;title &amp; more</h1><p>One\n  two<br>three <b>fo</b>ur.<p>Next &lt;b&gt; &#233;.</article><footer>&copy; Someone</footer>",
     "A title & more One two three four. Next <b> é."),
    ('<nav><a href="/">Home</a></nav><main><p>Text of the page, and some more of it.</p><!-- no <p>text</p> --><script>var a="<p>no</p>";</script></main>',
     "Text of the page, and some more of it."),
    ('<div class="cookie-notice">We use cookies.</div><article><p>Short.</p><div class="ad">Buy this now</div><p>End of it all.</p></article>'
     '<section class="comments"><div class="comment"><p>I have something to say about it, at some length.</p></div></section>',
     "Short. End of it all."),
    ('<header>Site</header><article><p title="a > b">Quoted.</p><ul><li>one<li>two</ul><form><label>Mail</label></form></article><aside>More to read</aside>',
     "Quoted. one two"),
])
def test_main_text(page, text):
    assert html.main_text(page, html.default_model()) == text


def test_text_inside_formulas_and_media_is_kept():
    """The contract leaves out no mathematics and no fallback text of an article."""
    from driftline.llm import blocks

    page = "<article><p>The formula <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p><object><p>Shown instead.</p></object></article>"
    assert [b.text for b in blocks.leaf_blocks(page)] == ["The formula a=b holds.", "Shown instead."]


def test_whole_blocks_are_looked_through():
    from driftline.llm import blocks, html

    block = blocks.leaf_blocks("<p>" + "x" * 600 + " privacy</p>")[0]
    assert "cue=True" in html.features(block, 0)
    block = blocks.leaf_blocks("<p>" + "x" * 300 + " " + "7" * 300 + "</p>")[0]
    assert "digits=True" in html.features(block, 0)


@pytest.mark.parametrize("page", ["<", "<p", "</p>", "<p><p", "<!--", "<script>x", "<a b='", "<p a=\"x>y", "&#xD800;&#0;&bogus;", "<" * 5000, "<div>" * 20_000 + "x", "</li>" * 5000])
def test_broken_pages(page):
    html.main_text(page, html.default_model())


def test_extract_odd(odd_pages):
    got = html.extract_text(odd_pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == odd_pages.count()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id in (2, 5)] == ["", ""]
    assert next(r.text for r in rows if r.page_id == 7) == " ".join(["Some text & more of it."] * 30_000)


def test_article_of_every_page(spark, folder):
    import html as unescape
    import re

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    texts = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert texts[r.page_id] == " ".join(unescape.unescape(re.sub(r"<[^>]+>", " ", article)).split())
