"""HTML extraction and WARC archives: hand-made pages, the cut against all labelings, round trips."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetwatch.llm import html_mincut, warc
from fleetwatch.llm.html_mincut import main_text, minimum_cut

PAGES = "page_id long, url string, html string"
PARAGRAPH = "The long valley lies between two rivers, and few travellers ever cross it in winter."


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title></head><body></body></html>", ""),
        (f"<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{PARAGRAPH}</p></article></body>", f"A & B\n{PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}<p>{PARAGRAPH} <b>bold</article><footer>&copy; x</footer>", f"{PARAGRAPH}\n{PARAGRAPH} bold"),
        (f"<div class='sidebar'><p>{PARAGRAPH}</p></div><main><p>{PARAGRAPH}</p></main>", PARAGRAPH),
        (f"<main><p>{PARAGRAPH}</p><section id='comments'><p>{PARAGRAPH}</p></section></main>", PARAGRAPH),
        (f"<main><p>{PARAGRAPH}</p><form><label>{PARAGRAPH}</label></form></main>", PARAGRAPH),
        (f"<div class='cookie-notice'>{PARAGRAPH}</div><div id='content'><p>{PARAGRAPH}</p></div>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p><div class='advertBox'>{PARAGRAPH}</div></article>", PARAGRAPH),
        (f"<article><script>var t='</p>{PARAGRAPH}';</script><style>p{{}}</style><p>{PARAGRAPH}</p></article>", PARAGRAPH),
        (f"<article><!-- <p>{PARAGRAPH}</p> --><p>one\n\t two&nbsp;three<br>four. {PARAGRAPH}</p></article>", f"one two three four. {PARAGRAPH}"),
        (f"<article><header><h1>Title</h1></header><p>{PARAGRAPH}</p></article><header>Site name</header>", f"Title\n{PARAGRAPH}"),
        (f"<article><ul><li>First {PARAGRAPH}<li>Second {PARAGRAPH}</ul></article>", f"First {PARAGRAPH}\nSecond {PARAGRAPH}"),
        (f"<article hidden><p>{PARAGRAPH}</p></article><p style='display: none'>{PARAGRAPH}</p>", ""),
        (f"<div class='content has-sidebar'><p>{PARAGRAPH}</p></div><div class='comment-body'>{PARAGRAPH}</div>", PARAGRAPH),
        (f"<article><p>a &lt;b&gt; &#233;&#x1F600; {PARAGRAPH}</p></article>", f"a <b> é😀 {PARAGRAPH}"),
    ],
)
def test_main_text(page, expected):
    assert main_text(page)[0] == expected


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT>if(a<b&&c<d){f()}</Script >",
        "<script>var open='<!--';</script>",
        "<script><!--\ndocument.write(\"<script src='x'></script>\");\n//--></script>",
        "<script>var s='<!-- <script>';</script>",
        "<style>a::before{content:'<b'}</style\n>",
        "<style>/* <!-- */</style>",
        "<textarea>i<n <!-- </textarea>",
        "<script>var t='</scripts>i<n';</script/>",
    ],
)
def test_raw_elements_end_at_their_own_end_tag(raw):
    assert main_text(f"<body>{raw}<article><p>{PARAGRAPH}</p></article></body>")[0] == PARAGRAPH
    assert main_text(f"<article><p>{PARAGRAPH}</p>{raw}<p>{PARAGRAPH}</p></article>")[0] == f"{PARAGRAPH}\n{PARAGRAPH}"
    assert main_text(f"<article><p>{PARAGRAPH}</p>{raw}{raw}</article><p>x</p><script>i<n")[0] == PARAGRAPH


CARD = "<article><h2>Other</h2><p>A short teaser of another page.</p></article>"


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<div class='container sidebar-right'><article><p>{PARAGRAPH}</p></article></div>", PARAGRAPH),
        (f"<div id='page' class='site footer-dark'><div class='content'><p>{PARAGRAPH}</p></div></div>", PARAGRAPH),
        (f"<div class='page sidebar-left'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<div class='nav-fixed'><div class='tools'><h1>A title</h1><p>{PARAGRAPH}</p></div></div>", f"A title\n{PARAGRAPH}"),
        (f"<main><div class='ad-free'><article><p>{PARAGRAPH}</p></article></div></main>", PARAGRAPH),
        (f"<article><p><strong class='alert'>Note:</strong> {PARAGRAPH}</p></article>", f"Note: {PARAGRAPH}"),
        (f"<article><p><a class='tag' href='x'>Rivers</a> {PARAGRAPH}</p></article>", f"Rivers {PARAGRAPH}"),
        (f"<article><p><span aria-hidden='true'>*</span>{PARAGRAPH}<i hidden>x</i></p></article>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p></article><p><span style='display:none'>{PARAGRAPH}</span></p>", PARAGRAPH),
        (f"<div class='site footer-dark'><article><p>{PARAGRAPH}</p></article><div class='sidebar'>{PARAGRAPH}</div></div>", PARAGRAPH),
        (f"<main><p>{PARAGRAPH}</p><div id='comments'>{f'<p>{PARAGRAPH}</p>' * 9}</div></main>", PARAGRAPH),
        (f"<div class='site footer-dark'><div class='content'><p>{PARAGRAPH}</p></div><div class='comments'>{f'<p>{PARAGRAPH}</p>' * 9}</div></div>", PARAGRAPH),
        (f"<main><article><h1>A title</h1><p>{PARAGRAPH}</p></article><div id='comments'>{f'<article><p>{PARAGRAPH}</p></article>' * 9}</div></main>", f"A title\n{PARAGRAPH}"),
        (f"<div class='content'><p>{PARAGRAPH * 4}</p></div><div class='related'>{CARD * 3}</div>", PARAGRAPH * 4),
        (f"<div class='banner'><h1>Site</h1></div><main><p>{PARAGRAPH}</p></main>", PARAGRAPH),
    ],
)
def test_names_are_weighed(page, expected):
    assert main_text(page)[0] == expected


def test_a_name_is_a_finite_cost():
    blocks = html_mincut.blocks_of(f"<main><p>{PARAGRAPH}</p></main><div class='notice'><p>{PARAGRAPH * 400}</p></div>")
    assert html_mincut.evidence(blocks[1]) > -html_mincut.SURE / 10
    assert [b.named for b in blocks] == [False, True]


def test_long_pages_and_broken_markup():
    many = "".join(f"<p>{PARAGRAPH} {i}" for i in range(5000))
    assert main_text(f"<article>{many}")[0].count("\n") == 4999
    assert main_text("<" * 5000)[0] in ("", "<" * 5000)
    assert main_text("<div>" * 3000 + PARAGRAPH)[1] == 1


def test_cut_is_the_cheapest_labeling():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 9)
        weights = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(labels):
            kept = sum(-w if c and w < 0 else w if not c and w > 0 else 0 for w, c in zip(weights, labels))
            return kept + sum(c for i, j, c in edges if labels[i] != labels[j])

        best = min(cost(labels) for labels in itertools.product([False, True], repeat=n))
        assert cost(minimum_cut(weights, edges)) == pytest.approx(best, abs=1e-6)


def test_extract_over_a_table(spark):
    rows = [(1, "u", f"<article><p>{PARAGRAPH}</p></article>"), (1, "u", f"<article><p>{PARAGRAPH}</p></article>"), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = html_mincut.extract(pages).select("page_id", "text", "n_chars").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [(1, PARAGRAPH, len(PARAGRAPH))] * 2 + [(2, "", 0), (None, "", 0)])
    )
    assert html_mincut.extract(pages.limit(0)).count() == 0


def _expected_records(rows):
    first = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page_id is not None:
            first[raw] = min(page_id, first.get(raw, page_id))
    out, led = [], set()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and raw in first and (page_id != first[raw] or raw in led)
        if len(raw) >= 100 and page_id == first.get(raw):
            led.add(raw)
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(map(str, out))


def test_archives_round_trip(spark, tmp_path):
    big, other = "é" * 60, "x" * 100
    rows = [(9, "http://a b/\r\nc", big), (3, "u", big), (3, "u", big), (4, "u", other), (5, "u", "x" * 99), (6, "u", "x" * 99)]
    rows += [(7, None, None), (8, "u", ""), (10, "ü", "\r\n\r\nWARC/1.1\r\n" * 20_000), (None, "u", other), (11, "u", other)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("place", F.lit(1)).repartition(4)
    got = warc.archive_pages(spark, pages, str(tmp_path))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(str(tuple(r)) for r in got.select(names).collect()) == _expected_records(rows)
    for archive in (tmp_path / "members").glob("*.warc.gz"):
        members = [json.loads(line) for line in open(f"{archive}.index")]
        raw = archive.read_bytes()
        assert sum(m["length"] for m in members) == len(raw)
        for m in members:  # each member is a gzip file of its own and holds one record
            record = gzip.decompress(raw[m["offset"] : m["offset"] + m["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    whole = sum(len(gzip.decompress(a.read_bytes())) for a in (tmp_path / "whole").glob("*.warc.gz"))
    assert whole == sum(len(gzip.decompress(a.read_bytes())) for a in (tmp_path / "members").glob("*.warc.gz"))


def test_empty_archives(spark, tmp_path):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES), str(tmp_path)).count() == 0


def test_inflate_takes_one_or_many_members():
    data = [b"a" * 3_000_000, b"", b"b" * 10]
    raw = b"".join(map(gzip.compress, data))
    pieces = [raw[i : i + 7] for i in range(0, len(raw), 7)]
    assert b"".join(warc.inflate(iter(pieces))) == b"".join(data)


def test_broken_stream_is_refused():
    record = warc.record_bytes(1, "u", b"payload", 7, "0" * 64, "response", None)
    assert list(warc.records_of(iter([record[:10], record[10:] + record]))) == [record, record]
    with pytest.raises(ValueError, match="after the last whole record"):
        list(warc.records_of(iter([record, b"WARC/1.1"])))


_PROSE = "Hello world, it is me, and this is a whole sentence of an article that says something. "


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<p title=it's>{_PROSE}</p>", _PROSE.strip()),
        (f"<p title=it's>{_PROSE}It's here.</p>", f"{_PROSE}It's here."),
        (f"<p title='it is' data-x=a'b>{_PROSE}</p>", _PROSE.strip()),
        (f'<p title="never closed>{_PROSE}</p>', _PROSE.strip()),
        (f"<p a = 'x>y' b=\"1>2\">{_PROSE}</p>", _PROSE.strip()),
        (f"<script src=/js/>var a=1; if (a<b) f()</script><p>{_PROSE}</p>", _PROSE.strip()),
        (f"<script src='/js/x.js' />var a=1;</script><p>{_PROSE}</p>", _PROSE.strip()),
        (f"<svg viewBox='0 0 1 1' /><p>{_PROSE}</p>", _PROSE.strip()),
        (f"<p>{_PROSE}</p><a <a <a", _PROSE.strip()),
        (f"<p>{_PROSE}3 < 4 and 5 > 2.</p>", f"{_PROSE}3 < 4 and 5 > 2."),
        (f"<!--><p>{_PROSE}</p><!-- open <p>no</p>", _PROSE.strip()),
    ],
)
def test_markup_by_the_rules_of_html(page, expected):
    assert main_text(page)[0] == expected


@pytest.mark.parametrize("piece", ["<a ", "<a b='", '<a b="', "<!", "<p title=it's ", "</", "<a b = "])
def test_a_megabyte_of_broken_tags_takes_a_moment(piece):
    import time

    page = f"<p>{_PROSE}</p>" + piece * (1_000_000 // len(piece))
    begin = time.perf_counter()
    text = main_text(page)[0]
    assert time.perf_counter() - begin < 10 and text.startswith(_PROSE.strip())


def test_a_page_of_many_mixed_blocks():
    import time

    rng = random.Random(2)
    kinds = [f"<p>{PARAGRAPH}</p>", "<p>Short.</p>", "<li><a href=x>A link</a></li>", "<div class='ad'>Buy now</div>", f"<div>{PARAGRAPH}</div>"]
    page = "<body>" + "".join(rng.choices(kinds, k=40_000)) + "</body>"
    begin = time.perf_counter()
    text, blocks, kept = main_text(page)
    assert time.perf_counter() - begin < 20 and blocks == 40_000 and 0 < kept < blocks
    assert PARAGRAPH in text and "Buy now" not in text
