"""Text of pages: what is easily lost, what is easily slow, and an independent tokenizer over all pages."""

import gzip
import time
import zlib
from html.parser import HTMLParser

import pytest

from lectern.llm import warc

CASES = {
    "<html><head><title>x</title><body><p>all the text</p>": "all the text",
    "<head><meta charset=utf-8><title>x</title> text at once": "text at once",
    "<head><style>a{}</style><div>one</div><head>two": "one\ntwo",
    "<p title='1 > 0' href=x>shown</p>": "shown",
    '<a href="a>b">link</a> <a name=x>no link': "link no link",
    "<!-- a > b --> c <!-- never closed": "c",
    "<script>if (a < b) '</p>'</script >d": "d",
    "<script>never closed": "",
    "<textarea>1 < 2 <b></textarea>": "1 < 2 <b>",
    "<template><p>hidden</p></template><noscript>x</noscript>y": "y",
    "1 < 2 and 3 <4 &amp; <b>5</b>": "1 < 2 and 3 <4 & 5",
    "<body><title>late</title>z": "z",
    "a<br/>b<TD>c</TD><?php x > y": "a\nb\nc\ny",
    "</ >x</>y<!doctype html>z": "xyz",
    "text <a href='never closed>...": "text",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_text_of_a_page(page):
    assert warc.plain_text(page) == CASES[page]


def test_what_a_page_says_of_itself():
    page = warc.Page("<!-- <html lang=no> --><html data-x='<html lang=bad>' LANG=\"de-AT\"><title> a &amp;\n b</title><title>second</title><a\nhref=x><a data-href=y><A HREF='z'>")
    assert (" ".join(page.title.split()), page.language, page.links) == ("a &amp; b", "de-AT", 2)


@pytest.mark.parametrize("piece", ["<title>", "<html ", "<a ", "<a href=", "<a b='", "<!--", "<script>", "</", "<", "< ", "<head>", "<template>", "<p =", "&amp", "<title", "</title"])
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    warc.Page(piece * (1_000_000 // len(piece))).lines()
    assert time.process_time() - began < 8  # a second or so; quadratic scans took hours


class Independent(HTMLParser):
    """The library's tokenizer with states of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.head = [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "title"):
            self.skip += 1
        elif tag == "head":
            self.head = True
        elif self.head and tag not in ("meta", "link", "base"):
            self.head = False
        if tag in warc.BREAK:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in warc.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag == "head":
            self.head = False
        if tag in warc.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip and not (self.head and not data.strip()):
            self.out.append(data)


def test_all_pages_against_an_independent_tokenizer(spark):
    seen = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        other = Independent()
        other.feed(r.html or "")
        other.close()
        lines = (" ".join(x.replace("\xa0", " ").split()) for x in "".join(other.out).split("\n"))
        assert [" ".join(x.split()) for x in warc.plain_text(r.html or "").split("\n") if x] == [x for x in lines if x], r.page_id
        seen += 1
    assert seen > 100


def test_codings_of_bodies():
    text = b"<p>" + b"some text " * 1000
    head = lambda value: [("Content-Encoding", value)]
    assert warc.body(gzip.compress(text[:500]) + gzip.compress(text[500:]), head("gzip")) == text
    assert warc.body(gzip.compress(text), head("identity, gzip")) == text and warc.body(gzip.compress(zlib.compress(text)), head("deflate, gzip")) == text
    assert warc.body(gzip.compress(text), [("Content-Encoding", "identity"), ("Content-Encoding", "x-gzip")]) == text
    raw = zlib.compressobj(wbits=-15)
    assert warc.body(raw.compress(text) + raw.flush(), head("deflate")) == text
    assert warc.body(b"br data", head("br")) == b"br data" and warc.body(b"no gzip", head("gzip")) == b"no gzip"
    assert text.startswith(cut := warc.body(gzip.compress(text)[:-12], head("gzip"))) and cut
    bomb = gzip.compress(bytes(20 << 20))
    assert warc.body(bomb, head("gzip"), most=1 << 20) == bomb and len(warc.body(bomb, head("gzip"))) == 20 << 20
    assert warc.body(gzip.compress(text) + b"trailing rubbish", head("gzip")) == text
