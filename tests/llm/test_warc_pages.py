"""Pages of every kind: hostile, compressed, in odd character sets; text and links against the standard parser."""

import gzip
import random
import time
import zlib
from html.parser import HTMLParser

import pytest

from ashlar.llm import warc


def made(content, target="http://a/", record_id="<urn:uuid:1>"):
    notes, text = warc.derive(record_id, target, "2024-01-01T00:00:00Z", content)
    return notes[-1].decode(), text[-1].decode()


def message(body, **headers):
    lines = "".join(f"{n.replace('_', '-')}: {v}\r\n" for n, v in headers.items())
    return f"HTTP/1.1 200 OK\r\n{lines}\r\n".encode() + body


@pytest.mark.parametrize("charset", ["idna", "undefined", "unicode_escape", "raw_unicode_escape", "utf-7", "rot13", "zlib", "punycode", "mbcs", "no-such"])
def test_codecs_that_are_no_character_sets_are_read_as_utf8(charset):
    body = "<p>été \\ud800 +2AA- </p>".encode()
    notes, text = made(message(body, Content_Type=f"text/html; charset={charset}"))
    assert "charset-detected: utf-8" in notes and text == "été \\ud800 +2AA-"


def test_every_listed_character_set_reads_any_bytes():
    everything = b"<p>" + bytes(range(256)) * 3 + b"</p>"
    for charset in sorted(warc.CHARSETS):
        notes, text = made(message(everything, Content_Type=f"text/html; charset={charset}"))
        assert f"charset-detected: {charset}" in notes and text


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<title ", "<br ", "<!--", "<script>", "<script ", "<a href=\"", "<a href='x", "<a href=", "</", "<", "<p x='",
                                   "<head>", "<template>", "&#", "&#9999999999", "&", "=\"", "<a " + "x" * 50, "<img/src=x>", " "])
def test_pages_of_one_piece_take_linear_time(piece):
    times = []
    for size in (1 << 19, 4 << 19):
        start = time.process_time()
        made((piece * (size // len(piece))).encode())
        times.append(time.process_time() - start)
    assert times[1] < 7 * times[0] + 1


def test_five_megabytes_of_open_tags_under_two_seconds():
    start = time.process_time()
    made(b"<a " * (5 * (1 << 20) // 3))
    assert time.process_time() - start < 2


def test_numbers_of_many_digits_are_no_characters():
    assert made(b"<p>a&#" + b"9" * 6000 + b";b&#" + b"0" * 6000 + b"65;c&#xD800;</p>")[1] == "a�bAc�"


def test_chunked_and_compressed_bodies():
    page = "<title>T</title><p>one two</p><a href='/l'>three</a>".encode()
    want = made(message(page))
    chunks = b"".join(b"%x;x=1\r\n%s\r\n" % (len(page[i : i + 7]), page[i : i + 7]) for i in range(0, len(page), 7)) + b"0\r\n\r\n"
    assert made(message(chunks, Transfer_Encoding="chunked")) == want
    assert made(message(gzip.compress(page), Content_Encoding="gzip")) == want
    assert made(message(zlib.compress(page), Content_Encoding="deflate")) == want
    assert made(message(zlib.compress(page)[2:-4], Content_Encoding="deflate")) == want
    both = gzip.compress(page)
    assert made(message(b"%x\r\n%s\r\n0\r\n\r\n" % (len(both), both), Transfer_Encoding="chunked", Content_Encoding="gzip")) == want
    assert made(message(page, Transfer_Encoding="chunked")) == want  # not chunked after all
    assert made(message(page, Content_Encoding="gzip"))[1] == ""
    assert made(message(gzip.compress(b"<p>" + b"word " * 9999)[:-9], Content_Encoding="gzip"))[1].startswith("word word")


def test_bodies_that_unpack_without_end_have_no_text(monkeypatch):
    monkeypatch.setattr(warc, "MOST_BODY", 1 << 16)
    assert made(message(gzip.compress(b"a" * (1 << 20)), Content_Encoding="gzip"))[1] == ""


def test_values_with_line_ends_forge_no_header():
    content = message(b"<p>x</p>")
    rows = warc.derive(None, "http://a/\r\nWARC-Type: request\r\n\r\nx", "2024\n", content)
    named = [f.split()[0] for f in warc.RECORDS.replace("array<struct<name:string,value:string>>", "x").split(",")]
    for row in rows:
        record = dict(zip(named, row, strict=True)) | {"source_headers": [{"name": "A\r\nWARC-Type", "value": "b\r\nc"}]}
        (headers, body), = warc.parse(warc.serialise(record))
        assert [v for n, v in headers if n == "WARC-Type"] == [record["record_type"]] and body == record["content"]
        assert dict(headers)["WARC-Target-URI"] == "http://a/%0D%0AWARC-Type: request%0D%0A%0D%0Ax"


class Reader(HTMLParser):
    """The same rules on the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.silent, self.raw = [], [], None, False

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.silent == "head":
            self.silent = None
        if self.silent is None and tag in warc.BREAKS:
            self.out.append("\n")
        if tag in warc.LINKED:
            found = next(((n, v) for n, v in attrs if n in warc.ADDRESSES and v is not None), None)
            if found and found[1].split():
                self.links.append((f"{tag}/{found[0]}", " ".join(found[1].split())))
        if tag in warc.SILENT:
            self.silent = self.silent or tag
        self.raw = tag in warc.RAW

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.raw = False
        if tag == self.silent:
            self.silent = None
        if self.silent is None and tag in warc.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.silent is None and not self.raw:
            self.out.append(data)


PARTS = ["one", " two ", "&amp;", "&lt;b&gt;", "&#233;", "é", "\n", "3 < 4", "a<3", "<p>", "</p>", "<br>", "<br/>", "<b>", "</b>", "<div class='x'>", "</div>",
         "<a href='/one'>", "<a class=\"q>r\" href=\"/two&amp;x\">", "</a>", "<img src=pic.png alt='a > b'>", "<img alt=x>", "<script>if (a<b) '<p>'</script>",
         "<style>p > a {}</style>", "<noscript>no <a href='/n'>", "</noscript>", "<!-- <a href='/c'> -->", "<head><link href='/css'>", "</head>", "<body>",
         "<form action='/go'>", "<script src='/s.js'></script>", "<TD>", "<A HREF='/up'>"]


@pytest.mark.parametrize("seed", range(40))
def test_text_and_links_equal_the_standard_parser(seed):
    rnd = random.Random(seed)
    page = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 120)))
    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.out).split("\n"))
    walked = warc.Page(page)
    assert walked.text() == "\n".join(line for line in lines if line) and walked.links == reader.links


def test_a_head_that_is_never_closed_ends_at_the_body():
    notes, text = made(b"<html><head><title>A &amp; B</title><link href='/c'><body><p>seen</p>")
    assert text == "seen" and "title: A & B" in notes and "outlink: /c link/href" in notes
