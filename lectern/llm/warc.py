"""WARC derivatives: a metadata record and a plain-text conversion record for each response.

Both derived records name the response in WARC-Refers-To, keep its target, date and payload digest, and carry a digest
of their own block. The metadata block holds the response's identifiers, digests, status line, all its HTTP headers in
their order - repeated ones as often as they occur - and its other WARC headers, and what the page says of itself
(title, language, number of links), as application/warc-fields. The conversion block is the page's text, by one forward
pass over it, after chunked transfer and all gzip and deflate codings are undone. Identifiers are name-based UUIDs, so that reruns agree.

read_warc() and serialised() are the source and the wire form: records survive the round trip byte by byte, headers
that no column holds as lines in `extra`. A file is unzipped as its records are read; what a worker holds are the
file's stored bytes (up to 2 GB, Spark's limit for a binary value) and a batch of records.

Defined results: a null url leaves out the target; a null or empty page gives an empty payload and an empty text.
A block without an end of HTTP headers is all payload; a body that doesn't decode is taken as it is. A record whose
Content-Length is no number has an empty block, and reading goes on at the next record. A body that would unfold to over
256 MB is taken as it is. What an unclosed comment, script, title or quote begins goes on to the end of the page; an unclosed head ends where the body begins. Repeated rows give records of
equal identifiers. An empty table gives an empty result; further columns are carried unless a record has one of that name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"

# Elements by what becomes of their text - never shown whatever they hold, read to their end tag without markup, allowed inside head - and elements that break a line.
HIDDEN = frozenset(("script", "style", "noscript", "template", "title"))
RAW = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"))
HEAD = frozenset(("base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"))
BREAK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
NAME, GAP, ATTRIBUTE, VALUE = re.compile(r"[A-Za-z][^\s/>]*"), re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*")
EQUALS = re.compile(r"\s*=\s*")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Bytes that a body may unfold to - one that would be larger is taken as it is - and that are unfolded at a time; zlib's number for gzip or zlib data.
MOST_UNFOLDED, UNFOLD_STEP, GZIP = 256 << 20, 1 << 20, 47
CHARSET = re.compile(rb"charset=[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


class Page:
    """What a page shows and says of itself, by one pass over it: text, title, language, links.

    The scan goes forward only: a tag ends at the first `>` outside of quotes, a comment at `-->`, raw text at its end tag;
    what has no end goes on to the end of the page. A head without end tag ends where the body begins: at an element that a head can't hold, or at text.
    """

    def __init__(self, page: str) -> None:
        self.page, self.shown, self.links = page, [], 0
        self.title: str | None = None
        self.language = ""
        self.hidden: list[str] = []  # open elements whose text isn't shown
        self.head = False
        at = 0
        while at < len(page):
            at = self.step(at)

    def step(self, at: int) -> int:
        """The text or the piece of markup at a place; where the next one begins."""
        page = self.page
        tag = page.find("<", at)
        if tag < 0:
            self.text(page[at:])
            return len(page)
        if tag > at:
            self.text(page[at:tag])
            return tag
        if page.startswith("<!--", at):
            return self.behind("-->", at + 4 if page[at + 4 : at + 5] != ">" else at + 2)
        if page[at + 1 : at + 2] in ("!", "?") or page.startswith("</", at) and not NAME.match(page, at + 2):
            if page[at + 1 : at + 2] == "/" and page[at + 2 : at + 3] != ">" and at + 2 >= len(page):
                self.text("</")
                return len(page)
            return self.behind(">", at + 1)
        if page.startswith("</", at):
            name = NAME.match(page, at + 2)
            end, _ = self.attributes(name.end())
            if end <= len(page):
                self.end(name[0].lower())
            return end
        if not (name := NAME.match(page, at + 1)):
            self.text("<")
            return at + 1
        end, found = self.attributes(name.end())
        return self.begin(name[0].lower(), found, end) if end <= len(page) else end

    def behind(self, mark: str, at: int) -> int:
        found = self.page.find(mark, at)
        return len(self.page) if found < 0 else found + len(mark)

    def attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """Where a tag ends (beyond the page if it doesn't), and its attributes, of each name the first."""
        page, found = self.page, {}
        while True:
            at = GAP.match(page, at).end()
            if at >= len(page):
                return len(page) + 1, found
            if page[at] == ">":
                return at + 1, found
            name, value = ATTRIBUTE.match(page, at), ""
            at = name.end()
            if gap := EQUALS.match(page, at):
                at = gap.end()
                if page[at : at + 1] in ("'", '"'):
                    close = page.find(page[at], at + 1)
                    if close < 0:
                        return len(page) + 1, found
                    value, at = page[at + 1 : close], close + 1
                else:
                    bare = VALUE.match(page, at)
                    value, at = bare[0], bare.end()
            found.setdefault(name[0].lower(), html.unescape(value))

    def begin(self, name: str, found: dict[str, str], at: int) -> int:
        if name == "html":
            self.language = self.language or found.get("lang", "").strip()
        elif name == "head":
            self.head = True
            return at
        elif self.head and not self.hidden and name not in HEAD:
            self.head = False
        if name == "a" and "href" in found and not self.hidden:
            self.links += 1
        if name in BREAK:
            self.shown.append("\n")
        if name in RAW:
            close = RAW_END[name].search(self.page, at)
            inside = self.page[at : close.start() if close else len(self.page)]
            if name == "title" and self.title is None and not self.hidden:
                self.title = inside
            elif name == "textarea" and not self.hidden:
                self.text(inside)
            return close.start() if close else len(self.page)
        if name in HIDDEN:
            self.hidden.append(name)
        return at

    def end(self, name: str) -> None:
        if name == "head":
            self.head = False
        elif name in BREAK:
            self.shown.append("\n")
        if self.hidden and self.hidden[-1] == name:
            self.hidden.pop()

    def text(self, text: str) -> None:
        if self.hidden:
            return
        if self.head:
            if not text.strip():
                return
            self.head = False
        self.shown.append(html.unescape(text))

    def lines(self) -> str:
        """The shown text, one line for each block, without blank lines."""
        lines = (BLANKS.sub(" ", x).strip() for x in "".join(self.shown).split("\n"))
        return "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    """The shown text of a page."""
    return Page(page).lines()


def header_pairs(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values of header lines in order; a line that begins with a blank goes on with the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}".strip())
        elif line.strip():
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return found


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, _, headers = head.decode("latin-1").partition(END)
    return status, header_pairs(headers.split(END)), payload


def unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; as it is where the chunks don't parse."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return data
        if (n := int(size, 16)) == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else data


def unfolded(data: bytes, bits: int, most: int) -> bytes | None:
    """zlib or gzip data - of a gzip file all members - unfolded; None if it isn't such data or unfolds to over `most` bytes. What a cut off end leaves counts."""
    out, size = [], 0
    while data:
        coder = zlib.decompressobj(bits)
        while not coder.eof:
            try:
                piece = coder.decompress(data, UNFOLD_STEP)
            except zlib.error:
                return None if not out else b"".join(out)
            data, size = coder.unconsumed_tail, size + len(piece)
            if size > most:
                return None
            out.append(piece)
            if not data and not piece:
                break
        data = coder.unused_data if bits == GZIP else b""
    return b"".join(out)


def body(payload: bytes, headers: list[tuple[str, str]], most: int = MOST_UNFOLDED) -> bytes:
    """The page's bytes: transfer and content codings undone, the last one first, as far as they are known and hold."""
    codings = lambda name: [c.strip() for k, v in headers if k.lower() == name for c in v.lower().split(",") if c.strip()]
    if "chunked" in codings("transfer-encoding"):
        payload = unchunked(payload)
    for coding in reversed(codings("content-encoding")):
        if coding == "identity":
            continue
        ways = {"gzip": (GZIP,), "x-gzip": (GZIP,), "deflate": (GZIP, -15)}.get(coding, ())
        found = next((x for bits in ways if (x := unfolded(payload, bits, most)) is not None), None)
        if found is None:
            break
        payload = found
    return payload


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = ";".join(v for k, v in headers if k.lower() == "content-type")
    found = CHARSET.search(kind.encode("latin-1", "replace")) or CHARSET.search(payload[:2048])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives(source: dict) -> Iterator[dict]:
    """The metadata and the conversion record of one response (see RECORD for the fields)."""
    status, headers, payload = http_parts(source["block"])
    page = decoded(body(payload, headers), headers)
    seen = Page(page)
    block_digest, payload_digest = source.get("block_digest") or digest(source["block"]), source.get("payload_digest") or digest(payload)
    fields = [
        ("source-record-id", source["record_id"]), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("http-status", status),
        *((f"http-header-{k.lower()}", v) for k, v in headers), *((f"source-header-{k.lower()}", v) for k, v in header_pairs((source.get("extra") or "").split(END))),
        ("title", " ".join(html.unescape(seen.title or "").split())), ("language", seen.language), ("links", str(seen.links)),
    ]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}{END}" for k, v in fields).encode()), "conversion": ("text/plain; charset=utf-8", seen.lines().encode())}
    for kind, (content_type, block) in blocks.items():
        yield {
            "record_type": kind, "record_id": record_id(f"{source['record_id']}|{kind}"), "refers_to": source["record_id"], "target_uri": source["target_uri"], "date": source["date"],
            "content_type": content_type, "block_digest": digest(block), "payload_digest": payload_digest, "extra": None, "block": block,
        }


#: Field of a record: its header, for those that have one of their own. extra holds the lines of all other headers.
RECORD = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "extra": None, "block": None}
SCHEMA = ", ".join(f"{k} {'binary' if k == 'block' else 'string'}" for k in RECORD)
ARROW = pa.schema([(k, pa.binary() if k == "block" else pa.string()) for k in RECORD])
#: Bytes of records that a task hands on at a time.
BATCH_BYTES = 16 << 20


def serialised(record: dict) -> bytes:
    head = "".join(f"{name}: {record[k]}{END}" for k, name in RECORD.items() if name and record.get(k) is not None)
    extra = f"{record['extra']}{END}" if record.get("extra") else ""
    return f"WARC/1.1{END}{head}{extra}Content-Length: {len(record['block'])}{END}{END}".encode() + record["block"] + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped (as a whole or record by record), one after the other. Header names in any case."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    names = {v.lower(): k for k, v in RECORD.items() if v}
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines: list[str] = []
        while (line := stream.readline()).strip():
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        fields: dict = dict.fromkeys(RECORD)
        length, extra = 0, []
        for name, value in header_pairs(lines):
            if name.lower() == "content-length":
                length = int(value) if re.fullmatch("[0-9]{1,18}", value) else 0
            elif (key := names.get(name.lower())) and fields[key] is None:
                fields[key] = value
            else:
                extra.append(f"{name}: {value}")
        yield fields | {"extra": END.join(extra) or None, "block": stream.read(length)}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files (.warc or .warc.gz) at path, one file a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in parsed(content.as_py()):
                    held.append(record)
                    size += len(record["block"])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, ARROW)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def derive(responses: DataFrame) -> DataFrame:
    """Both derived records of every response record; responses: the columns of read_warc(), others are carried."""
    carried = [c for c in responses.columns if c not in RECORD]
    kind = responses.select(*carried).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for k, source in enumerate(batch.to_pylist()):
                for record in derivatives(source):
                    rows.append(k)
                    made.append(record)
            out = pa.RecordBatch.from_pylist(made, ARROW)
            kept = batch.select(carried).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *out.columns], [*carried, *RECORD])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kind] + [SCHEMA])
    return responses.filter(F.col("record_type") == "response").select(*carried, *RECORD).mapInArrow(run, fields)


def _record_id(name: Column) -> Column:
    """record_id() of a column."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of fetched pages (page_id, url, html); page_id is carried. derive() adds missing digests."""
    page = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(page).cast("string"), F.lit(END + END))
    name = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    made = {
        "record_type": F.lit("response"), "record_id": _record_id(name), "target_uri": F.col("url"), "date": F.lit(date), "content_type": F.lit("application/http; msgtype=response"),
        "block": F.concat(head.cast("binary"), page),
    }
    return pages.select("page_id", *[made.get(k, F.lit(None).cast("string")).alias(k) for k in RECORD])


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")))
    return made.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block", F.decode("block", "UTF-8"))
