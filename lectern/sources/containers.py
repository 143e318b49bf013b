"""Files of every accepted kind to text segments: dispatch by type, zipped XML read as a stream under limits, refusals with their reason.

A file is read in the task that has it. A zipped document is walked entry by entry: their number and what they unfold to are
bounded before any of them is parsed, and XML goes through a parser that refuses document types, so no entity is ever resolved.
What can't be read becomes a row with a reason and the place where it failed, beside the segments and never instead of other files.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.chunking import markdown_sections

# The limits of an archive, the media type that an HWPX file states, and the share of replacement characters that is too much.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_ARCHIVE_BYTES = 512, 32 << 20, 100 << 20
HWPX_TYPE = "application/hwp+zip"
GARBLED = 0.05
STEP = 1 << 16


class Refused(ValueError):
    """A file that is not read: reason, and where in it."""

    def __init__(self, reason: str, place: str = "") -> None:
        super().__init__(f"{reason} {place}".strip())
        self.reason, self.place = reason, place


@dataclass
class Segment:
    text: str
    title: str | None = None
    metadata: str | None = None


@dataclass
class Limits:
    entries: int = MAX_ENTRIES
    entry_bytes: int = MAX_ENTRY_BYTES
    archive_bytes: int = MAX_ARCHIVE_BYTES


class Archive:
    """A zip file whose entries were all unfolded once, piece by piece, to see that they keep the limits."""

    def __init__(self, content: bytes, limits: Limits) -> None:
        self.limits = limits
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as bad:
            raise Refused("NOT_A_ZIP") from bad
        self.names = [i for i in self.zip.infolist() if not i.is_dir()]
        if len(self.names) > limits.entries:
            raise Refused("TOO_MANY_ENTRIES", str(len(self.names)))
        total = 0
        for entry in self.names:
            for piece in self.pieces(entry):
                total += len(piece)
                if total > limits.archive_bytes:
                    raise Refused("ARCHIVE_TOO_LARGE", entry.filename)

    def pieces(self, entry: zipfile.ZipInfo | str) -> Iterator[bytes]:
        name, size = getattr(entry, "filename", entry), 0
        try:
            with self.zip.open(entry) as file:
                while piece := file.read(STEP):
                    if (size := size + len(piece)) > self.limits.entry_bytes:
                        raise Refused("ENTRY_TOO_LARGE", name)
                    yield piece
        except KeyError as missing:
            raise Refused("ENTRY_MISSING", name) from missing
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError) as bad:
            raise Refused("ENTRY_UNREADABLE", name) from bad

    def parse(self, name: str, begin, end=None, text=None) -> None:  # noqa: ANN001
        """Runs an entry's XML through handlers of begin(tag, attributes), end(tag) and text(characters); names come without their namespaces."""
        parser = expat.ParserCreate(namespace_separator=" ")
        local = lambda full: full.rpartition(" ")[2]

        def no_doctype(*_: object) -> None:
            raise Refused("DOCUMENT_TYPE_DECLARED", name)

        parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = no_doctype
        parser.StartElementHandler = lambda tag, found: begin(local(tag), {local(k): v for k, v in found.items()})
        if end:
            parser.EndElementHandler = lambda tag: end(local(tag))
        if text:
            parser.CharacterDataHandler, parser.buffer_text = text, True
        try:
            for piece in self.pieces(name):
                parser.Parse(piece)
            parser.Parse(b"", True)
        except expat.ExpatError as bad:
            raise Refused("XML_MALFORMED", f"{name} line {bad.lineno}") from bad


def clean(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


@dataclass
class Trail:
    """The headings above a place, outermost first."""

    held: list[tuple[int, str]] = field(default_factory=list)

    def enter(self, level: int, heading: str) -> None:
        while self.held and self.held[-1][0] >= level:
            self.held.pop()
        self.held.append((level, heading))

    def metadata(self) -> str:
        return json.dumps({"headingPath": [h for _, h in self.held], "headingLevel": self.held[-1][0] if self.held else 0}, ensure_ascii=False)


class WordBody:
    """Handlers for the main part of a DOCX file: paragraphs and tables of the body in their order, cut into sections at headings."""

    MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}

    def __init__(self) -> None:
        self.path: list[str] = []
        self.text: list[str] = []
        self.style: str | None = None
        self.rows: list[str] = []
        self.cells: list[str] = []
        self.tables = 0
        self.parts: list[str] = []
        self.title: str | None = None
        self.trail, self.segments = Trail(), []

    def begin(self, tag: str, found: dict[str, str]) -> None:
        parent = self.path[-1] if self.path else ""
        self.path.append(tag)
        if tag == "tbl":
            self.tables += 1
            if self.tables == 1:
                self.rows = []
        elif tag == "tr" and self.tables == 1:
            self.cells = []
        elif tag == "tc" and self.tables == 1:
            self.text = []
        elif tag == "p" and not self.tables and parent == "body":
            self.text, self.style = [], None
        elif tag == "pStyle" and not self.tables:
            self.style = found.get("val")
        elif tag in self.MARKS and parent == "r":
            self.text.append(self.MARKS[tag])

    def characters(self, text: str) -> None:
        if self.path and self.path[-1] == "t":
            self.text.append(text)

    def end(self, tag: str) -> None:
        self.path.pop()
        if tag == "p" and self.tables:
            self.text.append("\n")
        elif tag == "p" and self.path and self.path[-1] == "body":
            self.paragraph(clean("".join(self.text)))
        elif tag == "tc" and self.tables == 1:
            self.cells.append(clean("".join(self.text)))
        elif tag == "tr" and self.tables == 1:
            if any(self.cells):
                self.rows.append("\t".join(self.cells))
        elif tag == "tbl":
            self.tables -= 1
            if not self.tables and self.rows:
                self.parts.append("\n".join(self.rows))

    def paragraph(self, text: str) -> None:
        if not text:
            return
        style = (self.style or "").lower()
        if style == "title" or style.startswith("heading"):
            self.close()
            level = re.search(r"\d+", style)
            self.trail.enter(0 if style == "title" else int(level[0]) if level else 1, text)
            self.title = text
        self.parts.append(text)

    def close(self) -> None:
        if self.parts:
            self.segments.append(Segment("\n".join(self.parts), self.title, self.trail.metadata()))
            self.parts = []


def docx(content: bytes, limits: Limits) -> list[Segment]:
    """SRC-12: sections of a Word file. Cells of a table row are divided by tabs, rows by newlines; a heading's text begins its section."""
    archive, body = Archive(content, limits), WordBody()
    archive.parse("word/document.xml", body.begin, body.end, body.characters)
    body.close()
    return body.segments


def hwpx(content: bytes, limits: Limits) -> list[Segment]:
    """SRC-13: the text of an HWPX file, section after section; paragraphs and table rows are lines, cells are divided by tabs."""
    archive = Archive(content, limits)
    if b"".join(archive.pieces("mimetype"))[:128].decode("utf-8", "replace").strip() != HWPX_TYPE:
        raise Refused("MEDIA_TYPE", "mimetype")
    names = [i.filename for i in archive.names]
    sections = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n)))
    for name in names:  # every XML part is looked through, as any of them could declare entities or encryption
        if name.lower().endswith((".xml", ".hpf")):
            archive.parse(name, lambda tag, _, name=name: _no_encryption(tag, name))
    lines: list[str] = []
    for _, name in sections:
        path, out = [], []

        def begin(tag: str, _: dict[str, str], path: list[str] = path, out: list[str] = out) -> None:
            if tag in ("tbl", "lineBreak"):
                out.append("\n")
            elif tag == "tab":
                out.append("\t")
            path.append(tag)

        def end(tag: str, path: list[str] = path, out: list[str] = out) -> None:
            path.pop()
            if tag == "tc":
                out.append("\t")
            elif tag in ("tr", "tbl") or tag == "p" and "tc" not in path:
                out.append("\n")
            elif tag == "p":
                out.append(" ")

        archive.parse(name, begin, end, lambda text, path=path, out=out: out.append(text) if path and path[-1] == "t" else None)
        lines += "".join(out).split("\n")
    text = "\n".join(x for x in ("\t".join(c.strip() for c in line.split("\t")).rstrip() for line in lines) if x.strip())
    return [Segment(text)] if text else []


def _no_encryption(tag: str, name: str) -> None:
    if tag == "encryption-data":
        raise Refused("ENCRYPTED", name)


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError as bad:
        raise Refused("NOT_UTF8", f"byte {bad.start}") from bad


def plain(content: bytes, _: Limits) -> list[Segment]:
    """SRC-07: the text as it is."""
    text = _decoded(content)
    return [Segment(text)] if text.strip() else []


def markdown(content: bytes, _: Limits) -> list[Segment]:
    """SRC-08: sections by headings."""
    return [Segment(text, title, metadata) for title, metadata, text in markdown_sections(_decoded(content))]


#: SRC-15, SRC-16. Kind of file: parser, accepted media types, first bytes.
PARSERS = {
    "txt": (plain, ("text/plain",), b""),
    "md": (markdown, ("text/markdown", "text/x-markdown", "text/plain"), b""),
    "docx": (docx, ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), b"PK\x03\x04"),
    "hwpx": (hwpx, ("application/hwp+zip", "application/haansofthwpx", "application/vnd.hancom.hwpx"), b"PK\x03\x04"),
}
#: Media types that say nothing, with which a file is judged by its name and first bytes.
UNSPECIFIC = ("", "application/octet-stream", "application/zip")


def segments_of(path: str, content: bytes, media_type: str | None, most_bytes: int, limits: Limits) -> list[Segment]:
    """Segments of one file, or Refused."""
    kind = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    if kind not in PARSERS:
        raise Refused("UNKNOWN_TYPE", kind)
    parse, media_types, first = PARSERS[kind]
    if not content:
        raise Refused("EMPTY_FILE")
    if len(content) > most_bytes:
        raise Refused("TOO_LARGE", str(len(content)))
    said = (media_type or "").partition(";")[0].strip().lower()
    if said not in UNSPECIFIC and said not in media_types:
        raise Refused("MEDIA_TYPE", said)
    if not content.startswith(first):
        raise Refused("FIRST_BYTES")
    found = parse(content, limits)
    if not found:
        raise Refused("NO_TEXT")
    broken, size = sum(s.text.count("�") for s in found), sum(len(s.text) for s in found)
    if broken > size * GARBLED:
        raise Refused("GARBLED", f"{broken} of {size}")
    return found


NAMES = ["path", "segment_no", "title", "metadata", "text", "reason", "place"]


def parse_files(files: DataFrame, most_bytes: int = 50 << 20, limits: Limits | None = None) -> DataFrame:
    """SRC-07..16: path, segment_no, title, metadata, text of each segment of files (path, content, optional media_type).

    A file that is refused is one row with `reason` and `place`, and no text. Null content is an empty file.
    """
    held = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, kind in zip(*(batch.column(i) for i in range(3)), strict=True):
                try:
                    found = segments_of(path.as_py() or "", content.as_py() or b"", kind.as_py(), most_bytes, held)
                    rows = [(path.as_py(), k, s.title, s.metadata, s.text, None, None) for k, s in enumerate(found)]
                except Refused as no:
                    rows = [(path.as_py(), None, None, None, None, no.reason, no.place)]
                columns = [pa.array(c, pa.int32() if n == "segment_no" else pa.string()) for n, c in zip(NAMES, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    kind = files["media_type"] if "media_type" in files.columns else F.lit(None).cast("string")
    return files.select("path", "content", kind.alias("media_type")).mapInArrow(run, "path string, segment_no int, title string, metadata string, text string, reason string, place string")


def divided(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segments, and the quarantine: path, reason, place. Both read parsed: write it first where it is costly."""
    return parsed.filter("reason IS NULL").drop("reason", "place"), parsed.filter("reason IS NOT NULL").select("path", "reason", "place")
