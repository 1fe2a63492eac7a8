"""Readers of document bytes, one for each format, and their registry.

A reader takes bytes and gives (section_no, page_number, kind, level, text) in order.
OCR needs software that is not part of this package: readers with it
(``pdf.pdf_reader``, ``pdf.image_reader``) are plugged in with ``register``.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from .pdf import pdf_reader
from .tables import ELEMENT_TOKENS, group_rows, markdown

Element = tuple[int, int | None, str, int | None, str]
Reader = Callable[[bytes], list[Element]]

#: Tokens as the default counter of chunks takes them.
_TOKEN = re.compile(r"\s*(?:[A-Za-z0-9_]+|\S)")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Fixed values of the compound-file and binary Word formats.
OLE_MAGIC, WORD_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1"), 0xA5EC
CLX_AT, TABLE_FLAG, ONE_BYTE = 154 + 33 * 8, 0x0200, 0x40000000
END_OF_CHAIN = 0xFFFFFFFA


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def pieces_of(text: str, most: int = ELEMENT_TOKENS) -> list[str]:
    """The text, or its pieces of at most ``most`` tokens."""
    tokens = _TOKEN.findall(text)
    return [text] if len(tokens) <= most else [x for i in range(0, len(tokens), most) if (x := "".join(tokens[i : i + most]).strip())]


def read_markdown(data: bytes) -> list[Element]:
    """Headings are headers, blocks between blank lines paragraphs; one section."""
    out: list[Element] = []
    for block in re.split(r"\n\s*\n", data.decode("utf-8-sig", "replace").replace("\r\n", "\n")):
        held: list[str] = []
        for line in block.split("\n"):
            if m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
                if text := "\n".join(held).strip():
                    out.append((0, None, "para", None, text))
                held = []
                out.append((0, None, "header", len(m[1]), m[2]))
            else:
                held.append(line)
        if text := "\n".join(held).strip():
            out.append((0, None, "para", None, text))
    return out


def _inner(node) -> str:
    return "".join(x.text or "" for x in node.iter(_W + "t")).strip()


def read_docx(data: bytes) -> list[Element]:
    """Paragraphs and tables of a document's body, in order; heading styles 1 to 6 are
    headers; what is over the element budget is cut."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    if body is None:
        raise ValueError("the document has no body")
    out: list[Element] = []
    add = lambda kind, level, text: out.append((0, None, kind, level, text))
    for node in body:
        if node.tag == _W + "p" and (text := _inner(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"(?i)heading([1-6])", style.get(_W + "val", "") if style is not None else "")
            if m and count_tokens(text) <= ELEMENT_TOKENS:
                add("header", int(m[1]), text)
            else:
                for piece in pieces_of(text):
                    add("para", None, piece)
        elif node.tag == _W + "tbl":
            rows = [[_inner(c) for c in r.findall(_W + "tc")] for r in node.findall(_W + "tr")]
            columns = max(map(len, rows), default=0)
            for kind, cells in group_rows(rows, count_tokens):
                if kind == "table":
                    add("table", None, markdown(cells, columns))
                else:
                    for piece in pieces_of(cells[0]):
                        add("para", None, piece)
    return out


class CompoundFile:
    """Streams of an OLE compound file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != OLE_MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        self.sector, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        directory, _, self.cutoff, mini_fat, _, difat, n_difat = struct.unpack_from("<7I", data, 48)
        table = list(struct.unpack_from("<109I", data, 76))
        per = self.sector // 4
        for _ in range(n_difat):
            more = struct.unpack_from(f"<{per}I", data, (difat + 1) * self.sector)
            table += more[:-1]
            difat = more[-1]
        self.fat: list[int] = []
        for s in table:
            if s < END_OF_CHAIN:
                self.fat += struct.unpack_from(f"<{per}I", data, (s + 1) * self.sector)
        entries = self._chain(directory)
        self.streams: dict[str, tuple[int, int]] = {}
        self.root = (END_OF_CHAIN, 0)
        for at in range(0, len(entries) - 127, 128):
            n = struct.unpack_from("<H", entries, at + 64)[0]
            name, kind = entries[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), entries[at + 66]
            first, size = struct.unpack_from("<II", entries, at + 116)
            if kind == 5:
                self.root = (first, size)
            elif kind == 2:
                self.streams[name] = (first, size)
        small = self._chain(mini_fat) if mini_fat < END_OF_CHAIN else b""
        self.mini_fat = struct.unpack(f"<{len(small) // 4}I", small)
        self.mini_data = self._chain(self.root[0]) if self.root[0] < END_OF_CHAIN else b""

    def _chain(self, s: int) -> bytes:
        out, seen = [], set()
        while s < END_OF_CHAIN and s < len(self.fat) and s not in seen:
            seen.add(s)
            out.append(self.data[(s + 1) * self.sector : (s + 2) * self.sector])
            s = self.fat[s]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.streams:
            return None
        s, size = self.streams[name]
        if size >= self.cutoff:
            return self._chain(s)[:size]
        out, seen = [], set()
        while s < END_OF_CHAIN and s < len(self.mini_fat) and s not in seen:
            seen.add(s)
            out.append(self.mini_data[s * self.mini : (s + 1) * self.mini])
            s = self.mini_fat[s]
        return b"".join(out)[:size]


def doc_text(word: bytes, table: bytes) -> str:
    """The text of a binary Word document from its main and table streams: the pieces of
    its piece table, of one byte (code page 936) or two bytes (UTF-16) a character."""
    at, size = struct.unpack_from("<ii", word, CLX_AT)
    if size <= 0 or at < 0 or at + size > len(table):
        raise ValueError("the document has no piece table")
    pos, end = at, at + size
    while pos < end and table[pos] == 1:
        pos += 3 + struct.unpack_from("<h", table, pos + 1)[0]
    if pos >= end or table[pos] != 2:
        return ""
    n = (struct.unpack_from("<i", table, pos + 1)[0] - 4) // 12
    borders = struct.unpack_from(f"<{n + 1}i", table, pos + 5)
    out = []
    for i in range(n):
        place = struct.unpack_from("<i", table, pos + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        chars, offset = borders[i + 1] - borders[i], place & 0x3FFFFFFF
        if place & ONE_BYTE:
            out.append(word[offset // 2 : offset // 2 + chars].decode("cp936", "replace"))
        else:
            out.append(word[offset : offset + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out)


def read_doc(data: bytes) -> list[Element]:
    """Binary Word 97-2003: a paragraph for each carriage return; cell marks are spaces."""
    file = CompoundFile(data)
    word = file.stream("WordDocument") or b""
    if len(word) < 0x200 or struct.unpack_from("<H", word)[0] != WORD_MAGIC:
        raise ValueError("not a binary Word document")
    named = "1Table" if struct.unpack_from("<H", word, 0x0A)[0] & TABLE_FLAG else "0Table"
    table = next((t for name in (named, "1Table", "0Table") if (t := file.stream(name)) is not None), None)
    if table is None:
        raise ValueError(f"the document has no {named}")
    out: list[Element] = []
    for raw in doc_text(word, table).split("\r"):
        if text := raw.replace("\x07", " ").strip("\x0b \t").strip():
            out += [(0, None, "para", None, piece) for piece in pieces_of(text)]
    if not out:
        raise ValueError("no text in the document")
    return out


READERS: dict[str, Reader] = {".md": read_markdown, ".docx": read_docx, ".doc": read_doc, ".pdf": pdf_reader()}


def register(extension: str, reader: Reader) -> None:
    """Plugs in a reader, as for pictures (OCR)."""
    READERS[extension] = reader


def elements_of(extension: str, data: bytes, readers: dict[str, Reader] | None = None) -> Iterator[tuple]:
    """(section_no, page_number, element_no, kind, level, text) of a file."""
    readers = READERS if readers is None else readers
    if extension not in readers:
        raise ValueError(f"no reader for {extension or 'files without extension'}")
    counts: dict[int, int] = {}
    for section, page, kind, level, text in readers[extension](data):
        n = counts[section] = counts.get(section, -1) + 1
        yield section, page, n, kind, level, text
