"""Text of PDF files, with OCR by a plugged-in engine for pages that have none.

Reads what the format's public specification (ISO 32000-1) calls the body: objects,
object streams, page trees, content streams without a filter or with FlateDecode, and
text of simple fonts and of fonts with a ToUnicode map.  Encrypted files and other
filters of content are errors.  Letters in the bands of header and footer are left out;
lines of a page are joined to paragraphs where they follow each other closely.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable

# The body of a page, the least sizes of embedded images, characters of a page that needs no OCR.
BAND, LEAST_AREA, LEAST_SIDE, USABLE_CHARS = (0.07, 0.93), 80 * 80, 40, 40

#: An embedded picture -> its text.
Ocr = Callable[[bytes], str]

_SPACE, _DELIMITERS = b" \t\r\n\x0c\x00", b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")


class Name(str):
    """A PDF name."""


class Ref(int):
    """The number of an indirect object."""


class Stream:
    def __init__(self, head: dict, data: bytes) -> None:
        self.head, self.data = head, data


class Lexer:
    """Values and operators of PDF syntax, from a place on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            if data[self.at] in _SPACE:
                self.at += 1
            elif data[self.at] == 0x25:
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self):
        """The next value; operators are bytes; None at the end."""
        self.skip()
        data = self.data
        if self.at >= len(data):
            return None
        c = data[self.at : self.at + 1]
        if data[self.at : self.at + 2] == b"<<":
            self.at += 2
            items = self._until(b">>")
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        if c == b"[":
            self.at += 1
            return self._until(b"]")
        if c == b"(":
            return self._literal()
        if c == b"<":
            end = data.index(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end])
            self.at = end + 1
            return bytearray.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            self.at += 1
            word = self._word()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word).decode("latin-1"))
        if c in (b")", b"]", b"}", b"{", b">"):
            self.at += 1 + (data[self.at : self.at + 2] == b">>")
            return data[self.at - 1 : self.at] if c != b">" else b">>"
        word = self._word()
        if _NUMBER.match(word):
            number = float(word)
            if b"." not in word and (m := re.compile(rb"\s+(\d+)\s+R(?![A-Za-z0-9])").match(data, self.at)):
                self.at = m.end()
                return Ref(int(word))
            return number
        return {b"true": True, b"false": False}.get(word, word)

    def _word(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in _SPACE and self.data[self.at] not in _DELIMITERS:
            self.at += 1
        self.at += self.at == start  # a stray delimiter is a word of its own
        return self.data[start : self.at]

    def _until(self, end: bytes) -> list:
        out = []
        while True:
            v = self.value()
            if v is None or (isinstance(v, bytes) and v == end):
                return out
            out.append(None if isinstance(v, bytes) and v == b"null" else v)

    def _literal(self) -> bytearray:
        out, depth, data = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 0x5C:
                c = data[self.at] if self.at < len(data) else 0
                self.at += 1
                if 0x30 <= c <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif c in b"\r\n":
                    self.at += data[self.at - 1 : self.at + 1] == b"\r\n"
                else:
                    out.append(b"\n\r\t\b\f"[b"nrtbf".index(c)] if c in b"nrtbf" else c)
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return out


def _decoded(stream: Stream) -> bytes:
    kinds = stream.head.get("Filter")
    for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
        if kind != "FlateDecode":
            raise ValueError(f"a stream has the filter {kind}")
    data = zlib.decompressobj().decompress(stream.data) if kinds else stream.data
    parms = stream.head.get("DecodeParms")
    parms = parms[0] if isinstance(parms, list) and parms else parms
    if isinstance(parms, dict) and parms.get("Predictor", 1) > 1:
        raise ValueError("a content stream has a predictor")
    return data


class Document:
    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the PDF is encrypted")
        self.objects: dict[int, object] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            lexer = Lexer(data, m.end())
            value = lexer.value()
            lexer.skip()
            if isinstance(value, dict) and data.startswith(b"stream", lexer.at):
                start = lexer.at + 6
                start += 2 if data.startswith(b"\r\n", start) else 1
                size = value.get("Length")
                end = start + int(size) if isinstance(size, float) else -1
                if end < 0 or not re.match(rb"\s*endstream", data[end : end + 20]):
                    end = data.find(b"endstream", start)
                value = Stream(value, data[start:end].rstrip(b"\r\n") if end < 0 else data[start:end])
            self.objects[int(m[1])] = value
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.head.get("Type") == "ObjStm":
                self._unpack(value)

    def _unpack(self, stream: Stream) -> None:
        data = _decoded(stream)
        lexer = Lexer(data)
        pairs = [(int(lexer.value()), int(lexer.value())) for _ in range(int(stream.head["N"]))]
        for number, at in pairs:
            self.objects.setdefault(number, Lexer(data, int(stream.head["First"]) + at).value())

    def get(self, value):
        seen = set()
        while isinstance(value, Ref) and value not in seen:
            seen.add(value)
            value = self.objects.get(int(value))
        return value

    def pages(self) -> list[dict]:
        """The pages in order, with what they inherit."""
        root = next((self.get(v.get("Pages")) for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        out, waiting, seen = [], [(root, {})], set()
        while waiting:
            node, given = waiting.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = given | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                waiting += [(self.get(k), own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append(own | node)
        return out

    def content(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        streams = [self.get(p) for p in parts] if isinstance(parts, list) else [parts]
        return b"\n".join(_decoded(s) for s in streams if isinstance(s, Stream))

    def images(self, page: dict) -> list[bytes]:
        """The bytes of embedded pictures that are large enough and stand as whole files (JPEG)."""
        resources = self.get(page.get("Resources")) or {}
        found = [self.get(x) for x in (self.get(resources.get("XObject")) or {}).values()]
        sized = [x for x in found if isinstance(x, Stream) and x.head.get("Subtype") == "Image"]
        size = lambda x, k: self.get(x.head.get(k)) or 0
        whole = lambda x: x.head.get("Filter") in ("DCTDecode", ["DCTDecode"])
        return [x.data for x in sized if whole(x) and size(x, "Width") * size(x, "Height") >= LEAST_AREA and min(size(x, "Width"), size(x, "Height")) >= LEAST_SIDE]


class Font:
    def __init__(self, document: Document, font: dict) -> None:
        self.wide = font.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        stream = document.get(font.get("ToUnicode"))
        if isinstance(stream, Stream):
            self._read(_decoded(stream))

    def _read(self, data: bytes) -> None:
        text = lambda b: bytes(b).decode("utf-16-be", "replace")
        code = lambda b: int.from_bytes(b, "big")
        for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", data, re.S):
            lexer, values = Lexer(body), []
            while (v := lexer.value()) is not None:
                values.append(v)
            if kind == b"bfchar":
                self.map |= {code(a): text(b) for a, b in zip(values[::2], values[1::2], strict=False)}
                continue
            for low, high, to in zip(values[::3], values[1::3], values[2::3], strict=False):
                for i in range(code(low), min(code(high), code(low) + 65535) + 1):
                    n = i - code(low)
                    if isinstance(to, list):
                        self.map[i] = text(to[n]) if n < len(to) else ""
                    else:
                        self.map[i] = text(to[:-2]) + chr((code(to[-2:]) + n) & 0xFFFF)

    def text(self, raw: bytes) -> str:
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        other = (lambda c: "") if self.wide else (lambda c: bytes([c]).decode("cp1252", "replace"))
        return "".join(self.map[c] if c in self.map else other(c) for c in codes)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_runs(document: Document, page: dict) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of what a page shows, in the order it is shown."""
    resources = document.get(page.get("Resources")) or {}
    fonts = {k: Font(document, document.get(v)) for k, v in (document.get(resources.get("Font")) or {}).items() if isinstance(document.get(v), dict)}
    lexer, args, runs, saved = Lexer(document.content(page)), [], [], []
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    base, line, now, font, size, lead = one, one, one, None, 1.0, 0.0

    def show(raw: bytes) -> None:
        nonlocal now
        text = font.text(bytes(raw)) if font else bytes(raw).decode("cp1252", "replace")
        m = _times(now, base)
        height = size * (abs(m[3]) or abs(m[1]) or 1.0)
        if text:
            runs.append((m[4], m[5], height, text))
        now = _times((1, 0, 0, 1, 0.5 * size * len(text), 0), now)  # widths aren't read: half an em for a letter

    def down(x: float, y: float) -> None:
        nonlocal line, now
        line = now = _times((1, 0, 0, 1, x, y), line)

    while (v := lexer.value()) is not None:
        if not isinstance(v, bytes) or isinstance(v, bytearray):
            args.append(v)
            continue
        try:
            if v == b"q":
                saved.append((base, font, size, lead))
            elif v == b"Q" and saved:
                base, font, size, lead = saved.pop()
            elif v == b"cm":
                base = _times(tuple(args[-6:]), base)
            elif v == b"BT":
                line = now = one
            elif v == b"Tf":
                font, size = fonts.get(args[-2]), float(args[-1])
            elif v == b"TL":
                lead = args[-1]
            elif v == b"Tm":
                line = now = tuple(args[-6:])
            elif v in (b"Td", b"TD"):
                lead = -args[-1] if v == b"TD" else lead
                down(*args[-2:])
            elif v == b"T*":
                down(0, -lead)
            elif v in (b"Tj", b"'", b'"'):
                if v != b"Tj":
                    down(0, -lead)
                show(args[-1])
            elif v == b"TJ":
                for part in args[-1]:
                    if isinstance(part, float):
                        if part < -200:  # a gap as wide as a space
                            show(b" " if not (font and font.wide) else b"")
                            runs += [(runs[-1][0], runs[-1][1], runs[-1][2], " ")] if font and font.wide and runs else []
                    else:
                        show(part)
            elif v == b"BI":
                at = lexer.data.find(b"EI", lexer.at)
                lexer.at = at + 2 if at >= 0 else len(lexer.data)
        except (IndexError, TypeError, ValueError):
            pass  # an operator with other operands than it takes is passed over, as viewers do
        args = []
    return runs


def page_blocks(runs: list[tuple[float, float, float, str]], low: float, high: float) -> list[str]:
    """Paragraphs of the letters between two heights: runs of one height are a line, lines
    closer than one and a half of their size a block."""
    lines: list[list] = []
    for _, y, size, text in (r for r in runs if r[1] > low and r[1] + r[2] < high):
        if lines and abs(lines[-1][0] - y) < 0.5 * size:
            lines[-1][2].append(text)
        else:
            lines.append([y, size, [text]])
    blocks: list[list[str]] = []
    before = None
    for y, size, parts in lines:
        if text := " ".join("".join(parts).split()):
            if before is None or not 0 < before - y <= 1.7 * size:
                blocks.append([])
            blocks[-1].append(text)
            before = y
    return ["\n".join(b) for b in blocks]


def visible(text: str) -> int:
    return sum(not c.isspace() and unicodedata.category(c) != "Cc" for c in text)


def reading_score(text: str, confidence: float) -> float:
    """How plausible an OCR result is, as ``functions.text.ocr_score`` has it."""
    han, latin = len(re.findall("[一-鿿]", text)), len(re.findall("[A-Za-z]", text))
    garbage = lambda line: len(line.strip()) >= 6 and not re.search("[一-鿿]", line) and len(re.findall("[A-Za-z]", line)) >= 6
    return confidence * 100 + han * 2 - latin - 80 * sum(map(garbage, text.splitlines()))


def best_reading(readings: list[tuple[str, float]]) -> str:
    """Of readings (text, confidence) of one picture in several layouts the most plausible;
    the first of equals, empty without any."""
    found = [r for r in readings if r[0].strip()]
    return max(found, key=lambda r: reading_score(*r))[0] if found else ""


def _paragraphs(text: str) -> list[str]:
    blocks = re.split(r"\n\s*\n", text.replace("\r\n", "\n"))
    return [b for b in ("\n".join(x.strip() for x in block.split("\n")).strip("\n") for block in blocks) if b.strip()]


def pdf_reader(ocr: Ocr | None = None, render: Callable[[bytes, int], bytes] | None = None):
    """A reader of PDF bytes: a section for each page, its blocks as paragraphs.

    A page whose text has fewer than 40 visible characters takes the text of its embedded
    pictures by ``ocr``, or else that of the page as ``render`` (file, page number) draws
    it, if that has enough characters; without either it keeps what text it has."""

    def read(data: bytes) -> list[tuple]:
        document, out = Document(data), []
        for number, page in enumerate(document.pages(), 1):
            box = document.get(page.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
            bottom, top = (float(document.get(box[i])) for i in (1, 3))
            height = top - bottom
            blocks = page_blocks(page_runs(document, page), bottom + BAND[0] * height, bottom + BAND[1] * height)
            if ocr and sum(map(visible, blocks)) < USABLE_CHARS:
                found = "\n\n".join(t for t in map(ocr, document.images(page)) if visible(t))
                if visible(found) < USABLE_CHARS and render:
                    found = ocr(render(data, number))
                if visible(found) >= USABLE_CHARS:
                    blocks = _paragraphs(found)
            out += [(number - 1, number, "para", None, b) for b in blocks]
        return out

    return read


def image_reader(ocr: Ocr):
    """A reader of pictures: one section, page 1, the recognised paragraphs."""

    def read(data: bytes) -> list[tuple]:
        return [(0, 1, "para", None, p) for p in _paragraphs(ocr(data))]

    return read
