"""PDF files by their cross-reference: the newest trailer, its chain of tables and streams, the page tree and the document information.

Only what these lead to is read (the file is mapped, not loaded). A file whose cross-reference is broken is searched for objects, content of streams left out.
"""

from __future__ import annotations

import mmap
import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple


class EncryptedPdf(ValueError):
    """The document needs a key; nothing in it can be trusted without one."""


class BrokenPdf(ValueError):
    pass


#: What reading a damaged file may end in.
_DAMAGE = (BrokenPdf, zlib.error, LookupError, TypeError, AttributeError, ValueError)


class Ref(NamedTuple):
    number: int
    generation: int


class Name(str):
    pass


class Stream(NamedTuple):
    head: dict
    at: int  # where its data begin


_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_REF = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_HEX = re.compile(rb"<([^>]*)>")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-zA-Z])")
_STRING_PART = re.compile(rb"[^()\\]*")
_STREAM = re.compile(rb"stream(?:\r\n|\n|\r)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_LITERALS = {b"true": True, b"false": False, b"null": None}
# Characters of PDFDocEncoding that aren't those of Latin-1, by code.
_DOC_ENCODING = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", strict=True)) | {0xA0: "€"}


def text_of(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, else PDFDocEncoding."""
    for mark, encoding in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(encoding, "replace")
    return raw.decode("latin-1").translate(_DOC_ENCODING)


def _string(data, at: int) -> tuple[bytes, int]:
    """A literal string from its opening bracket."""
    out, depth, at = [], 1, at + 1
    while True:
        m = _STRING_PART.match(data, at)
        out.append(m[0])
        at = m.end()
        c = data[at : at + 1]
        if c == b"\\":
            follows = data[at + 1 : at + 4]
            if octal := re.match(rb"[0-7]{1,3}", follows):
                out.append(bytes([int(octal[0], 8) & 255]))
                at += 1 + octal.end()
            elif follows[:1] in b"\r\n":
                at += 3 if follows[:2] == b"\r\n" else 2
            else:
                out.append(_ESCAPES.get(follows[:1], follows[:1]))
                at += 2
            continue
        if not c:
            raise BrokenPdf("a string that doesn't end")
        depth += 1 if c == b"(" else -1
        at += 1
        if not depth:
            return b"".join(out), at
        out.append(c)


def parse(data, at: int, depth: int = 0) -> tuple[Any, int]:
    """The object at this place, and where it ends."""
    if depth > 200:
        raise BrokenPdf("objects nested too deep")
    at = _SKIP.match(data, at).end()
    c = data[at : at + 1]
    if c == b"/":
        m = _WORD.match(data, at + 1)
        name = m[0] if m else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name).decode("latin-1")), at + 1 + len(name)
    if c == b"(":
        return _string(data, at)
    if data[at : at + 2] == b"<<":
        out, at = {}, at + 2
        while True:
            at = _SKIP.match(data, at).end()
            if data[at : at + 2] == b">>":
                return out, at + 2
            key, at = parse(data, at, depth + 1)
            if not isinstance(key, Name):
                raise BrokenPdf("a key that is no name")
            out[key], at = parse(data, at, depth + 1)
    if c == b"<":
        m = _HEX.match(data, at)
        if not m:
            raise BrokenPdf("a string that doesn't end")
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", m[1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), m.end()
    if c == b"[":
        items, at = [], at + 1
        while True:
            at = _SKIP.match(data, at).end()
            if data[at : at + 1] == b"]":
                return items, at + 1
            item, at = parse(data, at, depth + 1)
            items.append(item)
    if m := _REF.match(data, at):
        return Ref(int(m[1]), int(m[2])), m.end()
    if m := _NUMBER.match(data, at):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    if (m := _WORD.match(data, at)) and m[0] in _LITERALS:
        return _LITERALS[m[0]], m.end()
    raise BrokenPdf(f"no object at {at}")


def _unpredicted(raw: bytes, settings: dict) -> bytes:
    """Undo the predictor of a Flate stream: none, or the row filters of PNG."""
    kind = settings.get("Predictor", 1)
    if kind == 1:
        return raw
    if kind < 10:
        raise BrokenPdf(f"predictor {kind}")
    step = max(1, settings.get("Colors", 1) * settings.get("BitsPerComponent", 8) // 8)
    width = (settings.get("Colors", 1) * settings.get("BitsPerComponent", 8) * settings.get("Columns", 1) + 7) // 8
    out, above = bytearray(), bytes(width)
    for at in range(0, len(raw), width + 1):
        kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            if kind == 1:
                row[i] = row[i] + left & 255
            elif kind == 2:
                row[i] = row[i] + up & 255
            elif kind == 3:
                row[i] = row[i] + (left + up) // 2 & 255
            elif kind == 4:
                guess = left + up - corner
                row[i] = row[i] + min((left, up, corner), key=lambda x: abs(guess - x)) & 255
        out += row
        above = bytes(row).ljust(width, b"\0")
    return bytes(out)


class Document:
    """Objects of a PDF by number, found through the cross-reference or, where that is broken, by a search."""

    def __init__(self, data) -> None:
        self.data = data
        self.entries: dict[int, tuple[int, int, int]] = {}  # kind (0 free, 1 at a place, 2 in an object stream), place or stream, index
        self.trailer: dict = {}
        self.objects: dict[int, Any] = {}
        self.packed: dict[int, dict[int, Any]] = {}
        self.found: list[int] | None = None
        try:
            self._cross_reference()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise BrokenPdf("no catalog")
        except _DAMAGE:
            self.search()

    # the cross-reference

    def _cross_reference(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise BrokenPdf("no startxref")
        place, _ = parse(self.data, at + len(b"startxref"))
        waiting, seen = [place], set()
        while waiting:
            place = waiting.pop(0)
            if not isinstance(place, int) or place in seen or not 0 <= place < len(self.data):
                if place in seen:
                    continue
                raise BrokenPdf("a cross-reference outside the file")
            seen.add(place)
            begin = _SKIP.match(self.data, place).end()
            head = self._table(begin + 4) if self.data[begin : begin + 4] == b"xref" else self._stream_of_entries(begin)
            self.trailer = head | self.trailer
            waiting = [head[k] for k in ("XRefStm", "Prev") if k in head] + waiting

    def _table(self, at: int) -> dict:
        while True:
            at = _SKIP.match(self.data, at).end()
            if self.data[at : at + 7] == b"trailer":
                head, _ = parse(self.data, at + 7)
                return head
            first, at = parse(self.data, at)
            count, at = parse(self.data, at)
            for number in range(first, first + count):
                m = _ENTRY.match(self.data, at)
                if not m:
                    raise BrokenPdf("a broken table")
                at = m.end()
                self.entries.setdefault(number, (1 if m[3] == b"n" else 0, int(m[1]), 0))

    def _stream_of_entries(self, at: int) -> dict:
        value = self._object_at(at, None)
        if not isinstance(value, Stream) or value.head.get("Type") != "XRef":
            raise BrokenPdf("no cross-reference where one should be")
        head, raw = value.head, self.content(value)
        widths = head["W"]
        size = sum(widths)
        ranges = head.get("Index") or [0, head["Size"]]
        numbers = (n for first, count in zip(ranges[::2], ranges[1::2], strict=True) for n in range(first, first + count))
        for k, number in enumerate(numbers):
            row = raw[k * size : (k + 1) * size]
            if len(row) < size:
                break
            cells, i = [], 0
            for w in widths:
                cells.append(int.from_bytes(row[i : i + w], "big"))
                i += w
            self.entries.setdefault(number, (cells[0] if widths[0] else 1, cells[1], cells[2]))
        return head

    # objects

    def _object_at(self, at: int, number: int | None) -> Any:
        m = _OBJECT.match(self.data, _SKIP.match(self.data, at).end())
        if not m or number is not None and int(m[1]) != number:
            raise BrokenPdf(f"object {number} isn't where it should be")
        value, end = parse(self.data, m.end())
        if isinstance(value, dict) and (s := _STREAM.match(self.data, _SKIP.match(self.data, end).end())):
            return Stream(value, s.end())
        return value

    def content(self, stream: Stream) -> bytes:
        """The data of a stream, unpacked."""
        length = self.get(stream.head.get("Length"))
        end = stream.at + length if isinstance(length, int) else -1
        if end < 0 or not _ENDS.match(self.data, end):
            end = self.data.find(b"endstream", stream.at)
        raw = self.data[stream.at : end]
        listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        filters, settings = listed(self.get(stream.head.get("Filter"))), listed(self.get(stream.head.get("DecodeParms")))
        for k, name in enumerate(filters):
            if self.get(name) != "FlateDecode":
                raise BrokenPdf(f"filter {name}")
            one = self.get(settings[k]) if k < len(settings) else None
            raw = _unpredicted(zlib.decompressobj().decompress(raw), {a: self.get(b) for a, b in one.items()} if isinstance(one, dict) else {})
        return raw

    def get(self, value: Any) -> Any:
        """What a reference leads to (a stream's dictionary is its Stream); other values stand for themselves, missing objects for null."""
        for _ in range(64):
            if not isinstance(value, Ref):
                return value
            value = self._numbered(value.number)
        raise BrokenPdf("references in a circle")

    def _numbered(self, number: int) -> Any:
        if number not in self.objects:
            kind, place, index = self.entries.get(number, (0, 0, 0))
            self.objects[number] = None  # while it is looked for
            if kind == 1:
                self.objects[number] = self._object_at(place, number)
            elif kind == 2:
                self.objects[number] = self._packed(place).get(number)
        return self.objects[number]

    def _packed(self, number: int) -> dict[int, Any]:
        """The objects of an object stream."""
        if number not in self.packed:
            self.packed[number] = {}
            holder = self._numbered(number)
            if isinstance(holder, Stream):
                raw, head = self.content(holder), []
                at = 0
                for _ in range(2 * self.get(holder.head["N"])):
                    value, at = parse(raw, at)
                    head.append(value)
                first = self.get(holder.head["First"])
                self.packed[number] = {n: parse(raw, first + place)[0] for n, place in zip(head[::2], head[1::2], strict=True)}
        return self.packed[number]

    # without a cross-reference

    def search(self) -> None:
        """Take the objects that stand in the file, the last of each number, and what its trailers say together."""
        self.entries, self.objects, self.packed, self.found = {}, {}, {}, []
        packed, at = [], 0
        trailer: dict = {}
        while m := _OBJECT_OR_TRAILER.search(self.data, at):
            at = m.end()
            try:
                value, end = parse(self.data, at)
            except _DAMAGE:
                continue
            at = max(at, end)
            head = value if isinstance(value, dict) else {}
            if m[0] == b"trailer" or head.get("Type") == "XRef":
                trailer |= {k: v for k, v in head.items() if k in ("Root", "Info", "Encrypt")}
            if m[1]:
                number = int(m[1])
                self.entries[number] = (1, m.start(), 0)
                self.found.append(number)
                if head and (s := _STREAM.match(self.data, _SKIP.match(self.data, end).end())):
                    if head.get("Type") == "ObjStm":
                        packed.append(number)
                    end = self.data.find(b"endstream", s.end())
                    at = max(at, end)
        self.trailer = trailer
        for number in packed:
            try:
                inside = self._packed(number)
            except _DAMAGE:
                continue
            for n in inside:
                if n not in self.entries:
                    self.entries[n] = (2, number, 0)
                    self.found.append(n)
        if not self.found:
            raise BrokenPdf("no objects")

    def all_found(self) -> Iterator[dict]:
        """The dictionaries that a search has found."""
        for n in dict.fromkeys(self.found or ()):
            try:
                value = self._numbered(n)
            except _DAMAGE:
                continue
            if isinstance(value, dict):
                yield value

    # what a report wants

    def pages(self) -> int:
        """Leaves of the page tree; a node with Kids isn't one. Without a catalog the page objects that a search finds."""
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            return sum(x.get("Type") == "Page" for x in self.all_found())
        waiting, seen, n = [root.get("Pages")], set(), 0
        while waiting:
            ref = waiting.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.get(ref)
            if isinstance(node, dict):
                kids = self.get(node.get("Kids"))
                if isinstance(kids, list):
                    waiting += kids
                else:
                    n += node.get("Type", "Page") != "Pages"
        return n

    def information(self) -> dict[str, str]:
        """The document information's texts by key."""
        info = self.get(self.trailer.get("Info"))
        if info is None and self.found and not isinstance(self.get(self.trailer.get("Root")), dict):
            info = next((x for x in reversed([*self.all_found()]) if "Type" not in x and {"Title", "Author", "Producer", "Creator"} & x.keys()), None)
        values = {k: self.get(v) for k, v in info.items()} if isinstance(info, dict) else {}
        return {k: text_of(v) if isinstance(v, bytes) else str(v) for k, v in values.items() if v is not None and not isinstance(v, Stream)}


_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[\t ]+(\d{1,5})[\t ]+([nf])")
_ENDS = re.compile(rb"[\r\n \t]{0,3}endstream")
_OBJECT_OR_TRAILER = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-zA-Z])|trailer")

#: Fields of the document information that a record keeps, as pdf_<name>. Fixed values.
FIELDS = ("Title", "Author", "Subject", "Creator", "Producer")


def metadata(path: str) -> dict:
    """pages, and the fields that aren't empty. Encrypted files raise EncryptedPdf, what is no PDF BrokenPdf."""
    with open(path, "rb") as f:
        if b"%PDF-" not in f.read(1024):
            raise BrokenPdf("not a PDF")
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            document = Document(data)
            if document.trailer.get("Encrypt") is not None:
                raise EncryptedPdf("encrypted")
            try:
                pages, found = document.pages(), document.information()
            except _DAMAGE:
                document.search()
                pages, found = document.pages(), document.information()
            return {"pages": pages} | {f"pdf_{k.lower()}": found[k] for k in FIELDS if found.get(k)}
