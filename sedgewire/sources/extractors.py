"""Metadata of single files with the standard library: JPEG and PNG headers with EXIF, PDF, DOCX and MP4; ffprobe for video if it is there."""

from __future__ import annotations

import importlib
import json
import shutil
import struct
import subprocess
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO
from xml.etree import ElementTree

from sedgewire.sources.pdf import metadata

Found = tuple[dict, list[str]]


def resolved(name: str) -> Callable[[str], Found]:
    """The function that module:function names, imported where this is called."""
    module, _, function = name.partition(":")
    if not module or not function:
        raise ValueError(f"a reader is named module:function, not {name!r}")
    return getattr(importlib.import_module(module), function)


def parse_readers(text: str) -> dict[str, str]:
    """Readers of one's own as an option spells them: .suffix=module:function or type/subtype=module:function, by commas."""
    out = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        key, _, name = part.partition("=")
        if ":" not in name:
            raise ValueError(f"a reader is given as .suffix=module:function, not {part!r}")
        out[key.strip().lower()] = name.strip()
    return out


def extract(path: str, mime: str, readers: dict[str, str] | None = None) -> Found:
    """Metadata and warnings of a file by the reader for its suffix or type: one's own first, then those here; nothing if there is none."""
    kind = Path(path).suffix.lower()
    for key in (kind, mime, mime.partition("/")[0] + "/*"):
        if key and key in (readers or {}):
            return resolved(readers[key])(path)
    if mime.startswith("image/"):
        return image(path)
    if mime == "application/pdf":
        return pdf(path)
    if kind == ".docx":
        return docx(path)
    if mime.startswith("video/"):
        return video(path)
    return {}, []


def _rational(data: bytes, at: int, order: str) -> float:
    n, d = struct.unpack_from(order + "II", data, at)
    return n / d if d else 0.0


def exif(data: bytes) -> dict:
    """make, model, original time and position from a TIFF block; the sub-directories are followed."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]

    def entries(at: int) -> dict[int, tuple[int, int, int]]:
        (n,) = struct.unpack_from(order + "H", data, at)
        return {t: (k, c, at + 2 + 12 * i + 8) for i in range(n) for t, k, c in [struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)]}

    def offset(entry) -> int:
        return struct.unpack_from(order + "I", data, entry[2])[0]

    def text(entry) -> str:
        at = entry[2] if entry[1] <= 4 else offset(entry)
        return data[at : at + entry[1]].split(b"\0")[0].decode("utf-8", "replace").strip()

    main = entries(struct.unpack_from(order + "I", data, 4)[0])
    out = {name: text(main[tag]) for tag, name in ((0x10F, "exif_make"), (0x110, "exif_model")) if tag in main}
    sub = main | (entries(offset(main[0x8769])) if 0x8769 in main else {})
    if 0x9003 in sub:
        out["exif_datetime_original"] = text(sub[0x9003])
    if 0x8825 in main:
        gps = entries(offset(main[0x8825]))
        if 2 in gps and 4 in gps and gps[2][1] == gps[4][1] == 3:
            for tag, name, negative in ((2, "gps_latitude", "S"), (4, "gps_longitude", "W")):
                d, m, s = (_rational(data, offset(gps[tag]) + 8 * i, order) for i in range(3))
                value = d + m / 60 + s / 3600
                out[name] = -value if tag - 1 in gps and text(gps[tag - 1]).upper().startswith(negative) else value
    return out


# The mode of a PNG by bit depth and colour type.
PNG_MODES = {(1, 0): "1", (2, 0): "L", (4, 0): "L", (8, 0): "L", (16, 0): "I;16", (8, 2): "RGB", (16, 2): "RGB", (1, 3): "P", (2, 3): "P", (4, 3): "P", (8, 3): "P", (8, 4): "LA", (16, 4): "RGBA", (8, 6): "RGBA", (16, 6): "RGBA"}


def image(path: str) -> Found:
    """From the headers of a PNG's chunks or a JPEG's segments; pixels aren't read."""
    with open(path, "rb") as f:
        start = f.read(8)
        if start == b"\x89PNG\r\n\x1a\n":
            return _png(f), []
        if start[:2] == b"\xff\xd8":
            f.seek(2)
            return _jpeg(f), []
    raise ValueError("not a JPEG or PNG image")


def _png(f: BinaryIO) -> dict:
    out: dict = {}
    while len(head := f.read(8)) == 8:
        size, kind = struct.unpack(">I4s", head)
        if kind == b"IHDR":
            width, height, depth, color = struct.unpack_from(">IIBB", f.read(size))
            out = {"format": "PNG", "mode": PNG_MODES[depth, color], "width": width, "height": height}
            f.seek(4, 1)
        elif kind == b"eXIf":
            return out | exif(f.read(size))
        elif kind == b"IEND":
            break
        else:
            f.seek(size + 4, 1)
    if not out:
        raise ValueError("no image header")
    return out


def _jpeg(f: BinaryIO) -> dict:
    out: dict = {"format": "JPEG"}
    while True:
        while (byte := f.read(1)) not in (b"\xff", b""):  # what stands between segments is passed over
            pass
        while (marker := f.read(1)) == b"\xff":  # fill bytes
            pass
        if not byte or not marker or marker in (b"\xd9", b"\xda"):
            raise ValueError("no frame header")
        if marker in (b"\0", b"\1") or b"\xd0" <= marker <= b"\xd8":
            continue
        size = int.from_bytes(f.read(2), "big") - 2
        if marker == b"\xe1":
            body = f.read(size)
            if body.startswith(b"Exif\0\0"):
                out |= exif(body[6:])
        elif b"\xc0" <= marker <= b"\xcf" and marker not in (b"\xc4", b"\xc8", b"\xcc"):
            _, height, width, parts = struct.unpack(">BHHB", f.read(6))
            return out | {"mode": {1: "L", 3: "RGB", 4: "CMYK"}[parts], "width": width, "height": height}
        else:
            f.seek(max(0, size), 1)


def pdf(path: str) -> Found:
    return metadata(path), []


def docx(path: str) -> Found:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = {}
    with zipfile.ZipFile(path) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{word}body")
        out["docx_paragraphs"] = len(body.findall(f"{word}p")) if body is not None else 0
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    values = {e.tag.rpartition("}")[2]: e.text or "" for e in core}
    for key, tag in (("title", "title"), ("author", "creator"), ("last_modified_by", "lastModifiedBy"), ("subject", "subject"), ("keywords", "keywords")):
        out[f"docx_{key}"] = values.get(tag, "")
    return out, []


def _number(value, kind, default):
    try:
        return kind(value)
    except (TypeError, ValueError):
        return default


def video(path: str, timeout: float = 60) -> Found:
    """By ffprobe; without it, duration and size from the boxes of an MP4 and a warning."""
    if not shutil.which("ffprobe"):
        return _boxes(path), ["ffprobe_not_found"]
    try:
        ran = subprocess.run(["ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return {}, ["ffprobe_failed_to_run"]
    if ran.returncode:
        return {}, ["ffprobe_nonzero_exit"]
    try:
        told = json.loads(ran.stdout)
    except ValueError:
        return {}, ["ffprobe_invalid_json"]
    streams = [x for x in told.get("streams") or [] if x.get("codec_type") == "video"]
    places = {"format": told.get("format") or {}, "stream": streams[0] if streams else None}
    return {key: _number(places[place].get(field) or kind(), kind, kind()) for key, place, field, kind in PROBED if places[place] is not None}, []


# A video's keys, where ffprobe has them and their kind; missing ones are the kind's zero.
PROBED = (
    ("video_duration", "format", "duration", float), ("video_format_name", "format", "format_name", str), ("video_codec", "stream", "codec_name", str), ("video_width", "stream", "width", int), ("video_height", "stream", "height", int),
)


def _boxes(path: str) -> dict:
    """From the headers of an MP4's boxes; the media itself isn't read."""
    out: dict = {}
    with open(path, "rb") as f:
        stack = [(0, f.seek(0, 2))]

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        while stack:
            at, end = stack.pop()
            while at + 8 <= end:
                size, kind = struct.unpack(">I4s", read(at, 8))
                head = 8
                if size == 1 and at + 16 <= end:
                    size, head = struct.unpack(">Q", read(at + 8, 8))[0], 16
                size = size or end - at
                if size < head or at + size > end and kind not in (b"moov", b"trak"):
                    break
                if kind in (b"moov", b"trak"):
                    stack.append((at + head, min(at + size, end)))
                elif kind == b"mvhd" and size >= head + 32:
                    version = read(at + head, 1)[0]  # 1: times of 64 bits
                    scale, length = struct.unpack(">IQ" if version else ">II", read(at + head + (20 if version else 12), 12 if version else 8))
                    out["video_duration"] = length / scale if scale else 0.0
                elif kind == b"tkhd" and size >= head + 8:
                    width, height = struct.unpack(">II", read(at + size - 8, 8))
                    if width:
                        out |= {"video_width": width >> 16, "video_height": height >> 16}
                at += size
    return out
