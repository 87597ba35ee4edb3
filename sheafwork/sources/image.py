"""Images: what their headers say."""

from __future__ import annotations

import struct
from typing import Any

from .model import asset, block, document


def size_of(data: bytes) -> tuple[str, int | None, int | None]:
    """(format, width, height); None where the header does not say."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("PNG", *struct.unpack(">II", data[16:24]))
    if data[:4] == b"GIF8" and len(data) >= 10:
        return ("GIF", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "WEBP", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return ("WEBP", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30])))
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return "JPEG", None, None
    if data[:4] in (b"II*\x00", b"MM\x00*") and len(data) >= 8:
        end = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(end + "I", data[4:8])[0]
        found: dict[int, int] = {}
        for k in range(struct.unpack(end + "H", data[at : at + 2])[0] if at + 2 <= len(data) else 0):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) == 12:
                tag, kind = struct.unpack(end + "HH", entry[:4])
                found[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
        return "TIFF", found.get(256), found.get(257)
    return "unknown", None, None


def parse_image(data: bytes, name: str, options: Any) -> dict[str, Any]:
    from .mail import size

    kind, w, h = size_of(data)
    facts = [("Format", kind), ("Size", size(len(data)))] + ([("Dimensions", f"{w}x{h}")] if w and h else [])
    base = name.rpartition("/")[2] or "image"
    return document([block("key_values", kv=facts)], base, "filename", {"format": kind, "width": w, "height": h}, ["Text in images is not read; character recognition is not available."], [asset(1, base, f"image/{kind.lower()}", data, w, h)])
