"""Width and height of images, from their first bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _jpeg(b: bytes) -> tuple[int, int]:
    """Segments follow on each other; a frame segment (C0 to CF but C4, C8, CC) has the size."""
    at = 2
    while at + 9 <= len(b) and b[at] == 0xFF:
        kind, (length,) = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        at += 2 + length
    return 0, 0


def size(b: bytes | None) -> tuple[int, int]:
    """(width, height) of a PNG, GIF, BMP or JPEG image; (0, 0) if it is none of them or cut."""
    b = b or b""
    if b.startswith(b"\x89PNG\r\n\x1a\n") and len(b) >= 24:
        return struct.unpack(">II", b[16:24])
    if b.startswith((b"GIF87a", b"GIF89a")) and len(b) >= 10:
        return struct.unpack("<HH", b[6:10])
    if b.startswith(b"BM") and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return w, abs(h)
    return _jpeg(b) if b.startswith(b"\xff\xd8") else (0, 0)


def size_of(content: Column) -> Column:
    """A struct (width, height)."""

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([size(b) for b in batch], columns=["width", "height"])

    run.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "width int, height int")(content)
