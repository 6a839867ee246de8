"""Windows as PNG plots without a drawing library: the same series always gives the same bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

WIDTH, HEIGHT, EDGE = 640, 240, 12


def line_png(x, width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """A line plot of a series, dark on white."""
    x = np.asarray(x, float)
    x = np.where(np.isfinite(x), x, np.nan)
    image = np.full((height, width), 255, np.uint8)
    if np.isfinite(x).any():
        low, high = np.nanmin(x), np.nanmax(x)
        cols = np.arange(EDGE, width - EDGE)
        at = np.interp(np.linspace(0, max(len(x) - 1, 0), len(cols)), np.flatnonzero(np.isfinite(x)), x[np.isfinite(x)])
        rows = np.rint((height - 1 - EDGE) - (at - low) / ((high - low) or 1) * (height - 1 - 2 * EDGE)).astype(int)
        for c, a, b in zip(cols[1:], rows[:-1], rows[1:], strict=True):
            image[min(a, b) : max(a, b) + 1, c] = 30
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + r.tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def plot(x: pd.Series) -> pd.Series:
    return x.map(line_png)
