"""A minimal PNG writer for test images."""

import struct
import zlib

import numpy as np


def write_png(path, pixels):
    """``pixels``: height x width (grey) or height x width x 3 or 4, 8 bit."""
    a = np.asarray(pixels, np.uint8)
    kind = {2: 0, 3: 2, 4: 6}[a.ndim if a.ndim == 2 else a.shape[2] if a.shape[2] == 4 else 3]
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
