"""Well-known binary of polygons."""

from __future__ import annotations

import struct

import numpy as np


def rings_of(wkb: bytes) -> list[np.ndarray]:
    """All rings (n, 2) of a multipolygon's polygons, outer ones before their holes."""
    (n,), at, out = struct.unpack_from("<I", wkb, 5), 9, []
    for _ in range(n):
        (k,) = struct.unpack_from("<I", wkb, at + 5)
        at += 9
        for _ in range(k):
            (m,) = struct.unpack_from("<I", wkb, at)
            out.append(np.frombuffer(wkb, "<f8", 2 * m, at + 4).reshape(-1, 2))
            at += 4 + 16 * m
    return out
