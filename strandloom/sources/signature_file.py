"""Binary files of genomic signatures, and grey images (P5 PGM)."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

NAME_BYTES = 180
_HEADER = struct.Struct(f"<{NAME_BYTES}s4I")


def encode(name: str, k: int, x, y, n) -> bytes:
    """Name, k, both sides, number of words, then the square of 32-bit counts, which
    has n at (x, y)."""
    square = np.zeros((2**k, 2**k), "<i4")
    square[x, y] = n
    return _HEADER.pack(name.encode()[:NAME_BYTES], k, 2**k, 2**k, int(square.sum())) + square.tobytes()


def decode(data: bytes) -> tuple[str, int, int, np.ndarray]:
    """Name, k, number of words and the square."""
    name, k, dim_x, dim_y, words = _HEADER.unpack_from(data)
    side = dim_x or 2**k
    if len(data) < _HEADER.size + 4 * side * side:
        raise ValueError("the signature file is incomplete")
    square = np.frombuffer(data, "<i4", side * side, _HEADER.size).reshape(side, side)
    return name.rstrip(b"\0").decode(), k, words, square


def read_signature(spark: SparkSession, path: str) -> DataFrame:
    """path, word_count, x, y, n of the cells that aren't 0, of all files."""

    def cells(batches):
        import pandas as pd

        for files in batches:
            for p, data in zip(files["path"], files["content"]):
                _, _, words, square = decode(bytes(data))
                x, y = square.nonzero()
                yield pd.DataFrame({"path": p, "word_count": words, "x": x.astype("int32"), "y": y.astype("int32"), "n": square[x, y].astype("int64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, word_count bigint, x int, y int, n bigint")


def pgm(row: np.ndarray, col: np.ndarray, grey: np.ndarray) -> bytes:
    """The image with these points, at most 4**k or 128 by 128 of them."""
    side = int(row.max(initial=-1)) + 1
    image = np.zeros((side, side), np.uint8)
    image[row, col] = grey
    return f"P5\n{side} {side}\n255\n".encode() + image.tobytes()
