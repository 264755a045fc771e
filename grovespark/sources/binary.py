"""Optical-flow, disparity and pixel-map files by the binary source; each file is decoded by one row of a task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the tag that opens a flow file.
FLOW_TAG = 202021.25


def decode_flow(raw: bytes) -> np.ndarray:
    """(h, w, 2) of a flow file: tag, width, height, interleaved 32-bit u and v."""
    if np.frombuffer(raw, "<f4", 1)[0] != np.float32(FLOW_TAG):
        raise ValueError("not a flow file")
    w, h = np.frombuffer(raw, "<i4", 2, 4).tolist()
    return np.frombuffer(raw, "<f4", w * h * 2, 12).reshape(h, w, 2)


def encode_flow(flow: np.ndarray) -> bytes:
    h, w, _ = flow.shape
    return np.float32(FLOW_TAG).astype("<f4").tobytes() + np.array([w, h], "<i4").tobytes() + flow.astype("<f4").tobytes()


def decode_pfm(raw: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) of a float map: rows from the bottom, byte order by the sign of the scale."""
    m = re.match(rb"(P[Ff])\s+(\d+)\s+(\d+)\s+(\S+)\n", raw)
    if not m:
        raise ValueError("not a float map")
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"PF" else 1
    v = np.frombuffer(raw, "<f4" if float(m[4]) < 0 else ">f4", w * h * depth, m.end())
    return v.reshape((h, w, 3) if depth == 3 else (h, w))[::-1]


def encode_pfm(values: np.ndarray) -> bytes:
    h, w = values.shape
    return f"Pf\n{w} {h}\n-1.0\n".encode() + values[::-1].astype("<f4").tobytes()


def decode_pnm(raw: bytes) -> np.ndarray:
    """(h, w) of a grey or (h, w, 3) of a colour pixel map, binary form."""
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    if not m:
        raise ValueError("not a binary pixel map")
    w, h, top = int(m[2]), int(m[3]), int(m[4])
    shape = (h, w, 3) if m[1] == b"P6" else (h, w)
    return np.frombuffer(raw, np.uint8 if top < 256 else ">u2", int(np.prod(shape)), m.end()).reshape(shape)


def encode_pnm(values: np.ndarray) -> bytes:
    h, w = values.shape[:2]
    return f"P{6 if values.ndim == 3 else 5}\n{w} {h}\n255\n".encode() + values.astype(np.uint8).tobytes()


def _pixels(spark: SparkSession, path: str, decode, names: list[str]) -> DataFrame:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f["path"], f["content"]):
                v = decode(bytes(raw))
                v = v.reshape(*v.shape[:2], -1)
                for j in range(v.shape[0]):  # a frame a row of pixels
                    yield pd.DataFrame({"path": p, "i": np.arange(v.shape[1]), "j": j} | {n: v[j, :, k].astype(float) for k, n in enumerate(names)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, i long, j long, " + ", ".join(f"{n} double" for n in names))


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    return _pixels(spark, path, decode_flow, ["u", "v"])


def read_pfm(spark: SparkSession, path: str) -> DataFrame:
    return _pixels(spark, path, decode_pfm, ["v"])


def read_grey(spark: SparkSession, path: str) -> DataFrame:
    return _pixels(spark, path, decode_pnm, ["v"])


def read_colour(spark: SparkSession, path: str) -> DataFrame:
    return _pixels(spark, path, decode_pnm, ["r", "g", "b"])


def encoded(grid: DataFrame, group: str, encode, names: list[str]) -> DataFrame:
    """(group, content): the file of each image (group, i, j, names); an image is a unit of the format, so one task holds it."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((int(f["j"].max()) + 1, int(f["i"].max()) + 1, len(names)))
        v[f["j"].astype(int), f["i"].astype(int)] = f[names]
        return pd.DataFrame({group: [f[group].iloc[0]], "content": [encode(v if len(names) > 1 else v[:, :, 0])]})

    return grid.groupBy(group).applyInPandas(one, f"{group} string, content binary")
