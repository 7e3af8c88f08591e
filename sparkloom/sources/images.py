"""Image sets: IDX and CIFAR binary files, and PNG folders."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.columns import gray

SCHEMA = "id long, label string, shape array<int>, pixels array<double>"
#: Magic numbers of IDX images and labels, and sizes of CIFAR-10 records.
IDX_IMAGES, IDX_LABELS = 2051, 2049
CIFAR_SIDE, CIFAR_PLANE = 32, 1024
CIFAR_NAMES = ("airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck")


def idx_images(content: bytes) -> np.ndarray:
    magic, n, rows, columns = struct.unpack_from(">IIII", content)
    if magic != IDX_IMAGES:
        raise ValueError("no IDX image file")
    return np.frombuffer(content, np.uint8, n * rows * columns, 16).reshape(n, rows, columns)


def idx_labels(content: bytes) -> np.ndarray:
    magic, n = struct.unpack_from(">II", content)
    if magic != IDX_LABELS:
        raise ValueError("no IDX label file")
    return np.frombuffer(content, np.uint8, n, 8)


def read_idx(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """id, label, shape, pixels of a pair of IDX files; a file is the unit of work."""

    def rows(batches, parse, name):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                found = parse(content)
                for at in range(0, len(found), 1000):
                    part = found[at : at + 1000]
                    if name == "label":
                        yield pd.DataFrame({"id": np.arange(at, at + len(part)), "label": part.astype(str)})
                    else:
                        yield pd.DataFrame({"id": np.arange(at, at + len(part)), "shape": [list(part.shape[1:])] * len(part), "pixels": list(part.reshape(len(part), -1).astype(float))})

    file = lambda path: spark.read.format("binaryFile").load(path).select("content")
    pictures = file(images).mapInPandas(lambda b: rows(b, idx_images, "pixels"), "id long, shape array<int>, pixels array<double>")
    names = file(labels).mapInPandas(lambda b: rows(b, idx_labels, "label"), "id long, label string")
    return pictures.join(names, "id").select("id", "label", "shape", "pixels")


def read_cifar(spark: SparkSession, path: str, names=CIFAR_NAMES) -> DataFrame:
    """The binary layout: a label byte, then planes of red, green and blue. Pickled batches aren't read: unpickling
    runs code."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                data = np.frombuffer(content, np.uint8).reshape(-1, 1 + 3 * CIFAR_PLANE)
                pixels = data[:, 1:].reshape(-1, 3, CIFAR_SIDE, CIFAR_SIDE).transpose(0, 2, 3, 1).reshape(len(data), -1).astype(float)
                base = zlib.crc32(file.encode()) << 20
                yield pd.DataFrame({"id": base + np.arange(len(data)), "label": [names[i] for i in data[:, 0]], "shape": [[CIFAR_SIDE, CIFAR_SIDE, 3]] * len(data), "pixels": list(pixels)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, SCHEMA)


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of a grey (h, w) or colour (h, w, 3) image."""
    pixels = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.hstack([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)]).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_pngs(images: DataFrame, folder: str) -> None:
    """One file {id}_{label}.png for each row, written by the tasks; folder is a path that all executors share."""
    from pyspark.sql import Row

    def run(rows: list[Row]):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{base}/{row.id}_{row.label}.png") as out:
                out.write(png(np.array(row.pixels).reshape(row.shape)))

    images.select("id", "label", "shape", "pixels").foreachPartition(run)


def read_pngs(spark: SparkSession, folder: str) -> DataFrame:
    """id, label, shape, pixels of files {id}_{label}.png; Spark's image reader gives blue, green, red."""
    raw = spark.read.format("image").load(folder).select("image.*")
    name = F.regexp_extract("origin", r"(\d+)_([^/]*)\.png$", 1), F.regexp_extract("origin", r"(\d+)_([^/]*)\.png$", 2)

    def turn(batches):
        import pandas as pd

        for pdf in batches:
            shapes = [[h, w] if c == 1 else [h, w, c] for h, w, c in zip(pdf["height"], pdf["width"], pdf["nChannels"], strict=True)]
            flip = [np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, ::-1].reshape(-1).astype(float) for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "shape": shapes, "pixels": flip})

    return raw.select(name[0].cast("long").alias("id"), name[1].alias("label"), "height", "width", "nChannels", "data").mapInPandas(turn, SCHEMA)


def to_gray(pixels: str, count: int) -> Column:
    """Brightness of `count` colour pixels that stand one after another in an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: gray(F.slice(pixels, i * 3 + 1, 3)))
