"""Size, row count and checksum of every written file."""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator, Mapping
from functools import reduce
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sinks.csvfiles import CsvOptions

BLOCK_BYTES = 1 << 20

# How the compressions that Spark writes are undone block by block.
_DECODERS = {
    None: None,
    "none": None,
    "uncompressed": None,
    "gzip": lambda: zlib.decompressobj(31),
    "deflate": lambda: zlib.decompressobj(15),
    "bzip2": bz2.BZ2Decompressor,
}


def stored_file(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a file, and the file's name there.

    Spark names files by URI, which escapes some characters and leaves others
    (``größe``, ``a b``) as they are.  The store follows from scheme and host
    alone; the name is the decoded path.
    """
    parts = urlsplit(uri)
    name = unquote(parts.path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), name
    store, root = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
    return store, f"{root.rstrip('/')}{name}"


def _blocks(path: str) -> Iterator[bytes]:
    store, name = stored_file(path)
    with store.open_input_stream(name, compression=None) as stream:
        while block := stream.read(BLOCK_BYTES):
            yield block


class _LineCounter:
    """Line ends outside quotes; a doubled quote opens and closes at once."""

    def __init__(self, quote: str):
        self.quote, self.lines, self.inside, self.last = ord(quote), 0, 0, 10

    def feed(self, block: bytes) -> None:
        data = np.frombuffer(block, np.uint8)
        if len(data):
            depth = (np.cumsum(data == self.quote) + self.inside) & 1
            self.lines += int(((data == 10) & (depth == 0)).sum())
            self.inside, self.last = int(depth[-1]), int(data[-1])

    @property
    def total(self) -> int:
        return self.lines + (self.last != 10)


def _describe(path: str, options: CsvOptions) -> tuple[int, str, int, bool]:
    """Bytes, SHA-256, rows below the header, and whether a byte order mark leads, in one read."""
    digest, size, counter, head = hashlib.sha256(), 0, _LineCounter(options.quote), b""
    decoder = _DECODERS[options.compression]
    decode = decoder() if decoder else None
    for block in _blocks(path):
        digest.update(block)
        size += len(block)
        text = decode.decompress(block) if decode else block
        head = head or text[:3]
        counter.feed(text)
    return size, digest.hexdigest(), max(0, counter.total - 1), head == b"\xef\xbb\xbf"


def file_facts(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """``filepath, filesize, checksum, row_count, marked`` of every part file of one dataset.

    Each file is read once, a block at a time, by the task that describes it;
    only its path passes through the plan, so its size does not matter.
    """
    if options.compression not in _DECODERS:
        raise ValueError(f"cannot count rows of files compressed as {options.compression}")

    def describe(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            facts = [_describe(p, options) for p in paths]
            columns = [pa.array([f[i] for f in facts], t) for i, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *columns], names=["filepath", *_NAMES])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.col("_metadata.file_path").alias("filepath")).mapInArrow(
        describe, "filepath string, filesize bigint, checksum string, row_count bigint, marked boolean"
    )


_NAMES = ("filesize", "checksum", "row_count", "marked")
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.bool_())


def file_manifest(
    spark: SparkSession, outputs: Mapping[str, str], options: CsvOptions = CsvOptions()
) -> DataFrame:
    """``entity_name, filepath, filename, filesize, row_count, checksum``.

    ``outputs`` maps an entity to its directory.  Rows are counted from the
    files as written, the checksum is SHA-256 of the file's bytes.
    """

    def one(entity: str, path: str) -> DataFrame:
        return file_facts(spark, path, options).select(
            F.lit(entity).alias("entity_name"),
            "filepath",
            F.element_at(F.split("filepath", "/"), -1).alias("filename"),
            "filesize",
            "row_count",
            "checksum",
        )

    return reduce(DataFrame.unionByName, (one(e, p) for e, p in outputs.items()))
