"""Audio-file catalogs from wave headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# chunks walked at first, and before the number of steps is taken from the file's size
FEW_CHUNKS, MORE_CHUNKS = 4, 32


def _int(content: Column, at: Column, size: int) -> Column:
    """Little-endian unsigned integer at a byte offset (from 0)."""
    digits = F.hex(F.substring(content, at + 1, F.lit(size)))
    high_first = [F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]
    return F.conv(F.concat(*high_first), 16, 10).cast("long")


def _chunks(content: Column, steps: Column) -> Column:
    """Places of the ``fmt`` and ``data`` chunks, found by going from chunk to chunk by their sizes."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(12).cast("long").alias("at"), none.alias("fmt"), none.alias("data"), F.lit(False).alias("over"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"].cast("int")
        name, size = F.substring(content, at + 1, F.lit(4)).cast("string"), _int(content, at + 4, 4)
        inside = ~acc["over"] & (acc["at"] + 8 <= F.length(content))
        fmt = F.when(inside & (name == "fmt "), acc["at"] + 8).otherwise(acc["fmt"])
        data = F.when(inside & (name == "data") & acc["data"].isNull(), acc["at"] + 8).otherwise(acc["data"])
        # chunks are padded to an even size
        return F.struct(
            F.when(inside, acc["at"] + 8 + size + size % 2).otherwise(acc["at"]).alias("at"),
            fmt.alias("fmt"), data.alias("data"), (~inside | (fmt.isNotNull() & data.isNotNull())).alias("over"),
        )

    return F.aggregate(F.sequence(F.lit(1), steps), start, step)


def parse_audio(files: DataFrame) -> DataFrame:
    """Add sample_rate, channels, sample_width and n_frames from ``content``; unreadable files have 0 frames.

    Other chunks (LIST, JUNK, ...) of any size and content may stand before the two that count.
    """
    content = F.col("content")
    riff = (F.substring(content, 1, 4).cast("string") == "RIFF") & (F.substring(content, 9, 4).cast("string") == "WAVE")
    # a generated row holds the places, so that what uses them several times does not walk again
    few = F.when(F.coalesce(riff, F.lit(False)), _chunks(content, F.lit(FEW_CHUNKS)))
    rows = files.withColumn("_first", F.explode(F.array(few)))
    more = F.when(F.col("_first.over"), F.col("_first")).otherwise(_chunks(content, F.lit(MORE_CHUNKS)))
    rows = rows.withColumn("_few", F.explode(F.array(F.when(F.col("_first").isNotNull(), more))))
    # files with very many chunks are walked to their end
    full = F.when(F.col("_few.over"), F.col("_few")).otherwise(_chunks(content, (F.length(content) / 8).cast("int") + 1))
    rows = rows.withColumn("_c", F.explode(F.array(F.when(F.col("_few").isNotNull(), full))))
    fmt, data = F.col("_c.fmt").cast("int"), F.col("_c.data").cast("int")
    rows = rows.withColumns({"_bytes": _int(content, data - 4, 4), "_align": _int(content, fmt + 12, 2)})
    known = F.coalesce(fmt.isNotNull() & data.isNotNull() & (F.col("_align") > 0), F.lit(False))
    frames = F.expr("_bytes div _align")
    return rows.select(
        *[c for c in files.columns if c != "content"],
        F.when(known, _int(content, fmt + 4, 4).cast("int")).alias("sample_rate"),
        F.when(known, _int(content, fmt + 2, 2).cast("int")).alias("channels"),
        F.when(known, (_int(content, fmt + 14, 2) / 8).cast("int")).alias("sample_width"),
        F.coalesce(F.when(known, frames), F.lit(0)).alias("n_frames"),
    )


def audio_catalog(headers: DataFrame) -> DataFrame:
    """(speaker, utt_id, n_frames, sample_rate, duration) of ``<speaker>/<utt>.wav`` paths; unreadable files are dropped.

    ``headers`` are those of :func:`read_headers` or :func:`parse_audio`.
    """
    path = F.col("path")
    pattern = "([^/]+)/([^/]+)\\.wav$"
    return (
        headers.filter("n_frames > 0 AND sample_rate > 0")
        .select(
            F.regexp_extract(path, pattern, 1).alias("speaker"),
            F.regexp_extract(path, pattern, 2).alias("utt_id"),
            "path",
            "n_frames",
            "sample_rate",
            "channels",
            "sample_width",
            (F.col("n_frames") / F.col("sample_rate")).alias("duration"),
        )
    )


def list_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, relative) of the files below a folder, without reading them."""
    files = _files(spark, root, pattern)
    base = root.rstrip("/") + "/"
    return files.select("path", F.substring_index("path", base, -1).alias("relative"))


def _files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def open_range(path: str) -> pa.NativeFile:
    """A file of a store that Arrow reaches, for reading parts of it; ``path`` is as Spark lists it."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, below = rest.removeprefix("//").split("/", 1)
    if scheme in ("s3", "s3a"):
        return pafs.FileSystem.from_uri(f"s3://{host}")[0].open_input_file(f"{host}/{below}")
    return pafs.FileSystem.from_uri(f"{scheme}://{host}/")[0].open_input_file(f"{'' if scheme == 'hdfs' else host}/{below}")


# stores that Arrow reads by range
RANGED = ("file", "hdfs", "s3", "s3a", "gs")
_HEADER = "sample_rate int, channels int, sample_width int, n_frames long"


def wave_header(file: pa.NativeFile) -> tuple[int | None, int | None, int | None, int, int]:
    """Rate, channels, bytes a sample, frames, and how many bytes were read: the heads of the chunks up to format and data.

    A file without either has 0 frames and no rate. Chunks of any size are passed over unread.
    """
    size = file.size()
    head = file.read(12)
    read, at, form, data = len(head), 12, None, None
    while head[:4] == b"RIFF" and head[8:12] == b"WAVE" and at + 8 <= size and (form is None or data is None):
        file.seek(at)
        # the format's fields stand behind the head of their chunk
        chunk = file.read(24)
        read += len(chunk)
        name, length = chunk[:4], int.from_bytes(chunk[4:8], "little")
        if name == b"fmt " and len(chunk) == 24:
            form = struct.unpack_from("<HHIIHH", chunk, 8)
        elif name == b"data" and data is None:
            data = length
        # chunks are padded to an even size
        at += 8 + length + length % 2
    if form is None or data is None or not form[4]:
        return None, None, None, 0, read
    return form[2], form[1], form[5] // 8, data // form[4], read


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, sample_rate, channels, sample_width, n_frames) of the wave files below a folder.

    Spark lists the files, and each task reads some hundred bytes of its own, however long they are. In stores that Arrow
    does not reach the files are read whole by Spark, which holds up to 2 GB each. Unreadable files have 0 frames.
    """
    files = _files(spark, root)
    relative = F.substring_index("path", root.rstrip("/") + "/", -1).alias("relative")
    some = files.select("path").first()
    if some is not None and some["path"].split(":", 1)[0] not in RANGED:
        return parse_audio(files.select("path", relative, "content"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with open_range(path) as file:
                    rows.append(wave_header(file)[:4])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["path", "relative", "sample_rate", "channels", "sample_width", "n_frames"]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("relative"), *found], names=names)

    return files.select("path", relative).mapInArrow(scan, f"path string, relative string, {_HEADER}")


def read_audio_catalog(spark: SparkSession, root: str) -> DataFrame:
    return audio_catalog(read_headers(spark, root))
