"""File catalogs, tar archives, content sniffing and verification."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions import paths

#: Fixed values: (offset, bytes, format) of formats that are compressed already.
SIGNATURES = [
    (0, b"\x1f\x8b", "gzip"),
    (0, b"\x28\xb5\x2f\xfd", "zstd"),
    (0, b"\xfd7zXZ\x00", "xz"),
    (0, b"BZh", "bzip2"),
    (0, b"\x04\x22\x4d\x18", "lz4"),
    (0, b"PK\x03\x04", "zip"),
    (0, b"7z\xbc\xaf\x27\x1c", "7z"),
    (0, b"Rar!\x1a\x07", "rar"),
    (0, b"\x89PNG\r\n\x1a\n", "png"),
    (0, b"\xff\xd8\xff", "jpeg"),
    (0, b"GIF8", "gif"),
    (0, b"OggS", "ogg"),
    (0, b"fLaC", "flac"),
    (8, b"WEBP", "webp"),
    (4, b"ftyp", "mp4"),
    (0, b"wOFF", "woff"),
    (0, b"wOF2", "woff2"),
]
#: Leading bytes that are looked at, smallest member that counts, and the percentage that makes an archive compressed.
HEAD_BYTES, LEAST_MEMBER, COMPRESSED_PERCENT = 12, 4096, 90


def file_catalog(spark: SparkSession, root: str, pattern: str = "**") -> DataFrame:
    """(path, size, mtime_ns) of the files under root, by Spark's own listing; the walk starts at the pattern's literal prefix."""
    start = paths.literal_prefix(pattern)
    where = f"{root.rstrip('/')}/{start}" if start and start != pattern else root
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path", "length", "modificationTime")
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    inside = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(root.rstrip('/')) + 2})")
    out = listed.select(inside.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), bare.alias("full_path"))
    return out.where(paths.matches_glob("path", pattern)).drop("full_path")


def glob(files: DataFrame, include: str, exclude: tuple[str, ...] = (), package: str = "") -> DataFrame:
    """Paths relative to package that match include and none of exclude."""
    inside = files.where(paths.has_prefix("path", package))
    rel = F.substring("path", len(package) + 2 if package else 1, 1 << 30)
    out = inside.select(rel.alias("path")).where(paths.matches_glob("path", include))
    for pattern in exclude:
        out = out.where(~paths.matches_glob("path", pattern))
    return out


def parent_with(packages: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(package, parent): the file of that bare name in the package or the nearest directory above it, or null."""
    if "/" in name or not name:
        raise ValueError("a bare file name is needed")
    up = packages.select("package").distinct().select("package", F.explode(paths.ancestors("package")).alias("dir"))
    held = files.where(paths.basename("path") == name).select(F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), "/$", "").alias("dir")).distinct().withColumn("_held", F.lit(True))
    found = up.join(held, "dir", "left").groupBy("package")
    at = found.agg(F.max_by(F.when(F.col("_held"), F.col("dir")), F.when(F.col("_held"), paths.depth("dir"))).alias("dir"))
    return at.select("package", F.when(F.col("dir") == "", F.lit(name)).otherwise(F.concat("dir", F.lit(f"/{name}"))).alias("parent"))


def ignored(path: Column | str, dirs: tuple[str, ...] = (), globs: tuple[str, ...] = ()) -> Column:
    """Whether a path is in one of the directories or matches one of the globs."""
    out = F.lit(False)
    for d in dirs:
        out = out | paths.has_prefix(path, d)
    for g in globs:
        out = out | paths.matches_glob(path, g)
    return out


def sniff(content: Column | str) -> Column:
    """The compressed format that binary content starts as, or null."""
    head = F.hex(F.substring(content, 1, HEAD_BYTES))
    return F.coalesce(*(F.when(F.substring(head, 2 * at + 1, 2 * len(magic)) == magic.hex().upper(), F.lit(kind)) for at, magic, kind in SIGNATURES))


def archive_verdicts(archives: DataFrame) -> DataFrame:
    """(archive, incompressible_bytes, dominant, precompressed) of tar archives (path, content): members of LEAST_MEMBER bytes and
    more that start as a compressed format, against the whole archive; what is no archive isn't precompressed."""
    kinds = tar_entries(archives).where(F.col("size") >= LEAST_MEMBER).withColumn("kind", sniff("head")).where("kind is not null")
    sums = kinds.groupBy("archive", "kind").agg(F.sum("size").alias("bytes"))
    sums = sums.groupBy("archive").agg(F.sum("bytes").alias("incompressible_bytes"), F.max_by("kind", F.struct("bytes", "kind")).alias("dominant"))
    whole = archives.select(F.col("path").alias("archive"), F.length("content").alias("all_bytes"))
    held = F.coalesce("incompressible_bytes", F.lit(0))
    enough = (F.col("all_bytes") > 0) & (held * 100 >= F.col("all_bytes").cast("long") * COMPRESSED_PERCENT)
    return whole.join(sums, "archive", "left").select("archive", held.alias("incompressible_bytes"), "dominant", enough.alias("precompressed"))


def verified(content: Column, sha256: Column) -> Column:
    return F.lower(sha256) == F.sha2(content, 256)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarSource(DataSource):
    """spark.dataSource.register(TarSource); spark.read.format("tar_index").load(path): the entries of archives, one partition
    each, headers only: archive, name, size, offset, kind. Paths are comma-separated and local to the workers."""

    @classmethod
    def name(cls) -> str:
        return "tar_index"

    def schema(self) -> str:
        return "archive string, name string, size long, offset long, kind string"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options.get("path", ""))


class _TarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.path.split(",") if p]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        with tarfile.open(partition.path) as tar:
            for e in tar:
                kind = "file" if e.isfile() else "dir" if e.isdir() else "link" if e.issym() or e.islnk() else "other"
                yield partition.path, e.name, e.size, e.offset_data, kind


def tar_entries(archives: DataFrame) -> DataFrame:
    """The files in archives that Spark has read as (path, content), with their leading bytes, for stores that only Spark
    reaches; nothing for what is no archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                content = bytes(content or b"")
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as tar:
                        rows = [(path, e.name, e.size, e.offset_data, content[e.offset_data : e.offset_data + min(e.size, HEAD_BYTES)]) for e in tar if e.isfile()]
                except tarfile.TarError:
                    rows = []
                yield pd.DataFrame(rows, columns=["archive", "name", "size", "offset", "head"])

    return archives.select("path", "content").mapInPandas(run, "archive string, name string, size long, offset long, head binary")
