"""Small files through the Hadoop file system, so that any storage Spark reads can hold sources, manifests and databases."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Files up to this size are hashed on the executors, which hold them whole; larger ones are streamed by the driver's JVM.
HASHED_WHOLE = 512 << 20


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as readers report it."""
    fs, place = _place(spark, path)
    return fs.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole, in place of one that is there."""
    fs, place = _place(spark, path)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def hashes(spark: SparkSession, paths: list[str]) -> list[dict]:
    """path, bytes and SHA-256 of each file, in the order of paths."""
    names = {qualified(spark, p): p for p in paths}
    places = {name: _place(spark, p) for name, p in names.items()}
    sizes = {name: fs.getFileStatus(place).getLen() for name, (fs, place) in places.items()}
    found = {}
    small = [names[n] for n, size in sizes.items() if size <= HASHED_WHOLE]
    if small:
        rows = spark.read.format("binaryFile").load(small).select("path", F.sha2("content", 256).alias("sha256")).collect()
        found = {qualified(spark, r["path"]): r["sha256"] for r in rows}
    digest = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils
    for name in sizes.keys() - found.keys():
        fs, place = places[name]
        stream = fs.open(place)
        try:
            found[name] = digest.sha256Hex(stream)
        finally:
            stream.close()
    return sorted(({"path": p, "bytes": sizes[n], "sha256": found[n]} for n, p in names.items()), key=lambda r: r["path"])
