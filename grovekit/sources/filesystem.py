"""Directories as files of a tree, archives of trees, and the layout of stored objects."""

from __future__ import annotations

import io
import os
import tarfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors

#: Names at the top that a scan leaves out.
SKIPPED = (".git",)
#: Fixed: modes of directories, executable files and other files in archives.
MODES = (0o755, 0o755, 0o644)


def scan(spark: SparkSession, root: str, modes: DataFrame | None = None, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, id, exec, size, content) of every file below `root`, which any of Spark's file systems may hold.

    Modes (path, mode) tell which are executable (any of the three bits); Spark's
    listing doesn't. Empty directories are no files. Spark's reader leaves out empty
    files and hidden names: the former are added, the latter raise, so that none
    is lost in silence. Names come to the driver for that.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    every, each = {}, fs.listFiles(top, True)
    while each.hasNext():
        one = each.next()
        path = one.getPath().toUri().getPath()[len(base) :]
        if path.split("/")[0] not in skip:
            every[path] = one.getLen()
    hidden = sorted(p for p, n in every.items() if n and any(x.startswith((".", "_")) for x in p.split("/")))
    if hidden:
        raise ValueError(f"hidden names can't be read: {hidden[:32]}")
    empty = spark.createDataFrame([(p, 0, b"") for p, n in every.items() if not n], "path string, size long, content binary").withColumn("id", F.sha2("content", 256))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rows = rows.select(F.substr(plain, F.lit(len(base) + 1), F.length("path")).alias("path"), F.sha2("content", 256).alias("id"), F.col("length").alias("size"), "content")
    rows = rows.filter(~F.split("path", "/")[0].isin(*skip)) if skip else rows
    rows = rows.filter("size > 0").unionByName(empty)
    if modes is None:
        return rows.select("path", "id", F.lit(False).alias("exec"), "size", "content")
    told = modes.select("path", (F.col("mode").bitwiseAND(0o111) != 0).alias("exec"))
    return rows.join(told, "path", "left").select("path", "id", F.coalesce("exec", F.lit(False)).alias("exec"), "size", "content")


def tar_entries(files: DataFrame) -> DataFrame:
    """(path, kind, mode int, size) of an archive of files (path, exec, size): each directory once, and the files; sort by split(path, '/')."""
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).filter("path <> ''").distinct()
    told = files.select("path", F.lit("blob").alias("kind"), F.when(F.col("exec"), MODES[1]).otherwise(MODES[2]).alias("mode"), F.col("size").cast("long").alias("size"))
    return told.unionByName(dirs.select("path", F.lit("tree").alias("kind"), F.lit(MODES[0]).alias("mode"), F.lit(0).cast("long").alias("size")))


def write_tar(files: DataFrame, to: str) -> int:
    """Write files (path, exec, size, content) as one archive, the same bytes for the same files; the number of entries.

    An archive is one stream, so rows come to the driver one partition at a time in
    order of their path's components; the archive appears when it is whole.
    """
    rows = tar_entries(files).join(files.select("path", "content"), "path", "left").orderBy(F.split("path", "/"))
    part, n = f"{to}.{uuid.uuid4().hex}", 0
    with tarfile.open(part, "w", format=tarfile.GNU_FORMAT) as tar:
        for n, r in enumerate(rows.toLocalIterator(), 1):
            info = tarfile.TarInfo(r.path + "/" * (r.kind == "tree"))
            info.type, info.mode = tarfile.DIRTYPE if r.kind == "tree" else tarfile.REGTYPE, r.mode
            info.size = r.size
            tar.addfile(info, io.BytesIO(r.content) if r.kind == "blob" else None)
    with open(part, "rb") as done:
        os.fsync(done.fileno())
    os.replace(part, to)
    return n


def layout_audit(paths: DataFrame, top: str = "objects") -> DataFrame:
    """(code, resource): files (path) that lie where no object does: too high or too deep, under a name that is no id, or in the wrong shard."""
    rows = paths.filter(F.startswith("path", F.lit(top + "/"))).select("path", F.split("path", "/").alias("p")).withColumn("n", F.size("p"))
    name = F.get("p", F.lit(3))
    deep = F.array_join(F.slice("p", 1, 4), "/")
    code = F.when(F.col("n") != 4, "OBJECT_LAYOUT").when(~name.rlike("^[0-9a-f]{64}$"), "OBJECT_NAME")
    code = code.when((F.get("p", F.lit(1)) != F.substring(name, 1, 2)) | (F.get("p", F.lit(2)) != F.substring(name, 3, 2)), "OBJECT_SHARD")
    return rows.select(code.alias("code"), F.when(F.col("n") > 4, deep).otherwise(F.col("path")).alias("resource")).filter("code is not null").distinct()
