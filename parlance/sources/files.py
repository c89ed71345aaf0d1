"""Files of a workspace: listed on the driver through Hadoop's file systems, read by Spark. Paths are relative to a root."""

from __future__ import annotations

import posixpath
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import OFFICE_KINDS, detect_kind
from ..operators.discover import SKIPPED_FOLDERS, in_locale

LISTING = "path string, type string, length long, reason string"
CANONICAL = "terms array<struct<source: string, target: string, notes: string, origin: string>>"


def contained(path: str) -> str:
    """path in normal form, relative to the root; ValueError if it leads out of it."""
    out = posixpath.normpath(path.replace("\\", "/")).lstrip("/") or "."
    if out == ".." or out.startswith("../"):
        raise ValueError(f"{path!r} leads out of the workspace")
    return out


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def qualified(spark: SparkSession, root: str) -> str:
    return _open(spark, root)[1].toString().rstrip("/")


def store_uri(spark: SparkSession, root: str) -> str:
    """root as pyarrow names it."""
    base = qualified(spark, root)
    return "file://" + base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors see; a temporary one on one machine alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return shared or tempfile.gettempdir()


def exists(spark: SparkSession, root: str, path: str, folder: bool = False) -> bool:
    fs, p = _open(spark, f"{root}/{contained(path)}")
    return fs.exists(p) and fs.getFileStatus(p).isDirectory() == folder


def require(spark: SparkSession, root: str, path: str, label: str, folder: bool = False) -> None:
    if not exists(spark, root, path, folder):
        raise FileNotFoundError(f"{label} not found: {path!r} under {root!r}")


def list_tree(spark: SparkSession, root: str, path: str = ".", recursive: bool = True) -> DataFrame:
    """path, type, length and reason of what lies in a folder. reason is null, or says why a file or folder is passed over.

    Folders that discovery skips are named, not entered; a folder that cannot be read is recorded. One call to the file
    system for each folder: meant for projects, whose listing fits the driver; tables are read by Spark itself.
    """
    rows: list[tuple[str, str, int | None, str | None]] = []
    waiting = [contained(path)]
    for folder in waiting:
        try:
            fs, p = _open(spark, f"{root}/{folder}")
            found = list(fs.listStatus(p))
        except Exception as e:  # py4j's own type, whatever the file system raised
            rows.append((folder, "directory", None, f"unreadable: {type(e).__name__}"))
            continue
        for s in found:
            name = s.getPath().getName()
            own = name if folder == "." else f"{folder}/{name}"
            if s.isDirectory():
                skipped = name in SKIPPED_FOLDERS or name.startswith(".")
                rows.append((own, "directory", None, "skipped folder" if skipped else None))
                if recursive and not skipped:
                    waiting.append(own)
            else:
                rows.append((own, "file", s.getLen(), "hidden file" if name.startswith(".") else None))
    return spark.createDataFrame(rows, LISTING).orderBy(in_locale("path"), "path")


def read_bytes(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """path, length and content of these files. Spark's reader passes over empty files, which are added, and over names that begin
    with a dot or an underscore, which are refused."""
    names = [contained(p) for p in paths]
    for n in names:
        if posixpath.basename(n).startswith(("_", ".")):
            raise ValueError(f"{n!r} is a hidden name for Spark's readers")
    base = qualified(spark, root)
    if not names:
        return spark.createDataFrame([], "path string, length long, content binary")
    literal = [f"{base}/" + "".join("\\" + c if c in "*?[]{}\\" else c for c in n) for n in names]
    found = spark.read.format("binaryFile").load(literal).select(F.substr("path", F.lit(len(base) + 2)).alias("path"), "length", "content")
    sizes: dict[str, int] = {}
    for folder in sorted({posixpath.dirname(n) for n in names}):  # one call for each folder, not for each file
        fs, p = _open(spark, f"{base}/{folder}" if folder else base)
        sizes |= {posixpath.join(folder, s.getPath().getName()): s.getLen() for s in fs.listStatus(p) if s.isFile()}
    if missing := [n for n in names if n not in sizes]:
        raise FileNotFoundError(f"no such file: {missing[0]!r} under {root!r}")
    empty = [(n, 0, b"") for n in names if not sizes[n]]
    return found.unionByName(spark.createDataFrame(empty, "path string, length long, content binary"))


def read_documents(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """path, kind, length and content; content is null for kinds that are not text. Bytes that are no UTF-8 become U+FFFD."""
    files = read_bytes(spark, root, paths).withColumn("kind", detect_kind(F.col("path")))
    text = F.when(~F.col("kind").isin("pdf", *OFFICE_KINDS), F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", "kind", "length", text.alias("content"))


def canonical_terms(files: DataFrame) -> DataFrame:
    """path, ord, source, target, notes, origin of canonical glossaries (path, content); one without a list of terms is an error."""
    wrong = F.raise_error(F.concat(F.lit("not a canonical glossary: "), F.col("path")))
    terms = F.coalesce(F.from_json("content", CANONICAL)["terms"], wrong)
    return files.select("path", F.posexplode(terms).alias("ord", "t")).select("path", "ord", "t.*")
