"""Replies of translators and editors, kept in a shared folder by what was asked, so that no question is put twice.

A question is a part under its settings (part_key) and what else the answer hangs on: the glossary before it, and for an
editor the translation too (prior_key). Both are hashes of contents. A task writes each reply to the end of its own file
before it goes on: what a killed run or a lost executor had asked already is found again. A file for each reply would take a block
of disk each. Where a file system gives no part of a file that is not closed, a killed task's own replies are lost.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder, store_uri
from ..sources.notes import Notes

REPLY = "part_key string, prior_key string, reply string"
_json = json.JSONEncoder(ensure_ascii=False).encode


def part_key(settings: str, *columns: str) -> Column:
    """Hash of a part's own columns and of the settings: language, style, model, whatever changes a reply."""
    return F.sha2(F.to_json(F.struct(F.lit(settings).alias("settings"), *columns), {"ignoreNullFields": "false"}), 256)


def digest(before: str, value: object) -> str:
    """Hash of a list that ends with a value that JSON can say, from that of the list before it ("": empty)."""
    return hashlib.sha256((before + _json(value)).encode()).hexdigest()


@dataclass
class Journal:
    """One stage's replies of one job, as its tasks see them: a task's file, and those of its attempts before."""

    uri: str

    def open(self) -> Log:
        c = TaskContext.get()
        return Log(self.uri, c.partitionId(), c.taskAttemptId())


@functools.lru_cache(1)
def _lost(uri: str, task: int, attempt: int) -> dict[tuple[str, str], object]:
    """What other attempts at a task were told; the last line of such a file may be cut off."""
    store, folder = pafs.FileSystem.from_uri(uri)
    found: dict[tuple[str, str], object] = {}
    for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.startswith(f"{task}-") and not f.base_name.startswith(f"{task}-{attempt}-"):
            with store.open_input_stream(f.path) as lines:
                for line in lines.read().split(b"\n"):
                    with contextlib.suppress(ValueError):
                        r = json.loads(line)
                        found.setdefault((r["part_key"], r["prior_key"]), json.loads(r["reply"]))
    return found


class Log:
    """Replies of a task, or of one of its groups: what its lost attempts were told, and a file for what it is told itself."""

    def __init__(self, uri: str, task: int, attempt: int):
        self.store, self.folder = pafs.FileSystem.from_uri(uri)
        self.name, self.out, self.found = f"{task}-{attempt}-{uuid.uuid4().hex}.json", None, _lost(uri, task, attempt)

    def get(self, part: str, prior: str) -> object | None:
        return self.found.get((part, prior))

    def put(self, part: str, prior: str, reply: object) -> None:
        if self.out is None:
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        self.out.write((_json({"part_key": part, "prior_key": prior, "reply": _json(reply)}) + "\n").encode())
        self.out.flush()

    def __enter__(self) -> Log:
        return self

    def __exit__(self, *_: object) -> None:
        if self.out is not None:
            self.out.close()


class ReplyStore:
    """The replies of all runs that name this folder, and the tables that their stages ended with."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def temporary(cls, spark: SparkSession) -> ReplyStore:
        """A store of its own in the shared folder."""
        return cls(spark, f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}")

    def journal(self, stage: str) -> Journal:
        """A journal for one job."""
        return Journal(store_uri(self.spark, f"{self.root}/{stage}/{uuid.uuid4().hex}"))

    def notes(self, name: str) -> Notes:
        return Notes(store_uri(self.spark, f"{self.root}/{name}"))

    def replies(self, stage: str) -> DataFrame | None:
        """part_key, prior_key and reply of every question that was answered, one row each; None before the first."""
        path = f"{self.root}/{stage}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        lines = self.spark.read.schema(REPLY).option("recursiveFileLookup", True).json(path)
        return lines.where("part_key is not null and prior_key is not null and reply is not null").groupBy("part_key", "prior_key").agg(F.min("reply").alias("reply"))

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read from there: whatever made it runs no more."""
        path = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
