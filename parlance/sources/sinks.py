"""Writing documents, one file each, and glossaries in their canonical form."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import contained, store_uri

EMPTY_GLOSSARY = '{\n  "terms": []\n}\n'


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged; its rows are in the manifest."""

    rows: int


class StagedWriter(DataSourceWriter):
    """Writes every row's content under a folder of the job's own, and what it wrote into a manifest there."""

    def __init__(self, uri: str, job: str):
        self.uri, self.folder = uri, f".staged-{job}"

    def write(self, rows: Iterator[tuple]) -> Staged:
        store, at = pafs.FileSystem.from_uri(self.uri)
        task, told = uuid.uuid4().hex, []
        store.create_dir(f"{at}/{self.folder}/files/{task}", recursive=True)
        for n, (path, content) in enumerate(rows):
            if path is None:
                raise ValueError("a document without a path")
            with store.open_output_stream(f"{at}/{self.folder}/files/{task}/{n}") as out:
                out.write(content or b"")
            told.append(json.dumps({"path": path, "target": contained(path), "staged": f"{task}/{n}", "length": len(content or b"")}, ensure_ascii=False))
        store.create_dir(f"{at}/{self.folder}/manifest", recursive=True)
        # only a task that came to its end is in the manifest
        with store.open_output_stream(draft := f"{at}/{self.folder}/manifest/_{task}") as out:
            out.write("\n".join(told).encode())
        store.move(draft, f"{at}/{self.folder}/manifest/{task}.json")
        return Staged(len(told))

    def commit(self, messages: list) -> None:
        """Nothing yet: files take their places in a job of their own, once all are staged."""

    def abort(self, messages: list) -> None:
        store, at = pafs.FileSystem.from_uri(self.uri)
        if store.get_file_info(f"{at}/{self.folder}").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/{self.folder}")


class StagedFiles(DataSource):
    """Sink of documents (path, content), one file each, under an option's folder."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StagedWriter(self.options["uri"], self.options["job"])


MANIFEST = "path string, target string, staged string, length int"


def write_documents(docs: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Writes each row's content (text or bytes; null: empty) to its path under root; gives path and length of every row.

    The workers write, so root must be a folder they share, on a file system pyarrow knows. docs is computed once: first all
    contents are staged in a folder of this job's own; only when every task has committed does a second job move them to their
    places, each by a rename. A job that fails leaves nothing behind, and what was there before stays as it was. Of rows with
    one path, one stays. A path that leads out of root fails the job; a null path is an error too. The result is read from the
    tasks' manifests and held as a table.
    """
    spark = docs.sparkSession
    uri, job = store_uri(spark, root), uuid.uuid4().hex
    spark.dataSource.register(StagedFiles)
    folder = f".staged-{job}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for target, staged in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store.create_dir(posixpath.dirname(f"{at}/{target}"), recursive=True)
                source = f"{at}/{folder}/files/{staged}"
                # a task that runs again finds its files in place
                if store.get_file_info(source).type == pafs.FileType.File:
                    store.move(source, f"{at}/{target}")
        yield from ()

    rows = docs.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    store, at = pafs.FileSystem.from_uri(uri)
    store.create_dir(at, recursive=True)
    try:
        rows.write.format("staged_files").mode("append").option("uri", uri).option("job", job).save()
        told = spark.read.schema(MANIFEST).json(f"{root}/{folder}/manifest") if store.get_file_info(f"{at}/{folder}").type == pafs.FileType.Directory else spark.createDataFrame([], MANIFEST)
        one = told.groupBy("target").agg(F.min("staged").alias("staged"))
        one.mapInArrow(place, "target string").write.format("noop").mode("overwrite").save()
        return spark.createDataFrame(told.select("path", "length").toArrow()) if told.limit(1).count() else spark.createDataFrame([], "path string, length int")
    finally:
        if store.get_file_info(f"{at}/{folder}").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/{folder}")


def json_string(c: Column) -> Column:
    """c as a JSON string; null stays null."""
    listed = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))


def canonical_glossaries(terms: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """group and content: the canonical file of each group's terms, in order. A group without terms has no row: EMPTY_GLOSSARY."""
    fields = [F.concat(F.lit(f'      "{n}": '), json_string(F.col(n))) for n in ("source", "target", "notes", "origin")]
    term = F.concat(F.lit("    {\n"), F.concat_ws(",\n", *fields), F.lit("\n    }"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), term.alias("s"))))
    joined = F.array_join(F.transform(rows, lambda r: r["s"]), ",\n")
    return terms.groupBy(group).agg(F.concat(F.lit('{\n  "terms": [\n'), joined, F.lit("\n  ]\n}\n")).alias("content"))
