"""Queries over PDF files, which are made from tables: their pages and bookmarks come back as SQL can say them from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges
from ..sources import files, ocr, pdf, sinks
from ..sources.notes import Notes
from . import parts, samples
from .queries import _read, query
from .run_queries import checked, shout

# A conversation is a file, a turn a page with a bookmark. Of seven files one is encrypted and one shows images alone.

_TURNS = r"""(SELECT conv_id AS doc_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, CAST(row_number() OVER w AS INTEGER) AS page_no, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS total_pages
    FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
#: Bookmarks go by a page's number or by a name; every third leads nowhere.
_MARKS = f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS ord, role || ' ' || page_no AS title, page_no AS start_page, total_pages FROM {_TURNS} WHERE page_no % 3 > 0 AND doc_id % 7 <> 3)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and content."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    turns = _read(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & (flat != ""))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", flat.alias("line"))))
    talks = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(rows.alias("turns"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for n, turns in zip(b["doc_id"], b["turns"], strict=True):
                pages = [[] if n % 7 == 4 else [t["line"]] for t in turns]
                marks = [(f"{t['role']} {i}", 999 if i % 3 == 0 else i if i % 3 == 1 else f"p{i}") for i, t in enumerate(turns, 1)]
                made.append(samples.pdf_document(pages, marks, packed=n % 2 == 0, wide=True, locked=n % 7 == 3, nested=n % 4 > 1))
            yield pd.DataFrame({"doc_id": b["doc_id"], "path": [f"talks/{n}.pdf" for n in b["doc_id"]], "content": made})

    return talks.mapInPandas(make, "doc_id long, path string, content binary")


@query(f"""
    SELECT doc_id, page_no, line AS text, total_pages, CAST(NULL AS VARCHAR) AS reason FROM {_TURNS} WHERE doc_id % 7 NOT IN (3, 4)
    UNION ALL SELECT DISTINCT doc_id, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CASE WHEN doc_id % 7 = 4 THEN total_pages END, CASE WHEN doc_id % 7 = 3 THEN 'encrypted' ELSE '{pdf.SCANNED}' END FROM {_TURNS} WHERE doc_id % 7 IN (3, 4)""")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text, through plain and compressed files; encrypted and scanned ones have a reason."""
    return pdf.pdf_pages(_files(spark, sf_dir).drop("path"))


@query(f"SELECT doc_id, CAST(ord AS INTEGER) AS ord, title, start_page, total_pages FROM {_MARKS}")
def pdf_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks that lead to a page, directly or by name; where the first level has one entry, those below it."""
    return pdf.pdf_outlines(_files(spark, sf_dir).drop("path"))


@query(f"""
    SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY page_no) AS content, CAST(NULL AS VARCHAR) AS reason FROM {_TURNS} WHERE doc_id % 7 NOT IN (3, 4) GROUP BY doc_id
    UNION ALL SELECT DISTINCT doc_id, CAST(NULL AS VARCHAR), CASE WHEN doc_id % 7 = 3 THEN 'encrypted' ELSE '{pdf.SCANNED}' END FROM {_TURNS} WHERE doc_id % 7 IN (3, 4)""")
def pdf_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pdf_markdown(_files(spark, sf_dir).drop("path"))


@query(f"""
    SELECT doc_id, 'talks-' || doc_id % 2 AS folder, doc_id || '.part-' || printf('%03d', (page_no + 1) // 2) || '.pdf' AS path, CAST((page_no + 1) // 2 AS INTEGER) AS part, CAST(2 - page_no % 2 AS INTEGER) AS page_no, line AS text, CAST(least(2, total_pages - 2 * ((page_no + 1) // 2) + 2) AS INTEGER) AS total_pages
    FROM {_TURNS} WHERE doc_id % 7 NOT IN (3, 4)""")
def pdf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two pages each, read again: each has the pages of its range and no others."""
    files = _files(spark, sf_dir)
    totals = pdf.pdf_pages(files.drop("path")).groupBy("doc_id").agg(F.max("total_pages").alias("total_pages"))
    cut = pdf.split_files(files, ranges.fixed_windows(totals, 2).withColumn("title", F.lit(None).cast("string")))
    back = pdf.pdf_pages(cut.select("doc_id", "path", "part", "content"))
    return back.where("reason is null").select("doc_id", F.concat(F.lit("talks-"), F.col("doc_id") % 2).alias("folder"), "path", "part", "page_no", "text", "total_pages")


# whole runs of PDF files

_NATIONS = "(SELECT n_nationkey AS d, n_name, 2 * row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY n_nationkey) AS p FROM nation)"


def _run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a nation: four pages, bookmarks at the first and the third; every fourth has none."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [samples.pdf_document([[f"page {name} {i}"] for i in range(1, 5)], [("one", 1), ("three", 3)] if n % 4 else None) for n, name in zip(b["source_index"], b["n_name"], strict=True)]
            yield pd.DataFrame({"run_id": b["run_id"], "source_index": b["source_index"], "content": made})

    n = _read(spark, sf_dir, "nation").select(F.concat(F.lit("pdf-"), F.col("n_nationkey") % 3).alias("run_id"), F.col("n_nationkey").cast("int").alias("source_index"), "n_name")
    return n.mapInPandas(make, "run_id string, source_index int, content binary")


def _pdf_run(spark: SparkSession, sf_dir: str) -> tuple[parts.Run, DataFrame]:
    files = _run_files(spark, sf_dir)
    pages, own = parts.pdf_ranges(files)
    docs = files.select("run_id", "source_index", F.lit("pdf").alias("kind"), F.lit(None).cast("string").alias("content"))
    none = docs.limit(0).select("run_id", F.lit(0).alias("ord"), *[F.lit("").alias(c) for c in ("source", "target", "notes")])
    return parts.run(docs, shout, checked, none, pages=pages, ranges=own), own


_PARTS = f"""(SELECT d, n_name, d % 4 > 0 AS marked, sum(CASE WHEN d % 4 > 0 THEN 2 ELSE 1 END) OVER (PARTITION BY d % 3 ORDER BY d) AS last FROM {_NATIONS})"""


@query(f"""
    SELECT 'pdf-' || d % 3 AS run_id, CAST(d AS INTEGER) AS source_index, 'pdf' AS kind, 'page ' || n_name || ' 1' || chr(10) || chr(10) || 'page ' || n_name || ' 2' || CASE WHEN marked THEN ' [' || (last - 2) || ']!' ELSE '' END
        || chr(10) || chr(10) || 'page ' || n_name || ' 3' || chr(10) || chr(10) || 'page ' || n_name || ' 4 [' || (last - 1) || ']!' AS content FROM {_PARTS}""")
def run_pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From PDF files to reviewed documents: pages read, planned by bookmarks or windows, translated and put together."""
    return _pdf_run(spark, sf_dir)[0].documents


@query(f"SELECT 'pdf-' || d % 3 AS run_id, 'multi-document:' || string_agg(CASE WHEN d % 4 > 0 THEN 'outline' ELSE 'windows' END, ',' ORDER BY d) AS part_source FROM {_NATIONS} GROUP BY d % 3")
def run_pdf_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, own = _pdf_run(spark, sf_dir)
    return parts.part_sources(made.parts, own)


# the service


class Service:
    """A stand-in for the service: refuses every second document once for haste, and needs two checks.

    What was submitted lies in a shared folder, as the service is one for all streams: equal contents that two of them meet have one
    ticket, and whoever holds it may ask."""

    def __init__(self, held: Notes):
        self.seen, self.held = {}, held

    def submit(self, name: str, content: bytes) -> tuple[int, dict]:
        self.seen[name] = self.seen.get(name, 0) + 1
        if self.seen[name] == 1 and int(name.partition(".")[0]) % 2:
            return ocr.BUSY, {}
        texts, why = pdf.page_texts(content)
        self.held.put(name, {"status": "complete", "success": why is None, "error": why, "markdown": "\n\n".join(t for t in texts if t), "page_count": len(texts)})
        return ocr.OK, {"success": True, "request_check_url": name}

    def check(self, url: str) -> tuple[int, dict]:
        self.seen[url] = self.seen.get(url, 0) + 10
        if self.seen[url] <= 20:
            return ocr.OK, {"status": "processing"}
        found = self.held.get(url)
        return (404, {}) if found is None else (ocr.OK, found)

    def fetch(self, url: str) -> tuple[int, dict]:
        return 404, {}


@query(f"""
    SELECT 'talks/' || doc_id || '.pdf' AS path, string_agg(line, chr(10) || chr(10) ORDER BY page_no) AS content, CAST(count(*) AS INTEGER) AS page_count, CAST(NULL AS VARCHAR) AS reason FROM {_TURNS} WHERE doc_id % 7 NOT IN (3, 4) GROUP BY doc_id
    UNION ALL SELECT DISTINCT 'talks/' || doc_id || '.pdf', CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), 'failed: ' || CASE WHEN doc_id % 7 = 3 THEN 'encrypted' ELSE '{pdf.SCANNED}' END FROM {_TURNS} WHERE doc_id % 7 IN (3, 4)""")
def remote_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written, and read back through the service, which takes four documents of each stream at a time."""
    root = f"{files.shared_folder(spark)}/parlance-{uuid.uuid4().hex}"
    wrote = sinks.write_documents(_files(spark, sf_dir), f"{root}/in")
    paths = [r.path for r in wrote.select("path").collect()]
    return ocr.ocr_documents(spark, f"{root}/in", paths, Service(Notes(files.store_uri(spark, f"{root}/service"))), f"{root}/notes", pace=ocr.Pace(backoff=0.01, poll=0.01, held=4))
