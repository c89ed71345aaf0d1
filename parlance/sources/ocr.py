"""PDF files to markdown by a remote service: a source whose partitions submit documents and wait for them.

The service is a client that the caller hands in. What was submitted, how often it was refused and what came of it is noted in a
shared folder by the hash of the document: a task that runs again waits where the lost one waited, and submits nothing twice.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json
import time
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import contained, store_uri
from .notes import Notes

OK, BUSY = 200, 429


class Client(Protocol):
    """The service. Each call gives an HTTP status and the reply's fields."""

    def submit(self, name: str, content: bytes) -> tuple[int, dict]:
        """Fields: success, error, request_check_url."""

    def check(self, url: str) -> tuple[int, dict]:
        """Fields: status (``complete`` at the end), success, error, markdown, result_url, page_count."""

    def fetch(self, url: str) -> tuple[int, dict]:
        """A result that is kept elsewhere; fields as of check."""


@dataclass
class Pace:
    """Attempts to submit, seconds of back-off for each attempt so far, seconds between checks and after a busy one, and
    how long a document may take. spacing is the least time between two calls of one stream, held the most documents that one has on
    the way: while some wait, others are called for."""

    attempts: int = 4
    backoff: float = 15.0
    poll: float = 3.0
    busy: float = 15.0
    patience: float = 900.0
    spacing: float = 0.0
    held: int = 1


class Refused(Exception):
    """The service will not give this document."""


def use_remote(flag: bool | None, key: str | None) -> bool:
    """Whether a run's PDF files go to the service: as it says, or where there is a key for it."""
    return bool((key or "").strip()) if flag is None else flag


def use_remote_column(flag: Column, key: str | None) -> Column:
    return F.coalesce(flag, F.lit(use_remote(None, key)))


#: markdown, pages if told, and why there is none.
Result = tuple[str | None, int | None, str | None]
#: What is done for a document between its waits: each yields the moment up to which it waits.
Steps = Generator[float, None, Result]


class Conversion:
    """One stream of documents: one call after another, of one document or of those on the way."""

    def __init__(self, client: Client, notes: Notes, pace: Pace, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.client, self.notes, self.pace, self.now, self.sleep = client, notes, pace, now, sleep
        self.last = 0.0

    def _call(self, what: Callable[..., tuple[int, dict]], *args: object) -> tuple[int, dict]:
        wait = self.last + self.pace.spacing - self.now()
        if wait > 0:
            self.sleep(wait)
        self.last = self.now()
        return what(*args)

    def _until(self, moment: float) -> None:
        if (wait := moment - self.now()) > 0:
            self.sleep(wait)

    def _submitted(self, key: str, name: str, content: bytes) -> Generator[float, None, dict]:
        """The note of a submission, made before or now. Refusals for haste are counted in it, over all tasks that tried."""
        note = self.notes.get(f"{key}-ticket") or {"tries": 0, "not_before": 0.0}
        while "url" not in note:
            if note["tries"] >= self.pace.attempts:
                raise Refused("the service stayed busy")
            yield note["not_before"]
            status, body = self._call(self.client.submit, name, content)
            tries = note["tries"] + 1
            if status == BUSY:
                note = {"tries": tries, "not_before": self.now() + tries * self.pace.backoff}
            elif status != OK:
                raise Refused(f"submission failed with {status}")
            elif body.get("success") is False or not body.get("request_check_url"):
                raise Refused(f"rejected: {body.get('error') or 'unknown error'}")
            else:
                note = {"tries": tries, "url": body["request_check_url"], "deadline": self.now() + self.pace.patience}
            self.notes.put(f"{key}-ticket", note)
        return note

    def _finished(self, note: dict) -> Generator[float, None, dict]:
        while self.now() < note["deadline"]:
            status, body = self._call(self.client.check, note["url"])
            if status == BUSY:
                yield self.now() + self.pace.busy
                continue
            if status != OK:
                raise Refused(f"check failed with {status}")
            if body.get("status") == "complete":
                return body
            yield self.now() + self.pace.poll
        raise Refused("not complete in time")

    def _markdown(self, body: dict) -> str:
        for again in (True, False):
            if body.get("success") is False:  # limits are told here, in a reply that is complete
                raise Refused(f"failed: {body.get('error') or 'unknown error'}")
            if text := body.get("markdown"):
                break
            if not again or not body.get("result_url"):
                raise Refused("an empty result")
            status, body = self._call(self.client.fetch, body["result_url"])
            if status != OK:
                raise Refused(f"download failed with {status}")
        if not text.strip():
            raise Refused("an empty result")
        return text

    def _steps(self, key: str, name: str, content: bytes) -> Steps:
        """A refusal is an answer for this run, and is not noted: a later one asks anew."""
        if (done := self.notes.get(f"{key}-result")) is None:
            try:
                note = yield from self._submitted(key, name, content)
                del content
                body = yield from self._finished(note)
                done = {"markdown": self._markdown(body), "pages": body.get("page_count") if isinstance(body.get("page_count"), int) else None}
            except Refused as e:
                self.notes.put(f"{key}-ticket", {"tries": 0, "not_before": 0.0})
                return None, None, str(e)
            self.notes.put(f"{key}-result", done)
        return done["markdown"], done["pages"], None

    def convert(self, name: str, content: bytes) -> Result:
        """markdown, pages if told, and why there is none."""
        return next(result for _, result in self.convert_all([(name, name, lambda: content)]))

    def convert_all(self, documents: Iterable[tuple[object, str, Callable[[], bytes]]]) -> Iterator[tuple[object, Result]]:
        """Each document's (mark, name, how to read it) mark and result, as they come. A new one is begun when none on the way may be called for by
        then, so that calls that are spaced far apart go to the oldest. Of equal contents one is on the way at a time, as for whoever asks later."""
        more, count = iter(documents), itertools.count()
        waiting: list[tuple[float, int, str, object, Steps]] = []  # a heap
        behind: dict[str, list[tuple[object, Steps]]] = {}  # by content, those after the one on the way
        held = 0
        while True:
            free = max(self.now(), self.last + self.pace.spacing)
            if more is not None and held < self.pace.held and not (waiting and waiting[0][0] <= free):
                if (document := next(more, None)) is None:
                    more = None
                    continue
                mark, name, read = document
                content, held = read(), held + 1
                key = hashlib.sha256(content).hexdigest()
                steps = self._steps(key, name, content)
                del document, read, content
                if key in behind:
                    behind[key].append((mark, steps))
                    continue
                behind[key] = []
            elif waiting:
                moment, _, key, mark, steps = heapq.heappop(waiting)
                self._until(moment)
            else:
                return
            while True:
                try:
                    heapq.heappush(waiting, (next(steps), next(count), key, mark, steps))
                    break
                except StopIteration as e:
                    held -= 1
                    yield mark, e.value
                    if not behind[key]:
                        del behind[key]
                        break
                    mark, steps = behind[key].pop(0)


@dataclass
class Stream(InputPartition):
    paths: list[str]


class OcrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Stream]:
        paths, n = json.loads(self.options["paths"]), int(self.options["streams"])
        return [Stream(own) for i in range(n) if (own := paths[i::n])] or [Stream([])]

    def read(self, partition: Stream) -> Iterator[tuple]:
        client = cloudpickle.loads(base64.b64decode(self.options["client"]))
        work = Conversion(client, Notes(self.options["notes"]), Pace(**json.loads(self.options["pace"])))
        store, at = pafs.FileSystem.from_uri(self.options["uri"])
        gone = []

        def read(path: str) -> bytes:
            with store.open_input_stream(f"{at}/{path}") as f:
                return f.read()

        def documents() -> Iterator[tuple[str, str, Callable[[], bytes]]]:
            for path in partition.paths:
                if store.get_file_info(f"{at}/{path}").type != pafs.FileType.File:
                    gone.append(path)
                    continue
                yield path, path.rpartition("/")[2], lambda path=path: read(path)

        for path, result in work.convert_all(documents()):
            yield path, *result
        yield from ((path, None, None, "no file") for path in gone)


class Ocr(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_ocr"

    def schema(self) -> str:
        return "path string, content string, page_count int, reason string"

    def reader(self, schema) -> DataSourceReader:
        return OcrReader(self.options)


def ocr_documents(spark: SparkSession, root: str, paths: Iterable[str], client: Client, notes: str, streams: int = 4, pace: Pace | None = None) -> DataFrame:
    """path, content (markdown), page_count and reason of PDF files under root; reason says why a document has no content.

    `streams` partitions call the service, each with one document at a time, or as many as the pace holds, and no faster than the pace
    allows, so that streams over spacing bounds the calls in a second, and streams times held the documents on the way. notes names a shared folder: a document is submitted once, whoever asks and how often
    tasks run or the result is read; refused ones are asked for anew by the next reading. Names that lead out of root are refused."""
    spark.dataSource.register(Ocr)
    options = {
        "paths": json.dumps([contained(p) for p in paths]), "uri": store_uri(spark, root), "notes": store_uri(spark, notes), "streams": str(max(1, streams)),
        "client": base64.b64encode(cloudpickle.dumps(client)).decode(), "pace": json.dumps(asdict(pace or Pace())),
    }
    return spark.read.format("remote_ocr").options(**options).load()
