"""The service's pace and refusals, one submission for each document, and the mode."""

import os
import sys

import pytest
from pyspark import cloudpickle

from parlance.sources import ocr
from parlance.sources.notes import Notes


class Stub:
    """Refuses each document twice for haste, needs two checks, and counts its submissions in a file."""

    def __init__(self, folder, **odd):
        self.folder, self.odd, self.checks = folder, odd, {}

    def _told(self, name):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(name + "\n")
        with open(f"{self.folder}/calls") as f:
            return f.read().split("\n").count(name)

    def submit(self, name, content):
        if self._told(f"try {name}") <= self.odd.get("busy", 2):
            return 429, {}
        self._told(f"submit {name}")
        return self.odd.get("submit", (200, {"success": True, "request_check_url": f"u/{name}"}))

    def check(self, url):
        n = self.checks[url] = self.checks.get(url, 0) + 1
        if n < 3:
            return (429, {}) if n == 1 else (200, {"status": "processing"})
        return 200, self.odd.get("result", {"status": "complete", "success": True, "markdown": f"# {url}", "page_count": 2})

    def fetch(self, url):
        return self.odd.get("fetch", (200, {"markdown": f"from {url}"}))


class Clock:
    def __init__(self):
        self.t, self.slept = 1000.0, []

    def now(self):
        return self.t

    def sleep(self, s):
        self.slept.append(s)
        self.t += s


def run(tmp_path, pace=None, **odd):
    clock, notes = Clock(), Notes(f"file://{tmp_path}/notes")
    work = ocr.Conversion(Stub(str(tmp_path), **odd), notes, pace or ocr.Pace(), clock.now, clock.sleep)
    return work.convert("a.pdf", b"content"), clock.slept, notes


def test_pace(tmp_path):
    assert run(tmp_path) == (("# u/a.pdf", 2, None), [15.0, 30.0, 15.0, 3.0], Notes(f"file://{tmp_path}/notes"))
    (text, _, _), slept, _ = run(tmp_path)
    assert text == "# u/a.pdf" and slept == []  # noted: neither submitted nor waited for again


@pytest.mark.parametrize(
    "odd,why",
    [
        ({"busy": 4}, "the service stayed busy"), ({"submit": (500, {})}, "submission failed with 500"), ({"submit": (200, {"success": False, "error": "too large"})}, "rejected: too large"),
        ({"submit": (200, {})}, "rejected: unknown error"), ({"result": {"status": "complete", "success": False, "error": "limit"}}, "failed: limit"),
        ({"result": {"status": "complete", "markdown": " "}}, "an empty result"), ({"result": {"status": "complete"}}, "an empty result"), ({"result": {"status": "never"}}, "not complete in time"),
        ({"result": {"status": "complete", "result_url": "r"}, "fetch": (404, {})}, "download failed with 404"), ({"result": {"status": "complete", "result_url": "r"}, "fetch": (200, {"success": False})}, "failed: unknown error"),
    ],
)
def test_refusals(tmp_path, odd, why):
    assert run(tmp_path, **odd)[0] == (None, None, why)
    (text, _, reason), _, _ = run(tmp_path)  # the next run asks anew
    assert text == "# u/a.pdf" and reason is None


def test_results_kept_elsewhere(tmp_path):
    assert run(tmp_path, result={"status": "complete", "result_url": "r", "page_count": None})[0] == ("from r", None, None)


def test_a_lost_task_goes_on_waiting(tmp_path):
    class Lost(Exception):
        pass

    def lost(seconds):
        raise Lost

    notes = Notes(f"file://{tmp_path}/notes")
    stub = Stub(str(tmp_path))
    clock = Clock()
    with pytest.raises(Lost):
        ocr.Conversion(stub, notes, ocr.Pace(), clock.now, lost).convert("a.pdf", b"content")
    clock.t += 5
    text, _, _ = ocr.Conversion(Stub(str(tmp_path)), notes, ocr.Pace(), clock.now, clock.sleep).convert("a.pdf", b"content")
    assert text == "# u/a.pdf" and clock.slept == [10.0, 30.0, 15.0, 3.0]  # what was left of the first wait, then the second
    with open(f"{tmp_path}/calls") as f:
        assert f.read().split("\n").count("submit a.pdf") == 1


def test_spacing(tmp_path):
    slept = run(tmp_path, ocr.Pace(poll=0.1, busy=0.1, backoff=0.1, spacing=1.0))[1]
    assert slept == pytest.approx([0.1, 0.9, 0.2, 0.8, 1.0, 0.1, 0.9, 0.1, 0.9])


def test_mode():
    assert [ocr.use_remote(f, k) for f, k in ((True, None), (False, "key"), (None, "key"), (None, " "), (None, None))] == [True, False, True, False, False]


def test_source(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import tests
    root, notes = str(tmp_path / "in"), str(tmp_path / "notes")
    os.makedirs(f"{root}/d")
    for i in range(5):
        with open(f"{root}/d/{i}.pdf", "w") as f:
            f.write(f"content {i}")
    pace = ocr.Pace(backoff=0.01, poll=0.01, busy=0.01)
    paths = [f"d/{i}.pdf" for i in range(5)] + ["gone.pdf"]
    got = ocr.ocr_documents(spark, root, paths, Stub(str(tmp_path)), notes, 3, pace)
    for _ in range(3):
        assert sorted((r.path, r.content, r.page_count, r.reason) for r in got.collect()) == [*((f"d/{i}.pdf", f"# u/{i}.pdf", 2, None) for i in range(5)), ("gone.pdf", None, None, "no file")]
    with open(f"{tmp_path}/calls") as f:
        assert sorted(x for x in f.read().split("\n") if x.startswith("submit")) == [f"submit {i}.pdf" for i in range(5)]
    assert got.rdd.getNumPartitions() == 3
    assert ocr.ocr_documents(spark, root, [], Stub(str(tmp_path)), notes).count() == 0
    with pytest.raises(ValueError):
        ocr.ocr_documents(spark, root, ["../x"], Stub(str(tmp_path)), notes)
    flags = spark.createDataFrame([(True,), (False,), (None,)], "flag boolean")
    assert [r[0] for r in flags.select(ocr.use_remote_column(flags["flag"], "k")).collect()] == [True, False, True]


def test_equal_contents_in_two_streams(tmp_path):
    from parlance.plans import samples
    from parlance.plans.pdf_queries import Service

    scanned, shown = samples.pdf_document([[]], None), samples.pdf_document([["a"]], None)
    held, notes, clock = Notes(f"file://{tmp_path}/service"), Notes(f"file://{tmp_path}/notes"), Clock()

    class Lost(Exception):
        pass

    def lost(seconds):
        raise Lost

    for content, end in ((scanned, None), (shown, "a")):
        with pytest.raises(Lost):  # the first stream has submitted, and waits
            ocr.Conversion(Service(held), notes, ocr.Pace(), clock.now, lost).convert("4.pdf", content)
        text, _, why = ocr.Conversion(Service(held), notes, ocr.Pace(), clock.now, clock.sleep).convert("46.pdf", content)
        assert text == end and (why is None) == (end is not None)


def test_documents_on_the_way(tmp_path):
    """While one waits, others are called for; what each is asked stays the same."""
    took = {}
    for held in (1, 4):
        folder = tmp_path / str(held)
        folder.mkdir()
        clock = Clock()
        work = ocr.Conversion(Stub(str(folder)), Notes(f"file://{folder}/notes"), ocr.Pace(held=held), clock.now, clock.sleep)
        open_, most = [], [0]

        def documents():
            for i in range(6):
                open_.append(i)
                most[0] = max(most[0], len(open_))
                yield i, f"{i}.pdf", lambda i=i: b"same" if i > 3 else b"%d" % i

        got = {}
        for i, result in work.convert_all(documents()):
            open_.remove(i)
            got[i] = result
        assert got == {i: (f"# u/{min(i, 4)}.pdf", 2, None) for i in range(6)} and most[0] == held
        with open(f"{folder}/calls") as f:
            said = f.read().split("\n")
        assert sorted(x for x in said if x.startswith("submit")) == [f"submit {i}.pdf" for i in range(5)] and sum(x.startswith("try") for x in said) == 15
        took[held] = clock.t - 1000
    assert took[1] == 5 * 63 and took[4] <= 2 * 63


def test_spaced_calls_go_to_the_oldest(tmp_path):
    clock = Clock()
    work = ocr.Conversion(Stub(str(tmp_path), busy=0), Notes(f"file://{tmp_path}/notes"), ocr.Pace(spacing=60.0, held=4), clock.now, clock.sleep)
    ends = [(i, clock.t - 1000) for i, _ in work.convert_all((i, f"{i}.pdf", lambda i=i: b"%d" % i) for i in range(3))]
    assert ends == [(0, 180.0), (1, 420.0), (2, 660.0)]
