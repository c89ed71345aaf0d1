from parlance.operators import ranges

RANGES = "doc_id int, title string, start_page int, end_page int"


def test_range_pages(spark):
    parts = spark.createDataFrame([(1, "b", 3, 4), (1, None, 1, 2), (1, "x", None, 2), (2, "c", 1, 9)], RANGES)
    pages = spark.createDataFrame([(1, n, f"p{n}", "own") for n in range(1, 6)] + [(3, 1, "q", "own"), (2, 9, None, None)], "doc_id int, page_no int, text string, title string")
    got = sorted(tuple(r) for r in ranges.range_pages(parts.where("start_page is not null"), pages).select("doc_id", "page_no", "text", "part", "title").collect() if r.doc_id == 1)
    assert got == [(1, 1, "p1", 1, None), (1, 2, "p2", 1, None), (1, 3, "p3", 2, "b"), (1, 4, "p4", 2, "b")]
    assert sorted(map(tuple, ranges.range_pages(parts, pages).select("doc_id", "part", "page_no").collect())) == [(1, 1, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (2, 1, 9)]


def test_plan_ranges(spark):
    outline = spark.createDataFrame([(1, "a", 1, 4), (1, "b", 5, 9), (2, "a", 3, 9), (2, "Front matter", 1, 2)], RANGES)
    toc = spark.createDataFrame([(1, "t", 1, 2), (1, "u", 3, 9), (2, "t", 1, 2), (2, "u", 3, 9), (3, "t", 1, 9)], RANGES)
    windows = spark.createDataFrame([(d, None, 1, 9) for d in (1, 2, 3, 4)], RANGES)
    got = {(r.doc_id, r.plan, r.start_page) for r in ranges.plan_ranges(outline, toc, windows).collect()}
    assert got == {(1, "outline", 1), (1, "outline", 5), (2, "toc", 1), (2, "toc", 3), (3, "windows", 1), (4, "windows", 1)}


def test_pages_are_never_broadcast(spark, capsys):
    pages = spark.range(3).selectExpr("id AS doc_id", "explode(sequence(1, 50)) AS page_no")  # Spark takes it for three rows
    parts = spark.range(3).selectExpr("id AS doc_id", "'t' AS title", "1 AS start_page", "50 AS end_page")
    for df, n in ((ranges.select_pages(pages, last=3), 9), (ranges.range_pages(parts, pages), 150)):
        assert df.count() == n
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
