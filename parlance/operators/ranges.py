"""Page ranges: from chapter starts, in windows, merged, split; and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim, normalise_title, utf16_length

FRONT = "Front matter"
#: A line of a table of contents, what is cut off after its title, and the least length of a title.
_TOC = r"^(.+?)[\s.·:_–—-]{2,}(\d{1,4})\z"
_TOC_TAIL = r"[\s.·:_–—-]+\z"
_TITLE_LENGTH = 3
#: Entries that make a page one of contents, entries that make a table, entries that are verified, pages that are searched.
_ON_PAGE, _IN_TABLE, _VERIFIED, _SEARCHED = 2, 3, 8, 26


def ranges_from_starts(starts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, title, start_page, end_page from (id, ord, title, start_page, total_pages); pages before the first start are front matter."""
    page = F.least(F.greatest(F.col("start_page"), F.lit(1)), F.col("total_pages"))
    placed = starts.where("start_page is not null and total_pages >= 1").withColumn("start_page", page)
    one = placed.groupBy(id_col, "start_page").agg(F.min_by("title", "ord").alias("title"), F.max("total_pages").alias("total_pages"))
    order = Window.partitionBy(id_col).orderBy("start_page")
    ends = one.withColumn("end_page", F.coalesce(F.lead("start_page").over(order) - 1, F.col("total_pages"))).withColumn("first", F.row_number().over(order) == 1)
    own = F.struct("title", "start_page", "end_page")
    front = F.struct(F.lit(FRONT).alias("title"), F.lit(1).cast(one.schema["start_page"].dataType).alias("start_page"), (F.col("start_page") - 1).alias("end_page"))
    return ends.select(id_col, F.explode(F.when(F.col("first") & (F.col("start_page") > 1), F.array(front, own)).otherwise(F.array(own))).alias("r")).select(id_col, "r.*")


def fixed_windows(docs: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """id, start_page, end_page: windows of `size` pages over (id, total_pages)."""
    return docs.where("total_pages >= 1").select(id_col, "total_pages", F.explode(F.expr(f"sequence(1, cast(total_pages as int), {max(1, size)})")).alias("start_page")).select(
        id_col, "start_page", F.least(F.col("start_page") + max(1, size) - 1, F.col("total_pages").cast("int")).alias("end_page")
    )


def split_oversized(ranges: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """Ranges of more than `most` pages as pieces of that many, under the same title."""
    return ranges.select(id_col, "title", "end_page", F.explode(F.expr(f"sequence(start_page, end_page, cast({most} as bigint))")).alias("s")).select(
        id_col, "title", F.col("s").alias("start_page"), F.least(F.col("s") + most - 1, F.col("end_page")).alias("end_page")
    )


def _joined(a: Column, b: Column) -> Column:
    """Two neighbours as one range, under the first one's title."""
    return F.struct(a["start_page"].alias("start_page"), b["end_page"].alias("end_page"), a["title"].alias("title"))


def merge_undersized(ranges: DataFrame, least: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """A range under `least` pages takes in the next while both make at most `most`; a small last one joins the one before.

    One fold over each document's array of ranges in page order."""
    row = F.struct(F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), F.col("title").cast("string").alias("title"))
    pages = lambda r: r["end_page"] - r["start_page"] + 1
    fits = lambda a, b, small: (pages(small) < least) & (pages(a) + pages(b) <= most)
    less = lambda out, n: F.slice(out, 1, F.size(out) - n)
    last = lambda out, i: F.element_at(out, -i)

    def take(out: Column, r: Column) -> Column:
        return F.when(F.size(out) == 0, F.array(r)).when(fits(last(out, 1), r, last(out, 1)), F.concat(less(out, 1), F.array(_joined(last(out, 1), r)))).otherwise(F.concat(out, F.array(r)))

    def close(out: Column) -> Column:
        tail = F.when(F.size(out) > 1, fits(last(out, 2), last(out, 1), last(out, 1))).otherwise(False)
        return F.when(tail, F.concat(less(out, 2), F.array(_joined(last(out, 2), last(out, 1))))).otherwise(out)

    rows = ranges.groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.array().cast("array<struct<start_page: bigint, end_page: bigint, title: string>>")
    return rows.select(id_col, F.explode(F.aggregate("rows", empty, take, close)).alias("r")).select(id_col, "r.title", "r.start_page", "r.end_page")


def normalise_ranges(ranges: DataFrame, least: int, most: int, id_col: str = "doc_id") -> DataFrame:
    return split_oversized(merge_undersized(ranges, least, most, id_col), most, id_col)


def _toc_lines(pages: DataFrame, id_col: str) -> DataFrame:
    """id, page_no, ord, title, printed_page of the lines that look like a table of contents."""
    lines = pages.select(id_col, "page_no", F.posexplode(F.split("text", "\r?\n")).alias("ord", "line")).withColumn("line", js_trim(F.col("line")))
    title = js_trim(F.regexp_replace(F.regexp_extract("line", _TOC, 1), _TOC_TAIL, ""))
    found = lines.where(F.col("line").rlike(_TOC)).withColumn("title", title).withColumn("printed_page", F.regexp_extract("line", _TOC, 2).cast("int"))
    return found.where((utf16_length(F.col("title")) >= _TITLE_LENGTH) & ~F.col("title").rlike(r"^\d+\z") & (F.col("printed_page") >= 1)).drop("line")


def _first_of_title(found: DataFrame, within: list[str]) -> DataFrame:
    first = Window.partitionBy(*within, normalise_title(F.col("title"))).orderBy("page_no", "ord")
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def toc_candidates(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, page_no, ord, title, printed_page of the lines of (id, page_no, text) that look like a table of contents; the first of a title stays."""
    return _first_of_title(_toc_lines(pages, id_col), [id_col]).select(id_col, "page_no", "ord", "title", "printed_page")


def scan_toc(pages: DataFrame, scanned: int, id_col: str = "doc_id") -> DataFrame:
    """The contents entries among each document's first `scanned` pages: id, page_no, ord, title, printed_page, toc_end_page.

    Only pages with two entries or more count as contents, of which the last is toc_end_page; a document with under three
    entries of different titles has none."""
    own = _first_of_title(_toc_lines(pages.where(F.col("page_no") <= scanned), id_col), [id_col, "page_no"])
    on_page = own.withColumn("_n", F.count("*").over(Window.partitionBy(id_col, "page_no"))).where(F.col("_n") >= _ON_PAGE).drop("_n")
    ends = on_page.withColumn("toc_end_page", F.max("page_no").over(Window.partitionBy(id_col)))
    single = _first_of_title(ends, [id_col])
    enough = single.withColumn("_n", F.count("*").over(Window.partitionBy(id_col))).where(F.col("_n") >= _IN_TABLE)
    return enough.select(id_col, "page_no", "ord", "title", "printed_page", "toc_end_page")


def sample_evenly(rows: DataFrame, count: int, order: list[str], id_col: str = "doc_id") -> DataFrame:
    """Of each document's rows in order, `count` at even steps; all, if there are no more."""
    own = Window.partitionBy(id_col)
    numbered = rows.withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(own))
    k = F.ceil(F.col("_i") * count / F.col("_n"))  # the first step that is not before this row
    chosen = (F.col("_n") <= count) | ((k < count) & (F.floor(k * F.col("_n") / count) == F.col("_i")))
    return numbered.where(chosen).drop("_i", "_n")


def toc_to_starts(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, ord, title, start_page, total_pages of the candidates (with page_offset and total_pages) that lie inside the document."""
    moved = candidates.withColumn("start_page", F.col("printed_page") + F.col("page_offset"))
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("page_no", "ord"))
    return moved.where(F.col("start_page").between(1, F.col("total_pages"))).select(id_col, order.alias("ord"), "title", "start_page", "total_pages")


def find_toc_starts(pages: DataFrame, totals: DataFrame, scanned: int = 10, id_col: str = "doc_id") -> DataFrame:
    """id, ord, title, start_page, total_pages, page_offset from printed contents that the pages confirm.

    pages: id, page_no, text; totals: id, total_pages. The offset between printed and real pages comes from the first
    entries that a page shows. Of eight entries, evenly chosen, at least half of those whose page lies behind the contents
    and inside the document must be shown there; at least two starts must be left. Documents that fail have no rows.
    """
    found = scan_toc(pages, scanned, id_col)
    sized = found.join(page_offset(found, pages, id_col), id_col).join(totals.select(id_col, "total_pages"), id_col)
    sample = sample_evenly(sized, _VERIFIED, ["page_no", "ord"], id_col).withColumn("at", F.col("printed_page") + F.col("page_offset"))
    sample = sample.where((F.col("at") > F.col("toc_end_page")) & (F.col("at") <= F.col("total_pages")))
    shown = sample.join(pages.select(id_col, F.col("page_no").alias("at"), "text"), [id_col, "at"], "left")
    hit = F.coalesce(title_appears(F.col("title"), F.col("text")), F.lit(False))
    good = shown.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).where("hits * 2 >= n").select(id_col)
    body = sized.join(good, id_col, "left_semi").where(F.col("printed_page") + F.col("page_offset") > F.col("toc_end_page"))
    starts = toc_to_starts(body, id_col).join(sized.select(id_col, "page_offset").distinct(), id_col)
    return starts.withColumn("_n", F.count("*").over(Window.partitionBy(id_col))).where("_n >= 2").drop("_n")


def title_appears(title, page):
    """The title's words in a row on the page; or its first four words of more than two letters."""
    t, p = normalise_title(title), normalise_title(page)
    words = F.array_join(F.slice(F.filter(F.split(t, " "), lambda w: F.length(w) > 2), 1, 4), " ")
    return ((t != "") & F.contains(p, t)) | ((F.length(words) >= 3) & F.contains(p, words))


def page_offset(candidates: DataFrame, pages: DataFrame, id_col: str = "doc_id", reach: int = _SEARCHED) -> DataFrame:
    """id, page_offset: from the first of three candidates that a page within reach shows; a range join inside each document."""
    order = Window.partitionBy(id_col).orderBy("page_no", "ord")
    end = F.col("toc_end_page") if "toc_end_page" in candidates.columns else F.max("page_no").over(Window.partitionBy(id_col))
    few = candidates.withColumn("nth", F.row_number().over(order)).withColumn("body", end + 1).where("nth <= 3")
    low = F.greatest("printed_page", "body")
    p = pages.select(id_col, F.col("page_no").alias("at"), "text")
    hits = few.join(p, id_col).where((F.col("at") >= low) & (F.col("at") < low + reach) & title_appears(F.col("title"), F.col("text")))
    return hits.groupBy(id_col).agg(F.min_by(F.col("at") - F.col("printed_page"), F.struct("nth", "at")).alias("page_offset"))


def select_pages(pages: DataFrame, wanted: list[int] | None = None, first: int | None = None, last: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows of pages (id, page_no) that are chosen: by number; or from first to last; first alone is so many from the start, last alone so many from the end.

    Documents' numbers of pages are joined by sorting: there may be as many as rows, and Spark's estimates do not see pages that were spelled out."""
    page = F.col("page_no")
    if wanted is not None:
        return pages.where(page.isin(*wanted)) if wanted else pages.limit(0)
    if first is not None and last is not None:
        return pages.where((page >= first) & (page <= last))
    if first is not None:
        return pages.where(page <= first)
    if last is None:
        return pages
    total = pages.groupBy(id_col).agg(F.max("page_no").alias("_total"))
    return pages.join(total.hint("merge"), id_col).where(page > F.col("_total") - last).select(*pages.columns)


def range_pages(ranges: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The logical split of a document: pages with part (from 1, in page order) and title of every range that holds them.

    ranges (id, title, start_page, end_page) are spelled out page by page, so that the join has equal keys and long
    documents spread over its tasks. Pages outside all ranges and ranges without pages have no rows; null bounds neither.
    """
    order = Window.partitionBy(id_col).orderBy("start_page", "end_page", "title")
    told = ranges.where("start_page <= end_page").select(id_col, "title", "start_page", "end_page", F.row_number().over(order).alias("part"))
    spelled = told.select(id_col, "part", "title", F.explode(F.sequence(F.col("start_page").cast("int"), F.col("end_page").cast("int"))).alias("page_no"))
    return pages.drop("part", "title").join(spelled.hint("merge"), [id_col, "page_no"])


def plan_parts(pages: DataFrame, totals: DataFrame, outline: DataFrame, least: int = 2, most: int = 20, scanned: int = 10, id_col: str = "doc_id") -> DataFrame:
    """id, title, start_page, end_page, plan: how each paged document is cut.

    pages: id, page_no, text; totals: id, total_pages; outline: id, ord, title, start_page. Two bookmarks inside the document or
    more make the plan; else contents that the pages confirm; else windows of `most` pages. Ranges of the first two plans are
    merged and split between `least` and `most` pages."""
    inside = outline.join(totals.select(id_col, "total_pages"), id_col).where(F.col("start_page").between(1, F.col("total_pages")))
    starts = inside.withColumn("_n", F.count("*").over(Window.partitionBy(id_col))).where("_n >= 2").drop("_n")
    rest = totals.join(starts.select(id_col).distinct(), id_col, "left_anti")
    toc = find_toc_starts(pages.join(rest.select(id_col), id_col, "left_semi"), rest, scanned, id_col)
    windows = fixed_windows(rest.join(toc.select(id_col).distinct(), id_col, "left_anti"), most, id_col)
    named = lambda t, name: t.select(id_col, "title", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), F.lit(name).alias("plan"))
    cut = lambda t: normalise_ranges(ranges_from_starts(t, id_col), least, most, id_col)
    return named(cut(starts), "outline").unionByName(named(cut(toc), "toc")).unionByName(named(windows.withColumn("title", F.lit(None).cast("string")), "windows"))


def plan_ranges(outline: DataFrame, toc: DataFrame, windows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's ranges from its best plan, with plan: outline, else toc, else windows.

    A plan of outline or toc counts if it starts at two pages or more; its front matter is no start of its own.
    """
    starts = lambda t: t.where("title is null or title <> 'Front matter'").groupBy(id_col).agg(F.countDistinct("start_page").alias("n")).where("n >= 2").select(id_col)
    good_outline, good_toc = starts(outline), starts(toc)
    named = lambda t, name: t.select(id_col, "title", "start_page", "end_page", F.lit(name).alias("plan"))
    first = named(outline, "outline").join(good_outline, id_col, "left_semi")
    second = named(toc, "toc").join(good_toc, id_col, "left_semi").join(good_outline, id_col, "left_anti")
    rest = named(windows, "windows").join(good_outline, id_col, "left_anti").join(good_toc, id_col, "left_anti")
    return first.unionByName(second).unionByName(rest)
