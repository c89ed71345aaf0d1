"""Subtitles: SRT and ASS files to cues and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ass_drawing, ass_visible, js_trim, utf16_length

#: The timing line of an SRT cue.
_TIMING = r"^(\S+)\s+-->\s+(\S+)(.*)\z"
#: The fields of a dialogue line where the file names none.
ASS_FIELDS = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]


def to_lines(raw: Column) -> Column:
    return F.split(F.regexp_replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), r"^\x{FEFF}", ""), "\n")


def uses_crlf(raw: Column) -> Column:
    return F.contains(raw, F.lit("\r\n"))


def srt_blocks(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """id, block_no, is_cue, id of the cue (cue-N counts timed blocks), number, timing, text, raw; native expressions only."""
    body = F.array_join(to_lines(F.col(raw_col)), "\n")
    blocks = docs.select(id_col, F.posexplode(F.split(body, r"\n\s*\n")).alias("block_no", "raw")).where(js_trim(F.col("raw")) != "")
    lines = F.split("raw", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    nth = F.sum(F.when(F.col("at") > 0, 1).otherwise(0)).over(Window.partitionBy(id_col).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0))
    found = blocks.withColumn("lines", lines).withColumn("at", at).withColumn("nth", nth)
    number = js_trim(F.array_join(F.slice("lines", 1, F.greatest(F.col("at") - 1, F.lit(0))), "\n"))
    text = js_trim(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), "\n"))
    is_cue = F.col("at") > 0
    return found.select(
        id_col, "block_no", is_cue.alias("is_cue"), F.when(is_cue, F.concat(F.lit("cue-"), F.col("nth"))).alias("cue"),
        F.when(is_cue, F.coalesce(F.nullif(number, F.lit("")), F.col("nth").cast("string"))).alias("number"),
        F.when(is_cue, js_trim(F.element_at("lines", F.greatest("at", F.lit(1))))).alias("timing"), F.when(is_cue, text).alias("text"), "raw",
    )


def srt_cues(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """id, ord, cue, text, start, end of the cues that have a text; the others leave gaps in the ids."""
    got = srt_blocks(docs, id_col, raw_col).where("is_cue and text <> ''")
    part = lambda k: F.nullif(F.regexp_extract("timing", _TIMING, k), F.lit(""))
    return got.select(id_col, F.col("block_no").alias("ord"), "cue", "text", part(1).alias("start"), part(2).alias("end"))


def last_translations(translations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One translation for each cue: the last by ord, where the table has that column; null cues and translations do not count."""
    order = F.col("ord") if "ord" in translations.columns else F.lit(0)
    return translations.where("cue is not null and translation is not null").groupBy(id_col, "cue").agg(F.max_by("translation", F.struct(order, "translation")).alias("translation"))


def rebuild_srt(docs: DataFrame, translations: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """docs with translations (id, cue, translation, ord) in place of texts; of several for a cue the last holds; what has none keeps
    its own."""
    blocks = srt_blocks(docs, id_col, raw_col).join(last_translations(translations, id_col), [id_col, "cue"], "left")
    shown = F.when(F.col("is_cue"), F.concat_ws("\n", "number", "timing", F.coalesce("translation", "text"))).otherwise(F.col("raw"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", shown.alias("s")))), lambda r: r["s"]), "\n\n")
    built = blocks.groupBy(id_col).agg(F.concat(joined, F.lit("\n")).alias("_built"))
    out = F.when(uses_crlf(F.col(raw_col)), F.replace("_built", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("_built"))
    return docs.join(built, id_col, "left").withColumn(raw_col, F.coalesce(out, F.col(raw_col))).drop("_built")


def ass_lines(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """id, line_no, line, and for dialogue lines of the events section: fields, head (with its last comma) and text.

    Section and field names carry forward over a document's lines."""
    lines = docs.select(id_col, F.posexplode(to_lines(F.col(raw_col))).alias("line_no", "line"))
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract(js_trim(F.col("line")), r"^\[(.+)\]\z", 1)
    section = F.when(header != "", F.lower(js_trim(header)))
    lines = lines.withColumn("section", F.last(section, ignorenulls=True).over(order))
    named = F.transform(F.split(F.regexp_replace("line", r"(?i)^\s*format\s*:", ""), ","), lambda x: F.lower(js_trim(x)))
    default = F.array(*[F.lit(x) for x in ASS_FIELDS])
    own = F.when((F.col("section") == "events") & F.col("line").rlike(r"(?i)^\s*format\s*:"), F.when(F.array_contains(named, "text"), named).otherwise(default))
    fields = F.when(section == "events", default).otherwise(own)  # each events section begins with the usual fields
    lines = lines.withColumn("fields", F.coalesce(F.last(fields, ignorenulls=True).over(order), default))
    n = F.array_position("fields", "text").cast("int")
    lead = F.regexp_extract("line", r"(?i)^(\s*dialogue\s*:)", 1)
    values = F.split(F.substr("line", F.length(lead) + 1, F.length("line")), ",")
    is_dialogue = (F.col("section") == "events") & F.col("line").rlike(r"(?i)^\s*dialogue\s*:") & (F.size(values) >= n)
    before = F.array_join(F.slice(values, 1, n - 1), ",")
    head = F.concat(lead, before, F.when(n > 1, ",").otherwise(""))
    value = lambda name: F.when(is_dialogue & F.array_position("fields", name).between(1, n - 1), js_trim(F.get(values, F.array_position("fields", name).cast("int") - 1)))
    return lines.select(
        id_col, "line_no", "line", F.when(is_dialogue, head).alias("head"), F.when(is_dialogue, F.array_join(F.slice(values, F.greatest(n, F.lit(1)), F.size(values)), ",")).alias("text"),
        value("start").alias("start"), value("end").alias("end"), value("style").alias("style"),
    )


def ass_cues(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """id, ord, cue (line-N), text, start, end, style; drawings and lines without visible text are left out."""
    got = ass_lines(docs, id_col, raw_col).where(F.col("head").isNotNull() & ~ass_drawing(F.col("text")) & (ass_visible(F.col("text")) != ""))
    return got.select(id_col, F.col("line_no").alias("ord"), F.concat(F.lit("line-"), F.col("line_no")).alias("cue"), "text", "start", "end", "style")


def rebuild_ass(docs: DataFrame, translations: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """docs with translations (id, cue, translation, ord) in place of texts, the last of a cue; their line breaks become the format's own."""
    lines = ass_lines(docs, id_col, raw_col).withColumn("cue", F.concat(F.lit("line-"), F.col("line_no"))).join(last_translations(translations, id_col), [id_col, "cue"], "left")
    put = F.regexp_replace("translation", r"\r\n|\n", r"\\N")
    shown = F.when(F.col("head").isNotNull() & F.col("translation").isNotNull(), F.concat("head", put)).otherwise(F.col("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("s")))), lambda r: r["s"]), "\n")
    built = lines.groupBy(id_col).agg(joined.alias("_built"))
    out = F.when(uses_crlf(F.col(raw_col)), F.replace("_built", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("_built"))
    return docs.join(built, id_col, "left").withColumn(raw_col, F.coalesce(out, F.col(raw_col))).drop("_built")


def cues_of(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw", format_col: str = "format") -> DataFrame:
    """The cues of docs of both formats (srt, ass): id, ord, cue, text, start, end, style (null in SRT)."""
    part = lambda name: docs.where(F.col(format_col) == name)
    return srt_cues(part("srt"), id_col, raw_col).unionByName(ass_cues(part("ass"), id_col, raw_col), allowMissingColumns=True)


def rebuild_subtitles(docs: DataFrame, translations: DataFrame, id_col: str = "doc_id", raw_col: str = "raw", format_col: str = "format") -> DataFrame:
    """docs of both formats with translations in place, each by its own format's rules."""
    part = lambda name: docs.where(F.col(format_col) == name)
    return rebuild_srt(part("srt"), translations, id_col, raw_col).unionByName(rebuild_ass(part("ass"), translations, id_col, raw_col))


def styles_of(cues: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and styles: the cues' styles, each once, in the order in which they first come; empty for documents with none."""
    first = cues.groupBy(id_col, "style").agg(F.min("ord").alias("o"))
    listed = F.array_sort(F.collect_list(F.when(F.col("style") != "", F.struct("o", "style"))))
    return first.groupBy(id_col).agg(F.transform(listed, lambda r: r["style"]).alias("styles"))


def inspect_cues(cues: DataFrame, id_col: str = "doc_id", sample: int = 5) -> DataFrame:
    """Per document: number of cues, characters, first start, last end, and the first cues' texts."""
    texts = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), 1, sample)
    return cues.groupBy(id_col).agg(
        F.count("*").alias("cue_count"), F.sum(utf16_length(F.col("text"))).alias("characters"),
        F.min_by("start", "ord").alias("first_start"), F.max_by("end", "ord").alias("last_end"), texts.alias("sample"),
    )


def cue_page(cues: DataFrame, offset: int, limit: int = 100, id_col: str = "doc_id") -> DataFrame:
    """Cues offset .. offset + limit - 1 of each document (limit 1 to 500), with the total."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    own = Window.partitionBy(id_col)
    return cues.withColumn("_n", F.row_number().over(own.orderBy("ord"))).withColumn("total", F.count("*").over(own)).where(F.col("_n").between(offset + 1, offset + limit)).drop("_n")
