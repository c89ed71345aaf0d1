"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers trim it, for Java's regular expressions.
JS_SPACE = r"[\s\x{FEFF}\p{Z}]"

#: File kinds by extension; every other extension is text.
KIND_BY_EXTENSION = {
    "pdf": "pdf", "json": "json", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "mdx": "markdown",
    "srt": "srt", "ass": "ass", "ssa": "ass", "doc": "doc", "docx": "docx", "epub": "epub", "rtf": "rtf", "odt": "odt",
}
SUBTITLE_KINDS = ("srt", "ass")
OFFICE_KINDS = ("doc", "docx", "epub", "rtf", "odt")
#: The output format of a kind where it is not the kind itself.
FORMAT_BY_KIND = dict.fromkeys((*OFFICE_KINDS, "pdf"), "markdown")
#: Extension of an output format where the source's own extension is not kept.
EXTENSION_BY_FORMAT = {"markdown": "md", "text": "txt", "json": "json", "html": "html", "srt": "srt", "ass": "ass"}


def js_trim(c: Column) -> Column:
    """Strips Unicode white space, line ends and the byte order mark at both ends."""
    return F.regexp_replace(c, rf"^{JS_SPACE}+|{JS_SPACE}+\z", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def to_lf(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def basename_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """Lower-cased extension without its dot; empty if there is none. A name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(basename_of(path), r"(?s)^.+\.([^.]*)\z", 1))


def detect_kind(path: Column) -> Column:
    ext = extension_of(path)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_BY_EXTENSION.items() for x in kv])[ext], F.lit("text"))


def is_subtitle_kind(kind: Column) -> Column:
    return kind.isin(*SUBTITLE_KINDS)


def is_office_kind(kind: Column) -> Column:
    return kind.isin(*OFFICE_KINDS)


def output_format(kind: Column) -> Column:
    return F.when(kind.isin(*FORMAT_BY_KIND), "markdown").otherwise(kind)


def output_extension(fmt: Column, source: Column | None = None) -> Column:
    """The format's extension; subtitles and web pages keep the source's own, if it is one of that format."""
    plain = F.create_map(*[F.lit(x) for kv in EXTENSION_BY_FORMAT.items() for x in kv])[fmt]
    if source is None:
        return plain
    ext = extension_of(source)
    kept = ((fmt == "srt") & (ext == "srt")) | ((fmt == "ass") & ext.isin("ass", "ssa")) | ((fmt == "html") & ext.isin("html", "htm"))
    return F.when(kept, ext).otherwise(plain)


def language_slug(language: Column) -> Column:
    """Lower case, with a dash for each run outside a-z and 0-9 and none at the edges; "translated" if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(js_trim(language)), "[^a-z0-9]+", "-"), r"^-|-\z", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("translated"))


def output_name(path: Column, language: Column, fmt: Column) -> Column:
    """<base>.<language>.<extension>"""
    stem = F.regexp_replace(basename_of(path), r"(?<=.)\.[^.]*\z", "")
    return F.concat_ws(".", stem, language_slug(language), output_extension(fmt, path))


def pad_index(index: Column) -> Column:
    """At least three digits."""
    return F.format_string("%03d", index.cast("int"))


def glossary_format(path: Column) -> Column:
    ext = extension_of(path)
    return F.when(ext.isin("json", "csv"), ext).when(ext.isin("md", "markdown"), "markdown").otherwise("text")


def pointer_encode(segment: Column) -> Column:
    """A key as a JSON pointer's segment."""
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_decode(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def escape_html(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(c: Column, quote: Column) -> Column:
    """For a value between these quotes; a value without quotes gets its white space as character references."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    bare = out
    for char, to in (('"', "&quot;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;")):
        bare = F.replace(bare, F.lit(char), F.lit(to))
    bare = F.regexp_replace(bare, r"\s", "&#32;")
    return F.when(quote == '"', F.replace(out, F.lit('"'), F.lit("&quot;"))).when(quote == "'", F.replace(out, F.lit("'"), F.lit("&#39;"))).otherwise(bare)


def ass_visible(c: Column) -> Column:
    """A dialogue's text without override blocks, line breaks and hard spaces as spaces."""
    return js_trim(F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}", ""), r"\\[Nnh]", " "))


def ass_drawing(c: Column) -> Column:
    return c.rlike(r"\{[^}]*\\p[1-9]")


def normalise_title(c: Column) -> Column:
    """Lower case, with one space for each run that holds neither letters nor numbers."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def strip_separators(c: Column) -> Column:
    """Without lines that mark a page, as {12}------, and with at most one blank line in a row."""
    lines = F.filter(F.split(to_lf(c), "\n"), lambda x: ~x.rlike(r"^[ \t]*\{\d+\}[ \t]*-{6,}[ \t]*\z"))
    return js_trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


#: What makes plain text of markdown, in this order: fences, headings, images, links, two kinds of emphasis, code,
#: quotes, rules, blank lines.
MARKDOWN_REWRITES = (
    (r"(?m)^```[^\n]*\n([\s\S]*?)```$", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(\*\*|__)(.*?)\1", "$2"),
    (r"(\*|_)(.*?)\1", "$2"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^\s{0,3}>\s?", ""),
    (r"(?m)^\s*[-*_]{3,}\s*$", ""),
    (r"\n{3,}", "\n\n"),
)


def strip_markdown(c: Column) -> Column:
    """Plain text of markdown."""
    for pattern, to in MARKDOWN_REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return js_trim(c)


def page_count(start: Column, end: Column) -> Column:
    return end - start + 1


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))
