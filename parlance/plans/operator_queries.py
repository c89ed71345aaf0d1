"""More queries: every operator on inputs whose rows SQL can say too. They are added to the same tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, discover, pack, structured, subtitles
from .queries import _CUES, _read, _srt, greedy_sql, query

#: Extensions in turn, and the kind, output format, output extension and glossary format of each.
EXTENSIONS = ("pdf", "json", "HTML", "htm", "md", "mdx", "srt", "ass", "ssa", "docx", "odt", "bin")
_KINDS = """(VALUES (0, 'pdf', 'pdf', 'markdown', 'md', 'text'), (1, 'json', 'json', 'json', 'json', 'json'), (2, 'HTML', 'html', 'html', 'html', 'text'), (3, 'htm', 'html', 'html', 'htm', 'text'),
    (4, 'md', 'markdown', 'markdown', 'md', 'markdown'), (5, 'mdx', 'markdown', 'markdown', 'md', 'text'), (6, 'srt', 'srt', 'srt', 'srt', 'text'), (7, 'ass', 'ass', 'ass', 'ass', 'text'),
    (8, 'ssa', 'ass', 'ass', 'ssa', 'text'), (9, 'docx', 'docx', 'markdown', 'md', 'text'), (10, 'odt', 'odt', 'markdown', 'md', 'text'), (11, 'bin', 'text', 'text', 'txt', 'text')) AS k(i, ext, kind, format, out_ext, glossary)"""


def _ext(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % len(EXTENSIONS) + 1).cast("int"))


@query(f"""
    SELECT p_partkey AS doc_id, kind, kind IN ('srt', 'ass') AS subtitle, kind IN ('docx', 'odt') AS office, format, out_ext, glossary, lower(ext) AS ext, 'f.' || p_partkey || '.' || ext AS base,
        '' AS hidden_ext, 'f.' || p_partkey || '.fr-ca.' || out_ext AS name, printf('%03d', p_partkey) AS padded, greatest(3, least(p_size, 30)) AS clamped, p_size + 1 AS pages
    FROM part JOIN {_KINDS} ON i = p_partkey % 12""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    path = F.concat(F.lit("a.b/f."), "p_partkey", F.lit("."), _ext(F.col("p_partkey")))
    kind = T.detect_kind(path)
    fmt = T.output_format(kind)
    return part.select(
        F.col("p_partkey").alias("doc_id"), kind.alias("kind"), T.is_subtitle_kind(kind).alias("subtitle"), T.is_office_kind(kind).alias("office"), fmt.alias("format"), T.output_extension(fmt, path).alias("out_ext"),
        T.glossary_format(path).alias("glossary"), T.extension_of(path).alias("ext"), T.basename_of(path).alias("base"), T.extension_of(F.concat(F.lit("a.b/."), "p_name")).alias("hidden_ext"),
        T.output_name(path, F.lit(" Fr_CA. "), fmt).alias("name"), T.pad_index(F.col("p_partkey")).alias("padded"), T.clamp(F.col("p_size"), F.lit(3), F.lit(30)).alias("clamped"), T.page_count(F.lit(0), F.col("p_size")).alias("pages"),
    )


@query("SELECT n_nationkey AS doc_id, 'a~1' || n_name || '~0b~01' AS encoded, 'a/' || n_name || '~b~1' AS decoded FROM nation")
def pointer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("a/"), "n_name", F.lit("~b~1"))
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), T.pointer_encode(raw).alias("encoded"), T.pointer_decode(T.pointer_encode(raw)).alias("decoded"))


@query(r"""
    WITH t AS (SELECT doc_id, '<"' || text || '''>' AS text FROM documents), a AS (SELECT *, replace(text, '&', '&amp;') AS e FROM t)
    SELECT doc_id, replace(replace(e, '<', '&lt;'), '>', '&gt;') AS body, replace(e, '"', '&quot;') AS double, replace(e, '''', '&#39;') AS single,
        regexp_replace(replace(replace(replace(replace(e, '"', '&quot;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '\s', '&#32;', 'g') AS bare FROM a""")
def escaped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('<"'), "text", F.lit("'>"))
    quoted = lambda q: T.escape_attribute(text, F.lit(q))
    return _read(spark, sf_dir, "documents").select("doc_id", T.escape_html(text).alias("body"), quoted('"').alias("double"), quoted("'").alias("single"), quoted("").alias("bare"))


_TRIMMED = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"SELECT doc_id, {_TRIMMED.format("regexp_replace(text || chr(10) || text, '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents)")
def separators_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("{0}------\n"), "text", F.lit("\n \t{12} ---------\t\n"), "text", F.lit("\n{13}------"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.strip_separators(text).alias("text"))


@query(f"SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, t AS content FROM (SELECT *, {_TRIMMED.format("replace(text, chr(13) || chr(10), chr(10))")} AS t FROM conversations) WHERE t <> ''")
def paginated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("{"), "turn", F.lit("}--------\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("turn", page.alias("s"))))
    docs = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("content"))
    return chunk.paginated_pages(docs)


# chunking


@query("""
    SELECT s_nationkey AS doc_id, CAST(row_number() OVER w AS INTEGER) AS part_index, s_name AS title, '## ' || s_name || chr(10) || chr(10) || repeat('x', 80) AS content
    FROM supplier WHERE (SELECT count(*) FROM supplier s WHERE s.s_nationkey = supplier.s_nationkey) > 1 WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)
    UNION ALL SELECT s_nationkey, 1, NULL, '## ' || min(s_name) || chr(10) || chr(10) || repeat('x', 80) FROM supplier GROUP BY s_nationkey HAVING count(*) = 1""")
def chunk_by_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of over half the budget: each is a part under its heading; a document that fits is one untitled part."""
    section = F.concat(F.lit("## "), "s_name", F.lit("\r\n\r\n"), F.repeat(F.lit("x"), 80))
    rows = F.array_sort(F.collect_list(F.struct("s_suppkey", section.alias("s"))))
    docs = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\r\n").alias("content"))
    return chunk.chunk_documents(docs, 110)


@query("""
    WITH t AS (SELECT n_nationkey AS doc_id, n_name AS n, repeat('y', 60) AS y FROM nation)
    SELECT doc_id, 1 AS part_index, n AS title, '# ' || n || chr(10) || chr(10) || '## one' || chr(10) || chr(10) || 'short' || chr(10) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || chr(10) || '## two' AS content FROM t
    UNION ALL SELECT doc_id, 2, 'a', '### a' || chr(10) || y FROM t UNION ALL SELECT doc_id, 3, 'b', '### b' || chr(10) || y FROM t
    UNION ALL SELECT doc_id, 4, 'three', '## three' || chr(10) || chr(10) || 'p1' || chr(10) || 'p2' FROM t UNION ALL SELECT doc_id, 5, 'three', y || y FROM t UNION ALL SELECT doc_id, 6, 'three', 'end' FROM t""")
def chunk_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sections share a part, a fence hides its headings, a long section falls to its subsections, and one without any to blocks, of which
    a line over the budget stands alone."""
    y = "y" * 60
    text = F.concat(
        F.lit("# "), "n_name", F.lit(f"\n\n## one\n\nshort\n\n```\n# no heading\n```\n\n## two\n### a\n{y}\n### b\n{y}\n\n## three\n\np1\np2\n\n{y}{y}\n\nend\n")
    )
    return chunk.chunk_documents(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), text.alias("content")), 75)


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_TURNS = f"SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ord, {_FLAT} AS block FROM conversations WHERE {_FLAT} <> ''"


@query(greedy_sql(f"SELECT doc_id, ord, len(block) + 2 AS cost FROM ({_TURNS})", "doc_id", 5000, None, f"""
    , pieces AS (SELECT t.doc_id, b.bin, string_agg(block, chr(10) || chr(10) ORDER BY t.ord) AS piece FROM ({_TURNS}) t JOIN bins b USING (doc_id, ord) GROUP BY ALL),
    whole AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY ord) AS t FROM ({_TURNS}) GROUP BY doc_id)
    SELECT doc_id, CAST(bin + 1 AS INTEGER) AS part_index, CAST(NULL AS VARCHAR) AS title, piece AS content FROM pieces JOIN whole USING (doc_id) WHERE len(t) > 5000
    UNION ALL SELECT doc_id, 1, NULL, t FROM whole WHERE len(t) <= 5000"""))
def chunk_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are blocks; none is over the budget."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = F.array_sort(F.collect_list(F.struct("turn", flat.alias("s"))))
    docs = _read(spark, sf_dir, "conversations").where(flat != "").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n\n").alias("content"))
    return chunk.chunk_documents(docs, 5000)


# JSON and HTML


@query("""
    SELECT n_nationkey AS doc_id, n_nationkey % 4 = 0 AS translatable FROM nation""")
def json_translatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.concat(F.lit('{"a": [1, {"b": "'), "n_name", F.lit('"}]}')), F.lit('{"a": [" ", 2, null]}'), F.lit('"text"'), F.lit("[]")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return structured.translatable_json(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), raw.alias("raw")))


@query("SELECT c_nationkey AS doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, '/' || (row_number() OVER w - 1) AS pointer, c_name AS value, CAST((row_number() OVER w - 1) // 7 AS INTEGER) AS batch FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    docs = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.to_json(F.transform(rows, lambda r: r["c_name"])).alias("raw"))
    entries = structured.flatten_json(docs).withColumn("cost", T.utf16_length(F.col("pointer")) + T.utf16_length(F.col("value")))
    return pack.greedy_pack(entries, "doc_id", "ord", "cost", budget=20_000, cap=7).drop("cost")


def _page(name: Column, region: Column) -> Column:
    return F.concat(
        F.lit("<html><head><title>"), name, F.lit('</title><meta NAME=" Description " content="R &amp; '), region, F.lit('"><meta property=og:title content='), name,
        F.lit('><meta name="viewport" content="no"><script title="no">var x = "no";</script></head><body><p title=\''), region, F.lit("' id=x>Hello <b>"), name, F.lit("</b><br>\n<code>no</code></p><img alt=\""), name,
        F.lit('" src="no"><!-- no --><svg><text>no</text></svg>end</body></html>'),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("doc_id"), _page(F.col("n_name"), F.col("r_name")).alias("raw"))


_MARKED = """(SELECT n_nationkey AS doc_id, x.ord, x.pointer, CASE x.v WHEN 'N' THEN n_name WHEN 'R' THEN r_name WHEN 'R & ' THEN 'R & ' || r_name ELSE x.v END AS value
    FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0, 't-1', 'N'), (1, 'a-1', 'R & '), (2, 'a-2', 'N'), (3, 'a-3', 'R'), (4, 't-2', 'Hello '), (5, 't-3', 'N'), (6, 'a-4', 'N'), (7, 't-4', 'end')) AS x(ord, pointer, v))"""


@query(f"SELECT * FROM {_MARKED}")
def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.flatten_html(_pages(spark, sf_dir))


@query(f"SELECT doc_id, count(*) AS entry_count, count(*) FILTER (pointer LIKE 't%') AS text_count, count(*) FILTER (pointer LIKE 'a%') AS attribute_count, string_agg(value, '|' ORDER BY ord) FILTER (ord < 3) AS sample FROM {_MARKED} GROUP BY doc_id")
def html_attribute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.inspect_html(structured.flatten_html(_pages(spark, sf_dir)), sample=3).withColumn("sample", F.array_join("sample", "|"))


@query("""
    SELECT n_nationkey AS doc_id, '<html><head><title>&lt;' || n_name || '&gt; &amp; "''</title><meta NAME=" Description " content="<R & ' || r_name || '> & &quot;''"><meta property=og:title content=&lt;' || n_name || '&gt;&#32;&amp;&#32;&quot;&#39;><meta name="viewport" content="no"><script title="no">var x = "no";</script></head><body><p title=''<'
        || r_name || '> & "&#39;'' id=x>&lt;Hello &gt; &amp; "''<b>' || n_name || '</b><br>' || chr(10) || '<code>no</code></p><img alt="<' || n_name || '> & &quot;''" src="no"><!-- no --><svg><text>no</text></svg>&lt;end&gt; &amp; "''</body></html>' AS raw
    FROM nation JOIN region ON n_regionkey = r_regionkey""".replace("<R & ", "<R &amp; ").replace("> & &quot;", "> &amp; &quot;").replace("""'> & "&#39;""", """'> &amp; "&#39;"""))
def html_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value in angle brackets, with an ampersand and both quotes behind it; of two replies the later, and one text without any."""
    pages = _pages(spark, sf_dir)
    entries = structured.flatten_html(pages).where("pointer <> 't-3'")
    late = entries.select("doc_id", "pointer", F.concat(F.lit("<"), "value", F.lit("> & \"'")).alias("translation"), F.lit(1).alias("ord"))
    return structured.rebuild_html_docs(pages, late.unionByName(late.withColumn("translation", F.lit("early")).withColumn("ord", F.lit(0))))


# subtitles


def _ass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a nation: two events sections, of which the second is without a format; a drawing, a comment and an override."""
    raw = F.concat(
        F.lit("\ufeff[Script Info]\r\nDialogue: no\r\n[ Events ]\r\nFormat: Layer, Start, End, Style, Text\r\nDialogue: 0,0:00:01,0:00:02,Main,{\\i1}"), "n_name", F.lit(", with comma\r\nComment: 0,0:00:01,0:00:02,Main,no\r\nDialogue: 0,0:00:02,0:00:03,Sign,{\\p1}m 0 0\r\n"),
        F.lit("[Fonts]\r\nDialogue: no\r\n[events]\r\nDialogue: 0,0:00:04,0:00:05,Alt,name,0,0,0,fx,"), "n_name", F.lit("\\Nagain\r\nDialogue: 0,0:00:06,0:00:07,Alt,name,0,0,0,fx,{\\b1}\r\n"),
    )
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), raw.alias("raw"))


_ASS = """(SELECT n_nationkey AS doc_id, x.ord, 'line-' || x.ord AS cue, replace(x.t, 'N!', n_name) AS text, x.s AS start, x.e AS "end", x.style FROM nation,
    (VALUES (4, '{\\i1}N!, with comma', '0:00:01', '0:00:02', 'Main'), (10, 'N!\\Nagain', '0:00:04', '0:00:05', 'Alt')) AS x(ord, t, s, e, style))"""


@query(f"SELECT * FROM {_ASS}")
def ass_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.ass_cues(_ass(spark, sf_dir))


@query("""
    SELECT n_nationkey AS doc_id, replace('[Script Info]|Dialogue: no|[ Events ]|Format: Layer, Start, End, Style, Text|Dialogue: 0,0:00:01,0:00:02,Main,neu\\Nzwei|Comment: 0,0:00:01,0:00:02,Main,no|Dialogue: 0,0:00:02,0:00:03,Sign,{\\p1}m 0 0|[Fonts]|Dialogue: no|[events]|Dialogue: 0,0:00:04,0:00:05,Alt,name,0,0,0,fx,', '|', chr(13) || chr(10))
        || n_name || '\\Nagain' || chr(13) || chr(10) || 'Dialogue: 0,0:00:06,0:00:07,Alt,name,0,0,0,fx,{\\b1}' || chr(13) || chr(10) AS raw FROM nation""")
def ass_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ass(spark, sf_dir)
    reply = lambda text, ord_: docs.select("doc_id", F.lit("line-4").alias("cue"), F.lit(text).alias("translation"), F.lit(ord_).alias("ord"))
    return subtitles.rebuild_ass(docs, reply("neu\nzwei", 2).unionByName(reply("alt", 1)))


@query(f"SELECT doc_id, ord, cue, text, start, \"end\", CAST(NULL AS VARCHAR) AS style FROM ({_CUES}) UNION ALL SELECT doc_id + 1000000, ord, cue, text, start, \"end\", style FROM {_ASS}")
def cues_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.cues_of(_both(spark, sf_dir))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    ass = _ass(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long") + 1_000_000).withColumn("format", F.lit("ass"))
    return _srt(spark, sf_dir).withColumn("format", F.lit("srt")).unionByName(ass)


@query(f"SELECT doc_id, '' AS styles FROM ({_CUES}) GROUP BY doc_id UNION ALL SELECT n_nationkey + 1000000, 'Main|Alt' FROM nation")
def cue_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.styles_of(cues_of_both(spark, sf_dir)).withColumn("styles", F.array_join("styles", "|"))


@query("""
    SELECT n_nationkey AS doc_id, 'note without time' || chr(10) || chr(10) || '1' || chr(10) || '00:01-->00:02' || chr(10) || n_name || chr(10) || chr(10) || '2' || chr(10) || '00:03 --> 00:04 X1:0' || chr(10) || 'neu' || chr(10) || 'zwei' || chr(10) || chr(10) || 'last --> line' || chr(10) AS raw FROM nation""".replace("'last --> line'", "'3' || chr(10) || 'last --> line' || chr(10)"))
def srt_odd_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without a time stay; numbers are filled in; a cue without text keeps its place."""
    raw = F.concat(F.lit("\ufeffnote without time\n\n1\n00:01-->00:02\n"), "n_name", F.lit("\n \n2\n00:03 --> 00:04 X1:0\nold\n\n\nlast --> line"))
    docs = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), raw.alias("raw"))
    return subtitles.rebuild_srt(docs, docs.select("doc_id", F.lit("cue-2").alias("cue"), F.lit("neu\nzwei").alias("translation")))


@query("""SELECT n_nationkey AS doc_id, x.* FROM nation, (VALUES (1, 'cue-1', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)), (2, 'cue-2', '00:03', '00:04')) AS x(ord, cue, start, "end")""")
def srt_odd_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("note\n\n1\n00:01-->00:02\n"), "n_name", F.lit("\n\n2\n00:03 --> 00:04 X1:0\nold\n"))
    return subtitles.srt_cues(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), raw.alias("raw"))).drop("text")


@query(greedy_sql(f"SELECT doc_id, ord, len(text) AS cost FROM ({_CUES})", "doc_id", 3000, 2, "SELECT doc_id, CAST(ord AS INTEGER) AS ord, bin AS batch FROM bins"))
def cue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = subtitles.srt_cues(_srt(spark, sf_dir)).withColumn("cost", T.utf16_length(F.col("text")))
    return pack.greedy_pack(cues, "doc_id", "ord", "cost", budget=3000, cap=2).select("doc_id", "ord", "batch")


@query(f"""
    SELECT c_custkey AS doc_id, '{{' || chr(10) || '  "7": ' || c_custkey || '.50,' || chr(10) || '  "n": 1e400,' || chr(10) || '  "t": "' || upper(c_name) || '",' || chr(10) || '  "big": ' || repeat('9', 30) || c_custkey || chr(10) || '}}' || chr(10) AS raw FROM customer""")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers come through a rebuilt bundle as they are spelled, whatever their size; whole-number keys go first."""
    c = _read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc_id")
    raw = F.concat(F.lit('{"n":1e400,"7":'), "doc_id", F.lit('.50,"t":"'), "c_name", F.lit('","big":'), F.repeat(F.lit("9"), F.lit(30)), "doc_id", F.lit("}"))
    told = c.select("doc_id", F.lit("/t").alias("pointer"), F.upper("c_name").alias("translation"), F.lit(0).alias("ord"))
    return structured.rebuild_json_docs(c.select("doc_id", raw.alias("raw")), told).select("doc_id", "raw")


@query("""
    SELECT s_suppkey AS project, 'a ' || s_name || '.srt|A ' || s_name || '.srt|B ' || s_name || '.srt|c ' || s_name || '.srt|É ' || s_name || '.srt|f ' || s_name || '.srt' AS source_paths, 'b terms.md' AS glossary_path FROM supplier""")
def paths_in_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a project in the order of the root locale, and the first of several glossaries in it."""
    s = _read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "project")
    names = F.array(*[F.concat(F.lit(f"{c} "), "s_name", F.lit(".srt")) for c in "BfaÉcA"], F.lit("C terms.md"), F.lit("b terms.md"), F.lit("d terms.md"))
    found = discover.discover_projects(s.select("project"), s.select("project", F.explode(names).alias("path")))
    return found.select("project", F.array_join("source_paths", "|").alias("source_paths"), "glossary_path")


@query("""
    SELECT s_suppkey AS doc_id, CAST(o AS INTEGER) AS ord, p AS pointer, CASE o WHEN 0 THEN 'stray ' || s_name || ' again' WHEN 2 THEN s_name WHEN 1 THEN 'cell' WHEN 3 THEN 'un' WHEN 4 THEN 'closed' WHEN 5 THEN s_name WHEN 6 THEN s_name WHEN 7 THEN 'both' WHEN 8 THEN 'over' ELSE 'after' END AS value
    FROM supplier, (VALUES (0, 't-1'), (1, 't-2'), (2, 'a-1'), (3, 't-3'), (4, 't-4'), (5, 't-5'), (6, 'a-2'), (7, 't-6'), (8, 't-7'), (9, 't-8')) AS v(o, p)""")
def html_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a browser mends: text astray in a table goes before it, paragraphs end where others begin, marks that overlap are opened again."""
    s = _read(spark, sf_dir, "supplier")
    page = F.concat(
        F.lit("<table>stray "), "s_name", F.lit("<tr><td>cell</td></tr> again</table><p title='"), "s_name", F.lit("'>un<p>closed<div>"), "s_name",
        F.lit("</div><p>"), F.lit("<b title="), F.regexp_replace("s_name", "[^A-Za-z0-9#]", ""), F.lit(">both<i>over</b>after</i>"),
    )
    return structured.flatten_html(s.select(F.col("s_suppkey").alias("doc_id"), page.alias("raw")))
