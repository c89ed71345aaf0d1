"""Queries over the test tables, one for each operator of the localization engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, discover, glossary, pack, ranges, structured, subtitles
from ..sources import files, sinks
from . import localize, prepare, prompts, replies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def greedy_sql(items: str, group: str, budget: int, cap: int | None, result: str) -> str:
    """SQL with `bins` (group, ord, bin) of items (group, ord, cost) filled in order under a budget and a cap, and a result from it."""
    over = f"a.used + x.cost > {budget}" + (f" OR a.n >= {cap}" if cap else "")
    first = "{{'ord': x.ord, 'cost': x.cost, 'bin': {0}, 'used': {1}, 'n': {2}}}"
    step = f"CASE WHEN {over} THEN {first.format('a.bin + 1', 'x.cost', '1')} ELSE {first.format('a.bin', 'a.used + x.cost', 'a.n + 1')} END"
    step = step.replace("a.", "acc[len(acc)].").replace("x.", "x[1].")
    return f"""
    WITH items AS ({items}),
    folded AS (SELECT {group}, list_reduce(list([{{'ord': CAST(ord AS BIGINT), 'cost': CAST(cost AS BIGINT), 'bin': CAST(0 AS BIGINT), 'used': CAST(cost AS BIGINT), 'n': CAST(1 AS BIGINT)}}] ORDER BY ord), lambda acc, x: list_append(acc, {step})) AS l FROM items GROUP BY {group}),
    bins AS (SELECT {group}, u.ord AS ord, CAST(u.bin AS INTEGER) AS bin FROM (SELECT {group}, unnest(l) AS u FROM folded))
    {result}"""


_LINES = "SELECT doc_id, i - 1 AS line_no, l[i] AS line, len(l[i]) + 1 AS cost FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS s, unnest(range(1, len(l) + 1)) AS u(i)"


@query(f"""
    WITH RECURSIVE c AS (SELECT doc_id, line_no, cost, sum(cost) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM ({_LINES})),
    nx AS (SELECT a.doc_id, a.line_no, min(b.line_no) AS next FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND b.line_no > a.line_no AND b.upto - (a.upto - a.cost) > 2000 GROUP BY ALL),
    r AS (SELECT doc_id, line_no, next, 0 AS batch FROM nx WHERE line_no = 0 UNION ALL SELECT nx.doc_id, nx.line_no, nx.next, r.batch + 1 FROM r JOIN nx ON nx.doc_id = r.doc_id AND nx.line_no = r.next)
    SELECT r.doc_id, CAST(r.batch AS INTEGER) AS batch, CAST(count(*) AS BIGINT) AS lines, CAST(sum(c.cost) AS BIGINT) AS chars
    FROM r JOIN c ON c.doc_id = r.doc_id AND c.line_no >= r.line_no AND (r.next IS NULL OR c.line_no < r.next) GROUP BY ALL""")
def line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").where(T.js_trim(F.col("text")) != "")
    costs = F.transform(F.split("text", "\n"), lambda x: T.utf16_length(x) + 1)
    packed = docs.select("doc_id", costs.alias("costs")).withColumn("bins", pack.pack_array(F.col("costs"), 2000))
    totals = packed.select("doc_id", F.explode(pack.bin_totals(F.col("costs"), F.col("bins"))).alias("z"))
    return totals.select("doc_id", "z.batch", F.col("z.items").alias("lines"), F.col("z.cost").alias("chars"))


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_CONTENT = """(SELECT doc_id, source, '# ' || source || chr(10) || chr(10) || '## part' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS content, text
    FROM (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(text, '') AS text FROM documents))"""
_BLOCKS = f"(SELECT doc_id, i - 1 AS ord, {_TRIM.format('l[i]')} AS block FROM (SELECT doc_id, list_prepend('## part', string_split(text, chr(10))) AS l FROM {_CONTENT}) s, unnest(range(1, len(l) + 1)) AS u(i) WHERE {_TRIM.format('l[i]')} <> '')"
_PIECES = greedy_sql(f"SELECT doc_id, ord, len(block) + 2 AS cost FROM {_BLOCKS}", "doc_id", 2000, None, f"SELECT doc_id, bin + 1 AS ord, string_agg(block, chr(10) || chr(10) ORDER BY b.ord) AS piece FROM {_BLOCKS} b JOIN bins USING (doc_id, ord) GROUP BY ALL")


@query(greedy_sql(f"SELECT doc_id, ord, len(piece) + 2 AS cost FROM (SELECT * FROM ({_PIECES}) UNION ALL SELECT doc_id, 0, '# ' || source FROM {_CONTENT})", "doc_id", 2002, None, f"""
    , p AS (SELECT * FROM ({_PIECES}) UNION ALL SELECT doc_id, 0, '# ' || source FROM {_CONTENT})
    SELECT p.doc_id, CAST(bin + 1 AS INTEGER) AS part_index, CASE WHEN bin = 0 THEN any_value(c.source) ELSE 'part' END AS title, string_agg(piece, chr(10) || chr(10) ORDER BY p.ord) AS content
    FROM p JOIN bins USING (doc_id, ord) JOIN {_CONTENT} c ON c.doc_id = p.doc_id WHERE len(c.content) > 2000 GROUP BY p.doc_id, bin
    UNION ALL SELECT doc_id, 1, NULL, {_TRIM.format('content')} FROM {_CONTENT} WHERE len(content) <= 2000"""))
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, text = F.coalesce("source", F.lit("unknown")), F.coalesce("text", F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), source, F.lit("\n\n## part\n\n"), F.regexp_replace(text, "\n", "\n\n")).alias("content"))
    return chunk.chunk_documents(docs, 2000)


@query("""
    SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([^./]*)$', 1)) IN ('html', 'htm') THEN 'html' WHEN lower(regexp_extract(url, '\\.([^./]*)$', 1)) = 'pdf' THEN 'pdf'
        WHEN lower(regexp_extract(url, '\\.([^./]*)$', 1)) = 'json' THEN 'json' ELSE 'text' END AS kind FROM pages""")
def kind_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", T.detect_kind(F.col("url")).alias("kind"))


@query("""
    SELECT n_nationkey, 'report.' || coalesce(nullif(regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'translated') || '.md' AS name FROM nation""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.lit("docs/report.pdf")
    return _read(spark, sf_dir, "nation").select("n_nationkey", T.output_name(path, F.col("n_name"), T.output_format(T.detect_kind(path))).alias("name"))


@query("SELECT p_partkey AS doc_id, CAST(s AS INTEGER) AS start_page, CAST(least(s + 6, p_size) AS INTEGER) AS end_page FROM part, unnest(range(1, p_size + 1, 7)) AS u(s)")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.fixed_windows(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("total_pages")), 7)


_STARTS = "SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS ord, 'part ' || l_partkey AS title, CAST(l_quantity AS INTEGER) AS start_page, 60 AS total_pages FROM lineitem"


@query(f"""
    WITH f AS (SELECT doc_id, start_page, min_by(title, ord) AS title, max(total_pages) AS total FROM ({_STARTS}) GROUP BY ALL),
    e AS (SELECT *, coalesce(lead(start_page) OVER w - 1, total) AS end_page, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY start_page))
    SELECT doc_id, title, start_page, end_page FROM e UNION ALL SELECT doc_id, 'Front matter', 1, start_page - 1 FROM e WHERE k = 1 AND start_page > 1""")
def ranges_from_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.ranges_from_starts(_starts(spark, sf_dir))


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").agg(F.count("*").alias("c")).select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("part "), "l_partkey").alias("title"), F.col("l_quantity").cast("int").alias("start_page"), F.lit(60).alias("total_pages")
    )


_RANGES = f"""SELECT doc_id, title, start_page, end_page FROM (
    WITH f AS (SELECT doc_id, start_page, min_by(title, ord) AS title, max(total_pages) AS total FROM ({_STARTS}) GROUP BY ALL),
    e AS (SELECT *, coalesce(lead(start_page) OVER w - 1, total) AS end_page, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY start_page))
    SELECT doc_id, title, start_page, end_page FROM e UNION ALL SELECT doc_id, 'Front matter', 1, start_page - 1 FROM e WHERE k = 1 AND start_page > 1)"""


@query(f"""
    WITH g AS (SELECT doc_id, list([{{'s': CAST(start_page AS BIGINT), 'e': CAST(end_page AS BIGINT), 't': title}}] ORDER BY start_page) AS l FROM ({_RANGES}) GROUP BY doc_id),
    m AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a[len(a)].e - a[len(a)].s + 1 < 2 AND x[1].e - a[len(a)].s + 1 <= 20
        THEN list_append(a[:len(a) - 1], {{'s': a[len(a)].s, 'e': x[1].e, 't': a[len(a)].t}}) ELSE list_append(a, x[1]) END) AS l FROM g),
    c AS (SELECT doc_id, CASE WHEN len(l) > 1 AND l[len(l)].e - l[len(l)].s + 1 < 2 AND l[len(l)].e - l[len(l) - 1].s + 1 <= 20
        THEN list_append(l[:len(l) - 2], {{'s': l[len(l) - 1].s, 'e': l[len(l)].e, 't': l[len(l) - 1].t}}) ELSE l END AS l FROM m),
    u AS (SELECT doc_id, unnest(l) AS r FROM c)
    SELECT doc_id, r.t AS title, p AS start_page, least(p + 19, r.e) AS end_page FROM u, unnest(range(r.s, r.e + 1, 20)) AS v(p)""")
def normalised_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.normalise_ranges(ranges.ranges_from_starts(_starts(spark, sf_dir)), 2, 20)


_TERMS = "SELECT c_custkey AS ord, n.n_regionkey AS run_id, c_mktsegment AS source, n_name AS target, CASE WHEN c_custkey % 3 = 0 THEN 'seed' ELSE 'translator' END AS origin FROM customer JOIN nation n ON c_nationkey = n_nationkey"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_custkey").alias("ord"), F.col("n_regionkey").alias("run_id"), F.col("c_mktsegment").alias("source"), F.col("n_name").alias("target"), F.lit(None).cast("string").alias("notes"), F.when(F.col("c_custkey") % 3 == 0, "seed").otherwise("translator").alias("origin"))


@query(f"""
    WITH t AS ({_TERMS}), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, lower(trim(source)) ORDER BY origin <> 'seed', ord) AS k, min(ord) OVER (PARTITION BY run_id, lower(trim(source))) AS first FROM t)
    SELECT run_id, first AS ord, source, target, CAST(NULL AS VARCHAR) AS notes, origin FROM r WHERE k = 1""")
def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.merge_terms(_terms(spark, sf_dir), ["run_id"])


@query(f"""
    WITH t AS (SELECT *, CASE WHEN origin = 'seed' THEN NULL ELSE ord % 10 END AS part_index FROM ({_TERMS})),
    p AS (SELECT r_regionkey AS run_id, i AS part_index FROM region, unnest(range(0, 12)) AS u(i)),
    v AS (SELECT p.run_id, p.part_index, t.ord, t.source, t.target, t.origin, row_number() OVER (PARTITION BY p.run_id, p.part_index, lower(t.source) ORDER BY t.origin <> 'seed', t.part_index NULLS FIRST, t.ord) AS k
          FROM p JOIN t ON t.run_id = p.run_id AND (t.part_index IS NULL OR t.part_index < p.part_index))
    SELECT run_id, part_index, ord, source, target, CAST(NULL AS VARCHAR) AS notes, origin FROM v WHERE k = 1""")
def glossary_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, sf_dir).withColumn("part_index", F.when(F.col("origin") != "seed", F.col("ord") % 10))
    parts = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("run_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("part_index"))
    return glossary.glossary_as_of(terms, parts, "run_id")


@query("SELECT p_partkey AS path, 0 AS ord, trim(p_name) AS source, trim(p_type) AS target, CAST(NULL AS VARCHAR) AS notes, 'seed' AS origin FROM part WHERE trim(p_name) <> '' AND trim(p_type) <> ''")
def glossary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit('term;translation\n"'), "p_name", F.lit('";"'), "p_type", F.lit('"\n# end\n'))
    return glossary.parse_glossaries(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.lit("csv").alias("format"), row.alias("content")))


#: The texts of the test pages, which hold neither translated attributes nor entities but these: what lies between tags outside
#: script, style and comments.
_HTML = r"""SELECT page_id AS doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, 't-' || row_number() OVER w AS pointer,
        replace(replace(replace(replace(replace(replace(replace(v, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '&amp', '&') AS value
    FROM (SELECT page_id, i, l[i] AS v FROM (SELECT page_id, string_split(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', chr(1), 'g'), chr(1)) AS l FROM pages) AS s, unnest(range(1, len(l) + 1)) AS u(i))
    WHERE trim(v, ' ' || chr(9) || chr(10) || chr(13)) <> '' WINDOW w AS (PARTITION BY page_id ORDER BY i)"""


@query(_HTML)
def html_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.flatten_html(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw")))


@query(f"SELECT doc_id, count(*) AS entry_count, count(*) AS text_count, CAST(0 AS BIGINT) AS attribute_count, array_to_string(list(value ORDER BY ord)[:8], ' | ') AS sample FROM ({_HTML}) GROUP BY doc_id")
def html_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.inspect_html(html_entries(spark, sf_dir)).withColumn("sample", F.array_join("sample", " | "))


@query(greedy_sql(f"SELECT doc_id, ord, len(pointer) + len(value) AS cost FROM ({_HTML})", "doc_id", 2000, 100, f"SELECT h.doc_id, h.ord, pointer, value, CAST(len(pointer) + len(value) AS INTEGER) AS cost, bin AS batch FROM ({_HTML}) h JOIN bins USING (doc_id, ord)"))
def html_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = html_entries(spark, sf_dir).withColumn("cost", T.utf16_length(F.col("pointer")) + T.utf16_length(F.col("value")))
    return pack.greedy_pack(entries, "doc_id", "ord", "cost", budget=2000, cap=100)


@query("SELECT page_id AS doc_id, html AS raw FROM pages")
def html_rebuild_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw"))
    none = spark.createDataFrame([], "doc_id long, pointer string, translation string, ord int")
    return structured.rebuild_html_docs(docs, none)


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.concat(F.lit('{"a/b":"'), "n_name", F.lit('","n":1,"list":["'), "r_name", F.lit('"," ",{"x~y":"z"}]}'))
    return n.select(F.col("n_nationkey").alias("doc_id"), raw.alias("raw"))


@query("""
    SELECT n_nationkey AS doc_id, 0 AS ord, '/a~1b' AS pointer, n_name AS value FROM nation
    UNION ALL SELECT n_nationkey, 1, '/list/0', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 2, '/list/2/x~0y', 'z' FROM nation""")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.flatten_json(_bundles(spark, sf_dir))


@query("""
    SELECT n_nationkey AS doc_id, '{' || chr(10) || '  "a/b": "' || CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE lower(n_name) END || '",' || chr(10) || '  "n": 1,' || chr(10) || '  "list": [' || chr(10)
        || '    "' || lower(r_name) || '",' || chr(10) || '    " ",' || chr(10) || '    {' || chr(10) || '      "x~y": "z"' || chr(10) || '    }' || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS raw
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def json_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two replies for a pointer the later holds; null replies and unknown or null pointers are nothing."""
    bundles = _bundles(spark, sf_dir)
    entries = structured.flatten_json(bundles).where("doc_id % 5 <> 0 or ord > 0")
    late = entries.select("doc_id", "pointer", F.lower("value").alias("translation"), F.lit(1).alias("ord"))
    early = entries.select("doc_id", "pointer", F.upper("value").alias("translation"), F.lit(0).alias("ord"))
    odd = bundles.select("doc_id", F.explode(F.array(F.lit("/none"), F.lit(None), F.lit("/a~1b"))).alias("pointer")).withColumn("translation", F.when(F.col("pointer") == "/none", "x")).withColumn("ord", F.lit(2))
    return structured.rebuild_json_docs(bundles, early.unionByName(late).unionByName(odd))


def _srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a conversation, one cue a turn."""
    stamp = lambda c: F.format_string("00:00:%02d,000", c.cast("int"))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    block = F.concat(F.col("turn"), F.lit("\n"), stamp(F.col("turn")), F.lit(" --> "), stamp(F.col("turn") + 1), F.lit("\n"), flat)
    turns = _read(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & (flat != ""))
    rows = F.array_sort(F.collect_list(F.struct("turn", block.alias("s"))))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["s"]), "\n\n"), F.lit("\n")).alias("raw"))


_CUES = """SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, 'cue-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, printf('00:00:%02d,000', turn) AS start, printf('00:00:%02d,000', turn + 1) AS "end"
    FROM conversations WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"""


@query(_CUES)
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.srt_cues(_srt(spark, sf_dir))


@query(f"SELECT doc_id, ord, cue, text, start, \"end\", count(*) OVER (PARTITION BY doc_id) AS total FROM ({_CUES}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) BETWEEN 2 AND 4")
def cue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.cue_page(srt_cues(spark, sf_dir), 1, 3)


@query(f"SELECT doc_id, string_agg((CAST(split_part(start, ':', 3)[:2] AS INTEGER)) || chr(10) || start || ' --> ' || \"end\" || chr(10) || CASE WHEN ord % 3 = 2 THEN text ELSE '> ' || text END, chr(10) || chr(10) ORDER BY ord) || chr(10) AS raw FROM ({_CUES}) GROUP BY doc_id")
def srt_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two replies for a cue the later holds; every third cue has none."""
    docs = _srt(spark, sf_dir)
    cues = subtitles.srt_cues(docs).where("ord % 3 <> 2")
    reply = lambda text, ord_: cues.select("doc_id", "cue", text.alias("translation"), F.lit(ord_).alias("ord"))
    return subtitles.rebuild_srt(docs, reply(F.concat(F.lit("> "), "text"), 2).unionByName(reply(F.lit("first try"), 1)))


@query(f"SELECT doc_id, count(*) AS cue_count, CAST(sum(len(text)) AS BIGINT) AS characters, min_by(start, ord) AS first_start, max_by(\"end\", ord) AS last_end FROM ({_CUES}) GROUP BY doc_id")
def subtitle_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.inspect_cues(srt_cues(spark, sf_dir)).drop("sample")


@query("SELECT conv_id AS doc_id, 'line-' || (turn + 2) AS cue, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, role AS style FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def ass_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn is the line, so blank dialogue lines stand where a turn has no text."""
    turns = _read(spark, sf_dir, "conversations")
    line = F.concat(F.lit("Dialogue: 0:00:01,"), "role", F.lit(","), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("s"))))
    raw = F.concat(F.lit("[Events]\nFormat: Start, Style, Text\n"), F.array_join(F.transform(rows, lambda r: r["s"]), "\n"))
    return subtitles.ass_cues(turns.groupBy(F.col("conv_id").alias("doc_id")).agg(raw.alias("raw"))).select("doc_id", "cue", "text", "style")


@query("""
    WITH f AS (SELECT s_nationkey AS project, 'docs/file' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.srt' WHEN 2 THEN '.html' ELSE '.bin' END AS path, CASE s_suppkey % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'srt' WHEN 2 THEN 'html' ELSE 'text' END AS kind FROM supplier),
    c AS (SELECT project, kind, count(*) AS files FROM f GROUP BY ALL)
    SELECT project, kind, files FROM c QUALIFY row_number() OVER (PARTITION BY project ORDER BY files DESC, list_position(['srt', 'html', 'markdown', 'text'], kind)) = 1""")
def discover_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".md", ".srt", ".html", ".bin"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    files = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project"), F.concat(F.lit("docs/file"), "s_suppkey", ext).alias("path"))
    return discover.pick_source_kind(discover.classify_files(files))


@query("""
    SELECT CAST(p_partkey // 50 AS BIGINT) AS doc_id, p_size AS printed_page, p_name AS title FROM part WHERE p_size >= 1 AND length(p_name) >= 3
    QUALIFY row_number() OVER (PARTITION BY p_partkey // 50, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) ORDER BY p_partkey) = 1""")
def toc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", F.concat("p_name", F.lit(" ...... "), "p_size").alias("s"))))
    pages = _read(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 50").alias("doc_id")).agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("text")).withColumn("page_no", F.lit(1))
    return ranges.toc_candidates(pages).select("doc_id", "printed_page", "title")


@query("""
    WITH e AS (SELECT n_nationkey AS doc_id, 0 AS ord, '/a~1b' AS pointer, n_name AS value FROM nation
        UNION ALL SELECT n_nationkey, 1, '/list/0', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 2, '/list/2/x~0y', 'z' FROM nation)
    SELECT *, CASE WHEN (doc_id + ord) % 7 = 0 THEN value ELSE lower(value) || '!' END AS translation FROM e""")
def translate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh entry has no reply, the others two, of which the later holds."""
    entries = json_entries(spark, sf_dir)
    late = entries.where("(doc_id + ord) % 7 <> 0").withColumn("translation", F.concat(F.lower("value"), F.lit("!"))).withColumn("ord", F.lit(2))
    early = late.withColumn("translation", F.lit("early")).withColumn("ord", F.lit(1))
    return localize.with_fallback(entries, late.unionByName(early), ["doc_id", "pointer"]).select("doc_id", "ord", "pointer", "value", "translation")


@query("SELECT doc_id, text AS text FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents) WHERE text <> ''")
def assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").where(T.js_trim(F.col("text")) != "").select("doc_id", F.lit(1).alias("part_index"), F.col("text").alias("content"))
    return localize.assemble_text(docs)


@query("""
    SELECT source AS run_id, count(*) AS part_count, count(DISTINCT lang) AS document_count, CAST(0 AS BIGINT) AS term_count, CAST(count(i.doc_id) AS BIGINT) AS issue_count
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) i ON d.doc_id = i.doc_id GROUP BY source""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    issues = docs.join(_read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("source").alias("run_id"))
    none = spark.createDataFrame([], "run_id string")
    return localize.report(docs.select(F.col("source").alias("run_id"), F.col("lang").alias("source_index")), none, issues)


@query(r"""
    SELECT n_nationkey AS doc_id, n_name || chr(10) || chr(10) || 'see ' || r_name || ' or picture, a ``js' || chr(10) || 'b` c' || chr(10) || 'x = 1' || chr(10) || chr(10) || 'said ' || n_name || '`' || chr(10) || 'twice' || chr(10) || chr(10) || 'end > here' AS text
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences count at the start and end of a line alone, quotes after up to three spaces."""
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(
        F.lit("## **"), "n_name", F.lit("**\n\nsee [_"), "r_name", F.lit("_](http://x/y) or ![picture](p.png), a ```js\nb``` c\n```js\nx = 1\n```\n---\n\n  > said `"), "n_name", F.lit("`\n   > twice\n\n\n\nend > here\n"),
    )
    return n.select(F.col("n_nationkey").alias("doc_id"), T.strip_markdown(text).alias("text"))


@query("SELECT p_partkey AS doc_id, CAST(i AS INTEGER) AS page_no FROM part, unnest(range(1, p_size + 1)) AS u(i) WHERE i > p_size - 3")
def last_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "part").where("p_size >= 1").select(F.col("p_partkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.col("p_size").cast("int"))).alias("page_no"))
    return ranges.select_pages(pages, last=3)


@query(r"""
    SELECT doc_id, 'Target language: fr' || chr(10) || 'Source language: detect from the text' || chr(10) || 'Part 1 of 1' || coalesce(chr(10) || 'Title: ' || source, '') || chr(10) || 'Style guide:' || chr(10) || 'Keep the tone of the source.'
        || chr(10) || 'Glossary:' || chr(10) || 'No terms yet.' || chr(10) || chr(10) || 'Translate into fr. Keep headings, lists, links and code as they are marked. Report terms that will recur.' || chr(10) || chr(10)
        || '=== SOURCE ===' || chr(10) || text || chr(10) || '=== END OF SOURCE ===' AS prompt FROM documents""")
def text_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("title"), F.lit(1).alias("part_index"), F.lit(1).alias("total"), F.lit("").alias("glossary"))
    return localize.prompt_header(docs, "fr").select("doc_id", prompts.translation_prompt("text", "fr", F.col("header"), F.col("text")).alias("prompt"))


@query("SELECT doc_id, lang AS translation, CAST(0 AS INTEGER) AS terms FROM documents WHERE lang IS NOT NULL")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without the required field have no row; those without terms have an empty list."""
    raw = F.to_json(F.struct(F.col("lang").alias("translation")))
    got = _read(spark, sf_dir, "documents").select("doc_id", replies.parse_reply(raw, "text_translation").alias("r"))
    return got.where("r is not null").select("doc_id", "r.translation", F.size("r.newTerms").alias("terms"))


@query("SELECT n_regionkey AS path, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS ord, n_name AS source, lower(n_name) AS target, CAST(NULL AS VARCHAR) AS notes, 'seed' AS origin FROM nation")
def canonical_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("path"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("source"), F.lower("n_name").alias("target"), F.lit(None).cast("string").alias("notes"), F.lit("seed").alias("origin"))
    return files.canonical_terms(sinks.canonical_glossaries(terms, "path"))


@query("SELECT source AS run_id, CAST(doc_id AS INTEGER) AS part_index, text AS translation FROM documents")
def review_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").cast("int").alias("part_index"), F.col("text").alias("content"), F.col("text").alias("translation"))
    return localize.review_parts(parts, spark.createDataFrame([], "run_id string, ord int, source string, target string, notes string"), None).drop("issues")


@query("""
    WITH s AS (SELECT s_nationkey AS run_id, min(s_suppkey) AS o, s_suppkey % 3 AS folder, s_suppkey % 2 AS file FROM supplier GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS docs, count(*) OVER (PARTITION BY run_id, file) AS same FROM s)
    SELECT run_id, CAST(i AS INTEGER) AS source_index, 'd' || folder || '/f' || file || '.md' AS path, 'markdown' AS kind, 'markdown' AS format,
        'translation/' || run_id || '/' || CASE WHEN docs > 1 AND same > 1 THEN printf('doc-%03d-', i + 1) ELSE '' END || 'f' || file || '.fr.md' AS output_path,
        CASE WHEN docs > 1 THEN printf('doc-%03d-', i + 1) || 'f' || file END AS cache FROM n""")
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("s_suppkey") % 3, F.lit("/f"), F.col("s_suppkey") % 2, F.lit(".md"))
    sources = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("ord"), path.alias("path"))
    runs = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), F.lit("fr").alias("target"), F.lit(None).cast("string").alias("output_path"))
    return prepare.run_outputs(sources, runs)
