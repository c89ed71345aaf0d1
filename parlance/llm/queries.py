"""Queries over the test tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import filter_audit, jaccard, katz, langid, privacy, quality_kn, quality_rules, vector_fit
from .ann import nearest
from .bpe import Codec
from .collocations import collocations
from .common import fold, small_batches
from .common import table as _table
from .packing import pack
from .token_counts import count_tokens


#: A run's own secret in production; fixed here so that results can be compared.
PSEUDONYM_KEY = "parlance-test-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return _table(spark, sf_dir, name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Codec(docs, public_tokenizers.path("byte_bpe_50k.json")).digests(docs)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 7) == 2))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_kn.train(docs, table(spark, sf_dir, "labels"))
    return quality_kn.classify(docs.select("doc_id", "lang", "text"), model, keep_text=False).select("doc_id", "perplexity", "kept")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymise(table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_vector_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return vector_fit.pack(docs, Codec(docs, public_tokenizers.path("byte_bpe_50k.json")), max_len=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_jaccard": op3_jaccard,
    "op4_language": op4_language,
    "op5_katz": op5_katz,
    "op6_quality": op6_quality,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_nearest": op10_nearest,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_vector_fit": op13_vector_fit,
}

ORACLES: dict[str, str] = {
    "op3_jaccard": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
        n AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY ALL),
        p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON p.x = a.rid JOIN n b ON p.y = b.rid WHERE 100 * c >= 85 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT rid AS x, rid AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(v.doc_id) AS component_id
        FROM w LEFT JOIN n ON w.rid = n.rid JOIN r ON w.rid = r.x JOIN w v ON v.rid = r.y GROUP BY w.rid, w.doc_id""",
    "op10_nearest": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'max') = 0
                     AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v AS q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        x AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM w),
        b AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
              CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
              + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
              + 16 * CAST(coalesce(x.doc_id > least, false) AS INT) AS mask FROM x LEFT JOIN b ON x.doc_id = b.doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS v),
        p AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS vs FROM l a, l b, l c, l d, l e WHERE a.v + b.v + c.v + d.v + e.v = 31 AND (a.v | b.v | c.v | d.v | e.v) = 31),
        s AS (SELECT filter_order, step, vs[step] AS own, CAST(coalesce(list_sum(vs[1:step - 1]), 0) AS INT) AS before FROM p, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
        r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
              sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
              sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op12_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
        x AS (SELECT *, 1 AS cut, ws[1] AS lp, array_to_string(ws[2:], ' ') AS rp FROM c UNION ALL SELECT *, 2, array_to_string(ws[1:2], ' '), ws[3] FROM c WHERE k = 3),
        s AS (SELECT x.lang, x.k, x.phrase, x.a, l.f AS l, r.f AS r, x.cut, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
              FROM x JOIN f l ON l.lang = x.lang AND l.k = x.cut AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.k = x.k - x.cut AND r.phrase = x.rp),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3),
        m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
        o AS (SELECT b.*, n.n FROM b JOIN n ON b.lang = n.lang LEFT JOIN m ON b.lang = m.lang AND b.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
        k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000""",
}
