"""The registered queries of the training-data operators, with DuckDB SQL
where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm.arc_convert import archive_pages
from adlens.llm.collocations import collocations
from adlens.llm.common import table
from adlens.llm.cross_polytope import nearest
from adlens.llm.exact_dedup import exact_dedup
from adlens.llm.fair_mix import fair_mix
from adlens.llm.hard_negatives import hard_negatives
from adlens.llm.language_tree import identify_languages
from adlens.llm.line_spread import drop_boilerplate
from adlens.llm.packing import pack_documents
from adlens.llm.simple8b import read_ids, write_ids
from adlens.llm.surrogates import replace_pii
from adlens.llm.toxicity import toxicity_scores
from adlens.llm.vertical_join import ngram_join


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"), end_id=0, seq_len=1024)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), least=100)


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, tables=16, probes=8)


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"),
                              public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents"), min_sites=5, min_chars=20)


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), epochs=3)


def op9_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic")


def op10_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=5, num=80, den=100)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), every=100, positives=5, negatives=10, low=30, high=90, scale=256)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000, num=80, den=100, scale=2_000_000)


def op13_language_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), folds=4, left_out=2)


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_arc_to_warc": op4_arc_to_warc,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_simple8b": op6_simple8b,
    "op7_line_spread": op7_line_spread,
    "op8_fair_mix": op8_fair_mix,
    "op9_toxic_neighbours": op9_toxic_neighbours,
    "op10_vertical_join": op10_vertical_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_language_tree": op13_language_tree,
}

ORACLE = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op4_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest,
                     min(page_id) OVER (PARTITION BY h) AS best FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> best THEN best END AS refers_to
        FROM q""",
    "op7_line_spread": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
        l AS (SELECT row, source, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
        t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS core FROM l),
        c AS (SELECT core FROM t WHERE length(core) >= 20 GROUP BY core HAVING count(DISTINCT source) >= 5)
        SELECT d.doc_id, count(*) AS n_lines, count(c.core) AS n_removed,
               coalesce(string_agg(t.line, chr(10) ORDER BY t.place) FILTER (c.core IS NULL), '') AS text
        FROM d JOIN t ON t.row = d.row LEFT JOIN c ON c.core = t.core GROUP BY d.row, d.doc_id""",
    "op8_fair_mix": r"""
        WITH d AS (
          SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                 md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
        s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
                     (row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS weight FROM d GROUP BY key),
        b AS (SELECT CAST(sum(source_size) AS BIGINT) AS budget FROM s),
        -- sources in the order in which a rising water level meets their caps
        r AS (SELECT *, coalesce(sum(3 * source_size) OVER lower, 0) AS capped,
                     sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0) AS open_weight
              FROM s WINDOW lower AS (ORDER BY 3.0 * source_size / weight, key
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT CAST(budget - capped AS DOUBLE) AS words, CAST(open_weight AS DOUBLE) AS weights
              FROM r, b WHERE 3.0 * source_size / weight >= (budget - capped) / open_weight
              ORDER BY 3.0 * source_size / weight, key LIMIT 1),
        t AS (SELECT key, source_size, CASE WHEN words * weight / weights > 3 * source_size
                     THEN CAST(3 * source_size AS DOUBLE) ELSE words * weight / weights END AS target FROM s, l),
        q AS (SELECT d.*, t.source_size, t.target,
                     sum(size) OVER (PARTITION BY d.key ORDER BY draw, doc_id, size
                                     ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN t ON d.key = t.key),
        c AS (SELECT q.*, e.epoch, CAST(source_size * e.epoch + upto AS DOUBLE) / target AS finish
              FROM q, (SELECT unnest([0, 1, 2]) AS epoch) e WHERE size > 0 AND target > 0),
        k AS (SELECT *, sum(size) OVER (ORDER BY finish, key, epoch, upto, draw
                                        ROWS UNBOUNDED PRECEDING) AS total FROM c),
        n AS (SELECT doc_id, draw, count(*) AS copies FROM k, b WHERE total <= budget GROUP BY doc_id, draw)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.copies, 0) AS BIGINT) AS taken
        FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.draw = n.draw""",
    "op10_vertical_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
              FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r AS (SELECT doc_id, doc_id AS seen FROM documents
              UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id
        FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same,
                     CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
              FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
        SELECT p.anchor AS anchor_id, p.other AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
               s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
          AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        QUALIFY rank <= 10""",
    "op12_collocations": r"""
        WITH p AS (
          SELECT doc_id, row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (SELECT lang, unnest(flatten([[ws[i:i + m - 1] FOR i IN range(1, len(ws) - m + 2)]
                                           FOR m IN range(1, 5)])) AS ph FROM w),
        f AS (SELECT lang, ph, count(*) AS n FROM g GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
        c AS (SELECT lang, ph, n AS a FROM f WHERE len(ph) > 1 AND n >= 30),
        k AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM c),
        s AS (SELECT k.*, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * a // (x.n + y.n) AS BIGINT) AS score
              FROM k JOIN f x ON x.lang = k.lang AND x.ph = k.ph[1:k.k]
                     JOIN f y ON y.lang = k.lang AND y.ph = k.ph[k.k + 1:]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
        i AS (SELECT lang, unnest(flatten([[ph[i:i + m - 1] FOR i IN range(1, len(ph) - m + 2)]
                                           FOR m IN range(2, len(ph))])) AS ph, a FROM c WHERE len(ph) > 2),
        h AS (SELECT lang, ph, max(a) AS longest FROM i GROUP BY ALL),
        o AS (SELECT b.*, array_to_string(b.ph, ' ') AS phrase FROM b LEFT JOIN h ON h.lang = b.lang AND h.ph = b.ph
              WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a)
        SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, t.n, score
        FROM o JOIN t ON t.lang = o.lang QUALIFY rank <= 2000""",
}
