"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _licence_sql() -> str:
    from .licences import duckdb_sql

    return duckdb_sql()


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import through_archives

    records = through_archives(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licences

    return licences(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dartminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), similarity=0.8)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_report

    return substring_report(_table(spark, sf_dir, "documents"), size=50)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality
    from .store import held_out

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, _table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, capacity=4096)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import held_out
    from .toxicity import score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, _table(spark, sf_dir, "labels"), threshold=0.5)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import filter_interactions

    return filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestfit import pack_best_fit

    return pack_best_fit(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair_conversations

    return repair_conversations(damaged(_table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_near_dedup, op3_substring_dedup, op4_quality, op5_exact_dedup, op6_pieces, op7_top_k, op8_packing, op9_licences, op10_toxicity, op11_filter_audit, op12_best_fit, op13_repair, pipeline)}

#: What the filters remove, order by order, from the masks alone: no polynomial.
_AUDIT_SQL = """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
        w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
        m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * strlen(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
              FROM w JOIN f USING (t)),
        c AS (SELECT part, mask, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
        b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) b(letter, bit)),
        o AS (SELECT '' AS filter_order, 0 AS done UNION ALL SELECT filter_order || letter, done + bit FROM o JOIN b ON done & bit = 0),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bit, (SELECT coalesce(sum(b2.bit), 0) FROM b b2 WHERE position(b2.letter IN filter_order) < step) AS before
              FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5) JOIN b ON letter = filter_order[step]),
        r AS (SELECT part, filter_order, step, bit,
                CAST(sum(n) FILTER (mask & CAST(before + bit AS BIGINT) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0) AS BIGINT) AS removed,
                CAST(sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS BIGINT) > 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails,
                CAST(sum(good) FILTER (mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0) AS BIGINT) AS toxic_lost
              FROM c CROSS JOIN s GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
               coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r"""

#: The checksum by a table of 256 numbers that the query makes; the cheapest edits row by row over what the rows so far end with.
_REPAIR_SQL = """
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM conversations CROSS JOIN t),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM k, (VALUES (1), (2)) c(copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM r),
        f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
        x AS (SELECT *, fault IN ('', 'truncated') AS may, (fault = 'truncated')::INT AS cut FROM f),
        s AS (SELECT conv_id, 0::BIGINT AS pos, {c: 0, p: ''} AS s, {c: 9999999, p: ''} AS y, {c: 2, p: 'I'} AS u, {c: 4, p: 'II'} AS a FROM (SELECT DISTINCT conv_id FROM x)
              UNION ALL
              SELECT conv_id, pos, s, y, least(u, {c: a.c + 2, p: a.p || 'I'}), a FROM (SELECT conv_id, pos, s, y, u, least(a, {c: u.c + 2, p: u.p || 'I'}) AS a FROM
                (SELECT conv_id, pos, s, y, least(u, {c: s.c + 2, p: s.p || 'I'}, {c: y.c + 2, p: y.p || 'I'}, {c: a.c + 2, p: a.p || 'I'}) AS u, a FROM (
                  SELECT s.conv_id, x.pos, {c: s.s.c + 3, p: s.s.p || 'D'} AS s,
                    least({c: s.y.c + 3, p: s.y.p || 'D'}, CASE WHEN may AND i = 's' THEN {c: s.s.c + cut, p: s.s.p || 'K'} ELSE {c: 9999999, p: ''} END) AS y,
                    least({c: s.u.c + 3, p: s.u.p || 'D'}, CASE WHEN may THEN least({c: s.s.c + cut + e, p: s.s.p || n}, {c: s.y.c + cut + e, p: s.y.p || n}, {c: s.a.c + cut + e, p: s.a.p || n}) ELSE {c: 9999999, p: ''} END) AS u,
                    least({c: s.a.c + 3, p: s.a.p || 'D'}, CASE WHEN may THEN {c: s.u.c + cut + g, p: s.u.p || m} ELSE {c: 9999999, p: ''} END) AS a
                  FROM s JOIN (SELECT *, CASE WHEN i = 'u' THEN 0 ELSE 2 END AS e, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS n, CASE WHEN i = 'a' THEN 0 ELSE 2 END AS g, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS m FROM x) x
                    ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.pos = s.pos + 1)))),
        e AS (SELECT conv_id, least(s, a).c AS cost, least(s, a).p AS audit FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
        q AS (SELECT conv_id, unnest(range(1, strlen(audit) + 1)) AS place, audit FROM e),
        p AS (SELECT conv_id, place, audit[place] AS op, sum((audit[place] <> 'I')::INT) OVER w AS pos, sum((audit[place] <> 'D')::INT) OVER w - 1 AS out FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
        v AS (SELECT p.*, x.role, x.text, coalesce(max((out = 0 AND op = 'K' AND i = 's')::INT) OVER (PARTITION BY p.conv_id), 0) AS sys FROM p LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.pos = p.pos AND op <> 'I'),
        h AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (out - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) FILTER (op <> 'D') AS text FROM v GROUP BY conv_id),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(h.text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLE = {
    "op11_filter_audit": _AUDIT_SQL,
    "op13_repair": _REPAIR_SQL,
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        g AS (SELECT t, min(page_id) AS first, count(*) AS n FROM p WHERE strlen(t) >= 100 GROUP BY t HAVING count(*) > 1)
        SELECT page_id, strlen(p.t) AS payload_bytes, sha256(p.t) AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN g USING (t)""",
    "op9_licences": _licence_sql(),
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
