"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, ann, bpe, exact_dedup, language, line_dedup, mixing, near_dedup, quality, token_files, toxicity, vector_codes, warc
from tidemark.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_run=2, long_words=50).select(
        "doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256")
    )


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), spark, path), 256).alias("decoded_sha256"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("response")
    return warc.captures(table(spark, sf_dir, "pages")).select(
        r["page_id"].cast("long").alias("page_id"),
        r["payload_bytes"].alias("payload_bytes"),
        r["payload_digest"].alias("payload_digest"),
        r["warc_type"].alias("record_type"),
        r["refers_to"].cast("long").alias("refers_to"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(table(spark, sf_dir, "documents"), a, b, text=False)
    return found.withColumn("groups_sha256", F.lower(F.hex("groups"))).drop("groups")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.folder_for(spark)
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, folder)
    return token_files.read_documents(spark, folder).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_ann, op3_toxicity, op4_quality, op5_exact_dedup, op6_bpe, op7_near_dedup, op8_mixing,
        op9_language, op10_warc, op11_alignment, op12_vector_codes, op13_token_ids, pipeline,
    )
}



def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """All rounds one after the other; each compares every part with every entry."""
    steps = [f"""e AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT r, unnest(range(len(embedding))) AS j, len(embedding) // {parts} AS w, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS v FROM e),
c AS (SELECT r, j // w AS part, j % w AS i, v FROM x),
b0 AS (SELECT part, r - 1 AS entry, i, v FROM c WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d
 FROM (SELECT r, part, entry, sum((c.v - b{k}.v) * (c.v - b{k}.v))::BIGINT AS d FROM c JOIN b{k} USING (part, i) GROUP BY r, part, entry) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{k} JOIN c USING (r, part) GROUP BY part, entry, i),
b{k + 1} AS MATERIALIZED (SELECT part, entry, i, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v FROM b{k} LEFT JOIN s{k} USING (part, entry, i))""")
    return f"""WITH {", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN f USING (r)"""


ORACLE: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS s, unnest(range(len(lines))) AS line FROM d),
p AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY line) AS s2,
             lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS l2 FROM e),
q AS (SELECT doc_id, line, row_number() OVER (PARTITION BY s, s2 ORDER BY doc_id, line) AS nth FROM p WHERE l2 IS NOT NULL),
long AS (SELECT doc_id, line, row_number() OVER (PARTITION BY s ORDER BY doc_id, line) AS nth FROM e
         WHERE len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 50),
gone AS (SELECT doc_id, line + k AS line FROM q, (VALUES (0), (1)) AS v(k) WHERE nth > 1
         UNION SELECT doc_id, line FROM long WHERE nth > 1)
SELECT e.doc_id, count(*)::BIGINT AS n_lines, count(gone.line)::BIGINT AS n_deleted,
       sha256(coalesce(string_agg(e.s, chr(10) ORDER BY e.line) FILTER (WHERE gone.line IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.line = gone.line GROUP BY e.doc_id
""",
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM s WINDOW b AS (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, first_value(CASE WHEN cap > level * w THEN level END IGNORE NULLS)
             OVER (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fix FROM l),
t AS (SELECT source, source_size, CASE WHEN fix IS NULL THEN cap::DOUBLE ELSE fix * w END AS target FROM f),
q AS (SELECT d.*, source_size, target, md5(doc_id::VARCHAR) AS key,
             sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, key, size, (p * source_size + upto)::DOUBLE / target AS finish FROM q, range(3) AS r(p) WHERE size > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, key ROWS UNBOUNDED PRECEDING) AS total FROM c),
n AS (SELECT doc_id, count(*)::BIGINT AS copies FROM k WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)
""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""",
}
