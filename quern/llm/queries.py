"""The queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import warc

    path = f"{shared_dir(spark)}/quern-warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.parsed(warc.read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.surrogates import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ctw import score

    return score(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/language/folder/name. Each document whose id is a multiple of 40 is a licence file: every sixth of its source, every third other of its language's folder, the rest of their own folder."""
    from pyspark.sql import functions as F

    from quern.llm.licenses import scan

    name = F.when(F.col("doc_id") % 40 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    low = F.when(F.col("doc_id") % 240 == 0, F.lit(None)).otherwise(F.col("lang"))
    own = F.when(F.col("doc_id") % 120 == 0, F.lit(None)).otherwise(F.concat(F.lit("d"), (F.floor(F.col("doc_id") / 40) % 50).cast("string")))
    path = F.concat_ws("/", "source", low, own, name)
    return scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality_classifier import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.near_dups import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_mixing aims at, which SQL can express."""
    from pyspark.sql import functions as F

    from quern.llm.mixing import targets

    found = targets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8_quality_rules, which SQL can express."""
    return op8_quality_rules(spark, sf_dir).drop("kept", "posterior")


def ctw_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word columns of op4_ctw, which SQL can express."""
    from pyspark.sql import functions as F

    return op4_ctw(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_toxicity": op2_toxicity,
        "op3_surrogates": op3_surrogates,
        "op4_ctw": op4_ctw,
        "op5_licenses": op5_licenses,
        "op6_decontamination": op6_decontamination,
        "op7_mixing": op7_mixing,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality": op9_quality,
        "op10_near_dups": op10_near_dups,
        "pipeline": pipeline,
        "mixing_targets": mixing_targets,
        "quality_base": quality_base,
        "ctw_base": ctw_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op6_decontamination": OP6_SQL,
        "mixing_targets": TARGETS_SQL,
        "quality_base": QUALITY_SQL,
        "ctw_base": CTW_SQL,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, span, w[s:s + span - 1] AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS span, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0)
),
spans AS (SELECT DISTINCT span FROM iw),
dw AS (
  SELECT doc_id, s, span, w[s:s + span - 1] AS win
  FROM (SELECT doc_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS s FROM d, spans WHERE len(w) >= span)
),
hit AS (SELECT doc_id, item_id, s, dw.span FROM dw JOIN iw ON dw.span = iw.span AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + span - 1)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, html, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(hex, i, 1))]), 'string_agg', '') AS b
  FROM p
),
digests AS (
  SELECT page_id, html, list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(1, 6), lambda k: CAST(substr(b, 5 * j + k, 1) AS INTEGER) * CAST(pow(2, 5 - k) AS INTEGER)))::INTEGER, 1)), 'string_agg', '') AS digest
  FROM bits
),
last AS (SELECT html, max(page_id) AS last FROM digests GROUP BY html)
SELECT page_id, CAST(strlen(d.html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM digests d JOIN last l ON d.html = l.html
"""

_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

TARGETS_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_SPLIT}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1] AS w, 1.5 * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS i FROM w WHERE source_size > 0),
l AS (SELECT *, (total - (sum(2.0 * source_size) OVER (ORDER BY i) - 2.0 * source_size)) / (sum(w) OVER (ORDER BY i DESC)) AS level FROM o),
f AS (SELECT min(i) AS i FROM l WHERE level <= 2.0 * source_size / w),
t AS (SELECT source, CASE WHEN i < coalesce((SELECT i FROM f), 1e18) THEN 2.0 * source_size ELSE w * (SELECT level FROM l WHERE l.i = (SELECT i FROM f)) END AS target FROM l)
SELECT doc_id, size, source_size, round(coalesce(target, 0.0), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_SPLIT} AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice ON g.r = twice.r AND g.g = twice.g) GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (r) LEFT JOIN hit USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

#: crc32 bit by bit: the remainder, shifted, takes the polynomial where its last bit and the text's differ.
_BITS = "list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_transform(range(0, 8), lambda k: CAST((ascii(x) >> k) & 1 AS BIGINT)))))"
_CRC = f"xor(list_reduce({_BITS}, lambda c, x: xor(c >> 1, CASE WHEN (c & 1) <> x THEN 3988292384 ELSE 0 END)), 4294967295)"

CTW_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS w FROM documents),
t AS (SELECT r, doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY r, doc_id, held_out
"""
