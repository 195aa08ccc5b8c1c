"""Queries opN_<name> and pipeline over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import cotrain, decontaminate, packing, passages, pii, quality_rules, shards, simhash, token_file, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# --- fixed parts of op1, op2 and op9, which SQL can state -----------------------------------------------------


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_base(_table(spark, sf_dir, "pages"))


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.count_base(_table(spark, sf_dir, "documents"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_base(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_url_rules, op2_pii, op3_cotraining, op4_compaction, op5_passages, op6_packing, op7_decontamination, op8_token_file, op9_quality_rules, op10_simhash, pipeline, base_url_rules, base_pii_counts, base_quality]
    return {f.__name__: f for f in every}


_WORD = r"[^\x20\x09-\x0D]+"
_TEXTS = f"d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)"
#: Words by position, and `covered`, whether a window of `n` words over them is marked.
_COVER = "max(CASE WHEN marked THEN i END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) IS NOT NULL AS covered"

OP5_SQL = f"""WITH {_TEXTS},
p AS MATERIALIZED (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS MATERIALIZED (SELECT rid, i, array_to_string(list_slice(w, i, i + 34), ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
m AS MATERIALIZED (SELECT rid, i, count(*) OVER (PARTITION BY win) > 1 AS marked FROM s),
c AS (SELECT p.rid, p.i, p.word, {_COVER.format(n=34)} FROM p LEFT JOIN m USING (rid, i)),
k AS (SELECT rid, count(*) FILTER (covered) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (NOT covered) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""

BASE_QUALITY_SQL = f"""WITH {_TEXTS},
s AS MATERIALIZED (SELECT rid, i, list_slice(w, i, i + 2) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
m AS MATERIALIZED (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) > 1 AS marked FROM s),
p AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT p.rid, p.i, {_COVER.format(n=2)} FROM p LEFT JOIN m USING (rid, i)),
k AS (SELECT rid, count(*) FILTER (covered) AS again FROM c GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN k USING (rid) LEFT JOIN l USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DIGIT = f"CAST(substr({_DIGITS}, CAST(length({_DIGITS}) - i AS BIGINT), 1) AS INTEGER)"
_LUHN = f"list_sum([CASE WHEN {_DIGIT} * (1 + i % 2) > 9 THEN {_DIGIT} * 2 - 9 ELSE {_DIGIT} * (1 + i % 2) END for i in range(0, length({_DIGITS}))]) % 10 = 0"
BASE_PII_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len([m for m in regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') if len([x for x in string_split(m, '.') if length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255]) = 0]) AS BIGINT) AS n_ip,
CAST(len([m for m in regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') if length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}]) AS BIGINT) AS n_card,
CAST(len([m for m in regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') if length({_DIGITS}) BETWEEN 9 AND 15]) AS BIGINT) AS n_phone FROM d"""

_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(url_rules.BASE_RULES, key=lambda r: -len(r[0] + r[1]))]
BASE_URL_SQL = rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in _FITS)} END AS rule, CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in _FITS)} END AS verdict FROM u"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can state. Mined rules, disclosing terms, trained models, tokenizers, XXH64 and similarities of
    all windows are beyond it or too slow: tests/llm holds those against brute force."""
    return {"op5_passages": OP5_SQL, "base_quality": BASE_QUALITY_SQL, "base_pii_counts": BASE_PII_SQL, "base_url_rules": BASE_URL_SQL}
