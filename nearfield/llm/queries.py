"""One query for each operator, over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read

#: Rules of op7 as host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer's file, read on the driver; its text travels to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_files

    return token_files(read(spark, sf_dir, "documents"), tokenizer_json())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preferences import format_preferences, swapped_replies

    return format_preferences(swapped_replies(read(spark, sf_dir, "conversations")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_json())


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1,
    "op2_token_files": op2,
    "op3_nearest": op3,
    "op4_quality": op4,
    "op5_decontaminate": op5,
    "op6_near_duplicates": op6,
    "op7_urls": op7,
    "op8_preferences": op8,
    "op9_token_counts": op9,
    "op10_pii": op10,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT uid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT uid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT uid, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
per AS (
  SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY uid),
items AS (
  SELECT uid, count(DISTINCT item_id) AS n_items, count(DISTINCT item_id) FILTER (n = 8) AS n_long,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM hits GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_long, 0) AS n_long_items
FROM d LEFT JOIN per USING (uid) LEFT JOIN items USING (uid)
""",
    "op7_urls": rf"""
WITH r(r_host, r_path, r_verdict) AS (VALUES {_RULES_SQL}),
p AS (
  SELECT row_number() OVER () AS uid, page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT uid, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY uid ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS place
  FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (uid)
""",
    "op8_preferences": """
WITH c AS (SELECT conv_id, {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations),
own AS (SELECT conv_id, list(t ORDER BY t.turn, t.role, t.text) AS a FROM c GROUP BY conv_id),
reply AS (SELECT xor(conv_id, 1) AS conv_id, max(t) AS r FROM c WHERE t.role = 'assistant' GROUP BY ALL),
both_ AS (
  SELECT conv_id, a, CASE WHEN a[len(a)].role <> 'assistant' THEN a WHEN r IS NULL THEN a[1:len(a) - 1] ELSE list_append(a[1:len(a) - 1], r) END AS b
  FROM own LEFT JOIN reply USING (conv_id)),
cut AS (
  SELECT conv_id, a, b, coalesce(list_min(list_filter(generate_series(1, least(len(a), len(b))),
         lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, least(len(a), len(b))) AS n FROM both_),
side AS (
  SELECT conv_id, n, list_transform(a[1:n], lambda x: '<|turn:' || x.role || '|>' || x.text || '<|end|>' || chr(10)) AS p,
         list_transform(a[n + 1:], lambda x: {'role': x.role, 's': '<|turn:' || x.role || '|>' || x.text || '<|end|>' || chr(10)}) AS a,
         list_transform(b[n + 1:], lambda x: {'role': x.role, 's': '<|turn:' || x.role || '|>' || x.text || '<|end|>' || chr(10)}) AS b FROM cut)
SELECT conv_id AS pair_id, n AS n_prompt, coalesce(array_to_string(p, ''), '') AS prompt,
  array_to_string(list_transform(a, lambda x: x.s), '') AS chosen,
  array_to_string(list_transform(list_filter(generate_series(1, len(a)), lambda i: a[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(a[1:i - 1], lambda y: length(y.s))), 0) + 9 + length(a[i].role))::BIGINT || ':' || list_sum(list_transform(a[1:i], lambda y: length(y.s)))::BIGINT), ',') AS chosen_mask,
  array_to_string(list_transform(b, lambda x: x.s), '') AS rejected,
  array_to_string(list_transform(list_filter(generate_series(1, len(b)), lambda i: b[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(b[1:i - 1], lambda y: length(y.s))), 0) + 9 + length(b[i].role))::BIGINT || ':' || list_sum(list_transform(b[1:i], lambda y: length(y.s)))::BIGINT), ',') AS rejected_mask
FROM side
""",
}
