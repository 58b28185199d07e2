"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in vars(digests).items() if k.startswith("op") and callable(f)}

ORACLES: dict[str, str] = {
    "op1_quotation_links": r"""WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), e AS (SELECT conv_id, turn, min(text) AS text FROM m GROUP BY conv_id, turn),
j AS (SELECT m.conv_id, m.turn, m.text, p.text AS p, CASE WHEN p.text IS NOT NULL THEN string_split(q.text, chr(10))[1] END AS q FROM m
  LEFT JOIN e p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1 LEFT JOIN e q ON q.conv_id = m.conv_id AND q.turn = m.turn - 2),
n AS (SELECT *, CASE WHEN regexp_replace(coalesce(p, ''), '\s', '', 'g') <> '' THEN 1 ELSE 0 END AS one, CASE WHEN regexp_replace(coalesce(q, ''), '\s', '', 'g') <> '' THEN 1 ELSE 0 END AS two FROM j)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(one + two AS BIGINT) AS n_quotes, CAST(one + two AS BIGINT) AS n_linked,
  CAST(CASE WHEN two = 1 THEN 2 WHEN one = 1 THEN 1 ELSE 0 END AS INTEGER) AS deepest, CASE WHEN one = 1 THEN CAST(conv_id AS BIGINT) END AS reply_conv,
  CASE WHEN one = 1 THEN CAST(turn - 1 AS BIGINT) END AS reply_turn, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS clean_sha256 FROM n""",
}
