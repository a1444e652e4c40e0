"""Shared pieces of the query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import numbered
from tessella.session import table

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, and -0.0 as 0.0, so that results of different engines can be compared by value."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_round(expr: str, alias: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


def personae(spark, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "personae"), "persona")


def prompts(spark, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "prompts").withColumnRenamed("id", "prompt_id"), "prompt_id")


SQL_PERSONAE = "per AS (SELECT *, row_number() OVER (ORDER BY persona) - 1 AS ordinal FROM personae)"
SQL_PROMPTS = "pro AS (SELECT question, id AS prompt_id, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM prompts)"
SQL_SYSTEM_PROMPT = "'You are ' || CASE WHEN article IS NULL OR article IN ('', 'none') THEN '' ELSE article || ' ' END || persona || '.'"
SQL_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{SQL_BLANK}+', ''), '{SQL_BLANK}+$', '')"


def sql_number(expr: str) -> str:
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END"
