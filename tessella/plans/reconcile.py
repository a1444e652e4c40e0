"""Problem 5: results against results_copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.reconcile import differences
from tessella.session import table

KEYS = ["persona", "prompt_id", "rep_idx"]
METRICS = ["avg_entropy_thinking", "avg_entropy_output", "avg_entropy", "avg_top_k_mass_thinking", "avg_top_k_mass_output", "avg_top_k_mass"]
FIELDS = ["run_id", "category", "article", "system_prompt", "prompt", "response", *METRICS, "think_end_position", "num_tokens"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(
        table(spark, sf_dir, "results"), table(spark, sf_dir, "results_copy"), KEYS, "ordinal", FIELDS, "only_in_results", "only_in_copy"
    )


def _p5_sql() -> str:
    def differs(f: str) -> str:
        if f not in METRICS:
            return f"a.{f} IS DISTINCT FROM b.{f}"
        return (
            f"NOT ((a.{f} IS NULL AND b.{f} IS NULL) OR coalesce(isnan(a.{f}) AND isnan(b.{f}), false)"
            f" OR coalesce(a.{f} = b.{f}, false) OR coalesce(NOT isnan(a.{f}) AND NOT isnan(b.{f}) AND abs(a.{f} - b.{f}) <= 1e-6, false))"
        )

    key = ", ".join(KEYS)
    side = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ordinal DESC) AS rn FROM {t} WHERE persona IS NOT NULL AND prompt_id IS NOT NULL AND rep_idx IS NOT NULL) WHERE rn = 1"
    parts = [f"SELECT {', '.join('a.' + k for k in KEYS)}, 'differs' AS kind, '{f}' AS field FROM a JOIN b USING ({key}) WHERE {differs(f)}" for f in FIELDS]
    parts += [
        f"SELECT {key}, 'only_in_results' AS kind, 'row' AS field FROM a ANTI JOIN b USING ({key})",
        f"SELECT {key}, 'only_in_copy' AS kind, 'row' AS field FROM b ANTI JOIN a USING ({key})",
    ]
    return f"WITH a AS ({side.format(k=key, t='results')}), b AS ({side.format(k=key, t='results_copy')}) " + " UNION ALL ".join(parts)


QUERIES = {"p5_found": p5_found}
SQL = {"p5_found": _p5_sql()}
