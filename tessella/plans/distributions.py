"""Distribution metrics over the embeddings table, whose vectors stand in for logits (scaled by 20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import distribution as dist
from tessella.operators.variance import total_variance as variance_of
from tessella.plans.common import rounded, sql_round
from tessella.session import table

SCALE, TOP, TRUNCATED, TOKENS, THINK_END = 20.0, 5, 20, 17, 16


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * SCALE).alias("logits"))
    return dist.with_distribution(v.withColumn("token_id", F.col("vec_id") % TOKENS), "logits")


def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return rounded(t.select("vec_id", dist.entropy(F.col("p"), F.col("lp")).alias("entropy"), dist.top_k_mass(F.col("p"), TOP).alias("top_k_mass")))


def truncated_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy and mass from the 20 largest log-probabilities only, as an engine returns them."""
    t = _tokens(spark, d).withColumn("top", dist.largest(F.col("lp"), TRUNCATED))
    e, m = dist.entropy_of_logprobs(F.col("top")), dist.top_k_mass_of_logprobs(F.col("top"), TOP)
    return rounded(t.select("vec_id", e.alias("entropy"), m.alias("top_k_mass")))


def logprob_section_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Section metrics from maps of the 20 largest log-probabilities, token by token, as an engine returns them."""
    t = _tokens(spark, d)
    pairs = F.transform("lp", lambda v, i: F.struct(v.alias("lp"), i.alias("token")))
    best = F.transform(dist.largest(pairs, TRUNCATED), lambda e: F.struct(e["token"], e["lp"]))
    t = t.withColumn("logprobs", F.map_from_entries(best))
    e, m = dist.entropy_of_logprobs(F.map_values("logprobs")), dist.top_k_mass_of_logprobs(F.map_values("logprobs"), TOP)
    measured = t.select("label", "vec_id", "token_id", e.alias("e"), m.alias("m"))
    return rounded(dist.section_metrics(measured, "label", "vec_id", "token_id", "e", "m", THINK_END))


def greedy_token(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("vec_id", dist.argmax(F.col("logits")).alias("token"))


def sampled_token(spark: SparkSession, d: str) -> DataFrame:
    """Tokens drawn at temperature 2 with given numbers; the logits of the metrics stay unscaled."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * SCALE / 2.0).alias("scaled"))
    u = (F.col("vec_id") * 7919 + 13) % 10007 / F.lit(10007.0)
    return dist.with_distribution(v, "scaled").select("vec_id", dist.sampled(F.col("p"), u).alias("token"))


def normalised_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(dist.l2_normalise(F.col("embedding"))).alias("dim", "value"))
    return rounded(v.groupBy("vec_id").agg(F.sum(F.col("value") * F.col("value")).alias("length2"), F.sum(F.col("value") * F.col("dim")).alias("weighted")))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return t.select("label", "vec_id", "token_id", dist.entropy(F.col("p"), F.col("lp")).alias("e"), dist.top_k_mass(F.col("p"), TOP).alias("m"))


def sequence_section_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.section_metrics(_measured(spark, d), "label", "vec_id", "token_id", "e", "m", THINK_END))


def generation_trim_eos(spark: SparkSession, d: str) -> DataFrame:
    """The same after taking a single closing end token (here token 3) off each sequence."""
    t = _measured(spark, d)
    last = t.groupBy("label").agg(F.max("vec_id").alias("last"))
    kept = t.join(last, "label").where(~((F.col("vec_id") == F.col("last")) & (F.col("token_id") == 3)))
    return rounded(dist.section_metrics(kept, "label", "vec_id", "token_id", "e", "m", THINK_END))


def total_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variance_of(table(spark, d, "embeddings"), ["label"], "embedding"))


_P = f"""
    x AS (SELECT vec_id, label, vec_id % {TOKENS} AS token_id, list_transform(embedding, lambda v: v::DOUBLE * {SCALE}) AS l FROM embeddings),
    s AS (SELECT *, list_transform(l, lambda v: v - list_max(l)) AS c FROM x),
    z AS (SELECT *, ln(list_sum(list_transform(c, lambda v: exp(v)))) AS z FROM s),
    t AS (SELECT vec_id, label, token_id, l, list_transform(c, lambda v: v - z) AS lp FROM z),
    m AS (SELECT label, vec_id, token_id, -list_sum(list_transform(lp, lambda v: exp(v) * v)) AS e,
        list_sum(list_transform(list_reverse_sort(lp)[1:{TOP}], lambda v: exp(v))) AS m FROM t)"""
_SECTIONS = """
    p AS (SELECT label, min(CASE WHEN token_id = 16 THEN vec_id END) AS pos FROM {src} GROUP BY label),
    j AS (SELECT s.*, p.pos, (p.pos IS NOT NULL AND vec_id <= p.pos) AS inside FROM {src} s JOIN p USING (label))
    SELECT label, {cols}, CASE WHEN min(pos) IS NOT NULL THEN CAST(sum(CASE WHEN vec_id < pos THEN 1 ELSE 0 END) AS BIGINT) END AS think_end_position, count(*) AS num_tokens
    FROM j GROUP BY label"""
_COLS = ", ".join(
    sql_round(f"avg(CASE WHEN {w} THEN {c} END)", f"{n}{s}") for n, c in (("avg_entropy", "e"), ("avg_top_k_mass", "m")) for s, w in (("_thinking", "inside"), ("_output", "NOT inside"), ("", "true"))
)

QUERIES = {f.__name__: f for f in (
    total_variance, token_entropy, truncated_entropy, logprob_section_metrics, greedy_token, sampled_token, normalised_vectors, sequence_section_metrics, generation_trim_eos,
)}
SQL = {
    "total_variance": f"""
        WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v, vec_id FROM embeddings),
        v AS (SELECT label, d, var_samp(v) AS s, count(*) AS n FROM x GROUP BY label, d)
        SELECT label, {sql_round('sum(s)', 'total_variance')}, max(n) AS n_samples FROM v GROUP BY label""",
    "token_entropy": f"WITH {_P} SELECT vec_id, {sql_round('e', 'entropy')}, {sql_round('m', 'top_k_mass')} FROM m",
    "truncated_entropy": f"""
        WITH {_P}, k AS (SELECT vec_id, list_reverse_sort(lp)[1:{TRUNCATED}] AS top FROM t)
        SELECT vec_id, {sql_round('-list_sum(list_transform(top, lambda v: exp(v) * v))', 'entropy')},
            {sql_round(f'list_sum(list_transform(top[1:{TOP}], lambda v: exp(v)))', 'top_k_mass')} FROM k""",
    "greedy_token": f"WITH {_P} SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS token FROM t",
    "sampled_token": f"""
        WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * {SCALE} / 2.0) AS l FROM embeddings), s AS (SELECT vec_id, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM x),
        u AS (SELECT vec_id, generate_subscripts(e, 1) AS i, unnest(e) / list_sum(e) AS p FROM s), c AS (SELECT vec_id, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM u)
        SELECT vec_id, CAST(min(i) - 1 AS BIGINT) AS token FROM c WHERE c > ((vec_id * 7919 + 13) % 10007) / 10007.0::DOUBLE GROUP BY vec_id""",
    "normalised_vectors": f"""
        WITH n AS (SELECT vec_id, greatest(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 1e-12) AS n, embedding FROM embeddings),
        x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE / n AS v FROM n)
        SELECT vec_id, {sql_round('sum(v * v)', 'length2')}, {sql_round('sum(v * d)', 'weighted')} FROM x GROUP BY vec_id""",
    "sequence_section_metrics": f"WITH {_P}, {_SECTIONS.format(src='m', cols=_COLS)}",
    "logprob_section_metrics": f"""
        WITH {_P}, k AS (SELECT label, vec_id, token_id, list_reverse_sort(lp)[1:{TRUNCATED}] AS top FROM t),
        u AS (SELECT label, vec_id, token_id, -list_sum(list_transform(top, lambda v: exp(v) * v)) AS e, list_sum(list_transform(top[1:{TOP}], lambda v: exp(v))) AS m FROM k),
        {_SECTIONS.format(src='u', cols=_COLS)}""",
    "generation_trim_eos": f"""
        WITH {_P}, u AS (SELECT * FROM m WHERE NOT (token_id = 3 AND vec_id = (SELECT max(vec_id) FROM m q WHERE q.label = m.label))), {_SECTIONS.format(src='u', cols=_COLS)}""",
}
