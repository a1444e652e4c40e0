"""Model calls behind an injected backend: one Arrow-batched pass, the model loaded once per worker process.

A backend is a function without arguments that loads a model and returns a function from a list of prompts to as many
answers. Keys travel with their rows, so nothing depends on the order in which answers come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import blank_to_space, generation_prefix, message, output_section, render_chat, thinking_section
from tessella.operators.grid import persona_batches
from tessella.session import materialise, ship

Generate = Callable[[list[str]], list[tuple[str, int]]]
Embed = Callable[[list[str]], list[list[float]]]
_BACKENDS: dict[str, Callable[[], Generate]] = {}
_EMBEDDERS: dict[str, Callable[[], Embed]] = {}


def register(name: str, load: Callable[[], Generate]) -> None:
    _BACKENDS[name] = load


def register_embedder(name: str, load: Callable[[], Embed]) -> None:
    _EMBEDDERS[name] = load


def backend(name: str) -> Callable[[], Generate]:
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend: {name}")
    return _BACKENDS[name]


def stub_generate() -> Generate:
    """Answers that depend on the prompt alone; for tests and plans."""

    def run(prompts: list[str]) -> list[tuple[str, int]]:
        marks = [hashlib.sha256(p.encode()).hexdigest()[:12] for p in prompts]
        return [(f"<think>\n{m[:4]}\n</think>\n\nAnswer {m[4:]}.", len(p) % 50 + 10) for m, p in zip(marks, prompts, strict=True)]

    return run


def stub_embed() -> Embed:
    """Eight numbers from the text's hash, of length one."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [b - 127.5 for b in hashlib.sha256(t.encode()).digest()[:8]]
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v])
        return out

    return run


register("stub", stub_generate)
register_embedder("stub", stub_embed)


def _generate(df: DataFrame, prompt: str, response: str, tokens: str, load: Callable[[], Generate]) -> DataFrame:
    schema = df.select("*", F.lit("").alias(response), F.lit(0).cast("bigint").alias(tokens)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            answers = model(b[prompt].tolist())
            yield b.assign(**{response: [a for a, _ in answers], tokens: [n for _, n in answers]})

    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


def run_single(tasks: DataFrame, load: Callable[[], Generate]) -> DataFrame:
    """tasks (persona, system_prompt, question, ...) with prompt, response and num_tokens."""
    turns = F.array(message("system", F.col("system_prompt")), message("user", F.col("question")))
    return _generate(tasks.withColumn("prompt", render_chat(turns, generation_prefix(F.col("persona")))), "prompt", "response", "num_tokens", load)


def run_two_turns(tasks: DataFrame, load: Callable[[], Generate]) -> DataFrame:
    """tasks with response1 and response2; the second prompt holds the same row's first answer.

    The first turn is written before the second reads it, so a lost executor doesn't repeat both.
    """
    start = [message("system", F.col("system_prompt")), message("user", F.col("question"))]
    prefix = generation_prefix(F.col("persona"))
    one = materialise(_generate(tasks.withColumn("_prompt", render_chat(F.array(*start), prefix)), "_prompt", "response1", "response1_num_tokens", load))
    turns = F.array(*start, message("assistant", F.col("response1")), message("user", F.col("follow_up")))
    two = _generate(one.withColumn("_prompt", render_chat(turns, prefix)), "_prompt", "response2", "response2_num_tokens", load)
    return two.drop("_prompt")


def batched(tasks: DataFrame, size: int) -> DataFrame:
    """tasks (with an ordinal) with the batch they would run in: a persona's chunks of `size`."""
    return persona_batches(tasks, size)


def embed_views(rows: DataFrame, responses: list[str], load: Callable[[], Embed]) -> DataFrame:
    """rows without the responses, with text_* and embedding_* columns for full, thinking and output view of each.

    All views go through the model in one pass. Blank texts are embedded as one space. One response column is named
    "response": its columns are text, text_thinking, text_output and embedding, embedding_thinking, embedding_output.
    """
    named: dict[str, str] = {}
    out = rows
    for r in responses:
        own = "" if r == "response" else f"_{r}"
        for view, f in (("" if r == "response" else "_full", lambda c: c), ("_thinking", thinking_section), ("_output", output_section)):
            text = f"text{own}{'' if view == '_full' else view}"
            out = out.withColumn(text, f(F.coalesce(r, F.lit(""))))
            named[text] = f"embedding{own}{view}"
    schema = out.select("*", *[F.array(F.lit(0.0).cast("float")).alias(e) for e in named.values()]).drop(*responses).schema
    sent = out.withColumns({f"_{t}": blank_to_space(F.col(t)) for t in named}).drop(*responses)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            texts = [x for t in named for x in b[f"_{t}"].tolist()]
            vectors = model(texts) if texts else []
            n = len(b)
            b = b.drop(columns=[f"_{t}" for t in named])
            yield b.assign(**{e: vectors[i * n : (i + 1) * n] for i, e in enumerate(named.values())})

    ship(rows.sparkSession)
    return sent.mapInPandas(run, schema)
