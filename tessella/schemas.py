"""Schemas of the experiment files."""

from __future__ import annotations

METRICS = (
    "avg_entropy_thinking double, avg_entropy_output double, avg_entropy double, avg_top_k_mass_thinking double, avg_top_k_mass_output double, "
    "avg_top_k_mass double, think_end_position bigint, num_tokens bigint"
)
_TASK = "persona string, category string, article string, system_prompt string, prompt_id bigint"
RESULT = f"{_TASK}, prompt string, rep_idx bigint, response string, {METRICS}"
CONSISTENCY_RESULT = f"{_TASK}, question string, follow_up string, sample_idx bigint, " + ", ".join(
    f"response{i} string, " + ", ".join(f"response{i}_{c}" for c in METRICS.split(", ")) for i in (1, 2)
)
PERSONA = "persona string, category string, article string"
