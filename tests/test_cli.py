from __future__ import annotations

import json

import pytest

from tessella import cli
from tessella.sources import files


@pytest.fixture
def inputs(tmp_path):
    people = [{"persona": p, "category": c, "article": "a"} for p, c in (("fox", "beast"), ("wolf", "beast"), ("judge", "scholar"))]
    (tmp_path / "personae.json").write_text(json.dumps(people))
    (tmp_path / "prompts.json").write_text(json.dumps(["One?", {"question": "Two?", "id": 5}]))
    (tmp_path / "two.jsonl").write_text(json.dumps({"question": "One?", "follow_up": "And?", "id": 1}))
    return tmp_path


def test_run_and_resume(spark, inputs, capsys):
    argv = ["run", "--prompts-json", f"file://{inputs}/prompts.json", "--personae-json", f"file://{inputs}/personae.json", "--backend", "stub", "--output-dir", f"file://{inputs}/out"]
    cli.main(argv, spark)
    cli.main(argv, spark)
    assert capsys.readouterr().out.split("\n")[:2] == ["6 tasks were left", "0 tasks were left"]
    rows = files.load_results(spark, f"file://{inputs}/out/results.jsonl").collect()
    assert len({(r.persona, r.prompt_id, r.rep_idx) for r in rows}) == len(rows) == 6 and all(r.response and r.num_tokens for r in rows)
    with pytest.raises(ValueError, match="other settings"):
        cli.main([*argv, "--max-tokens", "5"], spark)
    cli.main(["compare", f"file://{inputs}/out/results.jsonl", f"file://{inputs}/out/results.jsonl"], spark)
    assert "identical_percent" in capsys.readouterr().out


def test_subsets_and_missing_files(spark, inputs, capsys):
    argv = ["run", "--prompts-json", f"file://{inputs}/prompts.json", "--personae-json", f"file://{inputs}/personae.json", "--backend", "stub"]
    cli.main([*argv, "--output-dir", f"file://{inputs}/part", "--subset-prompt", "0.5", "--subset-category-persona", "0.5"], spark)
    assert capsys.readouterr().out.startswith("2 tasks")
    with pytest.raises(ValueError, match="prompts_json not found"):
        cli.main(["run", "--prompts-json", f"file://{inputs}/none.json", *argv[3:], "--output-dir", f"file://{inputs}/x"], spark)


def test_consistency_and_variance(spark, inputs, capsys):
    argv = ["consistency", "--prompts-jsonl", f"file://{inputs}/two.jsonl", "--personae-json", f"file://{inputs}/personae.json", "--backend", "stub", "--n-samples", "2", "--output-dir", f"file://{inputs}/two"]
    cli.main(argv, spark)
    assert capsys.readouterr().out.startswith("6 tasks")
    e = spark.createDataFrame([(1, "fox", "q", "beast", [0.0, 2.0]), (1, "fox", "q", "beast", [2.0, 0.0]), (1, "wolf", "q", "beast", [1.0, 1.0])], "prompt_id long, persona string, question string, category string, embedding_a array<double>")
    e.write.parquet(str(inputs / "e"))
    cli.main(["variance", "--input", str(inputs / "e"), "--output", str(inputs / "v")], spark)
    got = {r.persona: (r.total_variance, r.n_samples, r.question, r.category) for r in spark.read.parquet(str(inputs / "v")).collect()}
    assert got == {"fox": (4.0, 2, "q", "beast"), "wolf": (None, 1, "q", "beast")}
