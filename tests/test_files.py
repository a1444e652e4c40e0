from __future__ import annotations

import json

import pytest

from tessella.config import ConsistencyConfig, EmbeddingConfig, RunConfig, configs_match
from tessella.operators import inference
from tessella.sources import files
from tessella.session import cached
from tessella.streaming.incremental import resume_guard, run_stream
from tessella.streaming.progress import Progress


def test_prompt_lines_count_blank_lines(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"question": "a"}\n\n{"question": "b", "id": 9}\n  \n{"question": "c", "x": 1}\n')
    got = [(r.question, r.prompt_id) for r in files.load_prompts(spark, str(p)).orderBy("ordinal").collect()]
    assert got == [("a", 0), ("b", 9), ("c", 4)]


def test_prompt_array_mixes_strings_and_objects(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps(["a", {"question": "b", "id": 7}, {"question": "c"}]))
    got = [(r.question, r.prompt_id) for r in files.load_prompts(spark, str(p)).orderBy("ordinal").collect()]
    assert got == [("a", 0), ("b", 7), ("c", 2)]


def test_bad_prompt_files(spark, tmp_path):
    empty = tmp_path / "e.jsonl"
    empty.write_text("\n\n")
    with pytest.raises(ValueError, match="no prompts"):
        files.load_prompts(spark, str(empty))
    lacking = tmp_path / "l.jsonl"
    lacking.write_text('{"id": 1}\n')
    with pytest.raises(Exception, match="without question"):
        files.load_prompts(spark, str(lacking)).collect()


def test_personae_and_consistency_prompts(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('[\n\n {"persona": "fox \\"f\\"", "category": "beast", "article": "a", "more": 1},\n {"persona": "", "category": "c", "article": ""}]')
    assert [tuple(r) for r in files.load_personae(spark, str(p)).collect()] == [(0, 'fox "f"', "beast", "a"), (1, "", "c", "")]
    p.write_text('[{"persona": "x", "category": "y"}]')
    with pytest.raises(Exception, match="without article"):
        files.load_personae(spark, str(p)).collect()
    q = tmp_path / "c.jsonl"
    q.write_text('{"question": "a", "follow_up": "b", "id": 3}\n')
    assert tuple(files.load_consistency_prompts(spark, str(q)).first()) == (0, "a", "b", 3)


def test_torn_last_line_is_left_out(spark, tmp_path):
    p = tmp_path / "results.jsonl"
    p.write_text('{"persona": "a", "prompt_id": 1, "rep_idx": 0}\n\n{"persona": "b", "prom')
    rows = files.load_results(spark, str(p))
    assert rows.count() == 1 and [r.persona for r in rows.collect()] == ["a"]
    assert files.torn_lines(spark, str(p)).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.load_results(spark, str(p), strict=True).collect()
    assert files.count_results(spark, str(p)) == 2 and files.count_results(spark, str(tmp_path / "none")) == 0


def test_results_array_and_append(spark, tmp_path):
    p = tmp_path / "results.json"
    p.write_text('[{"persona": "a", "num_tokens": 3},\n{"persona": "b"}]')
    rows = files.load_results(spark, str(p))
    assert rows.count() == 2
    for _ in range(2):
        files.append_results(rows, str(tmp_path / "out.jsonl"))
    assert files.load_results(spark, str(tmp_path / "out.jsonl")).count() == 4


def test_discovery_prefers_lines(spark, tmp_path):
    for name in ("r1/results.jsonl", "r1/results.json", "r2/results.json", "r3/other.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.find_runs(spark, str(tmp_path))
    assert [r.path.rsplit("/", 2)[-2:] for r in found.orderBy("rank").collect()] == [["r2", "results.json"], ["r1", "results.jsonl"]]


@pytest.mark.parametrize("bad", [{"model": ""}, {"backend": "x"}, {"max_tokens": 0}, {"n_reps": 0}, {"backend": "vllm", "logprobs_k": 3}, {"temperature": -1.0}, {"top_k_mass_k": 0}, {"subset_prompt": 0.0}, {"subset_category_persona": 1.5}, {"system_prompt_style": "x"}])
def test_config_rules(bad):
    with pytest.raises(ValueError):
        RunConfig(**bad)


@pytest.mark.parametrize("bad", [{"model": ""}, {"n_samples": 0}, {"logprobs_k": 0}, {"embedding_batch_size": 0}])
def test_consistency_config_rules(bad):
    with pytest.raises(ValueError):
        ConsistencyConfig(**bad)


def test_config_defaults(tmp_path, monkeypatch):
    monkeypatch.setenv("SLURM_JOB_ID", "7")
    with pytest.warns(UserWarning, match="n_reps"):
        c = RunConfig(n_reps=3)
    assert (c.n_reps, c.output_dir, c.logprobs_k) == (1, "logs/personae-inference-7", 10_000)
    assert RunConfig(temperature=0.5, n_reps=3).n_reps == 3 and RunConfig(logprobs_k=3).backend == "transformers"
    assert ConsistencyConfig().n_samples == 100 and ConsistencyConfig().output_dir == "logs/consistency-inference-7"
    assert RunConfig.of(c.to_dict() | {"other": 1}) == c
    (tmp_path / "p").write_text("x")
    RunConfig(str(tmp_path / "p"), str(tmp_path / "p")).check_files()
    with pytest.raises(ValueError, match="personae_json not found"):
        RunConfig(str(tmp_path / "p"), str(tmp_path / "q")).check_files()


def test_configs_match_but_for_output(spark, tmp_path):
    c = RunConfig(model="m", output_dir=f"file://{tmp_path}/run", backend="vllm", logprobs_k=-1)
    assert configs_match(c.to_dict() | {"output_dir": "else"}, c)
    assert not configs_match({k: v for k, v in c.to_dict().items() if k != "n_reps"}, c)
    resume_guard(spark, c)
    resume_guard(spark, c)
    with pytest.raises(ValueError, match="other settings"):
        resume_guard(spark, RunConfig(model="m2", output_dir=c.output_dir))
    with pytest.raises(ValueError):
        EmbeddingConfig("m", batch_size=0)


def test_prompts_in_an_array_by_their_json_type(spark, tmp_path):
    (tmp_path / "p.txt").write_text('["{not an object}", {"question": "q", "id": 7}, "[x]", {"question": "{r}"}]')
    rows = [(r.ordinal, r.question, r.prompt_id) for r in files.load_prompts(spark, str(tmp_path / "p.txt")).orderBy("ordinal").collect()]
    assert rows == [(0, "{not an object}", 0), (1, "q", 7), (2, "[x]", 2), (3, "{r}", 3)]


def test_stream_answers_each_key_once(spark, tmp_path):
    def put(keys, n):
        spark.createDataFrame(keys, "persona string, prompt_id long, rep_idx long").write.mode("append").parquet(f"{tmp_path}/tasks")

    schema = "persona string, prompt_id long, rep_idx long"
    answer = lambda t: t.selectExpr("*", "persona as answer")
    put([("a", 1, 0), ("a", 1, 0), ("b", 1, 0)], 1)
    assert run_stream(spark, f"{tmp_path}/tasks", schema, f"{tmp_path}/out", answer) == 1
    assert run_stream(spark, f"{tmp_path}/tasks", schema, f"{tmp_path}/out", answer) == 0
    put([("b", 1, 0), ("c", 2, 0)], 2)
    run_stream(spark, f"{tmp_path}/tasks", schema, f"{tmp_path}/out", answer)
    rows = [(r.persona, r.prompt_id) for r in spark.read.parquet(f"{tmp_path}/out/results").collect()]
    assert sorted(rows) == [("a", 1), ("b", 1), ("c", 2)]


def test_progress_of_a_stream(spark, tmp_path):
    import time

    spark.range(7).selectExpr("'a' as persona", "id as prompt_id", "0L as rep_idx").write.parquet(f"{tmp_path}/tasks")
    told = []
    with Progress(spark, told.append) as p:
        run_stream(spark, f"{tmp_path}/tasks", "persona string, prompt_id long, rep_idx long", f"{tmp_path}/out", lambda t: t)
        for _ in range(50):
            if p.lines:
                break
            time.sleep(0.1)
    assert p.lines == told and sum(x["rows"] for x in told) == 7


def test_cached_only_inside(spark):
    df = spark.range(5)
    with cached(df) as c:
        assert c.is_cached and c.count() == 5
    assert not df.is_cached


def test_two_turns_and_views(spark):
    tasks = spark.createDataFrame([("fox", "S", "q", "f")], "persona string, system_prompt string, question string, follow_up string")
    r = inference.run_two_turns(tasks, inference.backend("stub")).first()
    assert r.response1 != r.response2 and r.response1_num_tokens > 0
    with pytest.raises(ValueError, match="unknown backend"):
        inference.backend("none")
    rows = spark.createDataFrame([(1, "<think>a</think> b"), (2, " "), (3, None)], "k int, response string")
    got = {x.k: x for x in inference.embed_views(rows, ["response"], inference.stub_embed).collect()}
    assert got[1].text_thinking == "a" and got[1].text_output == "b" and "response" not in got[1].asDict()
    assert got[2].embedding == got[2].embedding_output == got[3].embedding
    wide = spark.createDataFrame([("x", "y")], "response1 string, response2 string")
    cols = inference.embed_views(wide, ["response1", "response2"], inference.stub_embed).columns
    assert [c for c in cols if c.startswith("embedding")] == [f"embedding_response{i}_{v}" for i in (1, 2) for v in ("full", "thinking", "output")]
