"""Stateful checks, merged progress, kept replies, actions, warnings, mappings and functions that had no test."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import ends_cleanly, is_empty
from tidemill.operators import classify as C
from tidemill.operators import curves as K
from tidemill.operators import dedup as D
from tidemill.operators import evaluate as E
from tidemill.operators import experiments as X
from tidemill.operators import normalize as N
from tidemill.operators import reports as P
from tidemill.operators import rubric as R
from tidemill.operators import runs as U
from tidemill.sources import readers, sinks
from tidemill.streaming import forecast as ST


def test_checks_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    """Four batches that restart from the checkpoint, among them runs that are longer than a thousand epochs, and gaps."""
    losses = [(r, e, 0.4 + 2.0 / (e + r) + 0.01 * ((e * 7 + r) % 5)) for r in (1, 2, 3) for e in range(1, 8 + 3 * r)] + [(4, 1, 1.0), (4, 2, None), (4, 9, 0.9)]
    losses += [(5, e, 1.0 + 1.0 / e) for e in range(1, 1_003)]
    frame = spark.createDataFrame(losses, "run_id long, seq int, val_loss double").where("run_id < 5 or seq % 167 < 3")
    got = ST.replayed_stream(frame, f"file://{tmp_path}/stream")
    want = ST.batch_checks(frame)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r["epoch"] for r in want.where("run_id = 3 and action is not null").collect()} == {3, 6, 9, 12, 15}
    assert want.where("error is not null").count() == 0


def test_a_call_takes_many_runs(spark, tmp_path, monkeypatch):
    """State is kept and read by buckets of runs, not run by run; runs come and go, one has no name and others very long ones."""
    monkeypatch.setattr(ST, "BUCKETS", 2)
    losses = [(None if r == 0 else r + (1 << 60), e, 2.0 / (e + r) + 0.5) for r in range(9) for e in range(1 + r % 3, 7 + r)]
    frame = spark.createDataFrame(losses, "run_id long, seq int, val_loss double")
    got = ST.replayed_stream(frame, f"file://{tmp_path}/stream")
    want = ST.batch_checks(frame)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    state = spark.read.format("statestore").option("stateVarName", "losses").load(f"file://{tmp_path}/stream/checkpoint")
    assert state.select("key").distinct().count() <= 3


def test_long_runs_are_checked(spark):
    rows = ST.updates(7, [1 + 1 / e for e in range(1, 1_001)], [1.0005, 1.0004])
    assert [r[1] for r in rows] == [1_001, 1_002] and rows[1][8] is not None and rows[1][9] is None


def test_progress_is_merged_by_field(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    frame = lambda *rows: spark.createDataFrame(list(rows), "run_id long, epoch int, loss double, val_loss double, at long").coalesce(1)
    sink = ST.merge_progress(path, arrival="at", compact=3)
    state = lambda: {(r["run_id"], r["epoch"]): (r["loss"], r["val_loss"]) for r in ST.latest(spark, path).collect()}
    sink(frame((1, 3, 0.9, None, 5), (1, 3, 0.8, None, 4)), 0)
    assert state() == {(1, 3): (0.9, None)}
    for _ in range(2):  # a batch that is played again changes nothing
        sink(frame((1, 3, None, 0.7, 6), (2, 1, 0.5, None, 1)), 1)
        assert state() == {(1, 3): (0.9, 0.7), (2, 1): (0.5, None)}
    for _ in range(2):  # also one that makes a snapshot
        sink(frame((2, 1, 0.4, 0.3, 2), (2, 1, 0.45, None, 1), (3, 1, None, None, 1)), 2)
        assert state() == {(1, 3): (0.9, 0.7), (2, 1): (0.4, 0.3), (3, 1): (None, None)}
    assert ST._folders(spark, f"{path}/snapshots", "upto", complete=True) == [2]
    for k in range(3, 9):
        sink(frame((3, 1, float(k), None, 1)), k)
    assert state()[3, 1] == (8.0, None) and state()[2, 1] == (0.4, 0.3)
    read = ST.latest(spark, path).inputFiles()
    assert all("snapshots/upto=8" in f for f in read)  # what lies before the last snapshot is not read
    with pytest.raises(ValueError):
        ST.latest(spark, f"file://{tmp_path}/none")


def test_replies_are_kept(spark, tmp_path):
    """Equal prompts are one call; a job that dies after some calls and is run again makes only those that are missing."""
    log, mark = str(tmp_path / "calls"), str(tmp_path / "mark")
    os.mkdir(log)
    rows = spark.createDataFrame([(str(k), f"prompt {k % 6}") for k in range(40)] + [("n", None), ("bad", "fails")], "_id string, prompt string").repartition(4)

    def responder(text, temperature):
        with open(f"{log}/{text.replace(' ', '_')}-{os.urandom(6).hex()}", "w"):
            pass
        if text == "fails":
            raise RuntimeError("down")
        if text == "prompt 5" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)  # the worker dies behind other replies
        return f"reply to {text}"

    make = lambda: R.called(rows, responder, key="_id", store=f"file://{tmp_path}/store", workers=1, retries=0)
    with pytest.raises(Exception, match="worker exited"):
        make().collect()
    for _ in range(2):  # the second use calls nothing but what failed
        out = make()
        got = {r["_id"]: r for r in out.collect()}
    assert len(got) == 42 and all(got[str(k)]["reply"] == f"reply to prompt {k % 6}" and got[str(k)]["success"] for k in range(40))
    assert (got["n"]["success"], got["n"]["error"]) == (False, "no prompt") and "down" in got["bad"]["error"]
    calls = [f.split("-")[0] for f in os.listdir(log)]
    assert all(calls.count(f"prompt_{k}") == 1 for k in range(5)) and calls.count("prompt_5") == 2
    traced = R.traces(out, "m", "f", "model").collect()
    assert sum(not t["success"] for t in traced) == 2 and all(t["error"] for t in traced if not t["success"])


def test_actions(spark):
    replies = [json.dumps({"action": a, "notify_user": n, "reason": "r"}) for a, n in zip(K.ACTIONS, (True, False, True, True))]
    replies += ['```json\n{"action": "STOP"}\n```', '{"action": "STOP_EARLY"}', "oops", None]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, reply string").select("k", R.parse_action(F.col("reply")).alias("a"))
    got = {r["k"]: (r["a"]["action"], r["a"]["notify_user"]) for r in rows.collect()}
    assert K.ACTIONS == ("STOP", "CONTINUE", "CONTINUE_MORE_EPOCHS", "UNLIKELY_TO_SUCCEED")
    assert got == {0: ("STOP", True), 1: ("CONTINUE", False), 2: ("CONTINUE_MORE_EPOCHS", True), 3: ("UNLIKELY_TO_SUCCEED", True), 4: ("STOP", True), 5: ("CONTINUE", False), 6: ("CONTINUE", False), 7: ("CONTINUE", False)}
    told = lambda losses, ahead, noise: tuple(K.decide(losses, {"median": [ahead]}, noise).values())[:2]
    assert told([1.0], 1.1, 0.01) == told([1.0], 0.999, 0.01) == ("STOP", True)
    assert told([1.0], 0.98, 0.01) == ("CONTINUE", False) and told([1.0], 0.7, 0.01) == ("CONTINUE_MORE_EPOCHS", True)
    assert told([1.0], 0.7, 0.3) == ("UNLIKELY_TO_SUCCEED", True) and told([1.0], float("nan"), 0.1) == ("CONTINUE", False)


def test_warnings(spark):
    statuses = [("a", "kept")] * 25 + [("b", "kept")] * 5 + [("b", "failed")] * 45 + [("c", "kept")] * 3 + [("d", "rejected_quality")]
    health = U.warning_reasons(C.dataset_health(spark.createDataFrame(statuses, "dataset string, final_status string"), "dataset"))
    said = {r["dataset"]: r["message"] for r in health.collect()}
    assert said["a"] == "" and said["b"] == "Only 5 examples were kept (20 or more are recommended).; Only 5 of 50 raw examples (10%) were kept." and said["d"].endswith("(0%) were kept.")
    seen = []

    def replies(rows):
        seen.extend(r["dataset"] for r in rows.collect())
        return rows.withColumn("reply", F.when(F.col("dataset") == "b", '```json\n{"warn_user": false, "message": ""}\n```').when(F.col("dataset") == "c", '{"message": "few"}').otherwise("[1]"))

    got = {r["dataset"]: (r["warn_user"], r["message"]) for r in U.decide_warnings(health, replies).collect()}
    assert sorted(seen) == ["b", "c", "d"] and got == {"a": (False, ""), "b": (False, ""), "c": (True, "few"), "d": (True, said["d"])}


def test_mapping_by_a_model(spark):
    raw = {"q.text": "hello", "ctx": "", "it's": "x", "n": "0", "f": "false", "z": 0, "l": [], "label": 5, "big": "y" * 9_000}
    rows = spark.createDataFrame([(json.dumps(raw), 0), (json.dumps({**raw, "ctx": "more"}), 1)], "raw string, pos long")
    asked = []

    def reply(text):
        return lambda prompt, temperature: asked.append(prompt) or text

    found = N.detect(rows, responder=reply('```json\n{"question_fields": ["q.text", "ctx"], "answer_field": "label"}\n```'))
    assert (found["schema"], found["confidence"], found["mapping"]) == ("llm_mapping", "llm", {"question_fields": ["q.text", "ctx"], "answer_field": "label"})
    assert len(asked) == 1 and len(asked[0]) < N.SAMPLE_CHARS + 400
    got = [(r["question"], r["answer"]) for r in N.normalize(rows, "llm_mapping", found["mapping"]).orderBy("pos").collect()]
    assert got == [("hello", "5"), ("hello\n\nmore", "5")]
    whole = N.normalize(rows, "llm_mapping", {"question_fields": ["n", "f", "z", "l", "it's", "none"], "answer_field": "absent"}).orderBy("pos").first()
    assert (whole["question"], whole["answer"]) == ("0\n\nfalse\n\nx", "")
    for bad in ("no json", "[1]", '{"question_fields": "q.text", "answer_field": "label"}', '{"question_fields": ["nope"], "answer_field": "label"}', '{"question_fields": ["ctx"], "answer_field": null}', None):
        report = N.detect(rows, responder=reply(bad))
        assert report["schema"] is None and report["mapping"] is None and "ValueError" in report["error"]
    assert N.detect(rows)["schema"] is None
    values = ["null", '""', "0", "0.0", "false", "[]", "{}", '"0"', '"false"', '"[]"', '" "', "[0]", "1e-9", "true", '{"a": 0}', "-0.0"]
    empty = spark.createDataFrame([(k, f'{{"v": {v}}}') for k, v in enumerate(values)] + [(99, "{}"), (98, "bad")], "k int, raw string").select("k", is_empty(F.col("raw"), "v").alias("e"))
    assert {r["k"] for r in empty.collect() if r["e"]} == {k for k, v in enumerate(values) if not json.loads(v)} | {98, 99}


def test_validation_losses_are_spread(spark):
    train = spark.createDataFrame([(r, s, 1.0) for r, n in ((1, 11), (2, 5), (3, 1)) for s in range(n)], "run_id long, step int, loss double")
    val = spark.createDataFrame([(1, i, float(i)) for i in range(4)] + [(2, 0, 9.0)] + [(3, i, float(i)) for i in range(3)] + [(4, i, float(i)) for i in range(2)], "run_id long, i int, val_loss double")
    got = {(r["run_id"], r["step"]): r["val_loss"] for r in X.spread_validation(train, val).where("val_loss is not null").collect()}
    want = {}
    for run, n, m in ((1, 11, 4), (2, 5, 1), (3, 1, 3)):
        for i in range(m):
            want[run, round(i * max(n - 1, 1) / max(m - 1, 1))] = 9.0 if run == 2 else float(i)
    assert got == {**want, (4, 0): 0.0, (4, 1): 1.0}


def test_prompts_and_endings(spark):
    rows = spark.createDataFrame([(" \t\n", "Ends."), ("x", 'quote"  '), (" ", "no"), ("", None)], "extra string, t string")
    got = rows.select(N.alpaca_prompt(F.lit("i"), F.col("extra"), F.lit("o")).alias("p"), ends_cleanly(F.col("t")).alias("e")).collect()
    assert ["### Input:" in r["p"] for r in got] == [False, True, False, False] and [r["e"] for r in got] == [True, True, False, None]
    fixed = spark.createDataFrame([("instruction", 0)], "x string, k int").select(F.lit('{"instruction": "i", "response": 7}').alias("raw"))
    assert tuple(N.normalize(fixed, "instruction_response").select("question", "answer").first()) == ("i", "7")


def test_reports(spark):
    training = P.training_report({"training_time_s": 1.0, "val_loss_history": [2.0, 1.5]}, [{"epoch": 3, "error": "ValueError: x"}, {"epoch": 6, "decision": {"action": "STOP", "reason": "flat", "notify_user": True}}, {"epoch": 9, "decision": {"action": "CONTINUE", "reason": "falls", "notify_user": False}}])
    assert "- Epoch 3: error: ValueError: x" in training and training.rstrip().endswith("Recommendation: STOP (flat)") and "Throughput: n/a" in training
    final = P.final_report({"kept": 2, "failed": 1}, training, "# Evaluation Summary\n", 7)
    assert "- Kept: 2" in final and "- Rejected: 0" in final and "- Model calls: 7" in final and "# Training Report" in final
    judged = spark.createDataFrame([(0, "q", "B", None, "t", None)], "pos long, question string, winner string, base_output string, ft_output string, reason string")
    assert P.detailed_blocks(judged).first()["block"] == "## q\n\nWinner: B\n\nBase: \n\nTuned: t\n\n\n"
    frame = spark.createDataFrame([(0, 3.0, "kept"), (1, None, "failed")], "pos long, avg_score double, final_status string")
    assert "- Kept: 1" in P.curation_report(frame, 2.0)
    shown = spark.createDataFrame([(1, 5, True), (1, 2, True), (1, 6, None)], "run_id long, epoch int, notify_user boolean")
    assert [r["epoch"] for r in ST.banners(shown, 4).collect()] == [5]


def test_logs_and_replays(spark, tmp_path):
    rows = spark.createDataFrame([("a", "q", "x", 8.0, 7.0, 6.0, 7.0, "kept"), ("b", "q", "x", 8.0, 7.0, 6.0, 7.0, "kept")], "_id string, question string, answer string, clarity double, correctness double, value double, avg_score double, final_status string")
    log = sinks.override_log(rows, spark.createDataFrame([("a", "reject")], "_id string, decision string"))
    sinks.append_log(log, str(tmp_path / "overrides"))
    sinks.append_log(log, str(tmp_path / "overrides"))
    back = readers.read_log(spark, str(tmp_path / "overrides"), readers.OVERRIDES).collect()
    assert [(r["id"], r["automatic_status"], r["user_decision"], r["haiku_score"]["avg_score"], r["user_reason"]) for r in back] == [("a", "kept", "reject", 7.0, None)] * 2
    for _ in range(2):
        sinks.append_outcome(spark, str(tmp_path / "outcomes"), {"kept": 1}, {"lr": 0.1}, {"loss": 2, "model": object()})
    kept = spark.read.json(str(tmp_path / "outcomes")).collect()
    assert len(kept) == 2 and json.loads(kept[0]["final_result"]) == {"loss": 2}
    steps = spark.createDataFrame([("T4", "fsdp", s, 0.0, 1.0, 2.0, 3.0, 4.0) for s in (2, 1)], "hardware string, framework string, step int, timestamp double, step_time_sec double, tokens_per_sec double, peak_memory_mb double, loss double")
    (tmp_path / "bench.json").write_text(sinks.benchmark_documents(steps).first()["document"])
    read = readers.read_benchmarks(spark, {("T4", "fsdp"): str(tmp_path / "bench.json"), ("T4", "ddp"): str(tmp_path / "absent.json")})
    assert [r["step"] for r in read.orderBy("step").collect()] == [1, 2] and read.columns == steps.columns
    assert readers.read_benchmarks(spark, {("T4", "ddp"): str(tmp_path / "absent.json")}).count() == 0
    (tmp_path / "state.json").write_text(json.dumps({"best_metric": 0.9, "best_global_step": 4, "log_history": [{"epoch": 1.0, "step": 2, "loss": 1.5}, {"epoch": 1.0, "step": 2, "eval_loss": 1.4}]}))
    state = readers.read_trainer_state(spark, str(tmp_path / "state.json"))
    assert [(r["step"], r["loss"], r["eval_loss"], r["best_metric"]) for r in state.collect()] == [(2, 1.5, None, 0.9), (2, None, 1.4, 0.9)]
    sinks.write_tokens(spark.createDataFrame([([1, 2], [1, 1], [1, -100])], "input_ids array<int>, attention_mask array<int>, labels array<int>"), str(tmp_path / "tokens"))
    assert spark.read.parquet(str(tmp_path / "tokens")).first()["labels"] == [1, -100]
    prompts = spark.createDataFrame([("p",), ("q",)], "prompt string")
    replies = prompts.limit(1).select(F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"), F.lit("kept").alias("reply"))
    assert {r["prompt"]: r["reply"] for r in R.replayed(prompts, replies).collect()} == {"p": "kept", "q": None}
    answers = spark.createDataFrame([('{"confirmed_duplicate": true, "reason": "same"}',), ("no",), ('{"reason": "x"}',)], "reply string").select(R.parse_verification(F.col("reply")).alias("v")).collect()
    assert [(a["v"]["confirmed_duplicate"], a["v"]["reason"]) for a in answers] == [(True, "same"), (False, "verification_parse_failed"), (False, "verification_parse_failed")]


def test_candidate_pairs_are_exact_up_to_a_size(spark):
    rows = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(30)], "pos long, embedding array<double>")
    pairs = lambda df: {(r["index_a"], r["index_b"]) for r in df.collect()}
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if i % 5 == j % 5}
    assert pairs(D.candidate_pairs(rows, 0.9999)) == pairs(D.candidate_pairs(rows, 0.9999, use_ann=False, exact_up_to=5)) == want
    assert pairs(D.candidate_pairs(rows, 0.9999, exact_up_to=5)) <= want


def test_simulated_losses_and_pairs(spark):
    made = ST.simulated_losses(spark, 3, 20)
    assert made.count() == 60 and made.agg(F.min("val_loss")).first()[0] >= 0.3
    assert all(abs(r["val_loss"] - max(0.3, 2.5 * 0.82 ** r["seq"])) <= 0.031 for r in made.collect())
    agree = E.cross_check(spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "run_id long, epoch int, loss double"), spark.createDataFrame([(1, 0.5)], "run_id long, avg_quality_margin double")).first()
    assert agree["signals_agree"]


def test_ids_of_a_given_tokenizer(spark):
    rows = spark.createDataFrame([(0, "ab a"), (1, None), (2, "a " * 20)], "pos long, text string")

    def encoder():
        known = {"ab": 7, "a": 9}
        return lambda texts: [[known[w] for w in t.split()] for t in texts]

    got = {r["pos"]: r for r in N.tokenized(rows, encoder, size=4, pad=1).collect()}
    assert (got[0]["input_ids"], got[0]["attention_mask"], got[0]["labels"]) == ([7, 9, 1, 1], [1, 1, 0, 0], [7, 9, -100, -100])
    assert got[1]["input_ids"] == [1] * 4 and got[1]["labels"] == [-100] * 4 and got[2]["input_ids"] == [9] * 4


def test_tokenizer_files(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")

    def encoder():
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]

    texts = ["Hello there.", "été, là", ""]
    got = [r["input_ids"] for r in N.tokenized(spark.createDataFrame(list(enumerate(texts)), "pos long, text string"), encoder, size=8).orderBy("pos").collect()]
    assert got == [(i + [0] * 8)[:8] for i in encoder()(texts)]


def test_tables_and_archives_survive_the_way_over_files(spark, tmp_path):
    values = ['say "hi", all', "two\nlines", "back\\slash", "tab\there", "é, ü", "plain"]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, text string").repartition(2)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert {r["k"]: r["text"] for r in readers.read_table(spark, str(tmp_path / "csv")).collect()} == {str(k): v for k, v in enumerate(values)}
    assert readers.parse_table('k,text\n1,"say ""hi"""\n') == [{"k": "1", "text": 'say "hi"'}]
    lines = spark.range(2_500).select(F.when(F.col("id") < 2_400, F.lit("large")).otherwise(F.concat(F.lit("small-"), F.col("id") % 3)).alias("which"), F.to_json(F.struct("id")).alias("raw")).repartition(5)
    sinks.write_archives(lines.unionByName(spark.createDataFrame([("small-0", None), (None, '{"id": -1}')], "which string, raw string")), f"file://{tmp_path}/zip", "which", "raw", entry_lines=500)
    back = readers.read_archives(spark, f"{tmp_path}/zip/*.zip")
    assert sorted(r[0] for r in back.select(F.get_json_object("raw", "$.id").cast("long")).collect()) == list(range(-1, 2_500))
    assert sorted(os.listdir(tmp_path / "zip")) == [f"which={n}.zip" for n in ("", "large", "small-0", "small-1", "small-2")]
    assert back.where("src_file like '%large%'").select("src_entry").distinct().count() == 5
