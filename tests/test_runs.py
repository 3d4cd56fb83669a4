"""Run metrics, selections, displays, strict replies, host-language strings and progress streams."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import as_text
from tidemill.operators import curves as K
from tidemill.operators import evaluate as E
from tidemill.operators import reports as P
from tidemill.operators import rubric as R
from tidemill.operators import runs as U
from tidemill.sources import readers
from tidemill.streaming import forecast as ST


def test_values_are_shown_as_the_host_language_prints_them(spark):
    values = ["1.0", "1", "-0.5", "1e20", "true", "false", "null", '"x y"', '""', '["x",1]', '{"k":true}', "[null, 2.0]", "123456789012", '{"a": {"b": [1.5]}}']
    rows = spark.createDataFrame([(k, f'{{"v": {v}}}') for k, v in enumerate(values)] + [(99, '{"w": 1}')], "k int, raw string")
    got = {r["k"]: r["s"] for r in rows.select("k", as_text(F.col("raw"), "v").alias("s")).collect()}
    assert got == {**{k: str(json.loads(v)) for k, v in enumerate(values)}, 99: ""}


def test_replies_of_wrong_kinds_are_failures(spark):
    good = {"clarity": 8, "correctness": 7.5, "value": 6, "keep": True, "reason": "fine"}
    replies = [good, {**good, "clarity": "8"}, {**good, "reason": ["x"]}, {**good, "reason": ""}, {**good, "keep": "yes"}, {**good, "value": None}, [good], 5, {**good, "value": True}]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(replies)] + [(20, None), (21, "no json"), (22, f"```json\n{json.dumps(good)}\n```")], "k int, reply string")
    got = {r["k"]: r["p"] for r in rows.select("k", R.parse_scores(F.col("reply")).alias("p")).collect()}
    assert {k for k, p in got.items() if not p["curation_failed"]} == {0, 4, 22}
    assert got[0]["keep"] is True and got[4]["keep"] is None and got[4]["keep_present"] and got[0]["avg_score"] == pytest.approx(21.5 / 3)


def test_lines_end_at_line_feeds_only():
    odd = '{"a": "x y\u0085z\x7f"}'
    assert readers.parse_lenient(f"{odd}\r\nnot json\n{odd}") == [json.loads(odd)] * 2
    assert readers.parse_strict(f"{odd}\n\n{odd}\n") == [json.loads(odd)] * 2


def test_archives_without_rows_are_empty_and_without_files_an_error():
    def archive(**entries):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in entries.items():
                z.writestr(name, text)
        return data.getvalue()

    assert readers.archive_rows(archive(**{"a.json": "[]", "b.csv": "x,y\n"})) == []
    with pytest.raises(ValueError):
        readers.archive_rows(archive(**{"read.me": "x"}))


def test_null_outputs_are_outputs(spark):
    base = spark.createDataFrame([(0, "q", "r", None), (1, "q", "r", "x")], "pos long, question string, reference string, output string")
    tuned = spark.createDataFrame([(0, "y"), (1, None)], "pos long, output string")
    assert sorted((r["pos"], r["base_output"], r["ft_output"]) for r in E.zip_outputs(base, tuned).collect()) == [(0, None, "y"), (1, "x", None)]
    with pytest.raises(Exception, match="differ in length"):
        E.zip_outputs(base, tuned.where("pos = 0")).collect()


def test_progress_is_kept_by_batch_and_step(spark, tmp_path):
    schema = "run_id long, epoch int, loss double"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    sink = ST.merge_progress(f"file://{tmp_path}/p")
    sink(frame((1, 1, 0.9), (1, 2, 0.8)), 0)
    for _ in range(2):  # a batch that is played again changes nothing
        sink(frame((1, 2, 0.7), (2, 1, 0.5)), 1)
        got = sorted(map(tuple, ST.latest(spark, f"file://{tmp_path}/p").collect()))
        assert got == [(1, 1, 0.9), (1, 2, 0.7), (2, 1, 0.5)]
        assert spark.read.parquet(f"file://{tmp_path}/p/log").count() == 4


def test_streams_are_tailed_followed_and_stopped(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.json").write_text('{"run_id": 1, "epoch": 1, "loss": 0.5}\n{"run_id": 1, "epoch": 2, "loss": 0.4}\n')
    rows = ST.tail(spark, str(folder), "run_id long, epoch int, loss double", per_batch=1)
    out = f"file://{tmp_path}/out"
    query = ST.follow(rows, ST.merge_progress(out), str(tmp_path / "cp"), every="1 second")
    try:
        for _ in range(120):
            if query.lastProgress and (tmp_path / "out/log").exists():
                break
            query.awaitTermination(0.5)
        ST.stop_when(query, lambda: True)
        assert not query.isActive
    finally:
        query.stop()
    (folder / "b.json").write_text('{"run_id": 1, "epoch": 2, "loss": 0.3}\n')
    ST.follow(rows, ST.merge_progress(out), str(tmp_path / "cp"), every=None).awaitTermination(120)
    assert sorted(map(tuple, ST.latest(spark, out).collect())) == [(1, 1, 0.5), (1, 2, 0.3)]


def test_forecasts_use_every_epoch_and_backtests_every_cutoff(spark):
    rows = spark.createDataFrame([(7, e, 1 + 2 / e) for e in range(1, 131)] + [(8, 1, None)], "run_id long, epoch int, loss double")
    assert {r["cutoff"] for r in K.forecast_runs(rows).collect()} == {130} and {r["cutoff"] for r in K.forecast_runs(rows, upto=9).collect()} == {9}
    got = K.backtest_fits(rows.where("epoch <= 8"), [3, 7], [1, 2]).collect()
    assert sorted((r["cutoff"], r["horizon"]) for r in got) == [(3, 1), (3, 2), (7, 1)]
    assert all(r["actual"] == pytest.approx(1 + 2 / (r["cutoff"] + r["horizon"])) and r["mape"] < 5 for r in got)
    one = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, None, None, 4.0, None], 1)], "r int, i int, v double")
    assert [r["value_filled"] for r in K.interpolate(one, "r", "i", "v").orderBy("i").collect()] == [1.0, 2.0, 3.0, 4.0, None]


def test_metrics(spark):
    devices = spark.createDataFrame([("a", {"bytes_in_use": 5, "bytes_reserved": 9}), ("a", {"peak_bytes_in_use": 7}), ("b", {})], "hw string, stats map<string,long>")
    got = {r["hw"]: r["peak_bytes"] for r in U.peak_memory(devices, "hw").collect()}
    assert got["a"] == 7 and math.isnan(got["b"])
    rows = spark.createDataFrame([(1.0,), (4.0,), (3.0,), (2.0,), (None,)], "avg_score double")
    assert tuple(U.score_spread(rows).first()) == (1.0, 4.0, 3.0)
    x = spark.createDataFrame([(50, 3, 10.0), (50, 3, 0.0)], "n int, e int, s double")
    assert [r[0] for r in x.select(U.run_throughput(F.col("n"), F.col("e"), F.col("s"))).collect()] == [15.0, None]
    y = spark.createDataFrame([(1.0, 1.5, None)], "actual double, a double, b double")
    assert tuple(U.with_absolute_errors(y, "actual", "a", "b").first())[3:] == (0.5, None)
    z = spark.createDataFrame([(2.345,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in z.select(U.shown(F.col("v"), 1)).collect()] == ["2.3", "—", "—"]
    backtest = spark.createDataFrame([(r, c, 1, arm, 1.0, 1.0, float(r + c + (arm == "b"))) for r in (1, 2) for c in (3, 4) for arm in "ab"], K.BACKTEST)
    labels = spark.createDataFrame([(1, "Easy"), (2, "Hard")], "run_id long, difficulty string")
    made = json.loads(U.summary_json(backtest, labels, ["a", "b"]).first()["summary"])
    assert made["head_to_head"] == {"a_wins": 4, "b_wins": 0, "ties": 0} and made["overall"]["a"]["n"] == 4 and made["by_difficulty"]["Easy"]["mean"] == 5.0 and made["by_cutoff"]["3/b"]["mean"] == 5.5


def test_selections(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"q{k}" * 110, "a", float(k), k == 4) for k in range(6)], "pos long, question string, answer string, avg_score double, curation_failed boolean")
    assert [r["pos"] for r in U.evaluation_source(None, rows.where("pos > 1"), rows, 2).collect()] == [2, 3]
    assert [r["pos"] for r in U.evaluation_source(rows.limit(0), None, rows, 2).collect()] == [0, 1]
    assert [r["pos"] for r in U.evaluation_set(rows, rows, lambda x: x, 3.0).orderBy("pos").collect()] == [3, 5]
    assert U.evaluation_set(None, rows, None, 3.0).count() == 6
    assert max(len(r["question"]) for r in U.preview(rows).collect()) == 200
    traces = spark.createDataFrame([("t", "m", "f", "x", True, 0.125), ("t", "m", "g", "x", True, 1.0)], "timestamp string, module string, function string, model string, success boolean, latency_s double")
    assert [r["latency_s"] for r in U.trace_view(U.traces_of(traces, "m", "f")).collect()] == [0.12]
    e = {r["k"]: r["embedding"] for r in U.text_embedding(spark.createDataFrame([(1, "a b a"), (2, "A, b! a"), (3, None)], "k int, text string"), size=16).collect()}
    assert e[1] == e[2] and sum(v * v for v in e[1]) == pytest.approx(1) and set(e[3]) == {0.0}
    prompts = spark.createDataFrame([("p",), ("q",)], "prompt string")
    stored = spark.createDataFrame([("p", True, "x", 0.1), ("p", False, "y", 0.2)], "prompt string, adapter boolean, output string, latency_s double")
    assert {r["prompt"]: r["output"] for r in U.generated(prompts, stored, False).collect()} == {"p": "y", "q": None}
    spark.createDataFrame([("i", None), ("j", "o")], "instruction string, output string").write.parquet(str(tmp_path / "hub"))
    assert [(r["input"], r["output"]) for r in readers.read_local_dataset(spark, str(tmp_path / "hub")).orderBy("instruction").collect()] == [("", ""), ("", "o")]
    spark.createDataFrame([(0, [1, 2])], "pos long, input_ids array<long>").write.parquet(str(tmp_path / "tokens"))
    assert readers.read_token_arrays(spark, str(tmp_path / "tokens")).first()["labels"] == [1, 2]


def test_notebook_reports(spark):
    rows = spark.createDataFrame([(k, f"q{k}", "a", float(k), "kept" if k > 1 else "rejected_quality", "kept", "why") for k in range(4)], "pos long, question string, answer string, avg_score double, final_status string, automatic_status string, reason string")
    text = P.notebook_curation(rows)
    assert "- kept: 2" in text and "0.00 to 3.00, median 2.00" in text and "q2 (2.0)" in text
    full = P.curation_report(rows, 2.0)
    assert "answer: a" in full and "automatic kept, final rejected_quality" in full
    latency = spark.createDataFrame([("base", 1.5, 2)], "model string, avg_latency double, n long")
    judged = spark.createDataFrame([(0, "q", "A")], "pos long, question string, winner string")
    summary = {"total_examples": 1, "wins": 0, "losses": 1, "ties": 0, "judge_failures": 0, "avg_quality_margin": -1.0, "n_regressions": 1}
    assert "- base: 1.50 s" in P.notebook_evaluation(summary, latency, judged) and "- q: A" in P.notebook_evaluation(summary, latency, judged)
