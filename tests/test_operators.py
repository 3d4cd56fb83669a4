"""Operators of the reference pipeline on small fixtures with known results."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill.operators import classify as C
from tidemill.operators import curves as K
from tidemill.operators import dedup as D
from tidemill.operators import evaluate as E
from tidemill.operators import experiments as X
from tidemill.operators import normalize as N
from tidemill.operators import reports
from tidemill.operators import rubric as R
from tidemill.sources import readers, sinks
from tidemill.streaming import forecast as ST

SCORED = "_id string, pos long, question string, avg_score double, keep boolean, keep_present boolean, curation_failed boolean, reason string"


def scored(spark):
    return spark.createDataFrame([("a", 0, "qa", 8.5, True, True, False, "r"), ("b", 1, "qb", 3.0, False, True, False, "r"), ("c", 2, "qc", 6.8, None, True, False, "r"), ("d", 3, "qd", None, None, False, True, "evaluation failed")], SCORED)


def otsu(scores):
    hist = [0] * 50
    for v in scores:
        b = min(int(v * 5), 49)
        b = b - 1 if v < b * 0.2 else b + 1 if v >= (b + 1) * 0.2 and b != 49 else b
        hist[b] += 1
    total, whole = sum(hist), sum(h * (0.2 * b + 0.1) for b, h in enumerate(hist))
    best, at, w, s = 0.0, 0.1, 0, 0.0
    for b, h in enumerate(hist):
        w, s = w + h, s + h * (0.2 * b + 0.1)
        if 0 < w < total and (v := round(w * (total - w) * (s / w - (whole - s) / (total - w)) ** 2, 6)) > best:
            best, at = v, 0.2 * b + 0.1
    return at


def test_thresholds_and_classes(spark):
    rows = scored(spark)
    assert C.auto_threshold(rows).first()[0] == pytest.approx(3.1)
    assert C.auto_threshold(rows, "percentile", 40).first()[0] == pytest.approx(6.04)
    status = {r["_id"]: r["final_status"] for r in C.classify(rows, C.auto_threshold(rows)).collect()}
    assert status == {"a": "kept", "b": "rejected_quality", "c": "kept", "d": "failed"}
    hyper = {r["_id"]: r["final_status"] for r in C.classify(rows, 6.5, mode="hyper", width=1.0).collect()}
    assert hyper["c"] == "rejected_quality"
    with pytest.raises(Exception, match="no valid scores"):
        C.auto_threshold(rows.where("curation_failed")).collect()
    same = spark.createDataFrame([(5.0, False)] * 4, "avg_score double, curation_failed boolean")
    assert C.otsu(same).first()[0] == pytest.approx(0.1)


def test_otsu_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        s = [round(rng.uniform(0, 10), 2) for _ in range(60)] + [0.0, 10.0, 0.6]
        df = spark.createDataFrame([(v, False) for v in s], "avg_score double, curation_failed boolean")
        assert C.otsu(df).first()[0] == pytest.approx(otsu(s))


def test_overrides_twice_change_nothing(spark):
    base = C.classify(scored(spark), 3.1)
    o = spark.createDataFrame([("d", "accept"), ("a", "reject")], "_id string, decision string")
    once = C.apply_overrides(base, o)
    got = {r["_id"]: (r["final_status"], r["automatic_status"]) for r in once.collect()}
    assert got["d"] == ("manually_accepted", "failed") and got["a"] == ("manually_rejected", "kept") and got["b"] == ("rejected_quality", None)
    assert {r["_id"]: (r["final_status"], r["automatic_status"]) for r in C.apply_overrides(once, o).collect()} == got
    report = reports.curation_report(once, 3.1)
    assert "- Manually accepted: 1" in report and "Accepted by hand after failure" in report


def test_health(spark):
    rows = spark.createDataFrame([("kept",)] * 8 + [("rejected_quality",)] * 2, "final_status string")
    r = C.dataset_health(rows).first()
    assert r["warning"] and r["reasons"] == ["few_examples"]


def test_drop_set_has_no_closure(spark):
    p = spark.createDataFrame([(0, 1, True), (1, 2, None), (3, 4, False)], "index_a long, index_b long, confirmed_duplicate boolean")
    assert {r["pos"] for r in D.drop_set(p).collect()} == {1, 2}


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    rng = random.Random(1)
    v = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(v)) + [(99, None)], "pos long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if cos(v[i], v[j]) >= 0.6}
    got = [(r["index_a"], r["index_b"]) for r in D.pairs_exact(df, 0.6).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r["index_a"], r["index_b"]) for r in D.pairs_lsh(df, 0.6).collect()} <= want


def test_hashed_pairs_miss_few(spark):
    """Recall of the hashed pairs at the threshold and tables of dup_pairs_lsh."""
    rng = random.Random(5)
    df = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(250)], "pos long, embedding array<double>")
    pairs = lambda found: {(r["index_a"], r["index_b"]) for r in found.collect()}
    want, got = pairs(D.pairs_exact(df, 0.40)), pairs(D.pairs_lsh(df, 0.40))
    assert len(want) > 500 and got <= want and len(got) >= 0.9 * len(want)


def test_few_pairs_are_compared_at_the_usual_threshold(spark):
    """Recall at 0.92 of vectors that lie at it, and the share of all pairs that share a bucket."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.standard_normal((2_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1_000, 32))
    side -= (side * base[:1_000]).sum(1, keepdims=True) * base[:1_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.925 * base[:1_000] + np.sqrt(1 - 0.925**2) * side
    df = spark.createDataFrame([(k, v) for k, v in enumerate(np.vstack([base, near]).tolist())] + [(9_000, [1.0, 0.0]), (9_001, [1.0, 0.0]), (None, [0.0] * 32), (9_002, None)], "pos long, embedding array<double>")
    pairs = lambda found: {(r["index_a"], r["index_b"]) for r in found.collect()}
    n = 3_002
    got = pairs(D.pairs_lsh(df, 0.92))
    assert len(got & {(k, 2_000 + k) for k in range(1_000)}) >= 900 and (9_000, 9_001) in got and len(got) <= 1_010
    bits, tables, share = D.hash_plan(n, 0.92)
    planes = np.random.default_rng([7, 32]).standard_normal((32, bits * tables))
    codes = ((np.vstack([base, near]) @ planes > 0).reshape(3_000, tables, bits) * (1 << np.arange(bits))).sum(2)
    met = sum(int(((c := np.unique(codes[:, t], return_counts=True)[1]) * (c - 1) // 2).sum()) for t in range(tables))
    assert met < 0.1 * n * (n - 1) / 2 and share < 0.1
    assert D.hash_plan(10**6, 0.92)[2] < 0.01 and D.hash_plan(1_000, 1.0)[1] == 1


def test_neighbours_of_either_end(spark):
    rows = [(0, 1, 0.99), (0, 2, 0.98), (0, 3, 0.97), (3, 4, 0.5), (2, 4, 0.6)]
    got = {(r["index_a"], r["index_b"]) for r in D.neighbours(spark.createDataFrame(rows, "index_a long, index_b long, similarity double"), 1).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (2, 4)}


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    rng = random.Random(1)
    v = [[1 + rng.gauss(0, 0.01) for _ in range(4)] for _ in range(60)] + [[-1.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(v)), "pos long, embedding array<double>")
    got = [(r["index_a"], r["index_b"]) for r in D.pairs_lsh(df, 0.9).collect()]
    assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


def test_normalization(spark):
    one = lambda raw, schema, **k: N.normalize(spark.createDataFrame([(json.dumps(raw), 0)], "raw string, pos long"), schema, **k).first()
    r = one({"instruction": " do \n", "input": "x", "output": None}, "alpaca")
    assert (r["question"], r["answer"]) == ("do\n\nx", "None")
    assert one({"instruction": "a", "output": True}, "alpaca")["answer"] == "True"
    assert one({"prompt": "p", "completion": 3}, "prompt_completion")["answer"] == "3"
    r = one({"messages": [{"role": "user", "content": "1"}, {"role": "assistant", "content": "2"}, {"role": "user", "content": "3"}]}, "chat")
    assert (r["question"], r["answer"]) == ("3", "2")
    assert one({"question": "q"}, "qa")["error"]
    r = one({"a": " x ", "b": "", "c": "y"}, "llm_mapping", mapping={"question_fields": ["a", "b"], "answer_field": "c"})
    assert (r["question"], r["answer"]) == ("x", "y")
    rows = spark.createDataFrame([(json.dumps({"question": 1, "answer": 2}), 0), ("{}", 1)], "raw string, pos long")
    assert N.detect(rows) == {"schema": "qa", "confidence": "heuristic", "mapping": None, "sample_fields": ["answer", "question"]}
    assert N.detect(rows.limit(0))["schema"] is None


def test_replies(spark):
    good = '```json\n{"clarity": 8, "correctness": 7, "value": 9, "reason": "fine"}\n```'
    rows = spark.createDataFrame([(good,), ("[1]",), ("no json",), (None,), ('{"clarity": "x", "correctness": 1, "value": 1, "reason": "r"}',)], "reply string")
    got = [r["s"] for r in rows.select(R.parse_scores(F.col("reply")).alias("s")).collect()]
    assert got[0]["avg_score"] == 8 and not got[0]["keep_present"] and [g["curation_failed"] for g in got] == [False, True, True, True, True]
    calls = spark.createDataFrame([("1", "p"), ("2", "bad")], "_id string, prompt string")

    def responder(prompt, temperature):
        if prompt == "bad":
            raise RuntimeError("down")
        return "ok" if temperature > 0 else None

    out = {r["_id"]: r for r in R.called(calls, responder, key="_id").collect()}
    assert out["1"]["reply"] == "ok" and not out["2"]["success"] and "down" in out["2"]["error"]
    j = spark.createDataFrame([('{"winner": "B", "score_a": {"x": 1}, "score_b": {"x": 3}, "reason": "r"}',), ('{"winner": "C"}',)], "reply string").select(R.parse_judgement(F.col("reply")).alias("j")).collect()
    assert (j[0]["j"]["winner"], j[0]["j"]["score_b"]) == ("B", {"x": 3.0}) and j[1]["j"]["winner"] == "JUDGE_FAILED"
    a = spark.createDataFrame([('{"action": "STOP"}',), ("oops",)], "reply string").select(R.parse_action(F.col("reply")).alias("a")).collect()
    assert (a[0]["a"]["notify_user"], a[1]["a"]["action"], a[1]["a"]["notify_user"]) == (True, "CONTINUE", False)


def test_summary(spark):
    m = lambda v: {"x": v} if v is not None else None
    rows = spark.createDataFrame([(0, "Q1", m(6.0), m(8.0), "B"), (1, "Q2", m(9.0), m(5.0), "A"), (2, "Q3", None, None, "JUDGE_FAILED")], "pos long, question string, score_a map<string,double>, score_b map<string,double>, winner string")
    s = E.summary(rows).first()
    assert (s["total_examples"], s["judge_failures"], s["wins"], s["losses"], s["ties"], s["avg_quality_margin"], s["n_regressions"]) == (3, 1, 1, 1, 0, -1.0, 1)
    assert "worse by 1.00" in reports.evaluation_report(s.asDict())


LOSSES = [2.45, 2.21, 1.87, 1.72, 1.64, 1.59, 1.57, 1.56]


def test_curves(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(LOSSES, 1)], "run_id long, epoch int, loss double")
    d, n = K.difficulty(df).first(), K.noise_floor(df).first()
    assert (d["prog"], d["nonlin"], d["vol"], n["noise"]) == (pytest.approx(-0.11125), pytest.approx(0.0494017857), pytest.approx(0.1146066921), pytest.approx(0.1317922472))
    gaps = spark.createDataFrame([(1, 0, None), (1, 1, 1.0), (1, 2, None), (1, 5, None), (1, 7, 4.0), (1, 9, None)], "k int, i int, v double")
    assert [r["value_filled"] for r in K.interpolate(gaps, "k", "i", "v").orderBy("i").collect()] == [None, 1.0, 1.5, 3.0, 4.0, None]


def test_forecasts():
    f = K.forecast([2.0, 1.5], [1, 2])
    assert f["median"] == [1.5, 1.5] and f["upper_95"][0] == pytest.approx(1.5 + 1.645) and f["n_families"] == 0
    f = K.forecast([1.7920806408, 1.515819788, 1.400411606], [1, 2, 3])
    assert f["median"] == pytest.approx([1.34019, 1.30419, 1.28026], abs=1e-4)
    with pytest.raises(ValueError):
        K.forecast([1.0], [0])


def test_qlora(spark):
    rows = spark.createDataFrame([("Org/Model-1.5B-Instruct",), ("Org/Model-7B-Instruct",), ("unnamed",)], "model_name string")
    assert [(r["verdict"], r["use_qlora"]) for r in X.qlora_rule(rows).collect()] == [("lora", False), ("qlora", True), (None, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, k, v + 0.1 * r) for r in (1, 2) for k, v in enumerate(LOSSES, 1)]
    schema = "run_id long, seq int, val_loss double"
    for part in range(3):
        spark.createDataFrame([x for x in rows if x[1] % 3 == part and x[1] <= 0] or [x for x in rows if (x[1] - 1) // 3 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.stream_checks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(ST.merge_progress(f"file://{tmp_path}/out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["run_id"], r["epoch"]): r["val_loss"] for r in spark.read.parquet(f"file://{tmp_path}/out/log").collect()}
    batch = ST.batch_checks(spark.createDataFrame(rows, schema)).collect()
    assert got == {(r["run_id"], r["epoch"]): r["val_loss"] for r in batch} and {r["epoch"] for r in batch if r["action"]} == {3, 6}
    last = ST.latest(spark, f"file://{tmp_path}/out")
    assert sorted(map(str, last.select(*batch[0].__fields__).collect())) == sorted(map(str, batch))


def test_sources_and_sinks(spark, tmp_path):
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.jsonl", '{"a": 3}\nnot json\n')
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("__MACOSX/y.json", "[1]")
        z.writestr("one.json", '{"rows": [{"a": 1}, 5]}')
        z.writestr("two.csv", "a,b\n2,\n")
        z.write(inner, "inner.zip")
    got = readers.read_archives(spark, str(tmp_path / "data.zip")).orderBy("pos").collect()
    assert [json.loads(r["raw"]) for r in got] == [{"a": 1}, {"a": "2", "b": ""}, {"a": 3}]
    assert readers.parse_lenient('{"a": 1}') == [{"a": 1}] and readers.parse_strict("[]") == []
    with pytest.raises(ValueError):
        readers.parse_strict('{"a": 1}\noops')
    assert readers.read_log(spark, str(tmp_path / "none"), readers.TRACE).count() == 0
    out = sinks.export_run(spark, str(tmp_path / "run"), "src", {"t": 1}, {"e": 2}, {"seed": 7, "final_loss": 0.5})
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "run")).collect())) == out
    (tmp_path / "curves.json").write_text('{"r": [3.0, 2.0]}')
    assert [tuple(r) for r in readers.read_curves(spark, str(tmp_path / "curves.json")).collect()] == [("r", 1, 3.0), ("r", 2, 2.0)]


def test_entry_imports_without_the_training_data_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "flagship" in e.queries()


def test_padded_tokens(spark):
    """Cut, short, empty and null ids, and ids that are null, as by the definition; the ids are computed once a row."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def ids(v):
        seen.add(1)
        return v

    rows = spark.createDataFrame([([5, 6, 7, 8, 9],), ([5, None],), ([],), (None,)], "v array<int>").coalesce(1).withColumn("ids", ids("v"))
    got = [tuple(r) for r in rows.withColumns(N.pad_tokens(F.col("ids"), 4, 1)).select("input_ids", "attention_mask", "labels").collect()]
    assert got[:3] == [([5, 6, 7, 8], [1] * 4, [5, 6, 7, 8]), ([5, None, 1, 1], [1, 1, 0, 0], [5, None, -100, -100]), ([1] * 4, [0] * 4, [-100] * 4)] and set(got[3]) == {None}
    assert seen.value == 4


def test_code_points_are_taken_once(spark, tmp_path):
    """Heads of long texts, characters outside the basic plane and control characters; no expression of the plan names the text's points more than once."""
    from tidemill.plans import catalog

    texts = ["", "a\x00é𝄞z", "𝄞" * 600, "x" * 511 + "é" + "y" * 5000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = catalog.token_pad_mask(spark, str(tmp_path))
    got = {r["doc_id"]: tuple(r)[1:] for r in made.collect()}
    for k, t in enumerate(texts):
        if t is not None:
            assert got[k] == (sum(map(ord, t[:512])), min(len(t), 512), 512 - min(len(t), 512))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("substring(text") <= 3
