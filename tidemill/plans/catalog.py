"""The query catalogue and its SQL.

No model can be reached here, so scores and judgements are deterministic stand-ins
computed from the tables: a stub rubric on documents, a stub judge on lineitem,
loss curves on events (a run per user, an epoch per event). They are not part of
the operators that the queries exercise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import curves as K
from ..operators import dedup as D
from ..operators import evaluate as E
from ..operators import experiments as X
from ..operators import normalize as N
from ..operators import rubric as R
from ..operators import runs as U
from ..operators import split as S
from ..operators import texts as T
from ..runtime import shared_folder, ship
from ..sources import readers, sinks
from ..streaming import forecast as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- stand-ins

RUBRIC_SQL = """scored AS (SELECT doc_id AS pos, source, text AS question, lang AS answer, n_chars,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id % 11 AS DOUBLE) END AS clarity,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 7 + 3) % 11 AS DOUBLE) END AS correctness,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(n_chars % 11 AS DOUBLE) END AS value,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (CAST(doc_id % 11 AS DOUBLE) + CAST((doc_id * 7 + 3) % 11 AS DOUBLE) + CAST(n_chars % 11 AS DOUBLE)) / 3 END AS avg_score,
  doc_id % 2 = 0 AS keep, doc_id % 5 <> 0 AS keep_present, doc_id % 17 = 0 AS curation_failed FROM documents)"""
OTSU_SQL = """bins AS (SELECT b.bin, (b.bin * 0.2::DOUBLE + (b.bin + 1) * 0.2::DOUBLE) / 2 AS centre, coalesce(h.n, 0) AS n
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b LEFT JOIN (SELECT CASE
    WHEN avg_score < least(floor(avg_score * 5), 49) * 0.2::DOUBLE THEN least(floor(avg_score * 5), 49) - 1
    WHEN avg_score >= (least(floor(avg_score * 5), 49) + 1) * 0.2::DOUBLE AND floor(avg_score * 5) < 49 THEN least(floor(avg_score * 5), 49) + 1
    ELSE least(floor(avg_score * 5), 49) END AS bin, count(*) AS n
    FROM scored WHERE NOT curation_failed AND avg_score BETWEEN 0 AND 10 GROUP BY 1) h ON b.bin = h.bin),
  cum AS (SELECT bin, centre, CAST(sum(n) OVER u AS DOUBLE) AS w0, sum(n * centre) OVER u AS s0, CAST(sum(n) OVER () AS DOUBLE) AS w, sum(n * centre) OVER () AS s FROM bins
    WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
  cut AS (SELECT coalesce((SELECT centre FROM (SELECT bin, centre, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS v FROM cum WHERE w0 > 0 AND w0 < w) WHERE v > 0 ORDER BY v DESC, bin LIMIT 1), 0.1) AS threshold)"""
STATUS_SQL = "CASE WHEN curation_failed THEN 'failed' WHEN avg_score >= threshold THEN 'kept' ELSE 'rejected_quality' END"
CLASSIFIED_SQL = f"{RUBRIC_SQL}, {OTSU_SQL}, classified AS (SELECT scored.*, {STATUS_SQL} AS final_status FROM scored, cut)"
JUDGE_SQL = """judged AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
  (l_orderkey % 11 + l_partkey % 11 + l_suppkey % 11) / 3.0::DOUBLE AS a, ((l_orderkey + 5) % 11 + (l_partkey * 3) % 11 + (l_suppkey + 7) % 11) / 3.0::DOUBLE AS b,
  CASE WHEN l_orderkey % 19 = 0 THEN 'JUDGE_FAILED' WHEN (l_orderkey + 5) % 11 + (l_partkey * 3) % 11 + (l_suppkey + 7) % 11 > l_orderkey % 11 + l_partkey % 11 + l_suppkey % 11 THEN 'B'
       WHEN (l_orderkey + 5) % 11 + (l_partkey * 3) % 11 + (l_suppkey + 7) % 11 < l_orderkey % 11 + l_partkey % 11 + l_suppkey % 11 THEN 'A' ELSE 'tie' END AS winner FROM lineitem)"""
CURVES_SQL = "curves AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch, value AS loss FROM events)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    doc, failed = F.col("doc_id"), F.col("doc_id") % 17 == 0
    parts = {"clarity": doc % 11, "correctness": (doc * 7 + 3) % 11, "value": F.col("n_chars") % 11}
    rows = table(spark, d, "documents").select(doc.alias("pos"), "source", F.col("text").alias("question"), F.col("lang").alias("answer"), "n_chars", *[F.when(~failed, v.cast("double")).alias(k) for k, v in parts.items()], (doc % 2 == 0).alias("keep"), (doc % 5 != 0).alias("keep_present"), failed.alias("curation_failed"))
    return rows.withColumn("avg_score", (F.col("clarity") + F.col("correctness") + F.col("value")) / 3)


def classified(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return C.classify(rows, C.auto_threshold(rows))


def judged(spark: SparkSession, d: str) -> DataFrame:
    o, p, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    a, b = [o % 11, p % 11, s % 11], [(o + 5) % 11, (p * 3) % 11, (s + 7) % 11]
    as_map = lambda v: F.create_map(*[x for k, e in zip(R.RUBRIC, v) for x in (F.lit(k), e.cast("double"))])
    sa, sb = a[0] + a[1] + a[2], b[0] + b[1] + b[2]
    winner = F.when(o % 19 == 0, "JUDGE_FAILED").when(sb > sa, "B").when(sb < sa, "A").otherwise("tie")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", as_map(a).alias("score_a"), as_map(b).alias("score_b"), winner.alias("winner"))


def curves(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(w).alias("epoch"), F.col("value").alias("loss"))


def r6(c: str):
    return F.round(c, 6).alias(c)


# ---------------------------------------------------------------- normalization


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id")
def normalize_chat(spark, d):
    return N.chat_turns(table(spark, d, "conversations"))


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def messages_array_roles(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.size(F.filter("m", lambda x: x["role"] == "user")).cast("long").alias("n_user"), F.element_at("m", -1)["role"].alias("last_role"))


@query(f"""SELECT conv_id, md5(CASE WHEN arg_min(role, turn) = 'system' THEN '' ELSE '<|im_start|>system' || chr(10) || '{N.DEFAULT_SYSTEM}<|im_end|>' || chr(10) END
  || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS rendered_md5 FROM conversations GROUP BY conv_id""")
def chat_template_render(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", F.md5(N.chat_template(F.col("m")).cast("binary")).alias("rendered_md5"))


@query("SELECT CASE WHEN list_contains(k, 'question') AND list_contains(k, 'answer') THEN 'qa' ELSE 'none' END AS shape, list_aggregate(list_sort(k), 'string_agg', ',') AS fields, count(*) AS n FROM (SELECT json_keys(props) AS k FROM events) GROUP BY 1, 2")
def schema_detect_events_props(spark, d):
    rows = table(spark, d, "events").select(F.coalesce(N.shape(F.col("props")), F.lit("none")).alias("shape"), F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("fields"))
    return rows.groupBy("shape", "fields").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5('### Instruction:' || chr(10) || text || chr(10) || CASE WHEN trim(lang) <> '' THEN chr(10) || '### Input:' || chr(10) || lang ELSE '' END || chr(10) || '### Response:' || chr(10) || source) AS prompt_md5 FROM documents")
def alpaca_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(N.alpaca_prompt(F.col("text"), F.col("lang"), F.col("source")).cast("binary")).alias("prompt_md5"))


@query("""SELECT doc_id, list_sum(list_transform(range(1, 513), lambda i: coalesce(CASE WHEN i <= length(text) THEN unicode(text[i]) END, 0)))::BIGINT AS ids_sum, least(length(text), 512)::BIGINT AS n_mask, (512 - least(length(text), 512))::BIGINT AS n_ignored FROM documents""")
def token_pad_mask(spark, d):
    head = F.substring("text", 1, 512)
    codes = F.when(F.length(head) > 0, F.transform(F.split(head, F.lit("")), F.ascii)).otherwise(F.array().cast("array<int>"))  # a code point each
    rows = table(spark, d, "documents").select("doc_id", codes.alias("ids")).withColumns(N.pad_tokens(F.col("ids")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", total("input_ids").alias("ids_sum"), total("attention_mask").alias("n_mask"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("n_ignored"))


# ---------------------------------------------------------------- files and back


STRIPPED_SQL = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


def _stripped(column: str) -> str:
    return STRIPPED_SQL.format(column)


_SHAPED = {
    "qa": lambda q, a: F.struct(q.alias("question"), a.alias("answer")),
    "alpaca": lambda q, a: F.struct(q.alias("instruction"), F.concat(F.lit(" "), a, F.lit("\t")).alias("input"), a.alias("output")),
    "prompt_completion": lambda q, a: F.struct(q.alias("prompt"), a.alias("completion")),
    "instruction_response": lambda q, a: F.struct(q.alias("instruction"), a.alias("response")),
    "chat": lambda q, a: F.struct(F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content")), F.struct(F.lit("assistant").alias("role"), a.alias("content")), F.struct(F.lit("user").alias("role"), q.alias("content"))).alias("messages")),
    "llm_mapping": lambda q, a: F.struct(q.alias("q.text"), F.lit("0").alias("it's"), F.lit(0).alias("none"), a.alias("label")),
}


@query(f"""SELECT doc_id, shape, md5(CASE shape WHEN 'qa' THEN text WHEN 'chat' THEN text WHEN 'alpaca' THEN {_stripped('text')} || chr(10) || chr(10) || source WHEN 'llm_mapping' THEN CASE WHEN text = '' THEN '' ELSE {_stripped('text')} || chr(10) || chr(10) END || '0' ELSE {_stripped('text')} END) AS question_md5, source AS answer
  FROM documents, (SELECT unnest(['qa', 'alpaca', 'prompt_completion', 'instruction_response', 'chat', 'llm_mapping']) AS shape)""")
def normalize_shapes(spark, d):
    """Documents written as JSON lines and read back, as an example of each shape, normalized."""
    path = shared_folder(spark, "documents-json")
    sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "source"), path)
    docs = readers.read_jsonl(spark, path, "doc_id long, text string, source string")
    mapping = {"question_fields": ["q.text", "it's", "none"], "answer_field": "label"}
    out = None
    for shape, made in _SHAPED.items():
        rows = docs.select("doc_id", F.to_json(made(F.col("text"), F.col("source"))).alias("raw"))
        one = N.normalize(rows, shape, mapping).select("doc_id", F.lit(shape).alias("shape"), F.md5(F.col("question").cast("binary")).alias("question_md5"), "answer")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id::VARCHAR AS doc_id, lang, md5(text) AS text_md5, n_chars::VARCHAR AS n_chars FROM documents")
def csv_and_back(spark, d):
    path = shared_folder(spark, "documents-csv")
    sinks.write_csv(table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars"), path)
    back = readers.read_table(spark, path)
    return back.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "n_chars")


@query("SELECT doc_id, md5(text) AS text_md5, doc_id % 97 AS archive FROM documents")
def archives_and_back(spark, d):
    """Documents as JSON lines in ZIP archives that tasks write, read back entry by entry."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 97).alias("archive"), F.to_json(F.struct("doc_id", "text")).alias("raw"))
    path = shared_folder(spark, "archives")
    sinks.write_archives(docs, path, "archive", "raw")
    back = readers.read_archives(spark, f"{path}/*.zip")
    return back.select(F.get_json_object("raw", "$.doc_id").cast("long").alias("doc_id"), F.md5(F.get_json_object("raw", "$.text").cast("binary")).alias("text_md5"), F.regexp_extract("src_file", r"archive=(\d+)", 1).cast("long").alias("archive"))


@query(f"WITH {CLASSIFIED_SQL} SELECT pos::VARCHAR AS id, md5(question) AS question_md5, answer, round(avg_score, 6) AS avg_score, final_status AS automatic_status, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS user_decision FROM classified JOIN labels ON pos = doc_id")
def override_log_and_back(spark, d):
    o = table(spark, d, "labels").select(F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("decision"))
    path = shared_folder(spark, "override-log")
    sinks.append_log(sinks.override_log(classified(spark, d), o, "pos"), path)
    back = readers.read_log(spark, path, readers.OVERRIDES)
    return back.select("id", F.md5(F.col("question").cast("binary")).alias("question_md5"), "answer", F.round("haiku_score.avg_score", 6).alias("avg_score"), "automatic_status", "user_decision")


# ---------------------------------------------------------------- splits


@query("SELECT split, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < (SELECT round_even(count(*) * 15 / 100.0, 0) FROM documents) THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY split")
def head_split(spark, d):
    rows = S.head_split(S.with_position(table(spark, d, "documents").select("doc_id"), "doc_id"), 15)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) <= 40 THEN 'train' ELSE 'val' END AS split FROM (SELECT * FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 50)")
def hash_sample_split(spark, d):
    rows = S.hash_sample(table(spark, d, "documents").select("doc_id"), 50, "doc_id")
    w = Window.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")).cast("binary")), "doc_id")  # the 50 rows of the sample
    return rows.select("doc_id", F.when(F.row_number().over(w) <= 40, "train").otherwise("val").alias("split"))


@query("SELECT rank, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS rank, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos < (SELECT count(*) // 4 * 4 FROM documents) GROUP BY rank")
def shard_drop_last(spark, d):
    rows = S.shards(S.with_position(table(spark, d, "documents").select("doc_id"), "doc_id"), 4)
    return rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def _permuted_sql(table: str, key: str, n: str) -> str:
    """SQL for the permutation of positions 0..n-1 of a table (id, pos): a recursive walk through the network's rounds."""

    def mapped(rows: str) -> str:
        cell = f"SELECT id, x // b AS l, x % b AS r, a, b, n FROM ({rows})"
        for t in range(S.ROUNDS):
            l, r = ("(l + ('0x' || substr(md5({k} || r), 1, 15))::BIGINT % a) % a", "r") if t % 2 == 0 else ("l", "(r + ('0x' || substr(md5({k} || l), 1, 15))::BIGINT % b) % b")
            k = f"({key}) || ':{t}:'"
            cell = f"SELECT id, {l.format(k=k)} AS l, {r.format(k=k)} AS r, a, b, n FROM ({cell})"
        return f"SELECT id, l * b + r AS x, a, b, n FROM ({cell})"

    grid = f"SELECT id, pos AS x, a, (n + a - 1) // a AS b, n FROM {table}, (SELECT n, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM ({n}))"
    return f"walk AS ({mapped(grid)} UNION ALL {mapped('SELECT * FROM walk WHERE x >= n')})"


_EPOCHS = (0, 1, 2)
EPOCH_SQL = "WITH RECURSIVE d AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), " + ", ".join(
    _permuted_sql("d", f"'7:{e}'", "SELECT count(*) AS n FROM documents").replace("walk", f"walk_{e}") for e in _EPOCHS
)


@query(f"""{EPOCH_SQL}, o AS ({" UNION ALL ".join(f"SELECT {e} AS epoch, id, x, n FROM walk_{e} WHERE x < n" for e in _EPOCHS)})
  SELECT epoch, (x % 4)::INTEGER AS rank, count(*) AS n, max(x // 4 // 8)::BIGINT AS last_batch, sum(id)::BIGINT AS ids, sum(id * (x // 4 % 97))::BIGINT AS in_order FROM o WHERE x < n // 32 * 32 GROUP BY ALL""")
def epoch_sampler(spark, d):
    """Three shuffled epochs, dealt to 4 ranks in batches of 8."""
    rows = S.with_position(table(spark, d, "documents").select("doc_id"), "doc_id")
    n = rows.count()
    out = None
    for e in _EPOCHS:
        one = S.epoch_shards(rows, 4, e, seed=7, batch=8, n=n).withColumn("epoch", F.lit(e))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("epoch", "rank").agg(F.count(F.lit(1)).alias("n"), F.max("batch").alias("last_batch"), F.sum("doc_id").alias("ids"), F.sum(F.col("doc_id") * (F.col("step") % 97)).alias("in_order"))


# ---------------------------------------------------------------- scores and thresholds


@query(f"WITH {RUBRIC_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE curation_failed) AS failed, round(avg(avg_score), 6) AS mean_score FROM scored GROUP BY source")
def rubric_avg(spark, d):
    rows = scored(spark, d)
    reply = F.when(F.col("curation_failed"), "not json").otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct("clarity", "correctness", "value", "keep", F.lit("stub").alias("reason"))), F.lit("\n```")))
    parsed = rows.select("source", R.parse_scores(reply).alias("s")).select("source", "s.*")
    return parsed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("curation_failed").alias("failed"), F.round(F.avg("avg_score"), 6).alias("mean_score"))


@query(f"WITH {RUBRIC_SQL}, {OTSU_SQL} SELECT bin, n::BIGINT AS n FROM bins")
def score_histogram(spark, d):
    return C.histogram(scored(spark, d).where("not curation_failed"))


@query(f"WITH {RUBRIC_SQL}, {OTSU_SQL} SELECT round(threshold, 6) AS threshold FROM cut")
def otsu_threshold(spark, d):
    return C.auto_threshold(scored(spark, d)).select(r6("threshold"))


@query(f"WITH {RUBRIC_SQL} SELECT round(quantile_cont(avg_score, 0.4), 6) AS threshold FROM scored WHERE NOT curation_failed")
def percentile_threshold(spark, d):
    return C.auto_threshold(scored(spark, d), "percentile", 40).select(r6("threshold"))


@query(f"WITH {CLASSIFIED_SQL} SELECT pos, round(avg_score, 6) AS avg_score, final_status FROM classified")
def classify_normal(spark, d):
    return classified(spark, d).select("pos", r6("avg_score"), "final_status")


@query(f"WITH {RUBRIC_SQL} SELECT pos, CASE WHEN curation_failed THEN 'failed' WHEN avg_score >= 6.5 OR (avg_score >= 5.5 AND (NOT keep_present OR keep)) THEN 'kept' ELSE 'rejected_quality' END AS final_status FROM scored")
def classify_hyper(spark, d):
    return C.classify(scored(spark, d), 6.0, mode="hyper", width=1.0).select("pos", "final_status")


@query(f"""WITH {RUBRIC_SQL}, ends AS (SELECT min(avg_score) AS a, max(avg_score) AS b FROM scored WHERE NOT curation_failed), grid AS (SELECT CAST(range AS INTEGER) AS step, a + (b - a) * range / 5 AS threshold FROM range(6), ends)
  SELECT step, round(threshold, 6) AS threshold, (count(*) FILTER (WHERE avg_score >= threshold))::BIGINT AS kept, (count(*) FILTER (WHERE avg_score < threshold))::BIGINT AS rejected FROM scored, grid WHERE NOT curation_failed GROUP BY step, threshold""")
def threshold_sweep(spark, d):
    return C.threshold_sweep(scored(spark, d)).select("step", r6("threshold"), "kept", "rejected")


def _overridden(spark, d):
    o = table(spark, d, "labels").select(F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("decision"))
    return C.apply_overrides(classified(spark, d), o, "pos")


OVERRIDDEN_SQL = f"{CLASSIFIED_SQL}, overridden AS (SELECT c.*, CASE WHEN quality IS NULL THEN NULL ELSE c.final_status END AS automatic_status, CASE WHEN quality = 1 THEN 'manually_accepted' WHEN quality = 0 THEN 'manually_rejected' ELSE c.final_status END AS status FROM classified c LEFT JOIN labels l ON c.pos = l.doc_id)"


@query(f"WITH {OVERRIDDEN_SQL} SELECT status AS final_status, automatic_status, count(*) AS n FROM overridden GROUP BY ALL")
def manual_overrides(spark, d):
    return C.override_buckets(_overridden(spark, d))


@query(f"WITH {CLASSIFIED_SQL} SELECT final_status, count(*) AS n, round(avg(avg_score), 6) AS mean_score FROM classified GROUP BY final_status")
def status_counts(spark, d):
    return classified(spark, d).groupBy("final_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("avg_score"), 6).alias("mean_score"))


@query(f"WITH {CLASSIFIED_SQL} SELECT final_status, pos FROM classified QUALIFY row_number() OVER (PARTITION BY final_status ORDER BY pos) <= 5")
def section_samples(spark, d):
    return C.section_samples(classified(spark, d).select("final_status", "pos")).select("final_status", "pos")


@query(f"""WITH {CLASSIFIED_SQL}, c AS (SELECT source, (count(*) FILTER (WHERE final_status = 'kept'))::BIGINT AS kept, count(*) AS total FROM classified GROUP BY source)
  SELECT source, kept, total, concat_ws(',', CASE WHEN kept < 20 THEN 'few_examples' END, CASE WHEN kept / total < 0.3 THEN 'low_keep_rate' END) AS reasons, kept < 20 OR kept / total < 0.3 AS warning FROM c""")
def dataset_health(spark, d):
    return C.dataset_health(classified(spark, d), "source").select("source", "kept", "total", F.array_join("reasons", ",").alias("reasons"), "warning")


@query(f"WITH {OVERRIDDEN_SQL} SELECT pos AS id, md5(question) AS question_md5, answer, round(avg_score, 6) AS avg_score, coalesce(automatic_status, status) AS automatic_status, status AS final_status FROM overridden")
def decisions_export(spark, d):
    rows = sinks.decisions(_overridden(spark, d).withColumn("reason", F.lit("stub")), "pos")
    return rows.select("id", F.md5(F.col("question").cast("binary")).alias("question_md5"), "answer", r6("avg_score"), "automatic_status", "final_status")


# ---------------------------------------------------------------- near-duplicates of embeddings

COSINE_SQL = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS index_a, b.vec_id AS index_b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")


@query(f"WITH {COSINE_SQL} SELECT index_a, index_b, round(s, 6) AS similarity FROM p WHERE s >= 0.4")
def dup_pairs_exact(spark, d):
    return D.pairs_exact(_vectors(spark, d), 0.40).select("index_a", "index_b", r6("similarity"))


@query()
def dup_pairs_lsh(spark, d):
    return D.pairs_lsh(_vectors(spark, d), 0.40)


@query(f"WITH {COSINE_SQL} SELECT DISTINCT index_b AS pos FROM p WHERE s >= 0.4 AND (index_a + index_b) % 3 <> 0")
def dup_drop_set(spark, d):
    pairs = D.pairs_exact(_vectors(spark, d), 0.40)
    answers = pairs.select("index_a", "index_b", ((F.col("index_a") + F.col("index_b")) % 3 != 0).alias("confirmed_duplicate"))
    return D.drop_set(D.verified(pairs, answers))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS pos, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
  SELECT query, pos, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, pos) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""")
def knn_top5(spark, d):
    v = _vectors(spark, d)
    return D.nearest(v, v.where("pos % 50 = 0"), 5).select("query", "pos", r6("similarity"), "rank")


TEXT_PAIRS_SQL = r"""w AS (SELECT doc_id, lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents),
  f AS (SELECT doc_id, lang, t, count(*) AS c FROM w GROUP BY ALL), g AS (SELECT doc_id, lang, md5(string_agg(t || ' ' || c, chr(10) ORDER BY t)) AS same, sum(c * c) AS square FROM f GROUP BY ALL),
  r AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, same) AS first FROM g), v AS (SELECT f.*, square FROM f JOIN r ON f.doc_id = r.doc_id WHERE first = f.doc_id),
  p AS (SELECT a.doc_id AS index_a, b.doc_id AS index_b, sum(a.c * b.c) / sqrt(any_value(a.square)::DOUBLE * any_value(b.square)::DOUBLE) AS similarity FROM v a JOIN v b ON a.lang = b.lang AND a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
  pairs AS (SELECT first AS index_a, doc_id AS index_b, 1.0::DOUBLE AS similarity FROM r WHERE doc_id > first UNION ALL FROM p WHERE similarity >= 0.92)"""


def _text_pairs(spark, d):
    return T.text_pairs(table(spark, d, "documents").select("doc_id", "lang", "text"), 0.92, pos="doc_id", block="lang")


@query(f"WITH {TEXT_PAIRS_SQL} SELECT index_a, index_b, round(similarity, 6) AS similarity FROM pairs")
def dup_text_cosine(spark, d):
    """Near-duplicate texts within a language; the first of equal vectors stands for them."""
    return _text_pairs(spark, d).select("index_a", "index_b", r6("similarity"))


@query(f"WITH {TEXT_PAIRS_SQL} SELECT DISTINCT index_b AS pos FROM pairs")
def dup_drop_texts(spark, d):
    """Documents that go: those with a similar one before them. The first of equal vectors is the least, so that pairs of first ones and their copies say it of all."""
    return T.later_texts(table(spark, d, "documents").select("doc_id", "lang", "text"), 0.92, pos="doc_id", block="lang")


# ---------------------------------------------------------------- judged pairs


@query(f"""WITH {JUDGE_SQL} SELECT l_returnflag, count(*) AS total_examples, count(*) FILTER (WHERE winner = 'JUDGE_FAILED') AS judge_failures, count(*) FILTER (WHERE winner = 'B') AS wins, count(*) FILTER (WHERE winner = 'A') AS losses,
  count(*) FILTER (WHERE winner = 'tie') AS ties, round(avg(b - a) FILTER (WHERE winner <> 'JUDGE_FAILED'), 6) AS avg_quality_margin, count(*) FILTER (WHERE winner <> 'JUDGE_FAILED' AND b - a <= -1.5) AS n_regressions FROM judged GROUP BY l_returnflag""")
def judge_summary(spark, d):
    s = E.summary(judged(spark, d), "l_returnflag")
    return s.withColumn("avg_quality_margin", F.round("avg_quality_margin", 6))


@query(f"WITH {JUDGE_SQL} SELECT l_orderkey, l_linenumber, round(b - a, 6) AS margin FROM judged WHERE winner <> 'JUDGE_FAILED' AND b - a <= -1.5")
def judge_regressions(spark, d):
    return E.regressions(judged(spark, d)).select("l_orderkey", "l_linenumber", r6("margin"))


@query("SELECT doc_id AS pos, lang AS base_output, source AS ft_output FROM documents")
def judge_zip_join(spark, d):
    docs = table(spark, d, "documents")
    base = docs.select(F.col("doc_id").alias("pos"), F.lit("q").alias("question"), F.lit("r").alias("reference"), F.col("lang").alias("output"))
    return E.zip_outputs(base, docs.select(F.col("doc_id").alias("pos"), F.col("source").alias("output"))).select("pos", "base_output", "ft_output")


@query(f"""WITH {CURVES_SQL}, {JUDGE_SQL}, ends AS (SELECT run_id, count(*) AS n, arg_min(loss, epoch) AS f, arg_max(loss, epoch) AS l FROM curves GROUP BY run_id),
  m AS (SELECT l_orderkey % 97 AS run_id, avg(b - a) FILTER (WHERE winner <> 'JUDGE_FAILED') AS q FROM judged GROUP BY 1)
  SELECT e.run_id, CASE WHEN n >= 2 AND q IS NOT NULL THEN l < f END AS loss_improved, CASE WHEN n >= 2 AND q IS NOT NULL THEN q > 0 END AS quality_improved, CASE WHEN n >= 2 AND q IS NOT NULL THEN (l < f) = (q > 0) END AS signals_agree,
  CASE WHEN n < 2 THEN 'too few losses' WHEN q IS NULL THEN 'no margin' WHEN (l < f) = (q > 0) THEN CASE WHEN l < f THEN 'both improved' ELSE 'neither improved' END ELSE 'mismatch' END AS note FROM ends e LEFT JOIN m ON e.run_id = m.run_id""")
def loss_quality_crosscheck(spark, d):
    m = E.summary(judged(spark, d).withColumn("run_id", F.col("l_orderkey") % 97), "run_id").select("run_id", "avg_quality_margin")
    return E.cross_check(curves(spark, d), m)


# ---------------------------------------------------------------- curves


@query(f"WITH {CURVES_SQL} SELECT run_id, count(*) AS n, round(arg_min(loss, epoch), 6) AS first_loss, round(arg_max(loss, epoch), 6) AS last_loss, round(avg(d), 6) AS mean_step FROM (SELECT *, loss - lag(loss) OVER (PARTITION BY run_id ORDER BY epoch) AS d FROM curves) GROUP BY run_id")
def loss_curve_long(spark, d):
    w = Window.partitionBy("run_id").orderBy("epoch")
    rows = curves(spark, d).withColumn("d", F.col("loss") - F.lag("loss").over(w))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min_by("loss", "epoch"), 6).alias("first_loss"), F.round(F.max_by("loss", "epoch"), 6).alias("last_loss"), F.round(F.avg("d"), 6).alias("mean_step"))


@query("""SELECT user_id AS run_id, event_id // 500 AS step, round(arg_max(value, event_id) FILTER (WHERE event_type = 'click'), 6) AS loss, round(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase'), 6) AS val_loss FROM events GROUP BY 1, 2""")
def step_merge(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.expr("event_id div 500").alias("step"), "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("loss"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("val_loss"))
    return X.step_merge(e, ["run_id", "step"], "event_id", ["loss", "val_loss"]).select("run_id", "step", r6("loss"), r6("val_loss"))


@query(f"""WITH {CURVES_SQL}, t AS (SELECT run_id, epoch - 1 AS step, loss FROM curves), v AS (SELECT run_id, epoch // 4 - 1 AS i, loss AS val_loss FROM curves WHERE epoch % 4 = 0),
  n AS (SELECT run_id, max(step) AS n FROM t GROUP BY run_id), m AS (SELECT run_id, max(i) AS m FROM v GROUP BY run_id),
  p AS (SELECT v.run_id, round_even(i * greatest(n, 1) / greatest(m, 1), 0)::INTEGER AS step, arg_max(val_loss, i) AS val_loss FROM v JOIN n ON v.run_id = n.run_id JOIN m ON v.run_id = m.run_id GROUP BY ALL)
  SELECT coalesce(t.run_id, p.run_id) AS run_id, coalesce(t.step, p.step)::INTEGER AS step, round(loss, 6) AS loss, round(val_loss, 6) AS val_loss FROM t FULL JOIN p ON t.run_id = p.run_id AND t.step = p.step""")
def review_alignment(spark, d):
    """A validation loss for every fourth epoch, spread over the steps of its run."""
    c = curves(spark, d)
    train = c.select("run_id", (F.col("epoch") - 1).cast("int").alias("step"), "loss")
    val = c.where("epoch % 4 = 0").select("run_id", F.expr("epoch div 4 - 1").alias("i"), F.col("loss").alias("val_loss"))
    return X.spread_validation(train, val).select("run_id", "step", r6("loss"), r6("val_loss"))


@query(f"""WITH {CURVES_SQL}, g AS (SELECT run_id, epoch, CASE WHEN epoch % 3 = 1 THEN loss END AS v FROM curves),
  f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN epoch END IGNORE NULLS) OVER b AS x0, last_value(v IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN v IS NOT NULL THEN epoch END IGNORE NULLS) OVER a AS x1, first_value(v IGNORE NULLS) OVER a AS y1 FROM g
    WINDOW b AS (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT run_id, epoch, round(coalesce(v, y0 + (y1 - y0) * (epoch - x0) / (x1 - x0)), 6) AS filled FROM f""")
def interpolate_inside(spark, d):
    g = curves(spark, d).withColumn("v", F.when(F.col("epoch") % 3 == 1, F.col("loss")))
    return K.interpolate(g, "run_id", "epoch", "v").select("run_id", "epoch", F.round("value_filled", 6).alias("filled"))


@query(f"WITH {CURVES_SQL} SELECT run_id, epoch, round(avg(loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS rolling FROM curves")
def rolling_mean_8(spark, d):
    return X.rolling_mean(curves(spark, d), ["run_id"], ["epoch"], "loss").select("run_id", "epoch", r6("rolling"))


LOGS_SQL = "logs AS (SELECT user_id AS hw, event_type AS fw, event_id, value AS v FROM events), ranked AS (SELECT *, row_number() OVER (PARTITION BY hw, fw ORDER BY event_id) AS up, row_number() OVER (PARTITION BY hw, fw ORDER BY event_id DESC) AS down FROM logs)"


def _logs(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("hw"), F.col("event_type").alias("fw"), "event_id", F.col("value").alias("tokens_per_sec"), F.col("value").alias("peak_memory_mb"), F.col("value").alias("loss"))


@query(f"WITH {LOGS_SQL} SELECT hw, fw, round(avg(v) FILTER (WHERE up > 3), 6) AS mean_tok_s, round(max(v), 6) AS peak_mem_mb, round(avg(v) FILTER (WHERE down <= 10), 6) AS final_loss_smoothed, count(*) AS n_steps_logged FROM ranked GROUP BY hw, fw")
def benchmark_summary(spark, d):
    s = X.benchmark_summary(_logs(spark, d), ["hw", "fw"], ["event_id"])
    return s.select("hw", "fw", r6("mean_tok_s"), r6("peak_mem_mb"), r6("final_loss_smoothed"), "n_steps_logged")


@query(f"""WITH {CURVES_SQL}, e AS (SELECT run_id, count(*) AS n, arg_min(loss, epoch) AS y0, arg_max(loss, epoch) AS y1 FROM curves GROUP BY run_id),
  r AS (SELECT c.run_id, e.n, y0, y1, loss, epoch - 1 AS k, loss - lag(loss) OVER (PARTITION BY c.run_id ORDER BY epoch) AS dl FROM curves c JOIN e ON c.run_id = e.run_id)
  SELECT run_id, round(CASE WHEN n < 2 THEN 0 ELSE any_value((y1 - y0) / n) END, 6) AS prog, round(CASE WHEN n < 2 THEN 0 ELSE avg(pow(loss - (y0 + (y1 - y0) * k / greatest(n - 1, 1)), 2)) END, 6) AS nonlin, round(CASE WHEN n < 2 THEN 0 ELSE stddev_pop(dl) END, 6) AS vol FROM r GROUP BY run_id, n""")
def difficulty_proxy(spark, d):
    return K.difficulty(curves(spark, d)).select("run_id", r6("prog"), r6("nonlin"), r6("vol"))


@query(f"WITH {CURVES_SQL}, l AS (SELECT run_id, count(*) AS n, regr_slope(loss, epoch) AS s, regr_intercept(loss, epoch) AS i FROM curves GROUP BY run_id) SELECT c.run_id, round(CASE WHEN any_value(n) < 3 THEN 0 ELSE stddev_pop(loss - (i + s * epoch)) END, 6) AS noise FROM curves c JOIN l ON c.run_id = l.run_id GROUP BY c.run_id")
def noise_floor(spark, d):
    return K.noise_floor(curves(spark, d)).select("run_id", r6("noise"))


TERCILES_SQL = """h AS (SELECT * FROM curves WHERE epoch <= 3), e AS (SELECT run_id, count(*) AS n, arg_min(loss, epoch) AS y0, arg_max(loss, epoch) AS y1 FROM h GROUP BY run_id),
  r AS (SELECT h.run_id, e.n, loss, y0, y1, epoch - 1 AS k, loss - lag(loss) OVER (PARTITION BY h.run_id ORDER BY epoch) AS dl FROM h JOIN e ON h.run_id = e.run_id),
  s AS (SELECT run_id, round(CASE WHEN n < 2 THEN 0 ELSE avg(pow(loss - (y0 + (y1 - y0) * k / greatest(n - 1, 1)), 2)) + stddev_pop(dl) END, 6) AS score FROM r GROUP BY run_id, n)"""
TERCILES_OF_SQL = "SELECT run_id, score, CASE ntile(3) OVER (ORDER BY score, run_id) WHEN 1 THEN 'Easy' WHEN 2 THEN 'Medium' ELSE 'Hard' END AS difficulty FROM s"


@query(f"WITH {CURVES_SQL}, {TERCILES_SQL} {TERCILES_OF_SQL}")
def difficulty_terciles(spark, d):
    s = K.difficulty(curves(spark, d).where("epoch <= 3")).select("run_id", F.round(F.col("nonlin") + F.col("vol"), 6).alias("score"))
    return K.terciles(s, "score", "run_id")


@query(f"WITH {CURVES_SQL}, n AS (SELECT run_id, max(epoch) AS n FROM curves GROUP BY run_id), g AS (SELECT run_id, b AS budget, least(b, n) AS epoch FROM n, (SELECT unnest([3, 4, 5, 6, 7]) AS b)) SELECT CAST(budget AS INTEGER) AS budget, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS std FROM g JOIN curves c ON c.run_id = g.run_id AND c.epoch = g.epoch GROUP BY budget")
def fixed_budget_baseline(spark, d):
    return X.fixed_budget(curves(spark, d), [3, 4, 5, 6, 7]).select("budget", r6("mean"), r6("std"))


BACKTEST_SQL = f"""{CURVES_SQL}, seen AS (SELECT run_id, epoch, loss, count(*) OVER w AS n, sum(epoch) OVER w AS sx, sum(loss) OVER w AS sy, sum(epoch * epoch) OVER w AS sxx, sum(epoch * loss) OVER w AS sxy FROM curves WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
  grid AS (SELECT c AS cutoff, h AS horizon FROM (SELECT unnest([3, 4, 5, 6, 7]) AS c), (SELECT unnest([1, 2, 3]) AS h)),
  pred AS (SELECT run_id, cutoff, horizon, loss AS lv, coalesce(sy / n + (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) * (cutoff + horizon - sx / n), loss) AS lin FROM seen JOIN grid ON epoch = cutoff),
  arms AS (SELECT run_id, cutoff, horizon, 'last_value' AS arm, lv AS pred FROM pred UNION ALL SELECT run_id, cutoff, horizon, 'linear', lin FROM pred),
  rows AS (SELECT a.run_id, CAST(cutoff AS INTEGER) AS cutoff, CAST(horizon AS INTEGER) AS horizon, arm, c.loss AS actual, pred, 100 * abs(c.loss - pred) / greatest(abs(c.loss), 1e-8) AS mape FROM arms a JOIN curves c ON a.run_id = c.run_id AND c.epoch = cutoff + horizon)"""


def _backtest(spark, d):
    return X.backtest(curves(spark, d), [3, 4, 5, 6, 7], [1, 2, 3])


@query(f"WITH {BACKTEST_SQL} SELECT run_id, cutoff, horizon, arm, round(actual, 6) AS actual, round(pred, 6) AS pred FROM rows")
def backtest_grid_mape(spark, d):
    return _backtest(spark, d).select("run_id", "cutoff", "horizon", "arm", r6("actual"), r6("pred"))


@query(f"WITH {BACKTEST_SQL} SELECT arm, round(avg(mape), 4) AS mean, round(stddev_samp(mape), 4) AS std, count(*) AS n FROM rows GROUP BY arm")
def mape_by_arm(spark, d):
    return X.error_stats(_backtest(spark, d), "arm").select("arm", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query(f"WITH {BACKTEST_SQL} SELECT cutoff, arm, round(avg(mape), 4) AS mean, round(stddev_samp(mape), 4) AS std, count(*) AS n FROM rows GROUP BY cutoff, arm")
def mape_by_cutoff_arm(spark, d):
    return X.error_stats(_backtest(spark, d), "cutoff", "arm").select("cutoff", "arm", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query(f"WITH {BACKTEST_SQL}, p AS (SELECT run_id, cutoff, horizon, avg(mape) FILTER (WHERE arm = 'last_value') AS a, avg(mape) FILTER (WHERE arm = 'linear') AS b FROM rows GROUP BY ALL) SELECT count(*) FILTER (WHERE a < b) AS a_wins, count(*) FILTER (WHERE b < a) AS b_wins, count(*) FILTER (WHERE a = b) AS ties FROM p")
def head_to_head_pivot(spark, d):
    return X.head_to_head(_backtest(spark, d), "last_value", "linear")


@query(f"""WITH {BACKTEST_SQL}, x AS (SELECT DISTINCT run_id FROM (SELECT run_id FROM rows WHERE arm = 'last_value' ORDER BY round(mape, 9) DESC, run_id, cutoff, horizon LIMIT 15)), y AS (SELECT DISTINCT run_id FROM (SELECT run_id FROM rows WHERE arm = 'linear' ORDER BY round(mape, 9) DESC, run_id, cutoff, horizon LIMIT 15))
  SELECT run_id, 'both' AS found FROM x WHERE run_id IN (FROM y) UNION ALL SELECT run_id, 'last_value' FROM x WHERE run_id NOT IN (FROM y) UNION ALL SELECT run_id, 'linear' FROM y WHERE run_id NOT IN (FROM x)""")
def worst15_sets(spark, d):
    return X.worst_sets(_backtest(spark, d), "last_value", "linear")


@query()
def forecast_arm_a(spark, d):
    return K.forecast_runs(curves(spark, d))


@query()
def forecast_checks_batch(spark, d):
    return ST.batch_checks(curves(spark, d).select("run_id", F.col("epoch").alias("seq"), F.col("loss").alias("val_loss")))


@query()
def forecast_checks_stream(spark, d):
    """The checks of forecast_checks_batch, from a stream of the same losses in four batches."""
    losses = curves(spark, d).select("run_id", F.col("epoch").alias("seq"), F.col("loss").alias("val_loss"))
    return ST.replayed_stream(losses, shared_folder(spark, "forecast-stream"))


# ---------------------------------------------------------------- run metrics and selections


@query(f"WITH {LOGS_SQL} SELECT hw, fw, round(avg(v) FILTER (WHERE down <= 10), 6) AS final_loss_smoothed FROM ranked GROUP BY hw, fw")
def last10_mean(spark, d):
    return X.benchmark_summary(_logs(spark, d), ["hw", "fw"], ["event_id"]).select("hw", "fw", r6("final_loss_smoothed"))


@query(f"WITH {LOGS_SQL} SELECT hw, fw, round(avg(v) FILTER (WHERE up > 3), 6) AS mean_tok_s FROM ranked GROUP BY hw, fw")
def skip3_throughput(spark, d):
    return X.benchmark_summary(_logs(spark, d), ["hw", "fw"], ["event_id"]).select("hw", "fw", r6("mean_tok_s"))


@query(f"WITH {RUBRIC_SQL}, s AS (SELECT source, list_sort(list(avg_score)) AS x FROM scored WHERE avg_score IS NOT NULL GROUP BY source) SELECT source, round(x[1], 6) AS least, round(x[len(x)], 6) AS most, round(x[len(x) // 2 + 1], 6) AS upper_median FROM s")
def score_spread(spark, d):
    return U.score_spread(scored(spark, d), "source").select("source", r6("least"), r6("most"), r6("upper_median"))


@query("SELECT count(l_extendedprice) AS n, round(min(l_extendedprice), 6) AS least, round(max(l_extendedprice), 6) AS most, round(quantile_disc(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def price_order_statistic(spark, d):
    """The element at place ceil(0.99 n) - 1 of all prices, selected in passes over one group."""
    rows = table(spark, d, "lineitem").select("l_extendedprice")
    out = U.order_statistic(rows, value="l_extendedprice", place=lambda n: F.ceil(n * F.lit("0.99").cast("decimal(3,2)")) - 1)
    return out.select("n", r6("least"), r6("most"), F.round("chosen", 6).alias("p99"))


@query("SELECT event_type AS model, round(avg(value), 6) AS avg_latency, count(value) AS n FROM events GROUP BY event_type")
def latency_by_model(spark, d):
    return U.latency_by_model(table(spark, d, "events"), "event_type", "value").select(F.col("event_type").alias("model"), r6("avg_latency"), "n")


@query(f"WITH {CURVES_SQL} SELECT run_id, round(avg(512 / (abs(loss) + 1)), 6) AS mean_tok_s, count(*) AS n FROM curves WHERE epoch > 2 GROUP BY run_id")
def step_throughput(spark, d):
    steps = curves(spark, d).select("run_id", F.col("epoch").alias("step"), F.lit(512).alias("tokens"), (F.abs("loss") + 1).alias("step_time"))
    return U.step_throughput(steps, "run_id", warm_up=2).select("run_id", r6("mean_tok_s"), "n")


@query(f"WITH {CURVES_SQL} SELECT run_id, arg_min(epoch, struct_pack(l := loss, e := epoch)) AS step, round(min(loss), 6) AS eval_loss FROM curves GROUP BY run_id")
def best_checkpoint(spark, d):
    rows = curves(spark, d).select("run_id", F.col("epoch").alias("step"), F.col("loss").alias("eval_loss"))
    return U.best_checkpoint(rows, "run_id").select("run_id", "step", r6("eval_loss"))


@query("SELECT part_key AS part, round(avg(q) FILTER (WHERE f = 'A') / avg(q) FILTER (WHERE f = 'R'), 6) AS ratio FROM (SELECT l_partkey % 10 AS part_key, l_returnflag AS f, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) GROUP BY 1")
def group_ratios(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 10).alias("part"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("double").alias("q"))
    return U.ratios(rows, "part", "f", "q", "A", "R").select("part", r6("ratio"))


@query(f"WITH {BACKTEST_SQL} SELECT run_id, cutoff, round(avg(mape) FILTER (WHERE arm = 'last_value'), 4) AS last_value, round(avg(mape) FILTER (WHERE arm = 'linear'), 4) AS linear FROM rows GROUP BY run_id, cutoff")
def errors_by_arm(spark, d):
    out = U.errors_by_arm(_backtest(spark, d), ["last_value", "linear"])
    return out.select("run_id", "cutoff", F.round("last_value", 4).alias("last_value"), F.round("linear", 4).alias("linear"))


@query(f"WITH {BACKTEST_SQL}, {TERCILES_SQL}, labels AS ({TERCILES_OF_SQL}) SELECT difficulty, round(avg(mape), 4) AS mean, count(*) AS n FROM rows JOIN labels ON rows.run_id = labels.run_id GROUP BY difficulty")
def mape_by_difficulty(spark, d):
    rows = U.with_difficulty(_backtest(spark, d), difficulty_terciles(spark, d).select("run_id", "difficulty"))
    return X.error_stats(rows, "difficulty").select("difficulty", F.round("mean", 4).alias("mean"), "n")


@query("SELECT doc_id AS pos, substr(text, 1, 200) AS question, substr(lang, 1, 200) AS answer FROM documents")
def preview(spark, d):
    return U.preview(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("question"), F.col("lang").alias("answer")))


@query("SELECT doc_id AS pos, source FROM documents WHERE doc_id % 3 = 0")
def keep_positions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "source")
    return U.keep_positions(docs, docs.where("pos % 3 = 0").select("pos"))


@query("SELECT doc_id AS pos FROM documents ORDER BY md5(doc_id || ':42:7'), doc_id LIMIT 64")
def batch_of_step(spark, d):
    return U.batch_of_step(table(spark, d, "documents").select(F.col("doc_id").alias("pos")), 7, 64)


@query(f"WITH {CURVES_SQL} SELECT run_id, count(*) AS n FROM curves GROUP BY run_id HAVING count(*) >= 5")
def long_curves(spark, d):
    return U.long_curves(curves(spark, d)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLASSIFIED_SQL}, c AS (SELECT source AS dataset, (count(*) FILTER (WHERE final_status = 'kept'))::BIGINT AS kept, count(*) AS total FROM classified GROUP BY source),
  w AS (SELECT *, concat_ws('; ', CASE WHEN kept < 20 THEN 'Only ' || kept || ' examples were kept (20 or more are recommended).' END, CASE WHEN kept / total < 0.3 THEN 'Only ' || kept || ' of ' || total || ' raw examples (' || round_even(100 * kept / total, 0)::INTEGER || '%) were kept.' END) AS m FROM c)
  SELECT dataset, m <> '' AS warning, m <> '' AND kept % 3 <> 1 AS warn_user, CASE WHEN m = '' OR kept % 3 = 1 THEN '' ELSE m END AS message FROM w""")
def dataset_warnings(spark, d):
    """Replies are stand-ins: of three, one is no JSON, one says no, and one leaves the message out."""
    health = C.dataset_health(classified(spark, d), F.col("source").alias("dataset"))
    reply = F.when(F.col("kept") % 3 == 0, "not json").when(F.col("kept") % 3 == 1, '{"warn_user": false, "message": ""}').otherwise('```json\n{"warn_user": true}\n```')
    return U.decide_warnings(U.warning_reasons(health), lambda rows: rows.withColumn("reply", reply)).select("dataset", "warning", "warn_user", "message")


@query()
def backtest_fits(spark, d):
    return K.backtest_fits(curves(spark, d), [3, 4, 5, 6, 7], [1, 2, 3])


# ---------------------------------------------------------------- cost rule


@query("""SELECT p_partkey, round(b, 3) AS params_b, CASE WHEN b * 2 * 1.3::DOUBLE <= 1 * 16.0::DOUBLE * 0.8::DOUBLE THEN 'lora' WHEN b * 0.5::DOUBLE * 1.3::DOUBLE <= 1 * 16.0::DOUBLE * 0.8::DOUBLE THEN 'qlora' ELSE 'qlora_may_not_fit' END AS verdict
  FROM (SELECT p_partkey, CAST(regexp_extract('model-' || p_size || '.5B-chat', '(\\d+(?:\\.\\d+)?)\\s*[bB](?:illion)?', 1) AS DOUBLE) AS b FROM part)""")
def qlora_rule(spark, d):
    models = table(spark, d, "part").select("p_partkey", F.concat(F.lit("model-"), F.col("p_size").cast("string"), F.lit(".5B-chat")).alias("model_name"))
    return X.qlora_rule(models).select("p_partkey", F.round("params_b", 3).alias("params_b"), "verdict")


FLAGSHIP_SQL = f"""WITH s AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS q, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS a FROM conversations GROUP BY conv_id),
  scored AS (SELECT (length(q) % 11 + length(a) % 11 + conv_id % 11) / 3.0::DOUBLE AS avg_score, conv_id % 17 = 0 AS curation_failed FROM s), {OTSU_SQL}
  SELECT {STATUS_SQL} AS final_status, count(*) AS n, round(avg(avg_score), 6) AS mean_score FROM scored, cut GROUP BY 1"""


@query(FLAGSHIP_SQL)
def flagship(spark, d):
    """Chat normalization, stub score, automatic threshold, classification, counts."""
    rows = N.chat_turns(table(spark, d, "conversations"))
    s = rows.select(((F.length("question") % 11 + F.length("answer") % 11 + F.col("conv_id") % 11) / 3).alias("avg_score"), (F.col("conv_id") % 17 == 0).alias("curation_failed"))
    return C.classify(s, C.auto_threshold(s)).groupBy("final_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("avg_score"), 6).alias("mean_score"))
