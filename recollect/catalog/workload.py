"""Question workload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.catalog.text import sql_paraphrase
from recollect.operators import workload as W
from recollect.sources import reports

SQL_DISTINCT = f"""{I.SQL_QUESTIONS},
firsts AS (SELECT * FROM (SELECT * EXCLUDE (seq), CASE WHEN dataset = 'documents' THEN seq ELSE seq - 1000000 END AS seq FROM questions)
           QUALIFY row_number() OVER (PARTITION BY question ORDER BY seq) = 1)"""


def questions(spark, sf):
    q = I.questions(spark, sf)
    return q.withColumn("seq", F.when(F.col("dataset") == "documents", F.col("seq")).otherwise(F.col("seq") - 1_000_000))


@query("distinct_questions", f"WITH {SQL_DISTINCT} SELECT dataset, seq, id, question FROM firsts")
def distinct_questions(spark, sf):
    return W.distinct_questions(questions(spark, sf)).select("dataset", "seq", "id", "question")


@query(
    "sample_queries",
    f"WITH {SQL_DISTINCT} SELECT id, {I.sql_hash(42, 'id')} AS mix FROM firsts ORDER BY {I.sql_hash(42, 'id')}, id LIMIT 100",
)
def sample_queries(spark, sf):
    s = W.sample_queries(W.distinct_questions(questions(spark, sf)), 100, 42)
    return W.shuffled(s.select("id"), 42)


CUT = int(0.3 * 2**32)
SQL_WORKLOAD = f"""{SQL_DISTINCT},
reworded AS (SELECT *, {sql_paraphrase('question', I.sql_hash(42, 'id'))} AS q FROM firsts WHERE {I.sql_hash(42, 'id')} < {CUT}),
workload0 AS (
  SELECT id, question, answer, false AS is_paraphrase, '' AS original_id FROM firsts
  UNION ALL SELECT substr(md5(q), 1, 12), q, answer, true, id FROM reworded),
workload AS (SELECT *, {I.sql_hash(43, 'id')} AS mix FROM workload0)"""


def workload(spark, sf):
    return W.build_workload(W.distinct_questions(questions(spark, sf)), 0.3, 42)


@query("build_workload", f"WITH {SQL_WORKLOAD} SELECT * FROM workload")
def build_workload(spark, sf):
    return workload(spark, sf)


@query(
    "unique_answers",
    f"""WITH {SQL_WORKLOAD} SELECT answer_key, min_by(answer, (mix, id)) AS answer, count(*) AS uses
        FROM (SELECT *, CASE WHEN is_paraphrase THEN original_id ELSE id END AS answer_key FROM workload) GROUP BY answer_key""",
)
def unique_answers(spark, sf):
    return W.unique_answers(workload(spark, sf))


@query(
    "workload_summary",
    f"""WITH {SQL_WORKLOAD} SELECT d.dataset, count(*) AS num_questions, count(*) FILTER (is_paraphrase) AS num_paraphrases
        FROM workload w JOIN firsts d ON d.id = CASE WHEN w.is_paraphrase THEN w.original_id ELSE w.id END GROUP BY d.dataset""",
)
def workload_summary(spark, sf):
    names = W.distinct_questions(questions(spark, sf)).select(F.col("id").alias("answer_key"), "dataset")
    return W.workload_summary(workload(spark, sf).withColumn("answer_key", W.answer_key()).join(names, "answer_key"))


SQL_TURNS = f"""turns AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '^{I.SQL_SPACE}|{I.SQL_SPACE}$', '', 'g') AS question, b.text AS answer
          FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
          WHERE a.role = 'user' AND b.role = 'assistant')"""


@query(
    "load_qa_workload",
    f"""WITH {SQL_TURNS}
        SELECT conv_id, turn, substr(md5(question), 1, 12) AS id, question, answer FROM turns WHERE length(question) > 0 AND length(answer) > 0""",
)
def load_qa_workload(spark, sf):
    """Chat turns written as nested question files and read back through the reader."""
    return W.load_qa_workload(spark, *_question_files(spark, sf))


@query(
    "qa_workload",
    f"""WITH {SQL_TURNS},
        loaded AS (SELECT *, substr(md5(question), 1, 12) AS id FROM turns WHERE length(question) > 0 AND length(answer) > 0),
        firsts AS (SELECT * FROM loaded QUALIFY row_number() OVER (PARTITION BY question ORDER BY conv_id * 1000 + turn) = 1),
        drawn AS (SELECT * FROM firsts ORDER BY {I.sql_hash(42, 'id')}, id LIMIT 150),
        reworded AS (SELECT *, {sql_paraphrase('question', I.sql_hash(42, 'id'))} AS q FROM drawn WHERE {I.sql_hash(42, 'id')} < {CUT}),
        both_kinds AS (
          SELECT id, question, answer, false AS is_paraphrase, '' AS original_id FROM drawn
          UNION ALL SELECT substr(md5(q), 1, 12), q, answer, true, id FROM reworded)
        SELECT *, {I.sql_hash(43, 'id')} AS mix FROM both_kinds""",
)
def qa_workload(spark, sf):
    """Question files read, made distinct, sampled and paraphrased in one call."""
    path, fmt, schema = _question_files(spark, sf)
    return W.qa_workload(spark, path, fmt, F.col("conv_id") * 1000 + F.col("turn"), 150, 0.3, 42, schema)


def _question_files(spark, sf):
    """Path, format and schema of the chat turns as nested question files."""
    c = I.table(spark, sf, "conversations")
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    raw = c.filter("role = 'user'").join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("question"),
        F.struct(F.array("reply").alias("text"), F.array(F.lit(0)).alias("answer_start")).alias("answers"),
    )
    path = I.scratch(spark, "qa")
    raw.write.mode("overwrite").json(path)
    schema = "conv_id BIGINT, turn BIGINT, question STRING, answers STRUCT<text: ARRAY<STRING>, answer_start: ARRAY<INT>>"
    return path, "json", schema


def _runs(spark, sf):
    """Eight runs from the log, one scorecard per event type."""
    from recollect.operators import metrics as M

    log = I.query_log(spark, sf).withColumn("run_id", F.concat(F.lit("run-"), (F.col("tenant_id") % 8).cast("string")))
    rows = log.select("run_id", F.concat(F.lit("s"), (F.col("k") % 3).cast("string")).alias("strategy"), "hit", "tier",
                      (F.col("latency_ms") < 50).alias("correct"), "latency_ms", "tenant_id")
    scores = M.strategy_scorecard(rows, ["run_id", "strategy"])
    scores = scores.withColumn("total_time_s", F.lit(0.0))
    ints = ("total_queries", "total_hits", "total_misses", "llm_calls", "correct_hits", "incorrect_hits", "tier1_hits", "tier2_hits")
    scores = scores.select(*[F.col(c).cast("int").alias(c) if c in ints else F.col(c) for c in scores.columns])
    runs = log.groupBy("run_id").agg(
        F.max("seq").cast("double").alias("timestamp"),
        F.when(F.max(F.col("tenant_id") % 8) % 2 == 0, F.lit("squad")).alias("dataset"),
        F.count(F.lit(1)).cast("int").alias("num_questions"), F.count_if("admission_rejected").cast("int").alias("num_paraphrases"),
        F.lit(300).alias("cache_capacity"),
    )
    return reports.nest_strategies(runs, scores)


def _written(spark, sf):
    path = I.scratch(spark, "runs")
    reports.write_run_report(_runs(spark, sf), path)
    return reports.scan_run_reports(spark, path)


@query(
    "scan_run_reports",
    f"""WITH {I.SQL_LOG}, r AS (SELECT 'run-' || CAST(tenant_id % 8 AS VARCHAR) AS run_id, max(seq)::DOUBLE AS timestamp,
            CASE WHEN max(tenant_id % 8) % 2 = 0 THEN 'squad' ELSE 'nq' END AS dataset, CAST(count(*) AS INTEGER) AS num_questions,
            CAST(count(*) FILTER (admission_rejected) AS INTEGER) AS num_paraphrases, 300 AS cache_capacity,
            CAST(count(DISTINCT k % 3) AS INTEGER) AS num_strategies FROM query_log GROUP BY 1)
        SELECT * FROM r""",
)
def scan_run_reports(spark, sf):
    return reports.report_summaries(_written(spark, sf))


@query(
    "write_run_report",
    f"""WITH {I.SQL_LOG} SELECT 'run-' || CAST(tenant_id % 8 AS VARCHAR) AS run_id, 's' || CAST(k % 3 AS VARCHAR) AS strategy,
          CAST(count(*) AS INTEGER) AS total_queries, CAST(count(*) FILTER (hit) AS INTEGER) AS total_hits,
          CAST(count(*) FILTER (hit AND latency_ms < 50) AS INTEGER) AS correct_hits FROM query_log GROUP BY ALL""",
)
def write_run_report(spark, sf):
    rows = reports.strategy_rows(_written(spark, sf))
    return rows.select("run_id", "strategy", "total_queries", "total_hits", "correct_hits")


@query(
    "get_report",
    f"""WITH {I.SQL_LOG} SELECT 'run-' || CAST(tenant_id % 8 AS VARCHAR) AS run_id, CAST(count(*) AS INTEGER) AS num_questions
        FROM query_log WHERE tenant_id % 8 = 3 GROUP BY 1""",
)
def get_report(spark, sf):
    return reports.get_report(_written(spark, sf), "run-3").select("run_id", "num_questions")


def _sql_shape(answer: str) -> str:
    return f"""WITH turns AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '^{I.SQL_SPACE}|{I.SQL_SPACE}$', '', 'g') AS question, {answer} AS answer
          FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
          WHERE a.role = 'user' AND b.role = 'assistant')
        SELECT conv_id, turn, substr(md5(question), 1, 12) AS id, question, answer FROM turns WHERE length(question) > 0 AND length(answer) > 0"""


def _shaped(spark, sf, answers, kind: str):
    c = I.table(spark, sf, "conversations")
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    raw = c.filter("role = 'user'").join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"), answers.alias("answers"))
    path = I.scratch(spark, "qa")
    raw.write.mode("overwrite").json(path)
    return W.load_qa_workload(spark, path, "json", f"conv_id BIGINT, turn BIGINT, question STRING, answers {kind}")


@query("load_qa_struct_list", _sql_shape("b.text"))
def load_qa_struct_list(spark, sf):
    """Answers as an array of structs."""
    return _shaped(spark, sf, F.array(F.struct(F.col("reply").alias("text"))), "ARRAY<STRUCT<text: STRING>>")


@query("load_qa_text_list", _sql_shape("b.text"))
def load_qa_text_list(spark, sf):
    """Answers as a plain array."""
    return _shaped(spark, sf, F.array("reply", F.lit("other")), "ARRAY<STRING>")
