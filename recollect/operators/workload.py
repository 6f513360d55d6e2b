"""Question workloads: reading, de-duplicating, paraphrasing, mixing and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from recollect.functions import text as T
from recollect.plans.spread import spread_join


def first_answer(df: DataFrame, column: str = "answers") -> Column:
    """First answer from a struct of arrays, an array of structs, an array of strings or a string."""
    kind = df.schema[column].dataType
    if isinstance(kind, StructType):
        return F.get(F.col(column)["text"], 0)
    if isinstance(kind, ArrayType):
        head = F.get(F.col(column), 0)
        return head["text"] if isinstance(kind.elementType, StructType) else head.cast("string")
    return F.col(column).cast("string")


def load_qa(df: DataFrame, question: str = "question", answers: str = "answers") -> DataFrame:
    """(id, question, answer) from nested rows; rows without a question or an answer are left out."""
    asked = T.collapse_edges(F.col(question))
    picked = df.select(*[c for c in df.columns if c not in (question, answers)],
                       asked.alias("question"), first_answer(df, answers).alias("answer"))
    good = picked.filter((F.length("question") > 0) & (F.length("answer") > 0))
    return good.withColumn("id", T.short_id(F.col("question")))


READERS = ("json", "parquet", "orc", "csv")


def load_qa_workload(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """Read question files of one of the known formats and reduce them to (id, question, answer)."""
    if fmt not in READERS:
        raise ValueError(f"format is one of {READERS}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return load_qa(reader.format(fmt).load(path))


def qa_workload(
    spark: SparkSession, path: str, fmt: str, first: Column, n: int, share: float = 0.3, seed: int = 42, schema: str | None = None
) -> DataFrame:
    """A workload from question files in one go: read, one row per question, a sample of ``n``, paraphrases of a share.

    Of rows with one question that with the lowest ``first`` stays.
    """
    rows = load_qa_workload(spark, path, fmt, schema).withColumn("seq", first)
    return build_workload(sample_queries(distinct_questions(rows), n, seed), share, seed)


def distinct_questions(questions: DataFrame) -> DataFrame:
    """The first row per question text; an aggregation, so copies combine before the shuffle."""
    rest = [c for c in questions.columns if c != "question"]
    first = questions.groupBy("question").agg(F.min_by(F.struct(*rest), "seq").alias("_r"))
    return first.select("question", "_r.*").select(*questions.columns)


def sample_queries(questions: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """A fixed sample of ``n`` rows, drawn by a seeded hash."""
    return questions.orderBy(T.seeded_hash(seed, F.col(key)), key).limit(n)


def shuffled(questions: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """Fixed mixed order as a sortable column; sorting is left to whoever needs the order."""
    return questions.withColumn("mix", T.seeded_hash(seed, F.col(key)))


def build_workload(questions: DataFrame, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Originals and the paraphrases of a share of them, with their mixed order.

    A question is paraphrased when its seeded hash falls below the share.
    """
    draw = T.seeded_hash(seed, F.col("id"))
    originals = questions.select(
        "id", "question", "answer", F.lit(False).alias("is_paraphrase"), F.lit("").alias("original_id")
    )
    chosen = questions.filter(draw < F.lit(int(share * 2**32)))
    reworded = chosen.withColumn("_q", T.paraphrase(F.col("question"), draw))
    copies = reworded.select(
        T.short_id(F.col("_q")).alias("id"), F.col("_q").alias("question"), "answer",
        F.lit(True).alias("is_paraphrase"), F.col("id").alias("original_id"),
    )
    return shuffled(originals.unionByName(copies), seed + 1)


def answer_key() -> Column:
    return F.when(F.col("is_paraphrase"), F.col("original_id")).otherwise(F.col("id"))


def unique_answers(workload: DataFrame) -> DataFrame:
    """One answer per answer key: that of the first row in mixed order."""
    return workload.groupBy(answer_key().alias("answer_key")).agg(
        F.min_by("answer", F.struct("mix", "id")).alias("answer"), F.count(F.lit(1)).alias("uses")
    )


def with_answers(workload: DataFrame, answers: DataFrame) -> DataFrame:
    """Workload rows with the shared answer of their key."""
    keyed = workload.withColumn("answer_key", answer_key())
    shared = answers.select("answer_key", F.col("answer").alias("shared_answer"))
    return spread_join(keyed, shared, ["answer_key"], "left", "id")


def workload_summary(workload: DataFrame) -> DataFrame:
    """Questions and paraphrases per dataset."""
    return workload.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("num_questions"), F.count_if("is_paraphrase").alias("num_paraphrases")
    )
