"""From raw documents to token files: quality, near duplicates, benchmark passages, source weights, encoding.

Every stage takes the documents its predecessor kept and returns documents with the same columns; the last
returns one row per written document.  Stages name the rows that go by id and text, so texts are only compared
with a list of those; rows without an id are judged by quality and benchmark passages and stay otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.copies import near_copies
from recollect.llm.mixing import mixed_documents
from recollect.llm.phrases import decontaminate
from recollect.llm.quality import quality
from recollect.llm.simhash import near_duplicates
from recollect.llm.tables import if_small, narrow, table
from recollect.llm.tokenfiles import read_tokens, with_checksum, write_tokens
from recollect.plans.materialize import new_path, stored

#: Rows of a list of rows to drop that may be broadcast.
SMALL = 1_000_000

#: Near copies: sets of distinct five-word shingles with a Jaccard similarity of at least this.
NEAR = 0.8


def _name(doc_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text) is not among ``gone`` (doc_id, tie)."""
    named = stored(gone.select(_name(F.col("doc_id")).alias("name"), "tie").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), _name(docs["doc_id"]).alias("name"), F.xxhash64(docs["text"]).alias("tie"))
    return rows.join(if_small(named, SMALL), ["name", "tie"], "left_anti").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.filter(~F.col("keep")).select("doc_id", "tie"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of rows sharing an id, one row.

    Fingerprints group the documents (``op10_simhash``), the similarity of the sets follows: it verifies those groups,
    and finds the copies at the floor whose fingerprints differ in more bits.
    """
    prints = near_duplicates(docs).filter("component_id < doc_id").select("doc_id", F.col("component_id").alias("other"))
    found = stored(near_copies(docs, NEAR, proposed=stored(prints.distinct(), "fingerprinted")), "near-copies").filter("doc_id is not null")
    copies = stored(found.filter("component_id < doc_id").select("doc_id").distinct(), "copies")
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"))
    kept = rows.join(if_small(copies, SMALL), "doc_id", "left_anti").select("doc_id", "row")
    repeated = stored(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept.select("row.*")
    repeated = if_small(repeated, SMALL)
    single = kept.join(repeated, "doc_id", "left_anti").select("row.*")
    several = kept.join(repeated, "doc_id").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return single.unionByName(several.select("row.*"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    named = narrow(docs, doc_id=F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("tie")), text="text")
    found = decontaminate(named, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("n_hit > 0").select("doc_id.doc_id", "doc_id.tie"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights, none repeated more than 1.25 times."""
    return mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(spark, "pipeline-tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return with_checksum(read_tokens(spark, path))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: The trained classifier, the fingerprints' components and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
