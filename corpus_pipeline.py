"""Training-corpus pipeline over the documents table.

``STAGES`` lists (name, function); each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of
documents:

1. toxicity: documents scored as toxic go.
2. near-duplicates: of each SimHash component (3-word shingles, at most 2
   differing bits) the document with the smallest id stays.
3. secrets: every secret found is replaced by a mask; the documents stay.
4. mixing: every document is repeated as often as the mix takes it (0-3).
5. encoding: BPE ids of every text and the text decoded from them, as
   counts and digests.

An empty documents table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, read_table
from tidemark.llm.covering_lsh import keep_one_per_component
from tidemark.llm.mixing import apply_mix
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.secret_ledger import redact, secret_findings
from tidemark.llm.spec_bpe import bpe_round_trip
from tidemark.llm.toxic_segments import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_component(docs, shingle=3, radius=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _ = secret_findings(docs)
    out = redact(docs, found)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs, weights=(5, 2, 1), max_repeats=3)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("mixing", mixing), ("encoding", encoding)]

#: The toxicity model has no SQL form; tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
