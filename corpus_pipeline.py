"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents: toxicity
drops the documents it rejects, line dedup drops frequent lines from texts (n_chars follows; a document that is left without text
stays), near-dedup keeps one document of each class, decontamination drops documents with a twentieth of their words in benchmark windows. The last
gives each document's SentencePiece ids, and digests of them and of the decoded text.

Defined results: a null text is kept as it is by the first two stages, and is a wordless one to near-dedup, where wordless texts are copies
only if they are equal (a null equals an empty text); a null doc_id is kept like any other; repeated rows are copies, of which near-dedup
keeps the first in the table; very long texts are taken whole; an empty table gives an empty result; extra columns stay until the last
stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskveil.llm import common as C
from duskveil.llm import dart_minhash, decontaminate, line_mphf, sentencepiece_backend, toxicity


def own(docs: DataFrame) -> list:
    """The columns of the input, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_documents(docs, C.table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.where(F.col(out.columns[-1]) < 0.5).select(own(docs))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_mphf.drop_lines(docs)
    return out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(own(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate.mark_hits(docs, C.table(spark, sf_dir, "benchmark"))
    n_words, n_hit, _ = out.columns[-3:]
    return out.where(~decontaminate.contaminated(n_words, n_hit)).select(own(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.encode_decode(docs, sentencepiece_backend.model_path(), keep_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_frequent_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = C.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
