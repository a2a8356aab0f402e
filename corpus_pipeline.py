"""The corpus pipeline: five stages over ``documents``, each written and reread.

1. toxicity: documents that the recurrent network scores toxic go;
2. MinHash near-dedup (five words, similarity 0.8): one document of each group
   stays, the one of smallest id;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: the documents stay, secrets in their texts are masked and
   ``n_chars`` is counted anew;
5. BPE: every remaining text is encoded and decoded again.

The toxicity stage learns from ``labels`` as ``op3`` does. ``ORACLE_SQL`` is
None: SQL cannot express a trained network or a tokenizer.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.llm import bpe, catalog, decontaminate, minhash_dedup, secret_scan, toxicity
from relaywatch.llm.common import Scratch, table, unused


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = F.coalesce(catalog.fold("doc_id", 4) == 2, F.lit(False))
    model = toxicity.fit(docs.filter(~held), table(spark, sf_dir, "labels"))
    column = unused("score", docs.columns)
    scored = toxicity.score(docs, model, into=column)
    return scored.filter(F.col(column) < catalog.TOXIC_FROM).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", length).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(catalog.TOKENIZER)
    return bpe.digests(docs, path)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", tokenized),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and reread."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    with scratch.dropped_on_failure():
        for _, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
