"""The thin ``opN_<name>`` queries over a scale-factor folder, and their SQL.

Each query applies its operator with production parameters to the whole table
and returns the columns its contract names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.llm import (bpe, decontaminate, embedding_dedup, langid, licenses, minhash_dedup, packing, secret_scan, sharding,
                            suffix_dedup, token_alignment, toxicity, vector_codes)
from relaywatch.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOXIC_FROM = 0.3


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = toxicity.fit(docs.filter(~held), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.filter(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"), shards=16)


_COMPONENTS = """
reach(id, low) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id),
parts AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
"""

OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nodes AS (SELECT id FROM v),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_COMPONENTS}
SELECT id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = parts.id) AS BIGINT) AS n_links, component_id,
    id = component_id AS kept FROM parts
"""

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id AS id, [x for x in regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS s FROM d),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
nodes AS (SELECT id FROM d),
links AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.s = y.s AND x.id <> y.id JOIN n nx ON nx.id = x.id
    JOIN n ny ON ny.id = y.id GROUP BY x.id, y.id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
{_COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM parts LEFT JOIN n USING (id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_embedding_dedup, op2_secret_scan, op3_toxicity, op4_suffix_dedup, op5_decontaminate, op6_license_scan,
        op7_language_id, op8_minhash_dedup, op9_bpe, op10_packing, op11_vector_codes, op12_token_alignment, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op5_decontaminate": decontaminate.ORACLE_SQL, "op8_minhash_dedup": OP8_SQL,
            "op11_vector_codes": vector_codes.ORACLE_SQL}
