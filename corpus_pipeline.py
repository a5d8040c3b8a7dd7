"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents. Null and empty texts count as texts
without a letter, so the first stage drops them; an empty table passes all stages as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import langid, packing, pii, simhash, toxicity
from attestor.llm.queries import language_model, toxicity_model
from attestor.llm.shared import BROADCAST_ROWS, stage, unstage

#: A document is dropped as toxic from this score on.
TOXIC = 0.7


def _by_place(docs: DataFrame) -> DataFrame:
    """The columns under names that no model or join adds, whatever they are called."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def _name(docs: DataFrame, column: str) -> str:
    return f"c{docs.columns.index(column)}"


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are near enough to a language learned from the documents themselves."""
    return _kept(docs, langid.predict(_by_place(docs), language_model(docs), _name(docs, "text")).where("not rejected"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below ``TOXIC`` by a model of the labelled documents."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, toxicity.predict(_by_place(docs), model, _name(docs, "text")).where(F.col("score") < TOXIC))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: that of least id, nulls last, and then of least hash.

    Groups are of texts, so different texts stay whether their ids are null or repeated. Of rows that are equal in all columns one stays; columns with maps are
    compared as JSON.
    """
    rows, key = _by_place(docs), _name(docs, "doc_id")
    plain = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in rows.dtypes]
    mark = F.xxhash64(*plain, *map(F.isnull, rows.columns))
    leads = simhash.leads(rows, mark, key, _name(docs, "text")).toDF("lead", "mark", "rows")
    total, most = leads.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()

    def kept(lead: DataFrame) -> DataFrame:
        lead = F.broadcast(lead) if total <= BROADCAST_ROWS else lead
        return rows.join(lead, (mark == F.col("mark")) & F.col(key).eqNullSafe(F.col("lead")), "left_semi")

    once = kept(leads.where("rows = 1") if most > 1 else leads)
    if most > 1:
        alike = kept(leads.where("rows > 1")).withColumn("alike", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        once = once.unionByName(alike.dropDuplicates(["alike"]).drop("alike"))
    return _kept(docs, once)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, plain or disguised, by its kind."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut documents into pieces of at most 2048 tokens and pack them into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: SQL can express neither the learned stages nor the tokenizer; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES[:-1]):
        kept = stage(step(spark, docs, sf_dir))
        if i:
            unstage(docs)
        docs = kept
    packed = STAGES[-1][1](spark, docs, sf_dir)
    unstage(docs)  # packing has staged the pieces that it reads
    return packed
