"""A corpus from raw documents to training sequences, stage by stage.

Each stage takes the documents its predecessor kept and returns a table; all but the last return the columns of
``documents``. ``run`` writes every stage's table as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, packing, secrets, simhash, toxicity
from strandloom.llm.common import drop_folder, ensure_checkpoint_dir, table


def _rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one column ``row`` beside columns of the stage's own, whatever names the documents' columns have."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, by a lexicon learned from the labels, is below the threshold.

    Null and empty texts have no hits and stay; repeated rows are judged alike; without rows or labels the seed words alone count.
    """
    lexicon = toxicity.learn_lexicon(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(_rows(docs, text=F.col("text")), lexicon, keep=["row"])
    return scored.filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of Jaccard similarity 0.8 or more, the first by id, then by a hash of the text.

    Found by SimHash blocks. Rows are known by id and text, so only rows equal in both, or linked, are merged; rows without an id are last.
    Texts without words are one group.
    """
    number = F.col("doc_id").try_cast("long")
    key = {"no_id": F.col("doc_id").isNull(), "no_number": number.isNull(), "number": F.coalesce(number, F.lit(0)), "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    keyed = _rows(docs, text=F.col("text"), **key)
    stay = simhash.representatives(keyed, list(key))
    return keyed.join(stay, list(key), "left_semi").dropDuplicates(list(key)).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Texts without words stay; rows of one id and text are judged alike."""
    found = decontaminate.find_overlaps(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = found.filter(F.size("items") > 0).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = _rows(docs, id=F.col("doc_id"), hash=decontaminate.text_hash("text"))
    return rows.join(bad, (rows["hash"] == bad["bad_hash"]) & rows["id"].eqNullSafe(bad["bad_id"]), "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars``, where there is such a column, counted anew if that changed the text. Null texts stay null."""
    masked = secrets.redact(secrets.scan(_rows(docs, text=F.col("text"))))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")))
    return masked.select(row.alias("row")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of every document, one end id for a null or empty text."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Lexicon fitting, fingerprints and tokens are beyond SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is removed when the next is written; the last one stays, for the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            drop_folder(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
