"""The jobs as registered queries: each runs its job twice into one new folder and returns what is stored after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import kmer_profiles, training_matrix
from strandloom import catalogue
from strandloom.plans.lineage import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_kmer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    for _ in range(2):
        kmer_profiles.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/mark")
    return kmer_profiles.sample_counts(spark, f"{folder}/out")


def job2_training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):
        training_matrix.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    return training_matrix.entries(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_kmer_profiles": job1_kmer_profiles, "job2_training_matrix": job2_training_matrix}


_JOB1 = f"""WITH {catalogue.windows_sql(catalogue.GATC_SQL, [6])}, c AS (SELECT doc_id, least(w, reverse(translate(w, 'atgc', 'tacg'))) AS kmer, count(*) AS n FROM w GROUP BY ALL)
    SELECT CAST(doc_id AS VARCHAR) AS sample_id, source, CAST({catalogue.CODE_SQL.format(s='kmer')} AS BIGINT) AS code, n FROM c JOIN documents USING (doc_id) WHERE regexp_matches(text, '\\S')"""

_JOB2 = f"""WITH u AS (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1) AND regexp_matches(text, '\\S')),
    f AS (SELECT doc_id, quality, (row_number() OVER (ORDER BY quality, md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM u),
    {catalogue.windows_sql(catalogue.LETTERS_SQL, [3, 4], "(SELECT * FROM documents JOIN u USING (doc_id))")},
    c AS (SELECT doc_id, w AS segment, count(*) AS n FROM w GROUP BY ALL),
    t AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM f WHERE fold <> 0),
    g AS (SELECT segment, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM c JOIN f USING (doc_id) WHERE fold <> 0 GROUP BY segment HAVING count(*) >= 2),
    s AS (SELECT segment, row_number() OVER (ORDER BY abs(p * n0 - q * n1) DESC, segment) - 1 AS seg_id FROM g, t ORDER BY seg_id LIMIT 200),
    e AS (SELECT doc_id, seg_id, segment, least(n, 65535) AS n FROM c JOIN s USING (segment))
    SELECT CAST(fold AS INTEGER) AS fold, doc_id AS sample_id, CAST(quality AS DOUBLE) AS label, seg_id, segment, n FROM f LEFT JOIN e USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"job1_kmer_profiles": _JOB1, "job2_training_matrix": _JOB2}
