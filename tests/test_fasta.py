"""FASTA files read in byte ranges against the plain parser."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.alphabet import Alphabet
from strandloom.functions.sequence import contigs
from strandloom.operators.counting import count_chunks, count_segments, kmer_histogram
from strandloom.sources import fasta


def plain(text):
    """Contigs of FASTA text, line by line."""
    out, lines = [], text.split("\n")
    if not any(x.startswith(">") for x in lines):
        return ["".join(lines)]
    for x in lines:
        if x.startswith(">"):
            out.append("")
        elif out:
            out[-1] += x
    return out


def random_fasta(seed, n, width=60):
    r = random.Random(seed)
    out = ["preamble"] if seed % 2 else []
    for i in range(n):
        seq = "".join(r.choice("acgtACGTnN") for _ in range(r.choice([0, 0, 1, 7, 59, 60, 61, 400, 3000])))
        out += [f">contig {i} > odd", *(seq[a : a + width] for a in range(0, len(seq), width))]
    return "\n".join(out) + ("\n" if seed % 3 else "")


FILES = {
    "empty.fna": "", "newline.fna": "\n", "one.fna": "acgt", "none.fna": "acg\n\ntta\n", "head.fna": ">only", "late.fna": "xx\nyy\n>a\nac\n>\n>b\ngt\n\nt", "cr.fna": ">a\r\nac\r\ngt\r\n", "é.fna": ">é\naé\ncg",
    **{f"r{i}.fna": random_fasta(i, 12) for i in range(6)}, "long.fna": ">one line\n" + "acgt" * 2_000 + "\n>two\n" + "\n".join(["gattacag" * 8] * 90),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fasta")
    for name, text in FILES.items():
        (d / name).write_bytes(text.encode())
    return str(d)


@pytest.fixture(params=["397", "4096"])
def small_blocks(spark, request):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if request.param == "4096" else "10000")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def named(rows):
    return sorted((r["item"].rsplit("/", 1)[1], r["contig_idx"], r["seq"]) for r in rows)


def test_contigs_equal_the_plain_parser(spark, folder, small_blocks):
    want = sorted((n, i, s) for n, t in FILES.items() if t for i, s in enumerate(plain(t)))
    if spark.conf.get("spark.sql.files.maxPartitionBytes") == "397":
        assert fasta._lines(spark, f"{folder}/r*.fna", None, False, None).rdd.getNumPartitions() > 50
    assert named(fasta.fasta_contigs(spark, folder).collect()) == want
    whole = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("item"), "value")
    assert named(contigs(whole, Alphabet(), id_column="item", text_column="value").withColumnRenamed("sample_id", "item").collect()) == named(fasta.fasta_contigs(spark, folder, Alphabet()).collect())


@pytest.mark.parametrize("chunk", [1, 13, fasta.CHUNK])
def test_chunks_hold_every_window_once(spark, folder, chunk):
    overlap = 4
    if chunk == 1:
        folder = f"{folder}/r1.fna"
    rows = fasta.fasta_chunks(spark, folder, Alphabet(), overlap, chunk=chunk).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["item"], r["contig_idx"], r["chunk_idx"])):
        seq = got.setdefault((r["item"], r["contig_idx"]), "")
        assert len(seq) == r["chunk_idx"] * chunk and len(r["seq"]) <= chunk + overlap and 0 < r["own"] <= chunk
        got[r["item"], r["contig_idx"]] = seq + r["seq"][: r["own"]]
    want = {(r["item"], r["contig_idx"]): r["seq"] for r in fasta.fasta_contigs(spark, folder, Alphabet()).collect()}
    assert got == {k: v for k, v in want.items() if v}
    for r in rows:
        begin = r["chunk_idx"] * chunk
        assert want[r["item"], r["contig_idx"]][begin : begin + chunk + overlap] == r["seq"]


@pytest.mark.parametrize("strategy", ["pattern", "join", "arrow"])
def test_counts_of_chunks_equal_counts_of_contigs(spark, folder, small_blocks, strategy):
    pool = spark.createDataFrame(list(enumerate(["a", "ac", "gat", "ttaca", "gattacag"[:6], "aaaa"])), "seg_id long, segment string")
    count = lambda f, rows: sorted(map(tuple, f(rows.withColumnRenamed("item", "sample_id"), pool, Alphabet(), strategy=strategy).collect()))
    got = count(count_chunks, fasta.fasta_chunks(spark, folder, Alphabet(), 5, chunk=50))
    assert got == count(count_segments, fasta.fasta_contigs(spark, folder, Alphabet())) and len(got) > 20


def test_histogram_of_chunks(spark, folder):
    hist = lambda rows: sorted(map(tuple, kmer_histogram(rows.withColumnRenamed("item", "sample_id"), Alphabet(), 6).collect()))
    assert hist(fasta.fasta_chunks(spark, folder, Alphabet(), 5, chunk=64)) == hist(fasta.fasta_contigs(spark, folder, Alphabet()))


def test_paths_are_listed_unopened(spark, folder):
    got = {r["item"].rsplit("/", 1)[1]: r["bytes"] for r in fasta.fasta_paths(spark, folder, "r*.fna").collect()}
    assert got == {n: len(t) for n, t in FILES.items() if n.startswith("r")}
