"""The queries registered for the library's own operators, and their SQL counterparts.

Every query runs over its whole tables. Long texts are cut into blocks of 256 characters in SQL too, as windows of a
long string cost more the further on they begin.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import scalars, sequence
from strandloom.functions.alphabet import Alphabet
from strandloom.operators import counting, metrics, pool, selection, splits
from strandloom.plans.lineage import number_rows, shared_folder, spread
from strandloom.plans.model import SegmentModel
from strandloom.plans.training import BaselinePipeline, TrainingPipeline
from strandloom.sources import fasta
from strandloom.sources.labels import invalid_labels, join_labels, without_labels
from strandloom.sources.readers import build_source, segment_list, text_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DNA = Alphabet()
LETTERS = Alphabet("abcdefghijklmnopqrstuvwxyz ")
#: The pools that documents are searched for.
WORDS = ("the", "and", "tion", "ing", "der", "que", "th", "zebra")
DNA_POOL = ("a", "aac", "acg", "gat", "atat", "ttt", "cagtt", "aagct")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _nodes(spark: SparkSession, sf_dir: str, alphabet: Alphabet) -> DataFrame:
    return sequence.contigs(_docs(spark, sf_dir), alphabet, id_column="doc_id", fasta=False)


def _pool(spark: SparkSession, segments) -> DataFrame:
    return spark.createDataFrame(list(enumerate(segments)), "seg_id long, segment string")


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- scalar functions

LETTERS_SQL = "regexp_replace(lower(text), '[^a-z ]', '', 'g')"
GATC_SQL = "regexp_replace(lower(text), '[^atgc]', '', 'g')"


@query("sanitise_text", f"SELECT doc_id, {LETTERS_SQL} AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", LETTERS.sanitise("text").alias("clean"))


@query("sanitise_keep_unknown", "SELECT doc_id, regexp_replace(lower(text), '[^atgc]', 'n', 'g') AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", DNA.sanitise("text", keep_unknown=True).alias("clean"))


@query("normalise_text", "SELECT item_id, lower(text) AS folded FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", LETTERS.normalise("text").alias("folded"))


@query("reverse_complement", f"SELECT doc_id, reverse(translate({GATC_SQL}, 'atgc', 'tacg')) AS rc FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", DNA.reverse_complement(DNA.sanitise("text")).alias("rc"))


@query("canonical", f"WITH t AS (SELECT doc_id, {GATC_SQL} AS s FROM documents) SELECT doc_id, least(s, reverse(translate(s, 'atgc', 'tacg'))) AS seq, s <= reverse(translate(s, 'atgc', 'tacg')) AS as_written FROM t")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", DNA.sanitise("text").alias("s"))
    return t.select("doc_id", DNA.canonical("s").alias("seq"), DNA.is_canonical("s").alias("as_written"))


def windows_sql(clean: str, lengths, source: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to ``w(key, w)``, one arm for each length."""
    m = max(lengths)
    arms = " UNION ALL ".join(f"SELECT {key}, substr(k, i, {n}) AS w FROM blk, unnest(range(1, least(256, length(k) - {n} + 1) + 1)) u(i)" for n in lengths)
    return f"d AS (SELECT {key}, {clean} AS s FROM {source}), blk AS (SELECT {key}, substr(s, b * 256 + 1, {255 + m}) AS k FROM d, unnest(range(0, (length(s) - 1) // 256 + 1)) u(b) WHERE length(s) > 0), w AS ({arms})"


CODE_SQL = "list_sum(list_transform(range(1, length({s}) + 1), lambda i: CAST((instr('atgc', substr({s}, i, 1)) - 1) * 4 ** (length({s}) - i) AS BIGINT)))"


@query("kmer_encode", f"WITH {windows_sql(GATC_SQL, [6])}, u AS (SELECT DISTINCT w AS kmer FROM w) SELECT kmer, CAST({CODE_SQL.format(s='kmer')} AS BIGINT) AS code FROM u")
def _(spark, d):
    w = sequence.windows(_nodes(spark, d, DNA), [6]).select(F.col("window").alias("kmer")).distinct()
    return w.select("kmer", DNA.encode("kmer").alias("code"))


@query("kmer_decode", "SELECT CAST(v AS BIGINT) AS code, list_aggregate(list_transform(range(5, -1, -1), lambda e: substr('atgc', CAST((v // CAST(4 ** e AS BIGINT)) % 4 + 1 AS BIGINT), 1)), 'string_agg', '') AS kmer FROM range(4096) r(v)")
def _(spark, d):
    return spark.range(4**6).select(F.col("id").alias("code"), DNA.decode("id", 6).alias("kmer"))


@query("sequence_lengths", "SELECT conv_id, count(*) AS n_contigs, CAST(sum(length(regexp_replace(lower(text), '[^a-z ]', '', 'g'))) AS BIGINT) AS length FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("contig_idx"), LETTERS.sanitise("text").alias("seq"))
    return sequence.sequence_lengths(c).withColumnRenamed("sample_id", "conv_id")


@query("concatenated_contigs", "SELECT conv_id, string_agg(regexp_replace(lower(text), '[^a-z ]', '', 'g'), '' ORDER BY turn) AS seq FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("contig_idx"), LETTERS.sanitise("text").alias("seq"))
    return sequence.concatenated(c).withColumnRenamed("sample_id", "conv_id")


@query("character_at", "SELECT conv_id, nullif(substr(string_agg(regexp_replace(lower(text), '[^a-z ]', '', 'g'), '' ORDER BY turn), 101, 1), '') AS character FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("contig_idx"), LETTERS.sanitise("text").alias("seq"))
    return sequence.character_at(c, 100).withColumnRenamed("sample_id", "conv_id")


@query(
    "contig_parse",
    r"""WITH f AS (SELECT conv_id, string_agg('>' || role || chr(10) || text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, string_split(chr(10) || t, chr(10) || '>')[2:] AS parts FROM f)
    SELECT conv_id, CAST(i - 1 AS INTEGER) AS contig_idx, CASE WHEN instr(parts[i], chr(10)) > 0 THEN replace(substr(parts[i], instr(parts[i], chr(10)) + 1), chr(10), '') ELSE '' END AS seq
    FROM p, unnest(range(1, len(parts) + 1)) u(i)""",
)
def _(spark, d):
    c = table(spark, d, "conversations")
    line = F.concat(F.lit(">"), F.col("role"), F.lit("\n"), F.col("text"))
    f = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda e: e["l"]), "\n").alias("t"))
    return f.select("conv_id", F.posexplode(sequence.parse_fasta("t")).alias("contig_idx", "seq"))


# --- sequence files: the documents written as FASTA by source, read back in byte ranges


def _fasta_folder(spark: SparkSession, d: str) -> str:
    folder = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    clean = F.regexp_replace(DNA.sanitise("text"), "(.{60})", "$1\n")
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    docs.select("source", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), clean).alias("value")).write.partitionBy("source").text(folder)
    return folder


def _of_source(item: str) -> Column:
    return F.regexp_extract(item, "source=([^/]*)/", 1).alias("source")


@query("sequence_files", f"SELECT source, CAST(sum(length('>' || doc_id) + 2 + length(c) + length(c) // 60) AS BIGINT) AS bytes FROM (SELECT source, doc_id, {GATC_SQL} AS c FROM documents WHERE text IS NOT NULL) GROUP BY source")
def _(spark, d):
    return fasta.fasta_paths(spark, _fasta_folder(spark, d), "*.txt").groupBy(_of_source("item")).agg(F.sum("bytes").alias("bytes"))


@query("fasta_file_contigs", f"SELECT source, {GATC_SQL} AS seq, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return fasta.fasta_contigs(spark, _fasta_folder(spark, d), DNA).groupBy(_of_source("item"), "seq").agg(F.count(F.lit(1)).alias("n"))


@query("discretise", "SELECT l_orderkey, l_linenumber, round_even(l_discount * 10, 0) AS k FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.discretise(F.col("l_discount") * 10).alias("k"))


@query("clip_probabilities", "SELECT doc_id, round(greatest(1e-15, least(1 - 1e-15, n_chars / 4000.0)), 6) AS p, n_chars / 4000.0 >= 0.5 AS positive FROM documents")
def _(spark, d):
    p = F.col("n_chars") / F.lit(4000.0)
    return table(spark, d, "documents").select("doc_id", _r(scalars.clip_probability(p)).alias("p"), scalars.is_positive(p).alias("positive"))


@query("min_max_scaled", "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS scaled FROM orders")
def _(spark, d):
    return scalars.min_max(table(spark, d, "orders"), "o_totalprice").select("o_orderkey", _r(F.col("scaled")).alias("scaled"))


@query("standardised", "WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders) SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / s, 6) AS z FROM lineitem, m")
def _(spark, d):
    train = table(spark, d, "orders").select(F.col("o_totalprice").alias("z"))
    other = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("z"))
    return scalars.standardise(train, other, ["z"])[1].select("l_orderkey", "l_linenumber", _r(F.col("z")).alias("z"))


# --- counting

_CANON = "least(w, reverse(translate(w, 'atgc', 'tacg')))"


@query("kmer_histogram", f"WITH {windows_sql(GATC_SQL, [6])}, c AS (SELECT doc_id, {_CANON} AS s, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, CAST({CODE_SQL.format(s='s')} AS BIGINT) AS code, n FROM c")
def _(spark, d):
    return counting.kmer_histogram(_nodes(spark, d, DNA), DNA, 6).withColumnRenamed("sample_id", "doc_id")


def _counts_sql(clean: str, segments, canonical: bool) -> str:
    values = ", ".join(f"({i}, '{s}')" for i, s in enumerate(segments))
    seg = _CANON if canonical else "w"
    usable = " WHERE segment <= reverse(translate(segment, 'atgc', 'tacg'))" if canonical else ""
    return f"WITH {windows_sql(clean, sorted({len(s) for s in segments}))}, pool AS (SELECT CAST(i AS BIGINT) AS seg_id, segment FROM (VALUES {values}) v(i, segment){usable}), c AS (SELECT doc_id, seg_id, count(*) AS n FROM w JOIN pool ON pool.segment = {seg} GROUP BY ALL) "


@query("segment_counts", _counts_sql(LETTERS_SQL, WORDS, False) + "SELECT doc_id, seg_id, n FROM c")
def _(spark, d):
    return counting.count_segments(_nodes(spark, d, LETTERS), _pool(spark, WORDS), LETTERS).withColumnRenamed("sample_id", "doc_id")


@query("segment_counts_join", _counts_sql(LETTERS_SQL, WORDS, False) + "SELECT doc_id, seg_id, n FROM c")
def _(spark, d):
    return counting.count_segments(_nodes(spark, d, LETTERS), _pool(spark, WORDS), LETTERS, strategy="join").withColumnRenamed("sample_id", "doc_id")


@query("segment_counts_arrow", _counts_sql(LETTERS_SQL, WORDS, False) + "SELECT doc_id, seg_id, n FROM c")
def _(spark, d):
    return counting.count_segments(_nodes(spark, d, LETTERS), _pool(spark, WORDS), LETTERS, strategy="arrow").withColumnRenamed("sample_id", "doc_id")


@query("segment_counts_dna", _counts_sql(GATC_SQL, DNA_POOL, True) + "SELECT doc_id, seg_id, n FROM c")
def _(spark, d):
    return counting.count_segments(_nodes(spark, d, DNA), _pool(spark, DNA_POOL), DNA).withColumnRenamed("sample_id", "doc_id")


@query("segment_counts_u16", _counts_sql(GATC_SQL, ("a", "c"), True) + "SELECT doc_id, seg_id, least(n, 65535) AS n FROM c")
def _(spark, d):
    c = counting.count_segments(_nodes(spark, d, DNA), _pool(spark, ("a", "c")), DNA)
    return c.select(F.col("sample_id").alias("doc_id"), "seg_id", counting.stored("n", uint16=True).alias("n"))


@query("segment_presence", _counts_sql(LETTERS_SQL, WORDS, False) + "SELECT doc_id, seg_id, least(n, 1) AS n FROM c")
def _(spark, d):
    c = counting.count_segments(_nodes(spark, d, LETTERS), _pool(spark, WORDS), LETTERS)
    return c.select(F.col("sample_id").alias("doc_id"), "seg_id", counting.stored("n", presence=True).alias("n"))


@query("segment_matrix_dense", _counts_sql(LETTERS_SQL, WORDS, False) + f"SELECT doc_id, list_aggregate(list(CAST(coalesce(n, 0) AS VARCHAR) ORDER BY s.seg_id), 'string_agg', ',') AS counts FROM documents CROSS JOIN (SELECT unnest(range({len(WORDS)})) AS seg_id) s LEFT JOIN c USING (doc_id, seg_id) GROUP BY doc_id")
def _(spark, d):
    p = _pool(spark, WORDS)
    c = counting.count_segments(_nodes(spark, d, LETTERS), p, LETTERS)
    dense = counting.dense_counts(c, table(spark, d, "documents").select(F.col("doc_id").alias("sample_id")), p)
    return dense.select(F.col("sample_id").alias("doc_id"), F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("segment_matrix_sparse", _counts_sql(LETTERS_SQL, WORDS, False) + "SELECT doc_id, string_agg(seg_id || ':' || n, ' ' ORDER BY seg_id) AS entries FROM c GROUP BY doc_id")
def _(spark, d):
    c = counting.sparse_counts(counting.count_segments(_nodes(spark, d, LETTERS), _pool(spark, WORDS), LETTERS))
    e = F.transform(F.arrays_zip("indices", "values"), lambda x: F.concat_ws(":", x["indices"].cast("string"), x["values"].cast("string")))
    return c.select(F.col("sample_id").alias("doc_id"), F.array_join(e, " ").alias("entries"))


@query("fasta_file_counts", _counts_sql(GATC_SQL, DNA_POOL, True) + "SELECT source, seg_id, CAST(sum(n) AS BIGINT) AS n FROM c JOIN documents USING (doc_id) GROUP BY ALL")
def _(spark, d):
    chunks = fasta.fasta_chunks(spark, _fasta_folder(spark, d), DNA, max(map(len, DNA_POOL)) - 1)
    counts = counting.count_chunks(chunks.withColumnRenamed("item", "sample_id"), _pool(spark, DNA_POOL), DNA)
    return counts.groupBy(_of_source("sample_id"), "seg_id").agg(F.sum("n").alias("n"))


@query("source_factory", "SELECT doc_id AS sample_id, CAST(doc_id AS VARCHAR) AS item, length(text) AS n, CAST(quality AS FLOAT) AS quality, CAST(toxic AS FLOAT) AS toxic FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '\\S') AND quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    return build_source(spark, table=rows, data_column="text", label_columns=["quality", "toxic"], id_column="doc_id").select("sample_id", "item", F.length("text").alias("n"), "quality", "toxic")


# --- pool algebra, on the words of the benchmark items

_WORDS_SQL = "bw AS (SELECT w AS segment, count(*) AS n FROM benchmark, unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) u(w) WHERE w <> '' GROUP BY w), bp AS (SELECT row_number() OVER (ORDER BY n DESC, segment) - 1 AS seg_id, segment FROM bw)"


def _word_pool(spark, d) -> DataFrame:
    w = table(spark, d, "benchmark").select(F.explode(F.split(LETTERS.sanitise("text"), " ")).alias("segment")).filter("segment <> ''")
    return number_rows(w.groupBy("segment").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("segment").asc()], "seg_id").select("seg_id", "segment")


@query(
    "kmer_seed_pool",
    "WITH k AS (SELECT v, list_aggregate(list_transform(range(4, -1, -1), lambda e: substr('atgc', CAST((v // CAST(4 ** e AS BIGINT)) % 4 + 1 AS BIGINT), 1)), 'string_agg', '') AS s FROM range(1024) r(v)), "
    "c AS (SELECT least(s, reverse(translate(s, 'atgc', 'tacg'))) AS segment, min(v) AS o FROM k GROUP BY 1) SELECT row_number() OVER (ORDER BY o) - 1 AS seg_id, segment FROM c",
)
def _(spark, d):
    return pool.canonical_kmers(spark, DNA, 5)


@query(
    "extend_segments",
    f"WITH {_WORDS_SQL}, s AS (SELECT * FROM bp WHERE length(segment) BETWEEN 3 AND 4), a AS (SELECT c, substr('abcdefghijklmnopqrstuvwxyz ', c + 1, 1) AS x FROM range(27) r(c)), "
    "e AS (SELECT 1 AS i, c AS code, x AS e FROM a UNION ALL SELECT 2, p.c * 27 + q.c, p.x || q.x FROM a p, a q), "
    "x AS (SELECT 1 AS part, seg_id, i, code, j, substr(e, 1, j) || segment || substr(e, j + 1) AS segment FROM s, e, unnest(range(0, i + 1)) u(j) UNION ALL SELECT 0, seg_id, 0, 0, 0, segment FROM bp), "
    "f AS (SELECT segment, min((part, seg_id, i, code, j)) AS o FROM x GROUP BY segment) SELECT row_number() OVER (ORDER BY o) - 1 AS seg_id, segment FROM f",
)
def _(spark, d):
    return pool.extend(_word_pool(spark, d), LETTERS, 2, 2)


@query(
    "graft_segments",
    f"WITH {_WORDS_SQL}, g AS (SELECT 1 AS part, n, a.seg_id AS a, b.seg_id AS b, a.segment || substr(b.segment, n + 1) AS segment FROM unnest([4, 5, 6]) u(n), bp a, bp b WHERE a.seg_id <> b.seg_id AND length(a.segment) >= n AND length(b.segment) >= n AND right(a.segment, n) = left(b.segment, n) "
    "UNION ALL SELECT 0, 0, seg_id, 0, segment FROM bp), f AS (SELECT segment, min((part, n, a, b)) AS o FROM g GROUP BY segment) SELECT row_number() OVER (ORDER BY o) - 1 AS seg_id, segment FROM f",
)
def _(spark, d):
    return pool.graft(_word_pool(spark, d), 4, 6)


@query("segment_list_import", f"WITH {_WORDS_SQL} SELECT seg_id AS ord, segment FROM bp")
def _(spark, d):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.txt"
    _word_pool(spark, d).sort("seg_id").select("segment").write.text(path)
    return segment_list(spark, path)


@query("pool_saved", f"WITH {_WORDS_SQL} SELECT seg_id, segment, 3 AS last_length, 5 AS current_max FROM bp")
def _(spark, d):
    path = f"{shared_folder(spark)}/pool-{uuid.uuid4().hex}"
    pool.SegmentPool(_word_pool(spark, d), 3, 5).save_table(path)
    saved = pool.SegmentPool.load_table(spark, path)
    return saved.table.select("seg_id", "segment", F.lit(saved.last_length).alias("last_length"), F.lit(saved.current_max).alias("current_max"))


@query("containment_pairs", f"WITH {_WORDS_SQL} SELECT a.seg_id AS outer_id, b.seg_id AS inner_id FROM bp a, bp b WHERE a.seg_id <> b.seg_id AND contains(a.segment, b.segment)")
def _(spark, d):
    return pool.containment_pairs(_word_pool(spark, d))


_ELIMINATE_SQL = f"""WITH RECURSIVE {_WORDS_SQL}, s(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL
    SELECT i + 1, CASE WHEN len(list_filter(kept, lambda x: contains(x, segment) OR contains(segment, x))) = 0 THEN list_append(kept, segment) ELSE kept END FROM s JOIN bp ON bp.seg_id = s.i)
    SELECT seg_id AS rank, segment FROM bp WHERE list_contains((SELECT kept FROM s ORDER BY i DESC LIMIT 1), segment)"""


@query("eliminate_redundant", _ELIMINATE_SQL)
def _(spark, d):
    return pool.eliminate_redundant(_word_pool(spark, d).withColumnRenamed("seg_id", "rank"))


@query("eliminate_redundant_joins", _ELIMINATE_SQL)
def _(spark, d):
    return pool.eliminate_distributed(_word_pool(spark, d).withColumnRenamed("seg_id", "rank"))


@query("feature_partitions", f"WITH {_WORDS_SQL}, p AS (SELECT count(*) AS n, greatest(count(*) // 100, 1) AS p FROM bp), q AS (SELECT p, n // p AS q, n % p AS r FROM p) SELECT seg_id, CAST(CASE WHEN seg_id < r * (q + 1) THEN seg_id // (q + 1) ELSE r + (seg_id - r * (q + 1)) // q END AS INTEGER) AS part FROM bp, q")
def _(spark, d):
    p = _word_pool(spark, d)
    return p.select("seg_id", pool.partition_of("seg_id", p.count(), 100).alias("part"))


@query("segment_fit", f"WITH {_WORDS_SQL} SELECT seg_id, NOT regexp_matches(segment, '[^atgcn]') AND segment <= reverse(translate(segment, 'atgc', 'tacg')) AS matchable FROM bp")
def _(spark, d):
    return _word_pool(spark, d).select("seg_id", DNA.matchable("segment").alias("matchable"))


@query("pool_append", f"WITH {_WORDS_SQL}, c AS (SELECT w AS segment, min((conv_id, turn, i)) AS o FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS w, generate_subscripts(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), 1) AS i FROM conversations) WHERE w <> '' GROUP BY w), n AS (SELECT segment, row_number() OVER (ORDER BY o) - 1 AS ord FROM c WHERE segment NOT IN (SELECT segment FROM bp)) SELECT seg_id, segment FROM bp UNION ALL SELECT (SELECT count(*) FROM bp) + row_number() OVER (ORDER BY ord) - 1, segment FROM n")
def _(spark, d):
    words = F.posexplode(F.split(LETTERS.sanitise("text"), " "))
    w = table(spark, d, "conversations").select("conv_id", "turn", words.alias("i", "segment")).filter("segment <> ''")
    first = w.groupBy("segment").agg(F.min(F.struct("conv_id", "turn", "i")).alias("o"))
    return pool.append(_word_pool(spark, d), number_rows(first, [F.col("o").asc()], "ord"))


@query("pool_subset", f"WITH {_WORDS_SQL} SELECT row_number() OVER (ORDER BY length(segment) DESC, seg_id) - 1 AS seg_id, segment FROM bp WHERE length(segment) > 5")
def _(spark, d):
    p = _word_pool(spark, d)
    ranked = number_rows(p.filter(F.length("segment") > 5), [F.length("segment").desc(), F.col("seg_id").asc()], "rank").select("seg_id", "rank")
    return pool.SegmentPool(p).subset(ranked).table


@query("segment_alphabet", f"WITH {_WORDS_SQL} SELECT DISTINCT substr(segment, i, 1) AS outside FROM bp, unnest(range(1, length(segment) + 1)) u(i) WHERE substr(segment, i, 1) NOT IN ('a', 't', 'g', 'c', 'n')")
def _(spark, d):
    used = _word_pool(spark, d).select(F.explode(F.split("segment", "")).alias("outside")).distinct()
    known = spark.createDataFrame([(c,) for c in DNA.symbols(include_unknown=True)], "outside string")
    return used.join(F.broadcast(known), "outside", "left_anti")


# --- labels and splits


@query("label_join", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    return join_labels(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("missing_labels", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _(spark, d):
    return without_labels(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("label_table_clean", "SELECT doc_id, CAST(quality AS FLOAT) AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND regexp_matches(text, '\\S')")
def _(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return text_table(t, "text", "quality", "doc_id").select(F.col("sample_id").alias("doc_id"), "quality")


@query("invalid_labels", "SELECT DISTINCT 'lang' AS label, lang AS value FROM documents WHERE try_cast(lang AS DOUBLE) IS NULL UNION ALL SELECT DISTINCT 'source', source FROM documents WHERE try_cast(source AS DOUBLE) IS NULL")
def _(spark, d):
    return invalid_labels(table(spark, d, "documents"), ["lang", "source"])


@query("non_binary_labels", "SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS value FROM lineitem WHERE l_linenumber NOT IN (0, 1)")
def _(spark, d):
    return metrics.non_binary(table(spark, d, "lineitem"), ["l_linenumber"])


_FOLD_SQL = """WITH s AS (SELECT doc_id, CAST(quality AS BIGINT) AS stratum FROM labels), z AS (SELECT stratum, count(*) AS n FROM s GROUP BY stratum),
    o AS (SELECT stratum, coalesce(sum(n) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 5 AS o FROM z)
    SELECT doc_id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) - 1 + o) % 5 AS INTEGER) AS fold FROM s JOIN o USING (stratum)"""


@query("stratified_folds", _FOLD_SQL)
def _(spark, d):
    return splits.stratified_folds(table(spark, d, "labels"), 5, key="doc_id", label="quality").select("doc_id", "stratum", "fold")


@query("fold_sizes", f"SELECT stratum, fold, count(*) AS n FROM ({_FOLD_SQL}) GROUP BY ALL")
def _(spark, d):
    return splits.stratified_folds(table(spark, d, "labels"), 5, key="doc_id", label="quality").groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("hold_out", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, r <= least(ceil(n * 0.2), n - 1) AS is_test FROM r")
def _(spark, d):
    return splits.hold_out(table(spark, d, "labels"), key="doc_id", label="quality").select("doc_id", "is_test")


@query("predefined_folds", "SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE source NOT IN ('src0', 'src3')")
def _(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("item"), "quality")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    folds = table(spark, d, "documents").select(F.col("doc_id").alias("item"), number.alias("fold")).join(labels.select("item"), "item", "left_semi")
    most = folds.agg(F.max("fold")).first()[0] + 1
    return splits.predefined_folds(labels, folds.filter("fold <> 0"), 3, most, item="item")[0].withColumnRenamed("item", "doc_id")


@query("oversample", "WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), m AS (SELECT max(n) AS m FROM n), r AS (SELECT doc_id, toxic, n, m, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS r FROM labels JOIN n USING (toxic), m) SELECT doc_id, toxic, CAST(c AS INTEGER) AS copy FROM r, unnest(range(0, m // n + CASE WHEN r < m % n THEN 1 ELSE 0 END)) u(c)")
def _(spark, d):
    return pool.oversample(table(spark, d, "labels"), "toxic", ["doc_id"]).select("doc_id", "toxic", "copy")


# --- scaling, importance

@query("label_scaler", "SELECT round(avg(l_quantity), 6) AS mean_quantity, round(stddev_pop(l_quantity), 6) AS std_quantity, round(avg(l_extendedprice), 4) AS mean_price, round(stddev_pop(l_extendedprice), 4) AS std_price FROM lineitem")
def _(spark, d):
    s = selection.LabelScaler.fit(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(round(s.means[0], 6), round(s.stds[0], 6), round(s.means[1], 4), round(s.stds[1], 4))], "mean_quantity double, std_quantity double, mean_price double, std_price double")


@query("scaled_labels", "WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round(CAST(CAST((l_quantity - a) / s AS FLOAT) AS DOUBLE), 4) AS z FROM lineitem, m")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("z"))
    return selection.LabelScaler.fit(t, ["z"]).transform(t).withColumn("z", _r(F.col("z").cast("double"), 4))


def _gains(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("seg_id"), F.pmod("l_linenumber", F.lit(2)).cast("int").alias("label_idx"), F.col("l_extendedprice").alias("gain"))
    return selection.mean_gain(t)


_GAINS_SQL = "g AS (SELECT l_partkey AS seg_id, CAST(l_linenumber % 2 AS INTEGER) AS label_idx, avg(l_extendedprice) AS gain FROM lineitem GROUP BY ALL), s AS (SELECT seg_id, gain / sum(gain) OVER (PARTITION BY label_idx) AS gain FROM g), i AS (SELECT seg_id, sum(gain) AS importance FROM s GROUP BY seg_id)"


@query("mean_gain", f"WITH {_GAINS_SQL} SELECT seg_id, label_idx, round(gain, 6) AS gain FROM g")
def _(spark, d):
    return _gains(spark, d).withColumn("gain", _r(F.col("gain")))


@query("gain_share_ranking", f"WITH {_GAINS_SQL} SELECT seg_id, round(importance, 9) AS importance FROM i")
def _(spark, d):
    return selection.rank_importance(_gains(spark, d)).withColumn("importance", _r(F.col("importance"), 9))


@query("top_segments", f"WITH {_GAINS_SQL} SELECT seg_id, round(importance, 9) AS importance FROM i ORDER BY i.importance DESC, seg_id LIMIT 25")
def _(spark, d):
    return selection.top_features(selection.rank_importance(_gains(spark, d)), 25).withColumn("importance", _r(F.col("importance"), 9))


@query("segment_importance", f"WITH {_GAINS_SQL}, {_WORDS_SQL} SELECT seg_id, segment AS Segment, round(coalesce(importance, 0), 9) AS Importance FROM bp LEFT JOIN i USING (seg_id)")
def _(spark, d):
    got = selection.with_importance(_word_pool(spark, d), selection.rank_importance(_gains(spark, d)))
    return got.withColumn("Importance", _r(F.col("Importance"), 9))


@query("merge_importance", "WITH x AS (SELECT l_returnflag AS Segment, l_linenumber AS f, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT Segment, round(sum(v) / 7.0, 6) AS Importance FROM x WHERE f BETWEEN 1 AND 7 GROUP BY Segment")
def _(spark, d):
    t = table(spark, d, "lineitem")
    folds = [t.filter(F.col("l_linenumber") == i).groupBy(F.col("l_returnflag").alias("Segment")).agg(F.avg("l_quantity").alias("Importance")) for i in range(1, 8)]
    return selection.merge_importance(folds).withColumn("Importance", _r(F.col("Importance")))


@query(
    "split_gain_level",
    f"WITH {windows_sql(GATC_SQL, [2])}, c AS (SELECT doc_id, {_CANON} AS s, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT doc_id, 0.5 - quality AS g, 0.25 AS h FROM labels), t AS (SELECT sum(g) AS tg, sum(h) AS th FROM l), "
    "b AS (SELECT s, n, sum(g) AS g, sum(h) AS h FROM c JOIN l USING (doc_id) GROUP BY ALL), r AS (SELECT s, n, sum(g) OVER o AS gr, sum(h) OVER o AS hr, coalesce(lead(n) OVER o, 0) AS threshold FROM b WINDOW o AS (PARTITION BY s ORDER BY n DESC)) "
    "SELECT s AS segment, CAST(threshold AS BIGINT) AS threshold, round(CAST(0.5 * ((tg - gr) ** 2 / (th - hr + 1) + gr ** 2 / (hr + 1) - tg ** 2 / (th + 1)) AS DOUBLE), 6) AS gain FROM r, t",
)
def _(spark, d):
    k2 = counting.kmer_histogram(_nodes(spark, d, DNA), DNA, 2).withColumnRenamed("code", "seg_id")
    stats = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), (0.5 - F.col("quality")).alias("g"), F.lit(0.25).alias("h"))
    got = selection.split_gains(k2, stats)
    return got.select(DNA.decode("seg_id", 2).alias("segment"), "threshold", _r(F.col("gain")).alias("gain"))


# --- metrics

_RETAIL = "SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem"
_LOG2 = "SELECT floor(log2(l_extendedprice)) AS y, log2(l_quantity * 1500.0) AS p FROM lineitem"
_TOXIC = "SELECT CAST(toxic AS DOUBLE) AS y, (n_chars % 1000) // 10 / 100.0 AS p FROM labels JOIN documents USING (doc_id)"
_CLASSES = "SELECT CAST(l_linenumber AS DOUBLE) AS y, l_quantity / 8.0 AS p FROM lineitem"


def _retail(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


def _log2(spark, d):
    return table(spark, d, "lineitem").select(F.floor(F.log2("l_extendedprice")).cast("double").alias("y"), F.log2(F.col("l_quantity") * 1500.0).alias("p"))


def _toxic(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return t.select(F.col("toxic").cast("double").alias("y"), (F.floor(F.pmod("n_chars", F.lit(1000)) / F.lit(10)) / F.lit(100.0)).alias("p"))


def _classes(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), (F.col("l_quantity") / 8.0).alias("p"))


_POS, _HIT = "y >= 0.5", "p >= 0.5"
_CELLS = f"SELECT count(*) FILTER ({_POS} AND {_HIT}) AS tp, count(*) FILTER (NOT ({_POS}) AND {_HIT}) AS fp, count(*) FILTER (NOT ({_POS}) AND NOT ({_HIT})) AS tn, count(*) FILTER ({_POS} AND NOT ({_HIT})) AS fn FROM x"
_RANKS = "r AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM x)"
_CONFUSION = "m AS (SELECT round_even(y, 0) AS y, round_even(p, 0) AS p, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL)"

_METRIC_SQL = {
    "rmse": (_retail, _RETAIL, "SELECT sqrt(avg((y - p) ** 2)) AS v FROM x", {}),
    "mae": (_retail, _RETAIL, "SELECT avg(abs(y - p)) AS v FROM x", {}),
    "mape": (_retail, _RETAIL, "SELECT avg(abs((y - p) / y)) FILTER (y <> 0) * 100 AS v FROM x", {}),
    "r2": (_retail, _RETAIL, "SELECT 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS v FROM x", {}),
    "pearson": (_retail, _RETAIL, "SELECT covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) AS v FROM x", {}),
    "spearman": (_retail, _RETAIL, f"SELECT corr(ry, rp) AS v FROM (WITH {_RANKS} SELECT * FROM r)", {}),
    "accuracy": (_classes, _CLASSES, "SELECT avg(CASE WHEN round_even(y, 0) = round_even(p, 0) THEN 1.0 ELSE 0.0 END) AS v FROM x", {}),
    "mcc": (_classes, _CLASSES, f"SELECT v FROM (WITH {_CONFUSION}, t AS (SELECT y AS k, sum(n) AS t FROM m GROUP BY y), q AS (SELECT p AS k, sum(n) AS q FROM m GROUP BY p), a AS (SELECT (SELECT sum(n) FROM m) AS s, (SELECT sum(n) FROM m WHERE y = p) AS c, (SELECT sum(t * q) FROM t JOIN q USING (k)) AS tq, (SELECT sum(t * t) FROM t) AS tt, (SELECT sum(q * q) FROM q) AS qq) SELECT (c * s - tq) / sqrt((s * s - qq) * (s * s - tt)) AS v FROM a)", {}),
    "auroc": (_toxic, _TOXIC, f"SELECT v FROM (WITH {_RANKS} SELECT (sum(rp) FILTER ({_POS}) - count(*) FILTER ({_POS}) * (count(*) FILTER ({_POS}) + 1) / 2.0) / (count(*) FILTER ({_POS}) * count(*) FILTER (NOT ({_POS}))) AS v FROM r)", {}),
    "auprc": (_toxic, _TOXIC, f"SELECT v FROM (WITH g AS (SELECT p, count(*) AS n, count(*) FILTER ({_POS}) AS c FROM x GROUP BY p), h AS (SELECT c, sum(c) OVER (ORDER BY p DESC) AS hits, sum(n) OVER (ORDER BY p DESC) AS seen FROM g) SELECT sum(c * hits / seen) / sum(c) AS v FROM h)", {}),
    "precision": (_toxic, _TOXIC, f"SELECT tp / (tp + fp) AS v FROM ({_CELLS})", {}),
    "recall": (_toxic, _TOXIC, f"SELECT tp / (tp + fn) AS v FROM ({_CELLS})", {}),
    "specificity": (_toxic, _TOXIC, f"SELECT tn / (tn + fp) AS v FROM ({_CELLS})", {}),
    "f1": (_toxic, _TOXIC, f"SELECT 2 * tp / (2 * tp + fp + fn) AS v FROM ({_CELLS})", {}),
    "balanced_accuracy": (_toxic, _TOXIC, f"SELECT (tp / (tp + fn) + tn / (tn + fp)) / 2 AS v FROM ({_CELLS})", {}),
    "log_loss": (_toxic, _TOXIC, f"SELECT -avg(CASE WHEN {_POS} THEN ln(greatest(1e-15, least(1 - 1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, p))) END) AS v FROM x", {}),
    "essential_agreement": (
        _log2,
        _LOG2,
        "SELECT avg(CASE WHEN y <= 12 THEN CASE WHEN r <= 12 THEN 1.0 ELSE 0.0 END WHEN y >= 16 THEN CASE WHEN r >= 16 THEN 1.0 ELSE 0.0 END WHEN abs(y - r) <= 1 THEN 1.0 ELSE 0.0 END) AS v FROM (SELECT y, CASE WHEN 2 ** p >= (2 ** floor(p) + 2 ** ceil(p)) / 2 THEN ceil(p) ELSE floor(p) END AS r FROM x)",
        {"ea_min": 4096.0, "ea_max": 65536.0},
    ),
}


def _metric_query(name: str) -> None:
    pairs, source, sql, params = _METRIC_SQL[name]

    def run(spark, d):
        v = metrics.Metric(name, **params).score(pairs(spark, d))
        return spark.createDataFrame([(name, round(v, 6))], "metric string, value double")

    query(f"metric_{name}", f"WITH x AS ({source}) SELECT '{name}' AS metric, round(CAST(v AS DOUBLE), 6) AS value FROM ({sql})")(run)


for _name in _METRIC_SQL:
    _metric_query(_name)


@query("confusion", f"WITH x AS ({_CLASSES}) SELECT round_even(y, 0) AS y, round_even(p, 0) AS p, count(*) AS n FROM x GROUP BY ALL")
def _(spark, d):
    return metrics.confusion(_classes(spark, d))


@query("average_ranks", "SELECT doc_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents")
def _(spark, d):
    return metrics.average_ranks(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "r").select("doc_id", "r")


@query("class_union", f"WITH x AS ({_CLASSES}) SELECT round_even(y, 0) AS k FROM x UNION SELECT round_even(p, 0) FROM x")
def _(spark, d):
    return metrics.classes(_classes(spark, d))


@query(
    "precision_recall_points",
    f"WITH x AS ({_TOXIC}), g AS (SELECT p, count(*) AS n, count(*) FILTER ({_POS}) AS pos FROM x GROUP BY p), h AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS hits, sum(n) OVER (ORDER BY p DESC) AS seen, pos FROM g) "
    "SELECT p, CAST(hits AS BIGINT) AS hits, CAST(seen AS BIGINT) AS seen, round(hits / seen, 6) AS precision, round(pos / (SELECT sum(pos) FROM g), 6) AS recall_step FROM h",
)
def _(spark, d):
    x = _toxic(spark, d)
    total = x.filter(scalars.is_positive("y")).count()
    got = metrics.precision_recall(x)
    return got.select("p", "hits", "seen", _r(F.col("hits") / F.col("seen")).alias("precision"), _r(F.col("pos") / F.lit(float(total))).alias("recall_step"))


@query("binary_cells", f"WITH x AS ({_TOXIC}) {_CELLS}")
def _(spark, d):
    tp, fp, tn, fn = metrics._cells(F.col("y"), F.col("p"))
    return _toxic(spark, d).agg(tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"))


# --- results over folds

_FOLDS_SQL = "SELECT doc_id, CAST(i AS INTEGER) AS Fold, round((n_chars % 1000) / 1000.0, 3) AS Prediction, CAST(quality AS DOUBLE) AS Actual FROM labels JOIN documents USING (doc_id), unnest(range(0, 3)) u(i) WHERE doc_id % 3 = i"


def _fold_tables(spark, d) -> list[DataFrame]:
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p = t.select("doc_id", F.round(F.pmod("n_chars", F.lit(1000)) / F.lit(1000.0), 3).alias("Prediction"), F.col("quality").cast("double").alias("Actual"))
    return [p.filter(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)]  # the three folds make the whole table


@query("fold_union", _FOLDS_SQL)
def _(spark, d):
    out = None
    for i, f in enumerate(_fold_tables(spark, d)):
        one = f.withColumn("Fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


@query("best_fold", f"WITH f AS ({_FOLDS_SQL}), s AS (SELECT Fold, avg(abs(Actual - Prediction)) AS v FROM f GROUP BY Fold) SELECT Fold, round(v, 6) AS score, round((SELECT avg(v) FROM s), 6) AS mean_score FROM s ORDER BY v, Fold LIMIT 1")
def _(spark, d):
    from strandloom.plans.results import FoldResult, TrainingResult

    m = metrics.Metric("mae")
    r = TrainingResult([FoldResult(i, None, f, s := m.score(f, "Actual", "Prediction"), [s], None) for i, f in enumerate(_fold_tables(spark, d))], m)
    best = r.best_fold
    return spark.createDataFrame([(best.fold, round(best.score, 6), round(r.score, 6))], "Fold int, score double, mean_score double")


@query("label_scale_mismatch", "SELECT l, coalesce(greatest(a, b) / least(a, b) >= 10, FALSE) AS mismatch FROM (SELECT l_returnflag AS l, coalesce(nullif(stddev_pop(l_quantity), 0), 1) AS a, coalesce(nullif(stddev_pop(l_discount), 0), 1) AS b FROM lineitem GROUP BY ALL UNION ALL SELECT 'n', coalesce(nullif(stddev_pop(l_quantity), 0), 1), coalesce(nullif(stddev_pop(l_linenumber), 0), 1) FROM lineitem)")
def _(spark, d):
    t = table(spark, d, "lineitem")
    flags = [r[0] for r in t.select("l_returnflag").distinct().collect()]  # a few
    rows = [(f, selection.scale_mismatch(t.filter(F.col("l_returnflag") == f), ["l_quantity", "l_discount"])) for f in flags]
    return spark.createDataFrame([*rows, ("n", selection.scale_mismatch(t, ["l_quantity", "l_linenumber"]))], "l string, mismatch boolean")


@query("registered_metric", f"SELECT round(CAST(max(abs(y - p)) AS DOUBLE), 6) AS score FROM ({_RETAIL})")
def _(spark, d):
    metrics.Metric.register("largest_error", lower_is_better=True)(lambda y, p: F.max(F.abs(y - p)))
    return spark.createDataFrame([(round(metrics.Metric("largest_error").score(_retail(spark, d), "y", "p"), 6),)], "score double")


# --- whole runs; trees of more than one split have no SQL counterpart


def _labelled(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")


def _settings(d: DataFrame) -> dict:
    return {"table": d, "data_column": "text", "label_columns": "quality", "id_column": "doc_id", "alphabet": LETTERS, "binary": True, "lr": 0.3, "num_rounds": 20, "partition_size_target": 2000}


@query("train_predict")
def train_predict(spark, d):
    run = TrainingPipeline(spark, **_settings(_labelled(spark, d)), k=2, ext=1, target=3, features=100)
    return run.train().predictions


@query("baseline_predict")
def _(spark, d):
    return BaselinePipeline(spark, **_settings(_labelled(spark, d)), k=2).train().predictions


_STUMP_SQL = f"""WITH t AS (SELECT doc_id, {LETTERS_SQL} AS c, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND regexp_matches(text, '\\S')),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM t),
    s AS (SELECT doc_id, c, y, r <= least(ceil(n * 0.2), n - 1) AS test FROM r), m AS (SELECT avg(y) AS base, count(*) AS h FROM s WHERE NOT test),
    p AS (SELECT DISTINCT doc_id, test, y, substr(c, i, 2) AS w FROM s, unnest(range(1, length(c))) u(i)), z AS (SELECT sum(base - y) AS tg FROM s, m WHERE NOT test),
    q AS (SELECT w, sum(base - y) AS g, count(*) AS n FROM p, m WHERE NOT test GROUP BY w),
    b AS (SELECT w, g, n FROM q, m, z WHERE n >= 1 AND h - n >= 1 ORDER BY round(0.5 * (g * g / (n + 1) + (tg - g) * (tg - g) / (h - n + 1) - tg * tg / (h + 1)), 10) DESC, strpos('abcdefghijklmnopqrstuvwxyz ', substr(w, 1, 1)) * 27 + strpos('abcdefghijklmnopqrstuvwxyz ', substr(w, 2, 1)) LIMIT 1)
    SELECT doc_id AS sample_id, CAST(doc_id AS VARCHAR) AS item, round(base - 0.5 * CASE WHEN contains(c, w) THEN g / (n + 1) ELSE (tg - g) / (h - n + 1) END, 6) AS prediction, y AS actual FROM s, m, z, b WHERE test"""


def _stumps(spark, d, **how) -> DataFrame:
    settings = _settings(_labelled(spark, d)) | {"binary": False, "binary_features": True, "lr": 0.5, "num_rounds": 1, "depth": 1, "metric": "rmse", "partition_size_target": 0}
    p = BaselinePipeline(spark, **(settings | how), k=2).train().predictions
    return p.select("sample_id", "item", _r(F.col("Prediction")).alias("prediction"), F.col("Actual").alias("actual"))


@query("stump_predict", _STUMP_SQL)
def _(spark, d):
    return _stumps(spark, d)


def _saved_stump(spark, d) -> SegmentModel:
    """A one-split model, saved by Spark and loaded again."""
    settings = _settings(_labelled(spark, d)) | {"binary": False, "binary_features": True, "lr": 0.5, "num_rounds": 1, "depth": 1, "metric": "rmse", "partition_size_target": 0}
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    BaselinePipeline(spark, **settings, k=2).train().model.save_table(path)
    return SegmentModel.load_table(spark, path)


@query(
    "saved_model_predict",
    _STUMP_SQL[: _STUMP_SQL.index("SELECT doc_id AS sample_id")] + f"SELECT doc_id AS sample_id, round(base - 0.5 * CASE WHEN contains(x.c, w) THEN g / (n + 1) ELSE (tg - g) / (h - n + 1) END, 6) AS prediction FROM (SELECT doc_id, {LETTERS_SQL} AS c FROM documents) x, m, z, b",
)
def _(spark, d):
    return _saved_stump(spark, d).predict_table(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("sample_id", _r(F.col("prediction")).alias("prediction"))


@query("model_counts", f"WITH d AS (SELECT doc_id, {LETTERS_SQL} AS c FROM documents), w AS (SELECT DISTINCT doc_id, substr(c, i, 2) AS w FROM d, unnest(range(1, length(c))) u(i)) SELECT w AS segment, count(*) AS samples FROM w GROUP BY w")
def _(spark, d):
    model = _saved_stump(spark, d)
    counts = model.count(table(spark, d, "documents").select("doc_id", "text"), "doc_id").groupBy("seg_id").agg(F.sum("n").alias("samples"))
    return counts.join(model.segment_importance.table, "seg_id").select(F.col("Segment").alias("segment"), "samples")


@query("stump_predict_levels", _STUMP_SQL)
def _(spark, d):
    return _stumps(spark, d, backend="levels")


#: One split of counts with zeros as missing: bins of each column, every cut in both directions, then the leaves of the held-out rows.
_SPARSE_STUMP_SQL = _STUMP_SQL[: _STUMP_SQL.index("    p AS (SELECT DISTINCT")] + """    z AS (SELECT sum(base - y) AS tg FROM s, m WHERE NOT test),
    e AS (SELECT doc_id, test, y, substr(c, i, 2) AS w, count(*) AS n FROM s, unnest(range(1, length(c))) u(i) GROUP BY ALL),
    v AS (SELECT w, n, count(*) AS m, sum(base - y) AS g FROM e, m WHERE NOT test GROUP BY w, n),
    x AS (SELECT *, count(*) OVER (PARTITION BY w) AS d, sum(m) OVER (PARTITION BY w) - 1 AS last, sum(m) OVER (PARTITION BY w ORDER BY n) AS hi FROM v),
    k AS (SELECT *, d <= 255 OR len(list_filter(range(255), lambda j: round_even(j * last / 254, 0) >= hi - m AND round_even(j * last / 254, 0) < hi)) > 0 AS kept FROM x),
    a AS (SELECT *, max(CASE WHEN kept THEN n END) OVER (PARTITION BY w ORDER BY n) AS at_n, min(CASE WHEN kept THEN n END) OVER (PARTITION BY w ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_n FROM k),
    t1 AS (SELECT *, coalesce((at_n + after_n) / 2, at_n + 1.0::DOUBLE) AS threshold FROM a),
    c1 AS (SELECT w, n, threshold FROM t1 WHERE kept),
    l1 AS (SELECT c1.w, threshold, coalesce(sum(g) FILTER (v.n < threshold), 0) AS bg, coalesce(sum(v.m) FILTER (v.n < threshold), 0) AS bh, sum(g) AS pg, sum(v.m) AS ph FROM c1 JOIN v ON v.w = c1.w GROUP BY c1.w, threshold),
    w1 AS (SELECT w, threshold, to_left, CASE WHEN to_left THEN bg + tg - pg ELSE bg END AS gl, CASE WHEN to_left THEN bh + h - ph ELSE bh END AS hl, tg, h FROM l1, m, z, (VALUES (TRUE), (FALSE)) y(to_left)),
    b AS (SELECT * FROM w1 WHERE hl >= 1 AND h - hl >= 1 ORDER BY round(CAST(0.5 * (gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (h - hl + 1) - tg * tg / (h + 1)) AS DOUBLE), 10) DESC, to_left DESC, strpos('abcdefghijklmnopqrstuvwxyz ', substr(w, 1, 1)) * 27 + strpos('abcdefghijklmnopqrstuvwxyz ', substr(w, 2, 1)), threshold LIMIT 1)
    SELECT s.doc_id AS sample_id, CAST(s.doc_id AS VARCHAR) AS item, round(CAST(base - 0.5 * CASE WHEN coalesce(n < threshold, to_left) THEN gl / (hl + 1) ELSE (tg - gl) / (b.h - hl + 1) END AS DOUBLE), 6) AS prediction, s.y AS actual
    FROM s CROSS JOIN m CROSS JOIN b LEFT JOIN e ON e.doc_id = s.doc_id AND e.w = b.w WHERE s.test"""


@query("stump_predict_sparse", _SPARSE_STUMP_SQL)
def _(spark, d):
    return _stumps(spark, d, sparse=True, binary_features=False)


@query("stump_predict_sparse_levels", _SPARSE_STUMP_SQL)
def _(spark, d):
    return _stumps(spark, d, sparse=True, binary_features=False, backend="levels")


@query("train_predict_levels")
def _(spark, d):
    return BaselinePipeline(spark, **(_settings(_labelled(spark, d)) | {"num_rounds": 3}), k=1, backend="levels").train().predictions


@query("random_segments")
def _(spark, d):
    return pool.SegmentPool.of(spark, list(DNA_POOL), 0, 5).filled(DNA, 500, 6).table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and their importance after binary training on the labelled documents."""
    run = TrainingPipeline(spark, **_settings(_labelled(spark, sf_dir)), k=2, ext=1, target=3, features=60)
    return run.train().segments


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
