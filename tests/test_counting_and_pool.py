import random
from collections import Counter

import pytest

from strandloom.functions import sequence
from strandloom.functions.alphabet import Alphabet
from strandloom.operators import counting, pool, window_counts
from strandloom.operators.pool import SegmentPool

DNA = Alphabet()
LETTERS = Alphabet("abcdefghijklmnopqrstuvwxyz ")


def counts(spark, alphabet, nodes, segments, strategy="join"):
    n = spark.createDataFrame([(0, i, s) for i, s in enumerate(nodes)], "sample_id long, contig_idx int, seq string")
    p = spark.createDataFrame(list(enumerate(segments)), "seg_id long, segment string")
    got = {r["seg_id"]: r["n"] for r in counting.count_segments(n, p, alphabet, strategy=strategy).collect()}
    return [got.get(i, 0) for i in range(len(segments))]


GOLDENS = [
    (DNA, ["aactgccaggcagtt"], ["aactg"], [2]),
    (DNA, ["aactgccagg"], ["cagtt"], [0]),
    (LETTERS, ["the cat sat on the mat"], ["the", "cat", "at", "zebra"], [2, 1, 3, 0]),
    (Alphabet("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ", case_sensitive=True), ["The cat sat on the Mat"], ["the", "The", "at", "Mat"], [1, 1, 3, 1]),
    (Alphabet("abcdefghijklmnopqrstuvwxyz"), ["ab cd"], ["abcd", "ab", "cd"], [0, 1, 1]),
    (Alphabet("augc", complement="uacg"), ["augcaugc"], ["aug"], [3]),
    (LETTERS, ["the cat sat"], ["123", "ca7", "cat"], [0, 0, 1]),
    (DNA, ["aactg"], ["", "aac"], [0, 1]),
    (DNA, ["aacngccagg"], ["acng", "acgg"], [1, 0]),
    (Alphabet("abc=+<>"), ["a=b+c", "a=b", "c<>a=b"], ["a=b", "=b+", "<>", "ccc"], [3, 1, 1, 0]),
    (DNA, ["aaa"], ["aa", "aa", "at"], [2, 2, 0]),
]


@pytest.mark.parametrize("strategy", ["pattern", "join", "arrow"])
@pytest.mark.parametrize("alphabet, nodes, segments, want", GOLDENS)
def test_goldens(spark, alphabet, nodes, segments, want, strategy):
    assert counts(spark, alphabet, nodes, segments, strategy) == want


def test_strategies_agree_with_plain_python(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("acgtn") for _ in range(r.randrange(0, 700))) for _ in range(12)]
    segments = ["at", "gc", "atgc", "aa", "cg", "acn", *{"".join(r.choice("acgt") for _ in range(r.choice([2, 3, 5]))) for _ in range(40)}]
    nodes = spark.createDataFrame([(i % 4, i, t) for i, t in enumerate(texts)], "sample_id long, contig_idx int, seq string")
    p = spark.createDataFrame(list(enumerate(segments)), "seg_id long, segment string")
    want = set()
    for s in range(4):
        for k, seg in enumerate(segments):
            n = sum(DNA.canonical_of(t[a : a + len(seg)]) == seg for i, t in enumerate(texts) if i % 4 == s for a in range(len(t) - len(seg) + 1))
            if n:
                want.add((s, k, n))
    for strategy in ("pattern", "join", "arrow", "auto"):
        assert {tuple(x) for x in counting.count_segments(nodes, p, DNA, strategy=strategy).collect()} == want
    with pytest.raises(ValueError):
        counting.count_segments(nodes, p, DNA, strategy="x")


def test_saturation_presence_and_matrices(spark):
    a = Alphabet("a", complement=None)
    nodes = spark.createDataFrame([(0, 0, "a" * 70_000), (1, 0, "")], "sample_id long, contig_idx int, seq string")
    p = spark.createDataFrame([(0, "a"), (1, "aa")], "seg_id long, segment string")
    c = counting.count_segments(nodes, p, a)
    assert {r[0] for r in c.filter("seg_id = 0").select(counting.stored("n", uint16=True)).collect()} == {65535}
    assert {r[0] for r in c.select(counting.stored("n", uint16=True, presence=True)).collect()} == {1}
    dense = {r["sample_id"]: r["counts"] for r in counting.dense_counts(c, nodes, p).collect()}
    assert dense == {0: [70_000, 69_999], 1: [0, 0]}
    assert [tuple(r) for r in counting.sparse_counts(c).collect()] == [(0, [0, 1], [70_000, 69_999])]
    hist = counting.kmer_histogram(nodes, a, 1, dense=True)
    assert {tuple(r) for r in hist.collect()} == {(0, 0, 70_000), (1, 0, 0)}


def ranked(spark, segments, ranks):
    return spark.createDataFrame(list(zip(ranks, segments, strict=True)), "rank long, segment string")


@pytest.mark.parametrize("eliminate", [pool.eliminate_redundant, pool.eliminate_distributed])
@pytest.mark.parametrize(
    "segments, ranks, want",
    [
        (["segment", "seg", "ment", "segm"], [0, 1, 2, 3], ["segment"]),
        (["segment", "seg", "ment", "segm"], [1, 0, 2, 3], ["seg", "ment"]),
        (["segment", "seg", "ment", "segm"], [1, 2, 0, 3], ["ment", "seg"]),
        (["segment", "segment"], [0, 1], ["segment"]),
        (["a", "b"], [1, 0], ["b", "a"]),
        ([], [], []),
    ],
)
def test_elimination(spark, eliminate, segments, ranks, want):
    got = eliminate(ranked(spark, segments, ranks)).orderBy("rank").collect()
    assert [r["segment"] for r in got] == want


def test_elimination_forms_agree(spark):
    r = random.Random(9)
    segments = ["".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(80)]
    df = ranked(spark, segments, range(80))
    assert sorted(map(tuple, pool.eliminate_redundant(df).collect())) == sorted(map(tuple, pool.eliminate_distributed(df).collect()))


def test_grafting(spark):
    p = SegmentPool.of(spark, ["segment", "menta", "abcsegm"], 4, 4)
    assert p.grafted().segments()[:3] == ["segment", "menta", "abcsegm"]
    assert set(p.grafted().segments()[3:]) == {"segmenta", "abcsegment"}
    assert SegmentPool.of(spark, ["aa", "bb"], 1, 2).grafted().segments() == ["aa", "bb"]


def test_extension(spark):
    abc = Alphabet("abc")
    grown = SegmentPool.of(spark, ["a"], 0, 1).extended(abc, 1)
    assert grown.segments()[0] == "a" and set(grown.segments()) == {"a", "aa", "ab", "ac", "ba", "ca"}
    assert (grown.last_length, grown.current_max) == (1, 2)
    assert SegmentPool.of(spark, ["a"], 1, 2).extended(abc, 1) is None


def test_extension_order_equals_the_sequential_rule(spark):
    from itertools import product

    segments = ["ac", "gg", "acg"]
    out = dict.fromkeys(segments)
    for s in segments:
        if 1 < len(s) <= 3:
            for i in (1, 2):
                for e in product("atgc", repeat=i):
                    for j in range(i + 1):
                        out.setdefault(DNA.canonical_of("".join(e[:j]) + s + "".join(e[j:])))
    assert SegmentPool.of(spark, segments, 1, 3).extended(DNA, 2).segments() == list(out)


def test_seed_pool(spark):
    from itertools import product

    got = SegmentPool.seed(spark, DNA, 3, 2)
    assert got.segments() == list(dict.fromkeys(DNA.canonical_of("".join(x)) for x in product("atgc", repeat=3)))
    assert (got.last_length, got.current_max) == (1, 3)
    with pytest.raises(ValueError):
        pool.canonical_kmers(spark, DNA, 30)


def test_append_subset_fill_and_checkpoint(spark, tmp_path):
    p = SegmentPool.of(spark, ["b", "a"], 0, 1).appended(["c", "a", "c"], 5)
    assert p.segments() == ["b", "a", "c"] and (p.last_length, p.current_max) == (1, 5)
    pick = spark.createDataFrame([(2, 0), (0, 1)], "seg_id long, rank long")
    assert p.subset(pick).segments() == ["c", "b"]
    with pytest.raises(IndexError):
        p.subset(spark.createDataFrame([(9, 0)], "seg_id long, rank long"))
    full = SegmentPool.of(spark, ["acgt"], 0, 4).filled(DNA, 20, 4)
    assert len(set(full.segments())) == 20 and full.segments()[0] == "acgt"
    p.save(str(tmp_path / "x" / "pool.json"))
    again = SegmentPool.load(spark, str(tmp_path / "x" / "pool.json"))
    assert again.segments() == p.segments() and again.current_max == 5


def test_feature_partitions(spark):
    import numpy as np

    for n, target in ((10, 3), (7, 0), (5, 10), (100, 7), (3, 1)):
        got = [r[0] for r in spark.range(n).select(pool.partition_of("id", n, target)).collect()]
        parts = np.array_split(np.arange(n), max(n // target, 1) if target > 0 else 1)
        assert got == [i for i, x in enumerate(parts) for _ in x]


def test_containment(spark):
    p = spark.createDataFrame(list(enumerate(["abc", "b", "bc", "abc", "x"])), "seg_id long, segment string")
    assert {tuple(r) for r in pool.containment_pairs(p).collect()} == {(0, 1), (0, 2), (3, 1), (3, 2), (2, 1), (0, 3)}


def test_oversampling(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "i long, y int")
    got = pool.oversample(df, "y", ["i"]).groupBy("y").count().collect()
    assert {r["count"] for r in got} == {7}


def test_blocked_long_text(spark):
    text = "ab" * 5000
    nodes = spark.createDataFrame([(0, text)], "sample_id long, seq string")
    assert sequence.windows(nodes, [3]).count() == len(text) - 2


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_containment_by_sorted_suffixes(spark, parts):
    import random

    r = random.Random(parts)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(150)] + ["", "é", "aé", "éa", "ab" * 40]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(x) for x in pool.containment_pairs(spark.createDataFrame(list(enumerate(words)), "seg_id long, segment string")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and b and b in a and (len(a) > len(b) or i < j)}
    assert set(got) == want and len(got) == len(want)


def test_a_pool_of_several_automata(spark, monkeypatch):
    import random

    from strandloom.operators import counting

    r = random.Random(3)
    texts = [("".join(r.choice("atgc") for _ in range(300)),) for _ in range(20)]
    nodes = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "sample_id long, seq string")
    segments = spark.createDataFrame(list(enumerate(sorted({"".join(r.choice("atgc") for _ in range(r.randint(2, 6))) for _ in range(300)}))), "seg_id long, segment string")
    want = sorted(map(tuple, counting.count_segments(nodes, segments, Alphabet(), strategy="join").collect()))
    monkeypatch.setattr(counting, "BROADCAST_BYTES", 15_000)
    used = []
    one = counting._count_automaton
    monkeypatch.setattr(counting, "_count_automaton", lambda *a: (used.append(1), one(*a))[1])
    for strategy in ("arrow", "auto"):
        assert sorted(map(tuple, counting.count_segments(nodes, segments, Alphabet(), strategy=strategy).collect())) == want
    assert 2 < len(used)


@pytest.mark.parametrize("dense", [False, True])
def test_listed_kmers_equal_worked_out_ones(spark, monkeypatch, dense):
    from strandloom.operators import counting

    nodes = spark.createDataFrame([(1, "gattacanngat"), (1, "tt"), (2, "acgtacgt"), (3, "")], "sample_id long, seq string")
    want = sorted(map(tuple, counting.kmer_histogram(nodes, Alphabet(), 3, dense).collect()))
    monkeypatch.setattr(counting, "LISTED_KMERS", 0)
    assert sorted(map(tuple, counting.kmer_histogram(nodes, Alphabet(), 3, dense).collect())) == want


@pytest.mark.parametrize(("characters", "complement"), [("acgt", None), ("atgc", "tacg"), ("añ語 ", None)])
@pytest.mark.parametrize("at_once", [1 << 16, 7])
def test_windows_are_counted_where_the_texts_lie(spark, monkeypatch, characters, complement, at_once):
    """No row for each place of a window; contigs of a sample add up, texts longer than a piece and characters outside the alphabet come right."""
    monkeypatch.setattr(window_counts, "AT_ONCE", at_once)
    alphabet = Alphabet(characters, complement=complement, unknown="?")
    r = random.Random(3)
    rows = [(i % 5, "".join(r.choice(characters + "?Z") for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 40, 200, 9, 31])]
    nodes = spark.createDataFrame([*rows, (9, None)], "sample_id long, seq string")
    segments = sorted({alphabet.canonical_of(s[i : i + n]) for _, s in rows for n in (1, 2, 3) for i in range(len(s.lower()) - n + 1) if "Z" not in s[i : i + n]})
    segments = [*segments[::2], segments[0], "Z", ""]
    want = Counter()
    for i, s in rows:
        for n in (1, 2, 3):
            for at in range(len(s) - n + 1):
                w = alphabet.canonical_of(s[at : at + n])
                want.update((i, k) for k, x in enumerate(segments) if x == w and set(w) <= set(characters + "?"))
    pool = spark.createDataFrame(list(enumerate(segments)), "seg_id long, segment string")
    got = counting.count_segments(nodes, pool, alphabet, strategy="join")
    assert {(q[0], q[1]): q[2] for q in got.collect()} == dict(want)
    assert "Generate" not in got._jdf.queryExecution().toString()
    monkeypatch.setattr(counting, "THIN_BYTES", 0)
    assert sorted(counting.count_segments(nodes, pool, alphabet, strategy="join").collect()) == sorted(got.collect())


def test_a_small_pool_of_one_length_is_counted_in_one_reading(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, "ACGTACGA"), (1, "TTTT"), (2, "")], "sample_id long, seq string")
    segments = spark.createDataFrame([(0, "ac"), (1, "cg"), (2, "aa")], "seg_id long, segment string")
    want = sorted(map(tuple, counting.count_segments(nodes, segments, DNA, strategy="pattern").collect()))
    assert want
    monkeypatch.setattr(counting, "_count_patterns", lambda *a: pytest.fail("a pattern for each segment"))
    assert sorted(map(tuple, counting.count_segments(nodes, segments, DNA).collect())) == want
