import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import scalars, sequence
from strandloom.functions.alphabet import Alphabet

DNA = Alphabet()
LETTERS = Alphabet("abcdefghijklmnopqrstuvwxyz ")


@pytest.mark.parametrize(
    "args",
    [
        {"characters": ""},
        {"characters": ["ab"]},
        {"characters": "aİ"},
        {"characters": "atgc", "unknown": "nn"},
        {"characters": "atgc", "unknown": "a"},
        {"characters": "abc", "complement": "ab"},
        {"characters": "abc", "complement": {"a": "b", "b": "c"}},
        {"characters": "abc", "complement": {"a": "x"}},
        {"characters": "abc", "complement": "bca"},
    ],
)
def test_refused_alphabets(args):
    with pytest.raises(ValueError):
        Alphabet(**args)


def test_defaults():
    assert DNA.symbols() == "atgc" and DNA.unknown == "n" and DNA.pairs == {"a": "t", "t": "a", "g": "c", "c": "g"}
    assert Alphabet("CGTA").pairs == DNA.pairs and Alphabet("CGTA") != DNA
    assert Alphabet("ACGTN").unknown is None and Alphabet("acgtn").pairs is None
    assert Alphabet("aAbB").characters == ("a", "b") and Alphabet("aAbB", case_sensitive=True).characters == ("a", "A", "b", "B")
    assert Alphabet("abc", complement={"a": "b"}).pairs == {"a": "b", "b": "a", "c": "c"}
    assert Alphabet("atgc", complement=None).complement_of("ag") == "ag"
    assert Alphabet("atgc", complement={"a": "t", "g": "c", "n": "n"}).complement_of("ang") == "cnt"
    assert Alphabet("ab", complement={"a": "n"}).complement_of("anb") == "ban"
    assert Alphabet("augc", complement="uacg").complement_of("aug") == "cau"
    assert Alphabet.from_dict(DNA.to_dict()) == DNA and hash(Alphabet.from_dict(DNA.to_dict())) == hash(DNA)
    with pytest.raises(ValueError):
        Alphabet("acgtn").symbols(include_unknown=True)
    assert DNA.codes(True) == {"a": 0, "t": 1, "g": 2, "c": 3, "n": 4}


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_columns(spark):
    assert one(spark, LETTERS.sanitise("t"), "The cat sat on the mat.\nIt sat") == "the cat sat on the matit sat"
    assert one(spark, DNA.sanitise("t", keep_unknown=True), "AxG-") == "angn"
    assert one(spark, DNA.reverse_complement("t"), "ang") == "cnt"
    assert one(spark, DNA.canonical("t"), "tttt") == "aaaa" and one(spark, DNA.is_canonical("t"), "cagtt") is False
    special = Alphabet("]^-\\[.", unknown="$")
    assert one(spark, special.sanitise("t"), "a]b^c-d\\e[f.") == "]^-\\[." and one(spark, special.sanitise("t", keep_unknown=True), "a.") == "$."
    with pytest.raises(ValueError):
        Alphabet("acgtn").sanitise("t", keep_unknown=True)


def test_encoding_round_trip(spark):
    rows = spark.range(4**5).select("id", DNA.decode("id", 5).alias("s")).withColumn("back", DNA.encode("s"))
    assert rows.filter("id <> back").count() == 0
    assert one(spark, DNA.encode("t"), "aa") == 0 and one(spark, DNA.encode("t"), "ca") == 12 and one(spark, DNA.encode("t"), "ax") is None and one(spark, DNA.encode("t"), "") == 0


def plain_fasta(text):
    nodes, open_ = [], None
    lines = text.split("\n")
    if not any(x.startswith(">") for x in lines):
        return ["".join(lines)]
    for x in lines:
        if x.startswith(">"):
            nodes.append("")
            open_ = True
        elif open_:
            nodes[-1] += x
    return nodes


@pytest.mark.parametrize("text", [">a\nac\ngt\n>b\ntt", "junk\n>a\nac", "", "ac\ngt", ">only", ">a\n>b\nac\n", "a>b\nc", ">a\nac\n\n>b\n\n", "\n", ">"])
def test_fasta(spark, text):
    assert one(spark, sequence.parse_fasta("t"), text) == plain_fasta(text)


def test_windows_across_blocks(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("acgt") for _ in range(n)) for n in (0, 1, 2, 9, 10, 11, 30, 57)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "sample_id long, seq string")
    got = sorted(map(tuple, sequence.windows(nodes, [1, 3, 7], block=5).collect()))
    assert got == sorted((i, t[a : a + n]) for i, t in enumerate(texts) for n in (1, 3, 7) for a in range(len(t) - n + 1))
    assert sequence.windows(nodes, []).collect() == []


def test_contigs_and_lengths(spark):
    s = spark.createDataFrame([(1, ">a\nACGT\n>b\nxxgg"), (2, None), (3, "ac")], "sample_id long, text string")
    nodes = sequence.contigs(s, DNA)
    assert sorted((r["sample_id"], r["contig_idx"], r["seq"]) for r in nodes.collect()) == [(1, 0, "acgt"), (1, 1, "gg"), (3, 0, "ac")]
    assert {tuple(r) for r in sequence.sequence_lengths(nodes).collect()} == {(1, 2, 6), (3, 1, 2)}
    assert {tuple(r) for r in sequence.concatenated(nodes).collect()} == {(1, "acgtgg"), (3, "ac")}
    assert {tuple(r) for r in sequence.character_at(nodes, 4).collect()} == {(1, "g"), (3, None)}


def test_scalars(spark):
    v = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    assert [r[0] for r in v.select(scalars.discretise("v")).collect()] == [0.0, 2.0, 2.0, -0.0]
    assert [r["scaled"] for r in scalars.min_max(v, "v").collect()] == [pytest.approx(x) for x in (1 / 3, 2 / 3, 1, 0)]
    assert [r["scaled"] for r in scalars.min_max(v.withColumn("v", F.lit(3.0)), "v").collect()] == [0.0] * 4
    train, other = scalars.standardise(v, v, ["v"])
    assert train.agg(F.stddev_pop("v")).first()[0] == pytest.approx(1) and other.count() == 4
    assert v.select(scalars.undo_min_max(F.lit(0.5), 2.0, 4.0)).first()[0] == 3.0
