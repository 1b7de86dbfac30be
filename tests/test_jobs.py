"""The runnable jobs: growing input, reruns, repeated batches, odd rows, settings and the command line's parts."""

import hashlib
import json
from collections import Counter

import pytest

from jobs import common, kmer_profiles, training_matrix
from strandloom.functions.alphabet import Alphabet

DOCS = "doc_id long, text string, source string, sample_id string, part string"


def put(spark, path, rows, mode="append"):
    spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).coalesce(1).write.mode(mode).parquet(path)


def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")


def kmers(text, k=6):
    """Canonical k-mers of a text by number, plainly."""
    s = "".join(c for c in text.lower() if c in "atgc")
    flip = str.maketrans("atgc", "tacg")
    seen = Counter(min(w, w[::-1].translate(flip)) for w in (s[i : i + k] for i in range(len(s) - k + 1)))
    out = Counter()
    for w, n in seen.items():
        code = 0
        for c in w:
            code = code * 4 + "atgc".index(c)
        out[code] += n
    return out


def want_counts(rows):
    return sorted((str(i), s, code, n) for i, t, s in rows for code, n in kmers(t).items())


def stored_counts(spark, out):
    return sorted((r["sample_id"], r["source"], r["code"], r["n"]) for r in kmer_profiles.sample_counts(spark, out).collect())


FIRST = [(1, "gattaca gattaca", "a"), (2, "ACGTACGTACGT", "b"), (3, "the quick brown tagged cat", None), (4, "ttttttttttttt", "a")]
SECOND = [(5, "catcatcatcatta", "b"), (6, "gggggggggcccc", "c")]


def test_two_runs_over_growing_input(spark, tmp_path):
    source, out, mark = folders(tmp_path)
    put(spark, source, FIRST)
    assert kmer_profiles.run(spark, source, out, mark) == {"batches": 1, "samples": 4}
    assert stored_counts(spark, out) == want_counts(FIRST)
    before = {r["f"] for r in spark.read.parquet(f"{out}/counts").selectExpr("_metadata.file_path || _metadata.file_modification_time AS f").distinct().collect()}
    put(spark, source, SECOND)
    assert kmer_profiles.run(spark, source, out, mark) == {"batches": 2, "samples": 6}
    assert stored_counts(spark, out) == want_counts(FIRST + SECOND)
    # what was there has not been written again, and a run without new files changes nothing
    files = lambda: {r["f"] for r in spark.read.parquet(f"{out}/counts").selectExpr("_metadata.file_path || _metadata.file_modification_time AS f").distinct().collect()}
    after = files()
    assert before < after
    assert kmer_profiles.run(spark, source, out, mark) == {"batches": 2, "samples": 6} and files() == after


def test_profiles_add_up(spark, tmp_path):
    source, out, mark = folders(tmp_path)
    for rows in (FIRST, SECOND):
        put(spark, source, rows)
        kmer_profiles.run(spark, source, out, mark)
    n, samples = Counter(), Counter()
    for _, t, s in FIRST + SECOND:
        for code, x in kmers(t).items():
            n[s, code] += x
            samples[s, code] += 1
    got = {(r["source"], r["code"]): (r["n"], r["samples"]) for r in kmer_profiles.profiles(spark, out).collect()}
    assert got == {k: (n[k], samples[k]) for k in n}


def test_odd_rows_are_told(spark, tmp_path):
    source, out, mark = folders(tmp_path)
    put(spark, source, [*FIRST, (1, "gattaca gattaca", "a"), (4, "ttttttttttttt", "zz"), (None, "acgtacgt", "a"), (7, None, "a"), (8, " \n", "a"), (9, "", None), (10, "xyz", ""), (11, "gattaca" * 30_000, "long")])
    kmer_profiles.run(spark, source, out, mark)
    put(spark, source, [(2, "another text of gattaca", "b"), *SECOND])
    kmer_profiles.run(spark, source, out, mark)
    digest = lambda t, s: hashlib.sha256(f"{s or ''}\n{t}".encode()).hexdigest()
    fourth = min((digest("t" * 13, s), s) for s in ("a", "zz"))[1]
    kept = [*FIRST[:3], (4, "t" * 13, fourth), (10, "xyz", ""), (11, "gattaca" * 30_000, "long"), *SECOND]
    assert stored_counts(spark, out) == want_counts(kept)
    stored = {r["sample_id"]: (r["source"], r["batch"]) for r in spark.read.parquet(f"{out}/samples").collect()}
    assert stored["10"] == ("", 0) and stored["3"] == (None, 0) and stored["5"] == ("b", 1) and len(stored) == 8
    reasons = Counter((r["batch"], r["sample_id"], r["reason"]) for r in spark.read.parquet(f"{out}/rejects").collect())
    assert reasons == Counter({(0, "1", "more than once"): 1, (0, "4", "more than once"): 1, (0, None, "no id"): 1, (0, "7", "no text"): 1, (0, "8", "no text"): 1, (0, "9", "no text"): 1, (1, "2", "came before"): 1})


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    """A batch that was written but not marked as done is given again by Spark under the same number."""
    source, out, mark = folders(tmp_path)
    put(spark, source, FIRST)
    kmer_profiles.run(spark, source, out, mark)
    put(spark, source, SECOND)
    late = spark.createDataFrame([(*r, "x", "y") for r in SECOND], DOCS)
    settings = common.check_settings({}, kmer_profiles.DEFAULTS)
    kmer_profiles.take(late.limit(1), 1, out, settings)  # half of it, as if by a run that was killed
    kmer_profiles.run(spark, source, out, mark)
    assert stored_counts(spark, out) == want_counts(FIRST + SECOND)
    kmer_profiles.take(late, 1, out, settings)
    assert stored_counts(spark, out) == want_counts(FIRST + SECOND)


def test_many_batches_equal_one(spark, tmp_path):
    source, out, mark = folders(tmp_path)
    for r in FIRST + SECOND:
        put(spark, source, [r])
    put(spark, source, [(1, "too late", "a")])
    assert kmer_profiles.run(spark, source, out, mark, settings={"files_per_batch": 2})["samples"] == 6
    rows = stored_counts(spark, out)
    assert {r[0] for r in rows} <= {str(i) for i in range(1, 7)}
    assert {(r["sample_id"], r["n_chars"]) for r in spark.read.parquet(f"{out}/samples").filter("sample_id <> '1'").collect()} == {(str(i), len(t)) for i, t, _ in (FIRST + SECOND)[1:]}


def test_empty_input_and_other_settings(spark, tmp_path):
    source, out, mark = folders(tmp_path)
    put(spark, source, [])
    assert kmer_profiles.run(spark, source, out, mark)["samples"] == 0
    assert stored_counts(spark, out) == [] and kmer_profiles.profiles(spark, out).count() == 0
    with pytest.raises(ValueError, match="other settings"):
        kmer_profiles.run(spark, source, out, mark, settings={"k": 5})
    with pytest.raises(ValueError, match="no such setting"):
        kmer_profiles.run(spark, source, out, mark, settings={"kk": 5})


def test_settings_come_from_a_file(spark, tmp_path):
    source, out, mark = folders(tmp_path)
    put(spark, source, FIRST)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"k": 3, "alphabet": "abcdefghijklmnopqrstuvwxyz "}))
    kmer_profiles.run(spark, source, out, mark, config=f"file://{config}")
    letters = Alphabet("abcdefghijklmnopqrstuvwxyz ")
    code = letters.encode_text("cat") if hasattr(letters, "encode_text") else (2 * 27 + 0) * 27 + 19
    assert {r[0] for r in stored_counts(spark, out) if r[2] == code} == {"3"}
    for name in ("kmer_profiles", "training_matrix"):
        import os

        path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs", f"{name}.json")
        common.read_settings(spark, path, {"kmer_profiles": kmer_profiles, "training_matrix": training_matrix}[name].DEFAULTS)
    a = vars(common.arguments("x", {"documents": "", "out": ""}).parse_args(["--documents", "hdfs://a/b", "--out", "o"]))
    assert a == {"documents": "hdfs://a/b", "out": "o", "config": None}


# --- the training matrix


LABELS = "doc_id long, quality int, text string, fold int"


def table(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    return path


def labelled(tmp_path, spark, docs, labels):
    return (
        table(spark, str(tmp_path / "docs"), [(i, t, "s", "x", "y") for i, t in docs], DOCS),
        table(spark, str(tmp_path / "labels"), [(i, q, "t", 3) for i, q in labels], LABELS),
        str(tmp_path / "out"),
    )


def brute_matrix(docs, labels, lengths, features, folds, test_fold, least):
    text = dict(docs)
    use = [(i, q) for i, q in labels if i in text]
    order = sorted(use, key=lambda r: (r[1], hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    fold = {i: n % folds for n, (i, _) in enumerate(order)}
    clean = {i: "".join(c for c in text[i].lower() if c in "abcdefghijklmnopqrstuvwxyz ") for i, _ in use}
    held = {i: Counter(clean[i][a : a + k] for k in lengths for a in range(len(clean[i]) - k + 1)) for i in clean}
    train = [(i, q) for i, q in use if fold[i] != test_fold]
    n1 = sum(q for _, q in train)
    p, a = Counter(), Counter()
    for i, q in train:
        for w in held[i]:
            a[w] += 1
            p[w] += q
    score = {w: abs(p[w] * (len(train) - n1) - (a[w] - p[w]) * n1) for w in a if a[w] >= least}
    pool = sorted(score, key=lambda w: (-score[w], w))[:features]
    return {(fold[i], i, float(q), n, w, held[i][w]) for i, q in use for n, w in enumerate(pool) if held[i][w]}, pool, fold


WORDS = "red green blue cyan pink gold grey lime".split()


def planted(n=60):
    return [(i, f"{WORDS[i % 7]} {'special case' if i % 2 else 'usual thing'} {WORDS[i % 5]}") for i in range(n)], [(i, i % 2) for i in range(n)]


def test_matrix_equals_brute_force(spark, tmp_path):
    docs, labels = planted()
    paths = labelled(tmp_path, spark, docs, labels)
    settings = {"features": 30, "lengths": [3, 5], "folds": 4, "test_fold": 1}
    done = training_matrix.run(spark, *paths, settings=settings)
    want, pool, fold = brute_matrix(docs, labels, [3, 5], 30, 4, 1, 2)
    got = {tuple(r) for r in training_matrix.entries(spark, paths[2]).collect()}
    assert got == want and done == {"rows": 60, "segments": 30, "entries": len(want)}
    assert [r["segment"] for r in training_matrix.segments(spark, paths[2]).orderBy("seg_id").collect()] == pool
    assert {r["fold"]: (r["rows"], r["positives"]) for r in spark.read.json(f"{paths[2]}/folds").collect()} == {f: (list(fold.values()).count(f), sum(i % 2 for i, x in fold.items() if x == f)) for f in range(4)}
    # a rerun, and a run with fewer folds, leave nothing of the run before
    assert training_matrix.run(spark, *paths, settings=settings) == done and {tuple(r) for r in training_matrix.entries(spark, paths[2]).collect()} == got
    training_matrix.run(spark, *paths, settings=settings | {"folds": 2})
    assert {r["fold"] for r in training_matrix.entries(spark, paths[2]).collect()} == {0, 1}


def test_matrix_of_odd_rows(spark, tmp_path):
    docs, labels = planted(20)
    docs += [(100, None), (101, " \t"), (102, "qqq"), (103, "one text"), (103, "second text"), (None, "no id"), (105, "special case " * 40_000)]
    labels += [(100, 1), (101, 0), (102, 1), (103, 0), (104, 1), (105, 1), (106, None), (107, 7), (2, 1), (3, 1), (3, 1), (None, 1)]
    paths = labelled(tmp_path, spark, docs, labels)
    training_matrix.run(spark, *paths, settings={"features": 20})
    rows = {r["sample_id"]: r for r in spark.read.parquet(f"{paths[2]}/matrix").collect()}
    assert set(rows) == {i for i in range(20) if i != 2} | {102, 103, 105}
    assert rows[102]["indices"] == [] and rows[3]["label"] == 1.0 and max(rows[105]["values"]) == 40_000
    reasons = {(r["sample_id"], r["reason"]) for r in spark.read.parquet(f"{paths[2]}/rejects").collect()}
    assert reasons == {(100, "no text"), (101, "no text"), (104, "no text"), (103, "more than one text"), (106, "label is not 0 or 1"), (107, "label is not 0 or 1"), (2, "labels differ")}


def test_matrix_of_nothing(spark, tmp_path):
    paths = labelled(tmp_path, spark, [], [])
    assert training_matrix.run(spark, *paths) == {"rows": 0, "segments": 0, "entries": 0}
    assert training_matrix.entries(spark, paths[2]).count() == 0
    with pytest.raises(ValueError, match="test_fold"):
        training_matrix.run(spark, *paths, settings={"test_fold": 9})
    with pytest.raises(ValueError, match="no column"):
        training_matrix.run(spark, *paths, settings={"label_column": "missing"})


def test_command_line(spark, tmp_path):
    """In a process of its own, as it creates and stops its session."""
    import os
    import subprocess
    import sys

    source, out, mark = folders(tmp_path)
    put(spark, source, FIRST)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = [sys.executable, "-m", "jobs.kmer_profiles", "--documents", source, "--out", out, "--checkpoint", mark, "--config", os.path.join(root, "jobs", "kmer_profiles.json")]
    done = subprocess.run(args, cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert json.loads(done.stdout.splitlines()[-1]) == {"batches": 1, "samples": 4}
    assert f"reads {source}" in done.stderr and f"wrote {out}/samples/batch=0" in done.stderr
    assert stored_counts(spark, out) == want_counts(FIRST)


def test_segments_are_chosen_without_a_row_for_each_place(spark):
    """Windows of the chosen segments are counted where the texts lie; a window that a sample holds several times counts once."""
    from strandloom.functions.alphabet import Alphabet
    from jobs.training_matrix import DEFAULTS, informative

    nodes = spark.createDataFrame([(1, 0, "ababab"), (2, 0, "abcabc"), (3, 0, "cbacba"), (4, 0, "bbbb"), (9, 0, "aaaa")], "sample_id long, contig_idx int, seq string")
    samples = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)], "sample_id long, label double")
    got = informative(samples, nodes, DEFAULTS | {"lengths": [3], "min_samples": 1, "features": 3}, Alphabet("abc"))
    assert [(r["segment"], r["positives"], r["negatives"]) for r in got.orderBy("seg_id").collect()] == [("aba", 1, 0), ("abc", 1, 0), ("acb", 0, 1)]


def test_counts_of_a_batch_meet_no_join(spark, tmp_path, monkeypatch):
    """A sample's counts carry its source from its text on: they are neither grouped nor joined, so no task holds more of them than it writes at once."""
    from jobs import kmer_profiles as job

    plans, write = [], job._write
    monkeypatch.setattr(job, "_write", lambda df, path, by=None: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if by else None, write(df, path, by))[1])
    batch = spark.createDataFrame([(1, "gattaca", "a"), (2, "acgtacgt", None), (2, "acgtacgt", None)], "doc_id long, text string, source string")
    job.take(batch, 0, str(tmp_path / "out"), job.DEFAULTS | {"k": 3})
    above = plans[0][: plans[0].index("MapInArrow")]
    assert "Join" not in above and "Aggregate" not in above
    got = {(r["sample_id"], r["source"]): 0 for r in job.sample_counts(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {("1", "a"), ("2", None)}
