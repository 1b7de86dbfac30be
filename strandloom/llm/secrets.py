"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Beyond them, two character Markov models, one of random strings and one
of ordinary identifiers, both trained from labelled samples, are compared on every long run of key-like
characters: a run whose log-likelihood ratio per step exceeds a threshold is a span of kind ``markov``; in other
runs the stretches of the highest summed ratio are, so a key joined to ordinary text is found in it.

Positions come from cutting a text at its matches: a match starts after the parts and matches before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the least length inside the pattern; a run of one class is matched whole, so this drops just the failing ones.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_=-]{16,}"
#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "markov")
SPAN = "array<struct<start:int,rank:int,end:int>>"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Mean log-likelihood ratio of a step from which a run counts as random.
RATIO = 0.6
#: Inside a run: what a step must add to go on, the fall of the sum that ends a stretch, and its least characters.
MARGIN, FALL, STRETCH = 0.3, 8.0, 16

#: Parts that ordinary identifiers, paths and long words are made of.
PARTS = (
    "get set is has make build create update delete remove insert find load save read write open close start stop init run test check user name value count index list map set data file path line word page item node edge tree "
    "graph table row column key type class object string number array buffer stream client server request response handler manager service factory config option default error warning message event action state view model "
    "controller component module package library application interface abstract internal external public private static final global local context session cookie header body content length size width height color image "
    "document information communication international development organization environment government relationship administration understanding responsibility characteristics "
    "the and tion ing ment ness able ible heit keit lich schaft ung que eaux tre elle cion miento dad mente"
).split()


def training_samples(spark: SparkSession, n: int = 600) -> DataFrame:
    """Labelled samples ``(text, random boolean)``: digests in three spellings, and identifiers built from common parts by rule."""
    base = spark.range(n)
    raw = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    mixed = F.regexp_replace(F.base64(raw), "[^A-Za-z0-9]", "")
    rand = base.select(F.explode(F.array(F.base64(raw), F.lower(F.hex(raw)), mixed)).alias("text"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, PARTS))
    part = [F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(len(PARTS))) + 1).cast("int")) for k in range(5)]
    number = F.when(F.col("id") % 5 == 0, F.concat(F.lit("_"), F.pmod(F.col("id"), F.lit(100)).cast("string"))).otherwise("")
    names = F.array(
        F.concat(F.concat_ws("_", *part[:4]), number),
        F.concat_ws("-", *part[1:4]),
        F.concat(part[0], *map(F.initcap, part[1:4])),
        F.upper(F.concat_ws("_", *part[2:5])),
        F.concat(F.lit("/"), F.concat_ws("/", *part[:4])),
        F.concat(*part),
        F.concat(F.initcap(part[0]), *part[1:3]),
        F.concat(part[0], F.lit("="), part[2], F.lit("/"), part[3]),
        F.rpad(F.lit(""), 24, F.substring(F.lit("-=_+/"), F.pmod(F.col("id"), F.lit(5)).cast("int") + 1, 1)),
    )
    return rand.unionByName(base.select(F.explode(names).alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios random : ordinary of every step between two characters, row by row; smoothed by one half."""
    chars = samples.select("random", F.split("text", "").alias("c")).filter(F.size("c") > 1)
    step = F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b")))
    got = chars.select("random", step.alias("s")).groupBy("random", "s.a", "s.b").agg(F.count(F.lit(1)).alias("n")).collect()  # at most twice the square of the alphabet, plus strays
    k = len(ALPHABET)
    table = {True: [[0.5] * k for _ in range(k)], False: [[0.5] * k for _ in range(k)]}
    for r in got:
        a, b = ALPHABET.find(r["a"]), ALPHABET.find(r["b"])
        if a >= 0 and b >= 0:
            table[r["random"]][a][b] += r["n"]
    out = []
    for a in range(k):
        p, q = sum(table[True][a]), sum(table[False][a])
        out += [math.log(table[True][a][b] / p) - math.log(table[False][a][b] / q) for b in range(k)]
    return out


def _placed(text: Column, pattern: str, rank: int, keep=None, within=None) -> Column:
    """Spans of all matches of ``pattern``; ``keep`` tests a matched string, ``within`` gives the ``start, end`` in it of spans instead."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("part"), found.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["hit"])
        ok = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"])
        if within is None:
            one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        else:
            one = F.transform(within(x["hit"]), lambda p: F.struct((start + p["start"]).alias("start"), F.lit(rank).alias("rank"), (start + p["end"]).alias("end")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(ok, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(SPAN))


def _steps(run: Column, table: list[float]) -> Column:
    """Log-likelihood ratios of the steps of a run of ``ALPHABET`` characters."""
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # one literal, folded when the plan is made; one call for each number takes seconds
    code = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda a, b: F.element_at(ratios, (a * len(ALPHABET) + b + 1).cast("int")))


def log_ratio(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the steps of a run of ``ALPHABET`` characters."""
    return F.aggregate(_steps(run, table), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.length(run) - 1, F.lit(1))


def stretches(run: Column, table: list[float], ratio: float = RATIO) -> Column:
    """``start, end`` of the random stretches of a run, widened to the separators ``/ = _ -`` around them."""
    kind = "array<struct<start:int,end:int>>"

    def ended(a: Column) -> Column:
        long = (a["end"] - a["start"] >= STRETCH) & (a["best"] / (a["end"] - a["start"] - 1) + MARGIN > ratio)
        return F.when(long, F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["out"])

    def state(i, cur, start, best, end, out):
        return F.struct(i.cast("int").alias("i"), cur.alias("cur"), start.cast("int").alias("start"), best.alias("best"), end.cast("int").alias("end"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        i, cur = a["i"] + 1, a["cur"] + x - MARGIN
        over = (cur <= 0) | (cur < a["best"] - FALL)
        higher = state(i, cur, a["start"], F.greatest(a["best"], cur), F.when(cur > a["best"], a["i"] + 2).otherwise(a["end"]), a["out"])
        return F.when(over, state(i, F.lit(0.0), i, F.lit(0.0), i, ended(a))).otherwise(higher)

    found = F.aggregate(_steps(run, table), state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.array().cast(kind)), step, ended)

    def widened(p: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(run, F.lit(1), p["start"] + 1), "[^/=_-]*$", 0))
        after = F.length(F.regexp_extract(F.substring(run, p["end"], F.length(run)), "^[^/=_-]*", 0))
        return F.struct((p["start"] + 1 - before).cast("int").alias("start"), (p["end"] - 1 + after).cast("int").alias("end"))

    return F.array_distinct(F.transform(found, widened))


def _around(spans: Column, base: Column) -> Column:
    """``spans`` without what ``base`` spans cover: the parts before, between and behind these. The name before an assignment is none."""

    def parts(m: Column) -> Column:
        inside = F.filter(base, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"]))
        starts = F.array_distinct(F.concat(F.array(m["start"]), F.transform(inside, lambda b: b["end"])))
        to = lambda p: F.coalesce(F.array_min(F.transform(F.filter(inside, lambda b: b["start"] >= p), lambda b: b["start"])), m["end"])
        cut = F.transform(starts, lambda p: F.struct(p.alias("start"), m["rank"].alias("rank"), to(p).alias("end")))
        free = lambda x: (x["start"] < x["end"]) & (x["start"] < m["end"]) & ~F.exists(inside, lambda b: (b["start"] <= x["start"]) & (x["start"] < b["end"]))
        named = lambda x: (x["end"] - x["start"] < STRETCH) & F.exists(inside, lambda b: (b["rank"] == 0) & (b["start"] == x["end"]))
        return F.filter(cut, lambda x: free(x) & ~named(x))

    return F.array_distinct(F.flatten(F.transform(spans, parts)))


def scan(docs: DataFrame, *, text_column: str = "text", table: list[float] | None = None, ratio: float = RATIO, out_column: str = "spans") -> DataFrame:
    """``docs`` with ``spans array<struct<start, rank, end>>`` added, ordered by start, then kind; code points, end exclusive.

    ``rank`` numbers ``KINDS``. Spans of kind ``markov`` never overlap a base span; they are split around these. A null text has none.
    Nothing is shuffled, and rows stay as they are, repeated or not; a column named ``out_column`` is replaced; an empty table gives no rows;
    a text of any length is read whole.
    """
    table = train(training_samples(docs.sparkSession)) if table is None else table
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    long_group = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    base = F.concat(
        _when((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), _placed(text, ASSIGN, 0, long_group)),
        _when(F.contains(text, F.lit("AKIA")), _placed(text, ACCESS, 1)),
        _when(text.rlike(HEX), _placed(text, HEX, 2)),
    )
    whole = lambda m: F.array(F.struct(F.lit(0).alias("start"), F.length(m).alias("end")))
    likely = lambda m: F.when(log_ratio(m, table) > ratio, whole(m)).otherwise(stretches(m, table, ratio))
    more = _when(text.rlike(RUN), _placed(text, RUN, 3, within=likely))
    longest = max(map(len, docs.columns), default=0)
    names = [x.ljust(longest + 1, "_") for x in ("__base", "__more")]  # longer than any there is
    out = docs.withColumn(names[0], base).withColumn(names[1], more)
    apart = _around(F.col(names[1]), F.col(names[0]))
    return out.withColumn(out_column, F.array_sort(F.concat(names[0], apart))).drop(*names)


def spelled(spans: Column | str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, *, text_column: str = "text", mask: str = "[SECRET]", spans: str = "spans") -> DataFrame:
    """Replaces the spans that ``scan`` found by ``mask``; overlapping spans by one. Null texts stay null; a text of any length is cut once."""
    text = F.col(text_column)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] < F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), acc), -1)["end"]), longer).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    apart = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)
    chars = F.split(text, "")
    cut = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
    ends = F.concat(F.array(F.lit(0)), F.transform(apart, lambda m: m["end"]))  # where the piece before each span begins
    pieces = F.zip_with(ends, F.transform(apart, lambda m: m["start"]), lambda a, b: F.when(b.isNull(), cut(a, F.size(chars))).otherwise(F.concat(cut(a, b), F.lit(mask))))
    return scanned.withColumn(text_column, F.when(text.isNotNull() & (F.size(spans) > 0), F.array_join(pieces, "")).otherwise(text))


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from ``scan``."""
    count = lambda r: F.size(F.filter("spans", lambda s: s["rank"] == r)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return scanned.select(F.col(id_column).alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
