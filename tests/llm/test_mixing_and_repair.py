"""Source mixing and conversation repair against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import lru_cache
from itertools import product

import pytest

from strandloom.llm import conversation_repair as repair
from strandloom.llm import mixing

# --- mixing


DOCS = "doc_id long, text string, source string, size string, u int, row string, target long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "r", 7) for i, t, s in rows], DOCS)


def shared_targets(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST_COPIES):
    """Targets by sharing the excess again and again, in fractions."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out = Fraction(share) * sum(sizes.values()), {}
    while len(out) < len(w):
        open_w = sum(x for s, x in w.items() if s not in out)
        above = [s for s in w if s not in out and left * w[s] / open_w > most * sizes[s]]
        if not above:
            return out | {s: left * w[s] / open_w for s in w if s not in out}
        for s in above:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in above)
    return out


def brute_mix(rows, seed=mixing.SEED):
    """(doc_id, source) -> words taken, by sorting each source whole."""
    sizes, of = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        h = hashlib.md5("|".join([str(seed), "" if i is None else str(i), hashlib.md5((t or "").encode()).hexdigest()]).encode()).hexdigest()
        of[s].append(((int(h[:12], 16) + 0.5) / 2**48, -1 if i is None else i, n))
    target, out = shared_targets(sizes), []
    for s, members in of.items():
        whole = int(target[s] / sizes[s]) if sizes[s] else 0
        left = target[s] - whole * sizes[s]
        certain = []
        rest = sorted((m for m in members if m[2]), key=lambda m: -m[2])
        while rest and left * rest[0][2] >= sum(m[2] ** 2 for m in rest):
            certain += [m for m in rest if m[2] == rest[0][2]]
            left -= sum(m[2] for m in rest if m[2] == rest[0][2])
            rest = [m for m in rest if m[2] != rest[0][2]]
        extra = Counter(certain)
        if rest and left > 0:
            c = float(left / sum(m[2] ** 2 for m in rest))
            ranked = sorted(rest, key=lambda m: ((m[0] / (1 - m[0])) / ((c * m[2]) / (1 - c * m[2])), m[1]))
            so_far = 0
            for m in ranked:
                if so_far + m[2] / 2 > left:
                    break
                extra[m] += 1
                so_far += m[2]
        for m, n in Counter(members).items():
            out += [(m[1], m[2], (whole + (j < extra[m])) * m[2]) for j in range(n)]
    return sorted(out), target, sizes


def random_docs(seed, n, sources):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 5 % 400)), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("bins", [1, mixing.BINS])
def test_mix_equals_sorting_whole_sources(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    rows = random_docs(3, 400, ["a", "b", "c", "é", None, "d", "hot", "hot", "hot", "hot", "hot", "hot"])
    rows += [(900, None, "a"), (901, "", "empty"), (None, "one two", "b"), (None, "one two", "b")] + [(7, "same words here", "hot")] * 30
    got = mixing.mix(docs(spark, rows)).collect()
    want, target, sizes = brute_mix(rows)
    assert sorted((-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], r["size"], r["taken"]) for r in got) == want
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    assert Counter((r["source_size"], round(r["target"], 6)) for r in got) == Counter((sizes[s], round(float(target[s]), 6)) for _, _, s in rows)


def test_mix_meets_targets_and_reruns(spark):
    rows = random_docs(5, 3000, ["x", "y", "z", "q", "q", "q"])
    table = docs(spark, rows)
    first, again = (sorted(mixing.report(mixing.mix(t)).collect()) for t in (table, table.repartition(7)))
    assert first == again
    taken, target = Counter(), {}
    for r in first:
        taken[rows[r["doc_id"]][2]] += r["taken"]
        target[rows[r["doc_id"]][2]] = r["target"]
    assert all(abs(taken[s] - t) <= 200 for s, t in target.items())  # half of the longest text at most
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in first)) < 1e-6


def test_long_texts_are_likelier(spark):
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 40)), "s") for i in range(2000)]
    got = mixing.mix(docs(spark, rows)).collect()
    share = lambda n: sum(r["copies"] - 1 for r in got if r["size"] == n) / 1000
    # half of all words are drawn again: p = c size with c = 25,000 / (1000 * 40^2 + 1000 * 10^2)
    assert abs(share(40) - 0.588) < 0.05 and abs(share(10) - 0.147) < 0.05


def test_mix_of_little(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    only = mixing.report(mixing.mix(docs(spark, [(1, None, None), (2, " \n", None)]))).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in only) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    long = mixing.report(mixing.mix(docs(spark, [(1, "word " * 1_000_000, "a"), (2, "x", "b")]))).collect()
    assert {r["doc_id"]: r["size"] for r in long} == {1: 1_000_000, 2: 1}


def test_mixture_repeats_documents(spark):
    table = docs(spark, random_docs(8, 200, ["a", "b"]))
    copies = {r["row"]["doc_id"]: r["copies"] for r in mixing.mix(table).collect()}
    out = mixing.mixture(table)
    assert out.columns == table.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in copies.items() if n})


# --- conversations


TURNS = "conv_id long, turn long, role string, text string, key string, part int, k string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)


def damaged_rows(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if draw == 0:
            continue
        role = "user" if draw == 4 else role
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(c, t, role, text)] * (2 if draw == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """The least (cost, audit) of all edits with at most two insertions in a place, and its repaired turns."""
    best = None
    kinds = faults(rows)
    choices = [[(n, e) for n in range(3) for e in (["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"])] for f in kinds]
    for ways in product(*choices, [(n, "") for n in range(3)]):
        for inserted in product("ua", repeat=sum(n for n, _ in ways)):
            roles, audit, cost, at, out = [], "", 0, 0, []
            for (n, e), row, kind in zip(ways, [*rows, None], [*kinds, ""], strict=True):
                for x in inserted[at : at + n]:
                    roles.append(x)
                    out.append(("user" if x == "u" else "assistant", ""))
                at += n
                audit += "I" * n + e[:1]
                cost += 5 * n + (2 if e == "D" else (1 if e[:1] == "R" else 0) + 5 * (kind == "truncated") if e else 0)
                if e and e != "D":
                    role = row[2] if e == "K" else "user" if e == "Ru" else "assistant"
                    roles.append(role[:1] or "-")
                    out.append((role, row[3]))
            if re.fullmatch("(s?(ua)+)?", "".join(roles)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def backward(rows):
    """The same from the last turn to the first, for long conversations."""
    kinds, nxt = faults(rows), repair.NEXT

    best = {0: (0, ""), 3: (0, ""), 2: (5, "I"), 1: (10, "II")}
    for row, kind in zip(reversed(rows), reversed(kinds), strict=True):
        own, now = row[2][:1], {}
        for s in range(4):
            ways = []
            reach = {s: 0}
            for _ in range(2):
                for a, n in list(reach.items()):
                    for x in "ua":
                        if (a, x) in nxt:
                            reach.setdefault(nxt[a, x], n + 1)
            for m, n in reach.items():
                steps = [("D", m, 2)]
                if kind not in ("blank", "duplicate"):
                    short = 5 if kind == "truncated" else 0
                    steps += [("K", nxt[m, own], short)] if (m, own) in nxt else []
                    steps += [("R", nxt[m, x], 1 + short) for x in "ua" if (m, x) in nxt]
                ways += [(5 * n + c + best[t][0], "I" * n + e + best[t][1]) for e, t, c in steps]
            now[s] = min(ways)
        best = now
    return best[0]


def want_row(rows, found):
    initials = [r[2][:1] for r in rows]
    numbers = [r[1] for r in rows if r[1] is not None]
    cost, audit = found[:2]
    repaired = repair.repaired_turns([r[2:] for r in rows], audit)
    kinds = faults(rows)
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest(),
    )


def check(spark, rows, solve, **kw):
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(turns(spark, rows), **kw).collect()}
    of = defaultdict(list)
    for r in damaged_rows(rows):
        of[r[0]].append(r)
    assert set(got) == {r[0] for r in rows}
    for c in got:
        mine = in_order(of[c])
        assert got[c] == want_row(mine, solve(mine)), (c, mine)


def random_turns(seed, n_conv, most, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None)):
    r = random.Random(seed)
    return [(c, t, r.choice(roles), r.choice(["Yes.", "No!", "well", "", " \t", None, "Ok?  \n", "a. b"])) for c in range(n_conv) for t in range(r.randint(1, most))]


def test_repair_equals_exhaustive_search(spark):
    rows = random_turns(1, 60, 3)
    of = defaultdict(list)
    for r in damaged_rows(rows):
        of[r[0]].append(r)
    for c, mine in of.items():
        mine = in_order(mine)
        if len(mine) < 4:
            cost, audit, out = exhaustive(mine)
            assert backward(mine) == (cost, audit) and repair.repaired_turns([r[2:] for r in mine], audit) == out
    check(spark, rows, backward)


@pytest.mark.parametrize("piece", [2, 5])
def test_repair_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "BATCH_ROWS", 40)
    check(spark, random_turns(2, 40, 14), backward)


def test_one_conversation_has_most_turns(spark):
    rows = random_turns(4, 30, 6) + [(99, t, r, x) for _, t, r, x in [(0, i, *random_turns(i, 1, 1)[0][2:]) for i in range(6000)]]
    check(spark, rows, backward)


def test_repair_of_odd_rows(spark):
    same = [(5, 2, "user", "Again.")] * 40
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "assistant", "x."), (1, None, "assistant", "x."), (1, 4, "system", "."), *same, (6, 1, "user", "long " * 200_000 + "."), (6, 2, "assistant", "é。"), (7, 0, "sage", "Ok.")]
    check(spark, rows, backward)
    assert repair.repair(turns(spark, [])).count() == 0


def test_all_turns_dropped(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = repair.repair(turns(spark, [(3, gone, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repairs_undamaged_turns(spark):
    rows = turns(spark, [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes.")])
    r = repair.repair(rows, rows.select("conv_id", "turn", "role", "text")).first()
    assert (r["cost"], r["audit"]) == (2, "DKK")


@lru_cache
def _best_moves():
    return {(s, c, f, t): (cost, letters) for s, c, f, t, cost, letters in repair.moves()}


def test_no_equal_cost_way_begins_with_another():
    ways = _best_moves().values()
    assert all(not (a != b and a[0] == b[0] and b[1].startswith(a[1])) for a in ways for b in ways)
