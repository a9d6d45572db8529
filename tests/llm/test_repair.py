"""Conversation repair against a dynamic program over all states, and the ways in which conversations are cut."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from dyadflow.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, kind string, at string, cost int"


def best_by_hand(turns):
    """turns: (initial, must go, cut short). The least (cost, audit) by a table over turns used, states and insertions."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    now = {"": (0, "")}
    for i in range(len(turns) + 1):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                for to in "ua":
                    if (state, to) in step:
                        now[step[state, to]] = min(now.get(step[state, to], (10**9, "")), (cost + 5, audit + "I"))
        if i == len(turns):
            break
        initial, gone, short = turns[i]
        after = {}
        for state, (cost, audit) in now.items():
            moves = [("D", state, 2)]
            if not gone:
                moves += [("K", step[state, initial], 5 * short)] if (state, initial) in step else []
                moves += [("R", step[state, to], 1 + 5 * short) for to in "ua" if (state, to) in step]
            for edit, to, more in moves:
                after[to] = min(after.get(to, (10**9, "")), (cost + more, audit + edit))
        now = after
    return min(now[s] for s in ("", "a") if s in now)


def whole_by_hand(rows):
    """The contract's columns for (conv_id, turn, role, text) rows by plain loops."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit = best_by_hand([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(kept, faults, strict=True)])
        made, left = [], iter(kept)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit in "IR":
                role = "assistant" if made and made[-1][0] == "u" else "user"
            made += [] if edit == "D" else [f"{role}:{text}"]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


def plain(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_search_is_optimal():
    rng = random.Random(5)
    for n in [*range(7)] * 60 + [30, 60, 200]:
        turns = [(rng.choice("suaaux"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        code = "".join("-" if gone else i.upper() if short else i for i, gone, short in turns)
        assert repair.solve(code) == best_by_hand(turns), code


def test_query_same_as_by_hand(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, SF).collect()
    assert len(got) == len({r[0] for r in rows}) and plain(got) == whole_by_hand(rows)


def odd_rows():
    rng, roles = random.Random(9), ["user", "assistant", "system", "tool", "", None]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(["Hi.", "And", "", " \n", None, "Why?", "ends here . \t"])) for c in range(40) for _ in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", "null id.") for t in range(3)] + [(77, 5, "user", "same.")] * 4 + [(78, 1, "user", "long " * 50_000 + ".")]
    return rows + [(500, t, ("user", "assistant")[t % 2], f"turn {t % 700}" + "." * (t % 5 > 0)) for t in range(3000)]


def test_odd_rows_and_a_hot_conversation(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "?", "?", 1) for r in rows], SCHEMA)
    assert plain(queries.repair_damaged(df).collect()) == whole_by_hand(rows)
    assert queries.repair_damaged(df.limit(0)).count() == 0


def test_all_conversations_across_ranges(spark):
    rows = odd_rows()
    df = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    numbered = df.orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").coalesce(1).withColumn("at", F.monotonically_increasing_id())
    assert plain(repair.repair_across(numbered, (3, 5, 8, 20, 40)).collect()) == whole_by_hand(rows)
