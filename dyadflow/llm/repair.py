"""Repair of conversations by a cheapest edit list, found by depth-first branch and bound.

A conversation should read: at most one system turn, then turns of user and assistant in alternation, ending with the
assistant. Edits keep, re-role or delete a turn, or insert an empty one. The search keeps an explicit stack of prefixes, bounds
the cost of what is left by a sum over suffixes, compares with the best (cost, audit) found, and has a table of the best prefix
of every node (turns used, state), which stops worse ones; it ends when the stack is empty, and what it then has is optimal.

Conversations lie in one order over the whole table, cut into ranges of any size. A conversation inside a range is repaired
where it lies. One that may cross a range's end is cut into pieces; each piece is searched for every pair of states before and
after it, and pieces are joined in a tree. Two edit lists of a piece with equal cost and states never begin with one another
(an insertion adds cost), so the least audit of the whole is made of least audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What keeping or re-roling a truncated turn adds.
CUT_SHORT = 5
#: States: nothing yet, after the system turn, after a user's, after an assistant's; and where an initial leads.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Neighbours that are in order.
LEGAL = {"su", "ua", "au"}
#: Turns of a search; longer conversations are joined from pieces of this size.
PIECE = 24
#: A turn as the search sees it: its initial (x if it's none of s, u, a), in capitals if it is cut short, or - if it must go.
MUST_GO = "-"

#: The best (cost, audit) for each pair of states before and after a piece.
Table = dict[tuple[int, int], tuple[int, str]]


def _moves(turn: str | None, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, state after it, cost) of what can be done at a turn, or with None only insertions; a turn is used up by all else."""
    if turn is not None:
        yield DELETE, state, COST[DELETE]
        if turn != MUST_GO:
            more = CUT_SHORT * turn.isupper()
            if (to := NEXT.get((state, turn.lower()))) is not None:
                yield KEEP, to, COST[KEEP] + more
            for initial in ROLES:
                if (to := NEXT.get((state, initial))) is not None:
                    yield REROLE, to, COST[REROLE] + more
    for initial in ROLES:
        if (to := NEXT.get((state, initial))) is not None:
            yield INSERT, to, COST[INSERT]


@lru_cache(200_000)
def search(turns: str, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """The cheapest edits of these turns from the state start to one of the goals: cost and audit, ties by the least audit."""
    least = [0] * (len(turns) + 1)
    for i in range(len(turns) - 1, -1, -1):
        least[i] = least[i + 1] + (COST[DELETE] if turns[i] == MUST_GO or turns[i].isupper() else 0)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if best and (cost + least[at], audit) > (best[0], best[1][: len(audit)]):
            continue
        if (at, state) in seen and seen[at, state] <= (cost, audit):
            continue
        seen[at, state] = cost, audit
        if at == len(turns) and state in goals and (best is None or (cost, audit) < best):
            best = cost, audit
        ahead = [(cost + c, audit + edit, at + (edit != INSERT), to) for edit, to, c in _moves(turns[at] if at < len(turns) else None, state)]
        # The cheapest is popped first, so a good incumbent is found soon.
        for c, a, i, to in sorted(ahead, reverse=True):
            stack.append((i, to, c, a))
    return best


def table_of(turns: str, starts: tuple[int, ...] = tuple(range(STATES))) -> Table:
    return {(a, b): found for a in starts for b in range(STATES) if (found := search(turns, a, (b,)))}


def joined(first: Table, second: Table) -> Table:
    out: Table = {}
    for (a, b), (cost, audit) in first.items():
        for (c, d), (more, rest) in second.items():
            if b == c and ((a, d) not in out or (cost + more, audit + rest) < out[a, d]):
                out[a, d] = cost + more, audit + rest
    return out


def cheapest(table: Table) -> tuple[int, str]:
    return min(found for (a, b), found in table.items() if a == 0 and b in FINAL)


def solve(turns: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(turns) <= PIECE:
        found = search(turns, 0, FINAL)
        assert found is not None  # deleting all turns is always possible
        return found
    tables = [table_of(turns[i : i + PIECE], (0,) if i == 0 else tuple(range(STATES))) for i in range(0, len(turns), PIECE)]
    return cheapest(_tree(tables))


def _tree(tables: list[Table]) -> Table:
    """Neighbouring tables joined two by two."""
    while len(tables) > 1:
        tables = [joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def fault_of(text: str) -> str:
    """blank, truncated or nothing, by the last character that isn't ASCII white space."""
    end = text.rstrip(" \t\n\x0b\x0c\r")
    return "blank" if not end else "" if end[-1] in ".!?" else "truncated"


@dataclass
class Counts:
    """What is counted over turns in order, and can be added for neighbouring stretches."""

    first: int | None = None
    last: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    head: str | None = None
    tail: str | None = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.illegal += self.tail is not None and self.tail + initial not in LEGAL
        self.head, self.tail = initial if self.head is None else self.head, initial

    def then(self, o: Counts) -> Counts:
        meet = self.tail is not None and o.head is not None and self.tail + o.head not in LEGAL
        return Counts(
            o.first if self.first is None else self.first, self.last if o.last is None else o.last, self.distinct + o.distinct - (self.last is not None and self.last == o.first),
            self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated, self.illegal + o.illegal + meet,
            o.head if self.head is None else self.head, self.tail if o.tail is None else o.tail,
        )

    def numbers(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal


def symbol(role: str, fault: str) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return MUST_GO if fault in ("blank", "duplicate") else initial.upper() if fault else initial


@dataclass
class Writer:
    """Hashes the repaired conversation as edits and turns come in."""

    digest: object = field(default_factory=hashlib.sha256)
    state: int = 0
    begun: bool = False

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun = True

    def edit(self, edit: str, role: str = "", text: str = "") -> None:
        if edit == DELETE:
            return
        if edit != KEEP:
            role = ROLES["a" if self.state == 2 else "u"]
        self.state = NEXT[self.state, role[0]]
        self._put(role, text)


def replay(writer: Writer, audit: str, at: int, role: str, text: str) -> int:
    """Insertions due before a turn, then its own edit; the place in the audit after it."""
    while audit[at] == INSERT:
        writer.edit(INSERT)
        at += 1
    writer.edit(audit[at], role, text)
    return at + 1


def finish(writer: Writer, audit: str, at: int) -> str:
    for _ in range(at, len(audit)):
        writer.edit(INSERT)
    return writer.digest.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _result(conv: int | None, counts: Counts, found: tuple[int, str], digest: str) -> tuple:
    return conv, *counts.numbers(), *found, digest


def repair_one(conv: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result row of one conversation of (turn, role, text) in order."""
    counts, turns, seen = Counts(), [], set()
    for turn, role, text in rows:
        fault = fault_of(text)
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if fault != "blank" and name in seen:
            fault = "duplicate"
        seen.add(name)
        counts.add(turn, role[:1], fault)
        turns.append(symbol(role, fault))
    found = solve("".join(turns))
    writer, at = Writer(), 0
    for _, role, text in rows:
        at = replay(writer, found[1], at, role, text)
    return _result(conv, counts, found, finish(writer, found[1], at))


def damaged(convs: DataFrame) -> DataFrame:
    """The test damage of conversations (conv_id, turn, role, text), chosen by the crc32 of conv_id:turn: each row with `live`,
    which is false for a dropped one. Nulls read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("live"), copies.alias("_copy")).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """Per conv_id of rows (conv_id, turn, role, text, live): its faults, the cheapest edits, and the hash of what they make.

    Rows come by turn, null ones first, then by role and text, so copies are neighbours. A row's first fault counts: blank, duplicate
    (role and text seen earlier), truncated. Rows that aren't live only make their conversation known; one without live rows
    has zeros, an empty audit and the hash of nothing. A null conv_id is a conversation of its own; roles other than system, user
    and assistant by their initials must be re-roled or deleted; texts are taken whole; an empty table gives no rows. A
    conversation may be of any length: its turns are spread over ranges and pieces, and only its repaired text, whose hash is
    one sequence by nature, streams through one task."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "live"]
    ranges = rows.select("conv_id", "turn", "role", "text", "live").repartitionByRange(*order).sortWithinPartitions(*order)
    # at: the place in the order, fixed from here on as it's written; range and place within it.
    out = materialise(ranges.withColumn("at", F.monotonically_increasing_id()).mapInPandas(_in_range, f"{RESULT}, rest struct<turn: long, role: string, text: string, live: boolean, at: long>"), "repaired")
    whole = out.filter("rest IS NULL").select(*NAMES)
    return whole.unionByName(repair_across(out.filter("rest IS NOT NULL").select("conv_id", "rest.*")))


def _in_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations that begin and end within a range as result rows; those at its ends, row by row, for later."""
    done, rest = [], []
    own, now, first = [], None, True

    def close(last: bool) -> None:
        nonlocal own, first
        if own and (first or last):
            rest.extend((now, *row) for row in own)
        elif own:
            done.append(repair_one(now, [row[:3] for row in own if row[3]]))
        own, first = [], False

    def flush() -> pd.DataFrame:
        nonlocal done, rest
        made = pd.DataFrame([(*r, None) for r in done] + [(r[0], *[None] * (len(NAMES) - 1), dict(zip(("turn", "role", "text", "live", "at"), r[1:], strict=True))) for r in rest], columns=[*NAMES, "rest"])
        done, rest = [], []
        return made.astype({n: "Int64" for n in NAMES[:7]})

    begun = False
    for batch in batches:
        ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
        turns = [None if pd.isna(x) else int(x) for x in batch["turn"]]
        for row in zip(ids, turns, batch["role"], batch["text"], batch["live"], batch["at"], strict=True):
            if not begun or row[0] != now:
                if begun:
                    close(False)
                now, begun = row[0], True
            own.append(row[1:])
            # The first conversation of a range goes on as rows in any case, so it isn't held.
            if first and len(own) >= 1000:
                rest.extend((now, *r) for r in own)
                own = []
        yield flush()
    close(True)
    yield flush()


PIECES = "conv_id long, at long, first long, last long, distinct long, blank long, duplicate long, truncated long, illegal long, head string, tail string, states array<struct<a: int, b: int, cost: long, audit: string>>"
#: How many low bits of `at` pieces of each level of the tree share.
LEVELS = (10, 20, 33, 43, 53, 63)


def _piece_row(conv: int | None, at: int, c: Counts, table: Table) -> tuple:
    return conv, at, c.first, c.last, c.distinct, c.blank, c.duplicate, c.truncated, c.illegal, c.head, c.tail, [{"a": a, "b": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in table.items()]


def _pieces(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in PIECES.split(", states")[0].split(", ")] + ["states"]
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names[:9]})


def _id(key: object) -> int | None:
    return None if pd.isna(key) else int(key)


def _first_pieces(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The piece of the rows of one conversation that lie in one stretch of the order."""
    rows = rows.sort_values("at")
    counts, turns = Counts(), []
    for turn, role, text, live, first in zip(rows["turn"], rows["role"], rows["text"], rows["live"], rows["is_first"], strict=True):
        if not live:
            continue
        fault = fault_of(text)
        fault = "duplicate" if fault != "blank" and not first else fault
        counts.add(_id(turn), role[:1], fault)
        turns.append(symbol(role, fault))
    whole = "".join(turns)
    return _pieces([_piece_row(_id(key[0]), int(rows["at"].iloc[0]), counts, _tree([table_of(whole[i : i + PIECE]) for i in range(0, max(1, len(whole)), PIECE)]))])


def _join_pieces(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One piece of the neighbouring pieces of a conversation."""
    rows = rows.sort_values("at")
    counts, tables = Counts(), []
    for r in rows.itertuples(index=False):
        counts = counts.then(Counts(_id(r.first), _id(r.last), int(r.distinct), int(r.blank), int(r.duplicate), int(r.truncated), int(r.illegal), r.head, r.tail))
        tables.append({(s["a"], s["b"]): (s["cost"], s["audit"]) for s in r.states})
    return _pieces([_piece_row(_id(key[0]), int(rows["at"].iloc[0]), counts, _tree(tables))])


def repair_across(rest: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The result rows of conversations that lie in any number of ranges: conv_id, turn, role, text, live, at (place in the order)."""
    name = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "role", "text").alias("h2")]
    firsts = rest.filter("live").groupBy("conv_id", *name).agg(F.min("at").alias("_first")).select("_first")
    marked = rest.join(firsts, F.col("at") == F.col("_first"), "left").withColumn("is_first", F.col("_first").isNotNull()).drop("_first")
    pieces = materialise(marked.groupBy("conv_id", F.shiftright("at", levels[0]).alias("_part")).applyInPandas(_first_pieces, PIECES), "pieces")
    for bits in levels[1:]:
        n = pieces.agg(F.count("*").alias("n"), F.count_distinct(F.struct("conv_id")).alias("m")).first()
        if n.n == n.m:
            break
        pieces = materialise(pieces.groupBy("conv_id", F.shiftright("at", bits).alias("_part")).applyInPandas(_join_pieces, PIECES), "pieces")
    # A conversation's edits come before its turns, and its text is hashed as it streams by.
    heads = pieces.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*[c for c in pieces.columns if c not in ("conv_id", "at")]).alias("piece"))
    turns = rest.filter("live").select("conv_id", "at", "role", "text", F.lit(None).cast(heads.schema["piece"].dataType).alias("piece"))
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at").mapInArrow(_hash_stream, RESULT)


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, counts, found, writer, at = None, None, None, None, 0

    def closed() -> list[tuple]:
        return [] if writer is None else [_result(conv, counts, found, finish(writer, found[1], at))]

    schema = pa.schema([(n, pa.int64()) for n in NAMES[:7]] + [(n, pa.string()) for n in NAMES[7:]])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        out = []
        for own, place, role, text, piece in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if place == -1:
                out += closed()
                conv, writer, at = own, Writer(), 0
                counts = Counts(*[piece[k] for k in ("first", "last", "distinct", "blank", "duplicate", "truncated", "illegal", "head", "tail")])
                found = cheapest({(s["a"], s["b"]): (s["cost"], s["audit"]) for s in piece["states"]})
            else:
                at = replay(writer, found[1], at, role, text)
        if out:
            yield batch_of(out)
    if out := closed():
        yield batch_of(out)


def repair_damaged(convs: DataFrame) -> DataFrame:
    """repair() of the rows that damaged() makes of conversations (conv_id, turn, role, text); other columns are ignored."""
    return repair(damaged(convs))
