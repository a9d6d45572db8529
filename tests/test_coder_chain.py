"""The coder's whole chain over hand-made records with the events that they should give, compared as coded and gold events."""

from datetime import date

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.operators import coder as N
from dyadflow.operators import coding as K
from dyadflow.operators import patterns as P

WORDS = [
    ("U.S.", "actor", "USA"), ("U.N.", "actor", "UNO"), ("Israel", "actor", "ISR"), ("Syria", "actor", "SYR"), ("Egypt", "actor", "EGY"), ("Iran", "actor", "IRN"), ("Soviet_Union", "actor", "SOVIET"), ("Foreign Ministry", "actor", "FOR"),
    ("minister", "agent", "GOV"), ("the", "det", None), ("and", "conj", None), ("while", "conj", None), ("he", "pron", None), ("they", "pron", None), ("was", "auxil", None), ("by", "by", None), ("of", "prep", None),
    ("accuse", "verb", "ACCUSE"), ("praise", "verb", "PRAISE"), ("meet", "verb", "MEET"), ("met", "verb", "MEET"), ("break off", "verb", "BREAK"), ("say", "verb", "SAY"), ("reported", "attrib", "REPORT"), ("according_to", "attrib", "ACCORD"), ("denied", "verb", "DENY"),
]
PATTERNS = [
    ("ACCUSE", "*", "112"), ("ACCUSE", "* + OF {TERROR | STATE_TERROR}", "1125"), ("PRAISE", "*", "051"), ("MEET", "*", "040"), ("MEET", "% *", "041"), ("BREAK", "* TIES", "160"), ("SAY", "*", "010"), ("SAY", "@ * $ WILL ^ +", "013"), ("DENY", "*", "---"),
]
REPORTERS = [("REPORT", "*", "A"), ("ACCORD", "* @", "A"), ("ACCORD", "* RUMOUR", "###")]
#: doc: story, sentence, text, gold, problem.
RECORDS = {
    "stops": ("s0", 1, 'The U.S. accused the U.N.; "why?" { USA / UNO / 112 }', None),
    "skipped": ("s0", 3, "Israel breaks quickly off all pact ties with Egypt { ISR / EGY / 160 }", None),
    "joined": ("s0", 5, "Foreign trade Ministry praised Egypt { FOR / EGY / 051 }", None),
    "terror": ("s0", 7, "Israel accused Syria yesterday of state terror { ISR / SYR / 1125 }", None),
    "lists": ("s0", 9, "Israel and Egypt met yesterday { ISR / EGY / 041 } { EGY / ISR / 041 }", None),
    "slots": ("s0", 11, "Iran says Israel will Egypt Syria { ISR / SYR / 013 }", None),
    "reported": ("s0", 13, "Israel accused Syria, Iran reported today { ISR / SYR / 112 }", None),
    "accord": ("s0", 15, "According to the Iran desk Israel accused Syria { IRN / SYR / 112 }", None),
    "rumour": ("s0", 17, "According to rumour Israel accused Syria { ### }", "discard code in text"),
    "comma": ("s0", 19, "Israel, which Egypt praised last week, accused Syria { ISR / SYR / 112 }", None),
    "clauses": ("s0", 21, "Israel accused Syria while Egypt praised Iran { ISR / SYR / 112 } { EGY / IRN / 051 }", None),
    "first": ("s0", 23, "Israel accused Syria and praised Egypt { ISR / SYR / 112 } { ISR / EGY / 051 }", None),
    "one": ("s1", 1, "Israel met someone and he accused Syria { ISR / XXX / 040 } { ISR / SYR / 112 }", None),
    "carried": ("s1", 2, "He praised Egypt { ISR / EGY / 051 }", None),
    "gap": ("s1", 4, "He praised Egypt { EGY / XXX / 051 }", None),
    "two": ("s2", 1, "Israel and Egypt accused Syria { ISR / SYR / 112 } { EGY / SYR / 112 }", None),
    "both": ("s2", 2, "They praised Iran { ISR / IRN / 051 } { EGY / IRN / 051 }", None),
    "old": ("s3", 1, "The Soviet Union accused Syria { USR / SYR / 112 }", None),
    "new": ("s3", 5, "The Soviet Union accused Syria { RUS / SYR / 112 }", None),
    "denied": ("s4", 1, "Israel denied it with Egypt { --- }", "only null events"),
    "idle": ("s4", 3, "Israel or Egypt walked { --- }", "no events"),
}
DAYS = {"old": date(1985, 3, 1), "new": date(1999, 3, 1)}


@pytest.fixture(scope="module")
def coded(spark):
    rows = [(d, s, n, t.split("{")[0], "{" + t.split("{", 1)[1], DAYS.get(d, date(2001, 2, 3))) for d, (s, n, t, _) in RECORDS.items()]
    records = spark.createDataFrame(rows, "doc string, story string, seq int, text string, gold string, day date")
    table = lambda rows: spark.createDataFrame([(r, n, p, c) for n, (r, p, c) in enumerate(rows)], "root string, ord int, pattern string, code string")
    words = spark.createDataFrame([(*w, n) for n, w in enumerate(WORDS)] + [("breaks off", "verb", "BREAK", 91)], "phrase string, wtype string, code string, ord int")
    dated = spark.createDataFrame([("SOVIET", 0, "USR", None, date(1991, 12, 31)), ("SOVIET", 1, "RUS", date(1992, 1, 1), None)], "name string, ord int, code string, valid_from date, valid_to date")
    shifts = spark.createDataFrame([("yesterday", -1, None), ("last week", -7, None)], "phrase string, days int, code string")
    counted = spark.createDataFrame([("the", "article"), ("of", "prep")], "word string, category string")
    issues = spark.createDataFrame([("pact", "treaty", "T", 1)], "phrase string, category string, code string, value int")
    known = N.Dictionaries(words, table(PATTERNS), table(REPORTERS), shifts, dated, issues, counted)
    options = N.Options(comma=(2, 6), source="XXX", target="XXX", mode="also", categories={"treaty": ("first", "none")}, word_categories=("article", "prep"))
    return records, {name: df.cache() for name, df in N.code_events(records, known, options).items()}


def test_events(coded):
    records, out = coded
    gold = records.select("doc", F.explode(N.parse_gold(F.col("gold"))).alias("e")).select("doc", "e.*").filter("source IS NOT NULL")
    pairs = lambda df: {(r["doc"], r["source"], r["target"], r["code"]) for r in df.collect()}
    assert (pairs(out["events"]) - pairs(gold), pairs(gold) - pairs(out["events"])) == (set(), set())
    ranked = lambda df: df.select("doc", F.row_number().over(W.partitionBy("doc").orderBy("source", "target", "code")).alias("n"), "source", "target", "code")
    assert {r["verdict"] for r in K.compare_events(ranked(out["events"]), ranked(gold)).collect()} == {"same"}


def test_problems_and_idle_sentences(coded):
    _, out = coded
    assert {r["doc"]: r["problem"] for r in out["problems"].collect()} == {d: p for d, (*_, p) in RECORDS.items() if p}
    assert {(r["doc"], r["source"], r["target"]) for r in out["non_events"].collect()} == {("denied", "ISR", "EGY"), ("idle", "ISR", "EGY")}


def test_days_reporters_issues_and_counts(coded):
    _, out = coded
    at = {r["doc"]: r for r in out["events"].collect()}
    assert (at["terror"]["day"], at["comma"]["day"], at["stops"]["day"]) == (date(2001, 2, 2), date(2001, 1, 27), date(2001, 2, 3))
    assert (at["reported"]["attrib"], at["accord"]["attrib"], at["slots"]["attrib"], at["stops"]["attrib"]) == ("IRN", "IRN", "IRN", None)
    assert {r["doc"]: r["treaty"] for r in out["issues"].collect()}["skipped"] == "T"
    assert {r["doc"]: (r["article"], r["prep"]) for r in out["counts"].collect()}["stops"] == (2, 0)


def test_roles_in_order(spark):
    """Sources hold from verb to verb until an actor opens a clause, a pattern gives one or a passive verb has gone by."""
    actors = [("a", 0, 1, "A"), ("a", 0, 3, "A"), ("a", 0, 5, "B"), ("a", 1, 8, "C"), ("a", 2, 12, "D"), ("b", 0, 4, "A"), ("b", 0, 6, "B"), ("c", 0, 1, "A"), ("c", 0, 2, "B"), ("c", 1, 9, "C")]
    verbs = [("a", 0, 2, False, None, None, None), ("a", 0, 4, False, None, None, None), ("a", 1, 7, False, None, None, None), ("a", 2, 13, False, "D", None, None), ("b", 0, 1, False, None, None, None), ("b", 0, 5, False, None, "B", None), ("c", 0, 3, True, None, None, None), ("c", 1, 8, False, None, None, None)]
    a = spark.createDataFrame(actors, "doc string, clause long, pos int, actor string")
    v = spark.createDataFrame(verbs, "doc string, clause long, i int, passive boolean, opener string, given_source string, given_target string")
    got = lambda *x: {(r["doc"], r["i"]): (r["source"], r["target"]) for r in N.roles_in_order(v, a, *x).collect()}
    assert got() == {("a", 2): ("A", "B"), ("a", 4): ("A", "B"), ("a", 7): ("A", "C"), ("a", 13): ("D", None), ("b", 1): ("A", "B"), ("b", 5): ("B", "A"), ("c", 3): ("A", "B"), ("c", 8): ("C", None)}
    assert (got(True)["b", 1], got(False, True)["b", 5], got(False, True)["c", 3]) == ((None, "A"), ("B", None), ("A", None))


def test_scope_and_modes(spark):
    rows = [("a", 0, 1, "---"), ("a", 0, 2, "01"), ("a", 0, 3, "02"), ("a", 1, 5, "03"), ("a", 1, 6, "04")]
    events = spark.createDataFrame(rows, "doc string, clause long, n int, code string")
    got = lambda *a: [r["n"] for r in N.stop_at_main(events, *a).orderBy("n").collect()]
    assert (got("all"), got("clause"), got("sentence"), got("sentence", ("01",))) == ([1, 2, 3, 5, 6], [1, 2, 5], [1, 2], [1, 2, 3])
    units = spark.createDataFrame([("a", 0, "actor", "X"), ("a", 1, "actor", "Y"), ("b", 0, "actor", "X"), ("b", 1, "actor", "Z")], "doc string, i int, wtype string, code string")
    pairs = lambda mode: {r["doc"] for r in N.non_events(units, events, mode).collect()}
    assert (pairs("off"), pairs("also"), pairs("only")) == (set(), {"b"}, {"b"})


def test_output_options_and_order(spark):
    events = spark.createDataFrame([("a", 0, "X", "Y", "01", "*", 3, 5), ("b", 0, "Y", "X", "02", "* +", 1, 2)], "doc string, n int, source string, target string, code string, pattern string, source_at int, verb_at int").withColumn("target_at", F.lit(None).cast("int"))
    records = spark.createDataFrame([("a", date(2001, 5, 1), "s", 4), ("b", date(2001, 4, 30), "s", 5)], "doc string, day date, story string, seq int")
    labels = spark.createDataFrame([("01", "yes")], "code string, label string")
    out = N.format_events(events, records, labels, ("label", "places", "story", "seq"))
    assert out.columns == ["doc", "day", "source", "target", "code", "label", "source_at", "target_at", "verb_at", "story", "seq"]
    assert [r["doc"] for r in N.by_date(events.join(records, "doc")).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="no output"):
        N.format_events(events, records, labels, ("colour",))


def phrases_by_hand(words, entries):
    """Units of a sentence: at each free word the entry with most letters; entries are lists of chunks of words."""
    held, out = set(), []
    for start in range(len(words)):
        if start in held:
            continue
        best = None
        for n, (chunks, kind) in enumerate(entries):
            at, places = start, []
            for k, chunk in enumerate(chunks):
                stop = next((i for i in range(start, len(words)) if words[i] == ","), len(words))
                spots = [start] if k == 0 else range(at, len(words))
                hit = next((i for i in spots if i + len(chunk) <= stop and words[i : i + len(chunk)] == chunk), None)
                if hit is None:
                    break
                places += range(hit, hit + len(chunk))
                at = hit + len(chunk)
            else:
                size = sum(len(w) for c in chunks for w in c)
                if best is None or size > best[0]:
                    best = size, places, kind, n
        if best:
            held |= set(best[1])
            out.append((start, tuple(best[1]), best[2]))
    return out


def test_phrases_same_as_by_hand(spark):
    """Random sentences of few words, so that gaps, overlaps and ties are common."""
    import random

    rng = random.Random(6)
    vocab, sentences = ["a", "bb", "ccc", "dd", "e", ","], {}
    phrases = [("a_bb", "noun"), ("a ccc", "verb"), ("bb ccc e", "noun"), ("dd", "word"), ("a_bb dd_e", "attrib"), ("ccc_ccc", "word"), ("e a", "prep"), ("bb bb", "attrib")]
    for d in range(150):
        sentences[d] = [rng.choice(vocab) for _ in range(rng.randrange(1, 14))]
    tokens = spark.createDataFrame([(d, i, w) for d, ws in sentences.items() for i, w in enumerate(ws)], "doc int, i int, word string")
    words = spark.createDataFrame([(p + "=", k, k, n) for n, (p, k) in enumerate(phrases)], "phrase string, wtype string, code string, ord int")
    got = {}
    for r in P.choose_phrases(P.phrase_places(tokens, P.surface_forms(words, N.ENDINGS), 2)).collect():
        got.setdefault(r["doc"], []).append((r["start"], tuple(r["places"]), r["wtype"]))
    entries = [([c.split("_") for c in p.split(" ")], k) for p, k in phrases]
    for d, ws in sentences.items():
        assert sorted(got.get(d, [])) == phrases_by_hand(ws, entries), ws


def test_endings(spark):
    words = spark.createDataFrame([("accuse", "verb", "V", 0), ("ally=", "actor", "A", 1), ("Old_Guard", "actor", "B", 2)], "phrase string, wtype string, code string, ord int")
    forms = {" ".join(r["chunks"]) for r in P.surface_forms(words, N.ENDINGS).collect()}
    assert {"accuse", "accused", "accuses", "accuseing", "ally", "old guard's", "old guards"} <= forms and "allys" not in forms


def test_long_record_in_linear_time(spark):
    """A record of 10,000 words with a verb in each ten: every connector and slot, in time that grows with the words."""
    import time

    def seconds(n):
        rows = [("d", i, i + 1, ("V" if i % 10 == 5 else f"w{i % 7}").upper() if i % 10 != 1 else "X", "verb" if i % 10 == 5 else "actor" if i % 10 == 1 else "word", "R" if i % 10 == 5 else "A" if i % 10 == 1 else None, i // 50) for i in range(n)]
        units = spark.createDataFrame(rows, "doc string, i int, stop int, text string, wtype string, code string, clause long").cache()
        units.count()
        patterns = spark.createDataFrame([("R", k, p, str(k)) for k, p in enumerate(["*", "$ W1 W2 W3 * + W4 W5", "W1 W1 W1 W1 W1 W9 * W9", "$ * W6 {W1 | W2}_W3 +"])], "root string, ord int, pattern string, code string")
        began = time.perf_counter()
        assert N.match_verb_patterns(units, patterns).count() == n // 10
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(10_000) < 60


def test_patterns_with_odd_marks(spark):
    units = spark.createDataFrame([("d", i, i + 1, w, "verb" if w == "GO" else "word", "R" if w == "GO" else None, 0) for i, w in enumerate(["(X", "GO", "[Y", "A+B", "C\\D"])], "doc string, i int, stop int, text string, wtype string, code string, clause long")
    table = lambda *ps: spark.createDataFrame([("R", n, p, str(n)) for n, p in enumerate(ps)], "root string, ord int, pattern string, code string")
    got = lambda *ps: [r["code"] for r in N.match_verb_patterns(units, table(*ps)).collect()]
    assert (got("*", "(X_* [Y"), got("*", "* A+B"), got("*", "* C\\D_"), got("*", "* C_"), got("*", "* C"), got("no mark"), got("*", "* {[Y | }")) == (["1"], ["1"], ["1"], ["0"], ["1"], [], ["1"])
