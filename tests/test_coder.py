"""The event coder over hand-made records, compared with the events that they should give."""

from pyspark.sql import functions as F

from dyadflow.operators import coder as N
from dyadflow.operators import coding as K

WORDS = [("United_States", "actor", "USA"), ("Israel", "actor", "ISR"), ("Syria", "actor", "SYR"), ("Egypt", "actor", "EGY"), ("Nowhere", "actor", "---"), ("president", "agent", "GOV"), ("former", "adj", None), ("the", "det", None), ("and", "conj", None), ("of", "prep", None), ("was", "auxil", None), ("by", "by", None), ("accuse", "verb", "ACCUSE"), ("criticize", "verb", "CRITICIZE"), ("meet", "verb", "MEET"), ("reported", "attrib", "REP"), ("cricket", "noun", "###"), ("give", "verb", "GIVE")]
PATTERNS = [("ACCUSE", "*", "112"), ("ACCUSE", "* + OF {TERROR | WAR}", "1125"), ("CRITICIZE", "*", "111"), ("MEET", "*", "040:041"), ("GIVE", "*", "---"), ("GIVE", "* AID_TO +", "070")]
RECORDS = {
    "a": ("Israel accused Syria of war . { ISR / SYR / 1125 }", None),
    "b": ("Israel and Egypt accused Syria today . { ISR / SYR / 112 } { EGY / SYR / 112 }", None),
    "c": ("Israel was criticized by Syria . { SYR / ISR / 111 }", None),
    "d": ("The president of Egypt accused the United States . { EGYGOV / USA / 112 }", None),
    "e": ("Israel met Syria . { --- }", "no events"),
    "f": ("Israel accused Syria over cricket . { ### }", "discard code in text"),
    "g": ("Israel gives up . { --- }", "only null events"),
    "h": ("Israel gives much aid to Syria . { ISR / SYR / 070 }", None),
    "i": ("Israel meets Egypt . { ISR / EGY / 040 } { EGY / ISR / 041 }", None),
    "j": ("Israel accuses , accuses , accuses Syria . { +++ }", "complex text: verbs"),
    "k": ("  { --- }", "record contains no text"),
}


def run(spark):
    rows = [(d, t.split("{")[0], "{" + t.split("{", 1)[1]) for d, (t, _) in RECORDS.items()]
    records = spark.createDataFrame(rows, "doc string, text string, gold string").withColumn("day", F.lit("2001-02-03").cast("date"))
    words = spark.createDataFrame([(*w, n) for n, w in enumerate(WORDS)], "phrase string, wtype string, code string, ord int")
    patterns = spark.createDataFrame([(r, n, p, c) for n, (r, p, c) in enumerate(PATTERNS)], "root string, ord int, pattern string, code string")
    return records, N.code_events(records, N.Dictionaries(words, patterns), N.Options({"verbs": 3}))


def test_records(spark):
    records, out = run(spark)
    got = {(r["doc"], r["source"], r["target"], r["code"]) for r in out["events"].collect()}
    gold = records.select("doc", F.explode(N.parse_gold(F.col("gold"))).alias("e")).select("doc", "e.*")
    want = {tuple(r) for r in gold.filter("source IS NOT NULL").collect()}
    assert got == want
    assert {r["doc"]: r["problem"] for r in out["problems"].collect()} == {d: p for d, (_, p) in RECORDS.items() if p}
    ranked = lambda df: df.withColumn("n", F.row_number().over(N.W.partitionBy("doc").orderBy("source", "target", "code")))
    verdicts = K.compare_events(ranked(out["events"].select("doc", "source", "target", "code")), ranked(gold.filter("source IS NOT NULL")))
    assert {r["verdict"] for r in verdicts.collect()} == {"same"}


def units(spark, *rows):
    return spark.createDataFrame([(d, i, i + 1, t, w, c) for d, seq in rows for i, (t, w, c) in enumerate(seq)], "doc string, i int, stop int, text string, wtype string, code string")


def test_marks(spark):
    A = lambda c: (c, "actor", c)
    conj, comma, det, word = ("and", "conj", None), (",", "comma", None), ("the", "det", None), ("x", "word", None)
    u = units(spark, ("1", [A("A"), comma, A("B"), conj, det, A("C"), word]), ("2", [A("A"), A("B"), conj, A("C")]), ("3", [A("A"), conj, word, A("B")]))
    got = {(r["doc"], r["i"]): r["compound"] for r in N.mark_compounds(u).collect()}
    assert [got["1", i] for i in range(7)] == [0, 0, 0, 0, 0, 0, None]
    assert [got["2", i] for i in range(4)] == [None, 1, 1, 1]
    assert all(got["3", i] is None for i in range(4))
    agent, former = ("minister", "agent", "GOV"), ("former", "adj", None)
    u = units(spark, ("1", [A("A"), agent]), ("2", [A("A"), former, agent]), ("3", [agent, ("of", "prep", None), A("A")]), ("4", [former, agent, A("A")]), ("5", [agent, word, A("A")]))
    at = N.attach_agents(u, convert=True).collect()
    assert {r["doc"]: r["agent"] for r in at if r["text"] == "A"} == {"1": "GOV", "2": "ELI", "3": "GOV", "4": "ELI", "5": None}
    assert [r["doc"] for r in at if r["text"] == "minister" and r["wtype"] == "actor"] == ["5"]


def test_pronouns(spark):
    """They means an earlier list; he, she and it pass over lists."""
    A = lambda c: (c, "actor", c)
    u = units(spark, ("1", [A("A"), ("and", "conj", None), A("B"), ("x", "word", None), A("C"), ("they", "pron", None), ("he", "pron", None)]), ("2", [A("A"), ("they", "pron", None)]))
    at = K.resolve_pronouns(N.mark_compounds(u).withColumnRenamed("text", "word"))
    got = {(r["doc"], r["i"]): r["actor"] for r in at.collect()}
    assert (got["1", 5], got["1", 6], got["2", 1]) == ("A/B", "C", "A")


def test_time_phrases(spark):
    """The first phrase moves the day; null codes are passed over, discards and complex codes are marked."""
    texts = {1: "said yesterday after a week ago", 2: "said now , a week ago", 3: "said in 1990 yesterday", 4: "said"}
    events = spark.createDataFrame(list(texts.items()), "id int, text string").withColumn("day", F.lit("2001-02-10").cast("date"))
    shifts = spark.createDataFrame([("yesterday", -1, None), ("a week ago", -7, None), ("week ago", -9, None), ("now", 0, "---"), ("in 1990", 0, "###")], "phrase string, days int, code string")
    got = {r["id"]: (r["day"].day, r["mark"]) for r in K.shift_dates(events, shifts).collect()}
    assert got == {1: (9, None), 2: (3, None), 3: (10, "###"), 4: (10, None)}
