"""Coding sentences into events with actor and verb dictionaries: steps over word-typed tokens and coded events.

tokens are (doc, i, word, wtype, ...); events are (doc, n, source, target, code, ...), n being their order in the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.lineage import cut
from dyadflow.operators.extract import name_candidates


def clean_text(text: Column, brackets: bool = False) -> Column:
    """Record text ready for the dictionaries. Comments go (one without an end to the text's end); ; : ( ) are commas; commas and
    double quotes stand apart, but commas inside numbers go; stops stay inside numbers and behind a capital (U.N.) and are blanks
    elsewhere; apostrophes and $ stay; other ASCII punctuation is a blank; blanks are squeezed. With `brackets` what stands
    in [ ] goes too, and what stands before the first letter or bracket."""
    out = F.regexp_replace(text, r"^[^A-Za-z\[]+", "") if brackets else text
    out = F.regexp_replace(out, r"(?s)/\*.*?(?:\*/|\z)", "")
    if brackets:
        out = F.regexp_replace(out, r"\[[^\]]*(?:\]|\z)", "")
    out = F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9])", "")
    out = F.regexp_replace(out, r"(?<![A-Z0-9])\.|(?<=[0-9])\.(?![0-9])", " ")
    out = F.regexp_replace(out, r"[;:(),]", " , ")
    out = F.regexp_replace(out, '"', ' " ')
    out = F.regexp_replace(out, r"[!#%&*+/<=>?@\[\\\]^_`{|}~-]", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def all_capitals(text: Column) -> Column:
    return text.rlike("[A-Z]") & ~text.rlike("[a-z]")


#: A set's name in a pattern, which ends where its word does.
SET = r"&([^\s_=~|{}&]+)"
SET_END = r"\E(?![^\s_=~|{}&])"


def synset_cycle(sets: DataFrame) -> str | None:
    """A set of sets (name, member) that leads to itself, if there is one."""
    step = sets.select(F.col("name").alias("a"), F.explode(F.regexp_extract_all("member", F.lit(SET), F.lit(1))).alias("b")).distinct()
    reach, known = cut(step), -1
    while known != (known := reach.count()):
        if loop := reach.filter("a = b").first():
            return loop.a
        further = reach.select("a", F.col("b").alias("_m")).join(reach.select(F.col("a").alias("_m"), "b"), "_m").select("a", "b")
        reach = cut(reach.union(further).distinct())
    return None


def expand_synsets(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """entries (id, pattern) with each &NAME of sets (name, member) replaced by its members, in all combinations and at any
    depth; other & words stay. A set that leads to itself is an error. Both are dictionaries, whose rounds are as many as a pattern
    has names, those of nested sets included."""
    if loop := synset_cycle(sets):
        raise ValueError(f"set &{loop} contains itself")
    known = sets.groupBy(F.col("name").alias("_s")).agg(F.collect_set("member").alias("_ms"))
    out = entries.select("id", "pattern").distinct()
    while True:
        # The first name that is a set; what it leaves behind may hold names again.
        names = out.select("id", "pattern", F.posexplode(F.regexp_extract_all("pattern", F.lit(SET), F.lit(1))).alias("_k", "_s"))
        first = names.join(known, "_s").groupBy("id", "pattern").agg(F.min_by(F.struct("_s", "_ms"), "_k").alias("_f")).select("id", "pattern", "_f.*")
        if first.isEmpty():
            return out
        at = F.regexp_instr("pattern", F.concat(F.lit(r"&\Q"), F.col("_s"), F.lit(SET_END)))
        new = lambda m: F.concat(F.substr("pattern", F.lit(1), at - 1), m, F.substr("pattern", at + F.length("_s") + 1))
        unfolded = first.select("id", F.explode(F.transform("_ms", new)).alias("pattern"))
        out = cut(out.join(first.select("id", "pattern"), ["id", "pattern"], "left_anti").union(unfolded).distinct())


def actor_codes_at(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """events (id, name, day) with `code`: the first entry, in list order, of dictionary (name, ord, code, valid_from, valid_to;
    null is open) whose days hold the event's; null if there is none."""
    fits = F.coalesce(F.col("day") >= F.col("valid_from"), F.lit(True)) & F.coalesce(F.col("day") <= F.col("valid_to"), F.lit(True))
    first = events.join(dictionary, "name").filter(fits).groupBy("id").agg(F.min_by("code", "ord").alias("code"))
    return events.join(first, "id", "left")


def mark_subordinate(tokens: DataFrame, least: int, most: int, begin: tuple[int, int] | None = None, end: tuple[int, int] | None = None) -> DataFrame:
    """tokens with `nulled`: whether they lie in a subordinate clause. Commas (outside lists of actors, where `compound` marks
    them) go in pairs, each opening one closed by the next; between the two least to most words must stand. What stands before an
    opening comma is one with begin[0] to begin[1] words, and what stands behind an opening comma that nothing closes, with
    end[0] to end[1] words. Commas themselves are never nulled."""
    by = W.partitionBy("doc").orderBy("i")
    comma = F.col("word") == ","
    if "compound" in tokens.columns:
        comma = comma & F.col("compound").isNull()
    at = tokens.withColumn("_k", comma).withColumn("_p", F.count_if("_k").over(by))
    opened = F.max(F.when(F.col("_k"), F.col("i"))).over(by)
    closed = F.min(F.when(F.col("_k"), F.col("i"))).over(by.rowsBetween(1, W.unboundedFollowing))
    whole = W.partitionBy("doc")
    stop = F.col("stop") if "stop" in tokens.columns else F.col("i") + 1
    at = at.withColumns({"_open": opened, "_close": closed, "_from": F.min("i").over(whole), "_to": F.max(stop).over(whole)})
    n = F.coalesce("_close", "_to") - F.col("_open") - 1
    inside = F.when(F.col("_close").isNotNull(), n.between(least, most)).otherwise(n.between(*end) if end else F.lit(False))
    nulled = (F.col("_p") % 2 == 1) & inside
    if begin:
        opening = F.col("_k") & (F.col("_p") % 2 == 1) & (F.col("i") - F.col("_from")).between(*begin)
        nulled = nulled | F.coalesce(F.col("i") < F.max(F.when(opening, F.col("i"))).over(whole), F.lit(False))
    return at.withColumn("nulled", nulled & ~F.col("_k")).drop("_k", "_p", "_open", "_close", "_from", "_to")


def mark_clauses(tokens: DataFrame) -> DataFrame:
    """tokens with `clause` from 0: a conjunction that doesn't join two nouns or two adjectives begins one."""
    by = W.partitionBy("doc").orderBy("i")
    pair = (F.lag("wtype").over(by) == F.lead("wtype").over(by)) & F.lag("wtype").over(by).isin("noun", "adj")
    return tokens.withColumn("_c", ((F.col("wtype") == "conj") & ~F.coalesce(pair, F.lit(False))).cast("int")).withColumn("clause", F.sum("_c").over(by)).drop("_c")


#: The words that stand for one actor, and for several.
ONE, MANY = ("he", "she", "it", "him", "her"), ("they", "them", "their")


def resolve_pronouns(tokens: DataFrame, story: DataFrame | None = None) -> DataFrame:
    """tokens with `actor`: their own code, or for he, she, it, him and her the sentence's first earlier actor outside a list of actors,
    for they, them and their the first earlier list (its codes joined by /), else the first earlier actor. `compound` marks
    lists, where given. With story (doc, story, seq) a sentence without such an actor takes what came first in the sentence
    that directly precedes it in its story: its first actor outside lists, or its first list, if any, for they."""
    before = W.partitionBy("doc").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    listed = F.col("compound") if "compound" in tokens.columns else F.lit(None).cast("int")
    word, coded = F.lower("word"), F.col("code").isNotNull()
    at = tokens.withColumn("_l", F.when(coded, listed))
    single = F.when(F.col("_l").isNull(), F.col("code"))
    at = at.withColumns({"_first": F.first("code", ignorenulls=True).over(before), "_single": F.first(single, ignorenulls=True).over(before), "_list": F.first("_l", ignorenulls=True).over(before)})
    lists = at.filter("_l IS NOT NULL").groupBy(F.col("doc").alias("_d"), F.col("_l").alias("_m")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"]), "/").alias("_codes"))
    at = at.join(lists, (F.col("doc") == F.col("_d")) & (F.col("_list") == F.col("_m")), "left").drop("_d", "_m")
    one, many = F.col("_single"), F.coalesce("_codes", "_first")
    if story is not None:
        own = tokens.withColumn("_l", F.when(coded, listed)).groupBy("doc").agg(F.min_by("code", F.when(coded & F.col("_l").isNull(), F.col("i"))).alias("_one"), F.min("_l").alias("_m"))
        own = own.join(lists.withColumnRenamed("_d", "doc"), ["doc", "_m"], "left")
        ahead = own.join(story, "doc").select(F.col("story").alias("_st"), (F.col("seq") + 1).alias("_sq"), F.col("_one").alias("_f_one"), F.coalesce("_codes", "_one").alias("_f_many"))
        carried = story.join(ahead, (F.col("story") == F.col("_st")) & (F.col("seq") == F.col("_sq"))).groupBy("doc").agg(F.first("_f_one").alias("_f_one"), F.first("_f_many").alias("_f_many"))
        at = at.join(carried, "doc", "left")
        one, many = F.coalesce(one, "_f_one"), F.coalesce(many, "_f_many")
    at = at.withColumn("actor", F.coalesce("code", F.when(word.isin(*ONE), one).when(word.isin(*MANY), many)))
    return at.select(*tokens.columns, "actor")


def assign_roles(verbs: DataFrame, actors: DataFrame, prior: bool = False, after: bool = False) -> DataFrame:
    """verbs (doc, clause, i, code) with target (the first actor behind the verb, else the nearest before) and source (the first
    actor of the clause that differs from it); actors are (doc, clause, pos, actor). With `prior` a source must stand before the
    verb, with `after` a target behind it; a role without such an actor is null. Verbs and actors of a clause lie in one order and
    meet by what stands before and behind, not in pairs."""
    line = verbs.select("doc", "clause", F.col("i").alias("_at"), "code", F.lit(None).cast("string").alias("_a"))
    line = line.unionByName(actors.select("doc", "clause", F.col("pos").alias("_at"), F.lit(None).cast("string").alias("code"), F.col("actor").alias("_a")).filter("_a IS NOT NULL").withColumn("_v", F.lit(False)), allowMissingColumns=True)
    clause = W.partitionBy("doc", "clause")
    order = clause.orderBy("_at")
    line = line.withColumns({
        "_next": F.first("_a", ignorenulls=True).over(order.rangeBetween(1, W.unboundedFollowing)), "_last": F.last("_a", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, -1)),
        "_one": F.min_by("_a", F.when(F.col("_a").isNotNull(), F.col("_at"))).over(clause), "_one_at": F.min(F.when(F.col("_a").isNotNull(), F.col("_at"))).over(clause),
    })
    other = F.when(F.col("_a") != F.col("_one"), F.col("_at"))
    line = line.withColumns({"_two": F.min_by("_a", other).over(clause), "_two_at": F.min(other).over(clause)})
    target = F.col("_next") if after else F.coalesce("_next", "_last")
    source = F.when(F.coalesce(F.col("_one") != F.col("target"), F.lit(after)), F.struct(F.col("_one").alias("a"), F.col("_one_at").alias("p"))).when(F.col("target").isNotNull(), F.struct(F.col("_two").alias("a"), F.col("_two_at").alias("p")))
    at = line.filter("_v IS NULL").withColumn("target", target).withColumn("_s", source)
    kept = F.when(F.col("_s.p") < F.col("_at"), F.col("_s.a")) if prior else F.col("_s.a")
    return at.select("doc", "clause", F.col("_at").alias("i"), "code", "target", kept.alias("source"))


def default_actors(events: DataFrame, source: str | Column, target: str | Column) -> DataFrame:
    """events with set codes for the roles that nothing filled."""
    return events.withColumns({"source": F.coalesce("source", F.lit(source)), "target": F.coalesce("target", F.lit(target))})


def expand_compounds(events: DataFrame, sep: str = "/") -> DataFrame:
    """An event for each pair of members of its source and target lists."""
    members = lambda c: F.explode(F.split(c, sep)).alias(c)
    rest = [c for c in events.columns if c not in ("source", "target")]
    return events.select(*rest, "target", members("source")).select(*rest, "source", members("target"))


def split_paired(events: DataFrame) -> DataFrame:
    """A paired code a:b gives a second event with code b and the roles swapped."""
    one = lambda k, s, t: F.struct(F.get(F.split("code", ":"), F.lit(k)).alias("code"), F.col(s).alias("source"), F.col(t).alias("target"))
    both = F.filter(F.array(one(0, "source", "target"), one(1, "target", "source")), lambda x: x["code"].isNotNull())
    rest = [c for c in events.columns if c not in ("code", "source", "target")]
    return events.select(*rest, F.explode(both).alias("e")).select(*rest, "e.*")


def resolve_precedence(events: DataFrame, dominant: list[str], subordinate: list[str]) -> DataFrame:
    """Events without null codes (---); a discard (###) or complex (+++) code voids its record; a dominant code cancels all
    others, and otherwise codes that aren't subordinate cancel those that are."""
    by = ("doc", "sent")
    kind = F.when(F.col("code").isin(dominant), 2).when(F.col("code").isin(subordinate), 0).otherwise(1)
    kept = events.filter("code <> '---'").withColumn("_k", kind)
    state = kept.groupBy(*by).agg(F.max("_k").alias("_m"), F.bool_or(F.col("code").isin("###", "+++")).alias("_void"))
    return kept.join(state, list(by)).filter("NOT _void AND _k = _m").drop("_k", "_m", "_void")


def drop_self_and_dups(events: DataFrame, allow_self: bool = False) -> DataFrame:
    """Events between different actors, the first of equal ones in each record."""
    out = events if allow_self else events.filter("source <> target")
    return out.groupBy("doc", "sent", "source", "target", "code").agg(F.min("n").alias("n"))


def first_events(events: DataFrame, scope: str) -> DataFrame:
    """All events, or the first of each sentence or of each clause."""
    if scope == "all":
        return events
    keys = ["doc", "sent"] + (["clause"] if scope == "clause" else [])
    return events.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[c for c in events.columns if c == "n"], *events.columns))).filter("_r = 1").drop("_r")


def shift_dates(events: DataFrame, shifts: DataFrame, longest: int = 8) -> DataFrame:
    """events (id, day, text) moved by the days of the first phrase of shifts (phrase, days) whose words stand in their text, the longest of
    those at one place, small letters or not. shifts may have `code`: a null code (---) is passed over; a discard (###) or complex (+++) code moves
    nothing and stands in `mark`. Runs of up to `longest` words of the text meet phrases in an equi-join."""
    code = F.col("code") if "code" in shifts.columns else F.lit(None).cast("string")
    table = shifts.select(F.lower("phrase").alias("phrase"), F.struct("days", code.alias("code")).alias("code")).filter("code.code IS NULL OR code.code <> '---'")
    words = events.select(F.col("id").alias("doc"), F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("i", "word"))
    hit = name_candidates(words, table, longest).groupBy(F.col("doc").alias("id")).agg(F.min_by("code", F.struct("start", (-F.col("end")).alias("n"), "phrase")).alias("_hit"))
    at = events.join(hit, "id", "left")
    moved = F.when(F.col("_hit.code").isNull(), F.col("_hit.days"))
    return at.withColumns({"day": F.date_add("day", F.coalesce(moved, F.lit(0))), "mark": F.col("_hit.code")}).drop("_hit")


def composite_code(actor: Column, agent: Column) -> Column:
    """The actor's code with the agent's behind it, unless it already stands there on a boundary of three letters."""
    parts = F.regexp_extract_all(actor, F.lit("(.{1,3})"), F.lit(1))
    return F.when(agent.isNull() | F.array_contains(parts, agent), actor).otherwise(F.concat(actor, agent))


def category_counts(tokens: DataFrame, dictionary: DataFrame, categories: list[str]) -> DataFrame:
    """(doc, a count for each category) of the tokens in dictionary (word, category)."""
    hit = tokens.select("doc", F.lower("word").alias("word")).join(dictionary, "word")
    return hit.groupBy("doc").pivot("category", categories).agg(F.count(F.lit(1))).na.fill(0)


def compare_events(coded: DataFrame, gold: DataFrame) -> DataFrame:
    """Per record (doc) whether coded has fewer or more events than gold, mismatched ones, or only other days; events
    (doc, n, source, target, code) with, in both or neither, `day`."""
    dated = "day" in coded.columns and "day" in gold.columns
    day = F.col("day") if dated else F.lit(None).cast("date")
    side = lambda df, s: df.select("doc", "n", F.concat_ws(" ", "source", "target", "code").alias(s), day.alias(f"{s}_day"))
    both = side(coded, "c").join(side(gold, "g"), ["doc", "n"], "full").groupBy("doc")
    verdict = F.when(F.count("c") < F.count("g"), "fewer").when(F.count("c") > F.count("g"), "more").when(~F.bool_and(F.coalesce(F.col("c") == F.col("g"), F.lit(False))), "mismatched")
    return both.agg(verdict.when(~F.bool_and(F.col("c_day").eqNullSafe(F.col("g_day"))), "date mismatched").otherwise("same").alias("verdict"))


def dictionary_usage(matches: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Uses of each dictionary entry (kind, entry), zero ones kept, with totals by kind (entry null)."""
    used = matches.groupBy("kind", "entry").agg(F.count(F.lit(1)).alias("u"))
    return dictionary.join(used, ["kind", "entry"], "left").rollup("kind", "entry").agg(F.sum(F.coalesce("u", F.lit(0))).alias("uses")).filter("kind IS NOT NULL")
