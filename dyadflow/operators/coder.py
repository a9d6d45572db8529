"""The event coder's chain: typed units of a sentence, their marks, verb patterns, roles, filters and coded events.

tokens are (doc, i, word), one sentence being one `doc`. units are (doc, i, stop, text, wtype, code), one dictionary phrase or
single word each, in the order of i; wtype is one of actor, agent, verb, noun, adj, det, conj, prep, pron, auxil, by, comma,
number, attrib, issue and word. All steps group by doc, so units partitioned by doc are shuffled once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from dyadflow.functions.lineage import cut
from dyadflow.operators import coding as K
from dyadflow.operators import patterns as P
from dyadflow.operators.extract import bound, gather

#: Regular endings of a phrase's last word.
ENDINGS = {"verb": ("", "s", "es", "ed", "ing", "d"), "actor": ("", "s", "'s", "es"), "agent": ("", "s", "'s", "es"), "noun": ("", "s", "'s", "es")}


def whole() -> WindowSpec:
    return W.partitionBy("doc")


def order() -> WindowSpec:
    return whole().orderBy("i")


def back() -> WindowSpec:
    """What stands before in the sentence."""
    return order().rowsBetween(W.unboundedPreceding, -1)


def type_tokens(tokens: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """units of tokens, with `places` (where their words stand): from left to right, at each word that no earlier phrase holds,
    the phrase of dictionary (phrase, wtype, code, ord) with most letters there, the first of equal ones. In a phrase _ joins neighbours
    and a blank lets words stand between, which are units of their own; longest is the most words without a gap. Commas and numbers have types of their own, the
    rest are single words. No phrase goes beyond a comma."""
    found = P.chosen(P.phrase_places(tokens, P.surface_forms(dictionary, ENDINGS), longest))
    # Words and phrases of a sentence meet once, a row each.
    kind = found.schema["kept"].dataType
    at = gather(tokens).join(found, "doc", "left").select("doc", F.transform("tokens", lambda t: F.struct(t["i"].cast("int").alias("i"), t["word"].alias("word"))).alias("_t"), F.coalesce("kept", F.array().cast(kind)).alias("_k"))
    at = at.withColumn("_held", F.flatten(F.transform("_k", lambda p: p["places"])))
    unit = lambda i, places, text, wtype, code: F.struct(i.cast("int").alias("i"), places.alias("places"), text.alias("text"), wtype.alias("wtype"), code.alias("code"))
    none = lambda name: F.lit(None).cast(kind.elementType[name].dataType)
    alone = F.transform(F.filter("_t", lambda t: ~F.array_contains("_held", t["i"])), lambda t: unit(t["i"], F.array(t["i"]), t["word"], none("wtype"), none("code")))
    # A word that two phrases hold is the first one's.
    own = lambda p, k: F.when(F.size(p["places"]) == 1, p["places"]).otherwise(F.array_except(p["places"], F.flatten(F.transform(F.slice("_k", 1, k), lambda q: q["places"]))))
    words = lambda places: F.filter("_t", lambda t: F.array_contains(places, t["i"]))
    phrase = lambda p, ws: unit(p["start"], F.transform(ws, lambda t: t["i"]), F.array_join(F.transform(ws, lambda t: t["word"]), " "), p["wtype"], p["code"])
    phrases = F.transform("_k", lambda p, k: bound(words(own(p, k)), lambda ws: phrase(p, ws)))
    units = at.select("doc", F.explode(F.concat(alone, phrases)).alias("u")).select("doc", "u.*")
    plain = F.when(F.col("text") == ",", "comma").when(F.col("text").rlike("^[0-9][0-9.]*$"), "number").otherwise("word")
    return units.select("doc", "i", (F.array_max("places") + 1).alias("stop"), "text", F.coalesce("wtype", plain).alias("wtype"), "code", "places")


def mark_nouns(units: DataFrame) -> DataFrame:
    """units whose verbs behind a determiner or capitalised inside a sentence of mixed letters, and null-coded actors, are nouns."""
    mixed = F.max(F.col("text").rlike("[a-z]")).over(whole())
    behind = F.lag("wtype").over(order())
    verb = (F.col("wtype") == "verb") & behind.isNotNull() & ((behind == "det") | (mixed & F.col("text").rlike("^[A-Z]")))
    noun = verb | ((F.col("wtype") == "actor") & (F.col("code") == "---"))
    return units.withColumn("_n", F.coalesce(noun, F.lit(False))).withColumns({"wtype": F.when(F.col("_n"), "noun").otherwise(F.col("wtype")), "code": F.when(~F.col("_n"), F.col("code"))}).drop("_n")


def mark_compounds(units: DataFrame) -> DataFrame:
    """units with `compound`, the first unit's i of the list "A, B and C" that they belong to (null outside): actors before an
    and or nor, joined by commas and conjunctions, to the last actor right behind it. Determiners and adjectives are passed
    over; of nested lists the longest counts."""
    link, actor = F.col("wtype").isin("conj", "comma"), F.col("wtype") == "actor"
    at = units.withColumn("_last", F.max_by("wtype", F.when(link | actor, F.col("i"))).over(back()))
    # A segment ends at other words and between two actors without a link; a run also ends at links.
    at = at.withColumn("_seg", F.count_if(~(link | F.col("wtype").isin("actor", "det", "adj")) | (actor & F.coalesce(F.col("_last") == "actor", F.lit(False)))).over(order()))
    at = at.withColumn("_run", F.count_if(~F.col("wtype").isin("actor", "det", "adj")).over(order()))
    start = F.min(F.when(actor, F.col("i"))).over(W.partitionBy("doc", "_seg").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    end = F.max(F.when(actor, F.col("i"))).over(W.partitionBy("doc", "_run"))
    joins = (F.col("wtype") == "conj") & F.lower("text").isin("and", "nor")
    at = at.withColumn("_c", F.when(joins, F.struct(start.alias("start"), end.alias("end"))))
    at = at.withColumn("_c", F.when(F.col("_c.start").isNotNull() & (F.col("_c.end") > F.col("i")), F.col("_c")))
    # A list's conjunctions lie one after another, so only the nearest ones on both sides can hold a unit.
    behind = F.last("_c", ignorenulls=True).over(back())
    ahead = F.first("_c", ignorenulls=True).over(order().rowsBetween(1, W.unboundedFollowing))
    own = F.coalesce(F.when(behind["end"] >= F.col("i"), behind["start"]), F.col("_c.start"), F.when(ahead["start"] <= F.col("i"), ahead["start"]))
    return at.withColumn("compound", own).select(*units.columns, "compound")


def attach_agents(units: DataFrame, elite: str = "ELI", convert: bool = False) -> DataFrame:
    """units with `agent` on actors: the code of the role word right behind, else right before (a preposition may stand
    between); `elite` where "former" stands beside. With `convert` role words that no actor took become actors."""
    wt, tx = (lambda k: F.lag("wtype", k).over(order())), (lambda k: F.lower(F.lag("text", k).over(order())))
    former = lambda k: F.coalesce((wt(k) == "adj") & (tx(k) == "former"), F.lit(False))
    code, here = (lambda k: F.lag("code", k).over(order())), F.lag("i", 0).over(order())
    place = lambda k: F.lag("i", k).over(order())
    after = F.when(former(-1), F.struct(wt(-2).alias("w"), code(-2).alias("c"), place(-2).alias("p"))).otherwise(F.struct(wt(-1).alias("w"), code(-1).alias("c"), place(-1).alias("p")))
    before = F.when(wt(1) == "prep", F.struct(wt(2).alias("w"), code(2).alias("c"), place(2).alias("p"), former(3).alias("f"))).otherwise(F.struct(wt(1).alias("w"), code(1).alias("c"), place(1).alias("p"), former(2).alias("f")))
    at = units.withColumns({"_a": after, "_b": before, "_f": former(-1) | former(1), "_h": here})
    late, early = F.coalesce(F.col("_a.w") == "agent", F.lit(False)), F.coalesce(F.col("_b.w") == "agent", F.lit(False))
    actor = F.col("wtype") == "actor"
    agent = F.when(actor & late, F.when(F.col("_f"), elite).otherwise(F.col("_a.c"))).when(actor & early, F.when(F.col("_f") | F.col("_b.f"), elite).otherwise(F.col("_b.c")))
    at = at.withColumns({"agent": agent, "_taken": F.when(actor & late, F.col("_a.p")).when(actor & early, F.col("_b.p"))})
    if convert:
        taken = F.collect_set("_taken").over(whole())
        at = at.withColumn("_free", (F.col("wtype") == "agent") & ~F.array_contains(taken, F.col("i")))
        at = at.withColumn("wtype", F.when(F.col("_free"), "actor").otherwise(F.col("wtype")))
    return at.select(*units.columns, "agent")


def match_verb_patterns(units: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc, clause, i, code, src_i, tgt_i, rep_i, pattern): each verb of units (with `clause`, code naming its root) with the longest
    of patterns (root, ord, pattern, code) that matches its clause behind it and its sentence before it."""
    return P.match_patterns(units, patterns, "verb")


def passive_verbs(units: DataFrame) -> DataFrame:
    """units with `passive`: an auxiliary one or two units before and a by-word one to three behind."""
    any_of = lambda kind, ks: F.coalesce(F.greatest(*[F.coalesce((F.lag("wtype", k).over(order()) == kind).cast("int"), F.lit(0)) for k in ks]), F.lit(0)) > 0
    return units.withColumn("passive", (F.col("wtype") == "verb") & any_of("auxil", (1, 2)) & any_of("by", (-1, -2, -3)))


def swap_passive(events: DataFrame) -> DataFrame:
    """events with source and target exchanged where the verb is passive and neither role came from a pattern."""
    swap = F.col("passive") & F.col("src_i").isNull() & F.col("tgt_i").isNull()
    return events.withColumns({"source": F.when(swap, F.col("target")).otherwise(F.col("source")), "target": F.when(swap, F.col("source")).otherwise(F.col("target"))})


def attribution(units: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(doc, attrib, code, named): the reporter by the last attribution phrase with a code: the actor in slot @ of the phrase's best pattern,
    else the nearest actor before it with no comma between, else the sentence's first actor. A phrase's code is its own, or
    with patterns (root, ord, pattern, code), whose roots it names, that of the best match (none: passed over); a discard (###) or complex (+++) code reports
    nobody and stands in `code`, while `named` is whom such a phrase names too."""
    actor = F.col("wtype") == "actor"
    near = F.max_by("code", F.when(actor, F.col("i"))).over(back())
    stop, last = F.max(F.when(F.col("wtype") == "comma", F.col("i"))).over(back()), F.max(F.when(actor, F.col("i"))).over(back())
    first = F.min_by("code", F.when(actor, F.col("i"))).over(whole())
    at = units.withColumn("_who", F.when(F.coalesce(last > F.coalesce(stop, F.lit(-1)), F.lit(False)), near).otherwise(first)).filter("wtype = 'attrib'")
    if patterns is None:
        at = at.select("doc", "i", "_who", "code")
    else:
        hit = P.match_patterns(units, patterns, "attrib").select("doc", "i", F.col("code").alias("_code"), F.col("rep_i"))
        who = units.filter(actor).select("doc", F.col("i").alias("rep_i"), F.col("code").alias("_slot"))
        at = at.join(hit, ["doc", "i"]).join(who, ["doc", "rep_i"], "left").select("doc", "i", F.coalesce("_slot", "_who").alias("_who"), F.col("_code").alias("code"))
    at = at.filter("code IS NOT NULL AND code <> '---'").groupBy("doc").agg(F.max_by(F.struct("_who", "code"), "i").alias("_l")).select("doc", "_l.*")
    marks = F.col("code").isin("###", "+++")
    return at.select("doc", F.when(~marks, F.col("_who")).alias("attrib"), F.when(marks, F.col("code")).alias("code"), F.col("_who").alias("named"))


def issues(units: DataFrame, dictionary: DataFrame, categories: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(doc, a column for each category): by dictionary (phrase, category, code, value) over all units. A category is
    (mode, default): first code, all codes, or the total of the numbers before its words, or else their values."""
    number = F.when(F.lag("wtype").over(order()) == "number", F.regexp_extract(F.lag("text").over(order()), "^[0-9]+", 0).cast("long"))
    at = units.select("doc", "i", F.lower("text").alias("phrase"), number.alias("_n"))
    hit = at.join(dictionary, "phrase")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"])
    each = hit.groupBy("doc", "category").agg(codes.alias("_codes"), F.sum(F.coalesce("_n", "value")).cast("string").alias("_total"))
    value = {"first": F.get("_codes", F.lit(0)), "all": F.array_join("_codes", " "), "number": F.col("_total")}
    columns = [F.coalesce(F.max(F.when(F.col("category") == name, value[mode])), F.lit(default)).alias(name) for name, (mode, default) in categories.items()]
    return units.select("doc").distinct().join(each, "doc", "left").groupBy("doc").agg(*columns)


def non_events(units: DataFrame, events: DataFrame, mode: str = "also") -> DataFrame:
    """(doc, source, target) of sentences without events: their first two distinct actors. mode: "off" gives none; "also" and "only"
    give the same, but with "only" the events themselves aren't wanted (see code_events)."""
    if mode not in ("off", "also", "only"):
        raise ValueError(f"no mode {mode}")
    actors = units.filter("wtype = 'actor' AND code IS NOT NULL").groupBy("doc", "code").agg(F.min("i").alias("i"))
    pair = actors.withColumn("_r", F.row_number().over(order())).filter("_r <= 2").groupBy("doc").agg(F.min_by("code", "i").alias("source"), F.max_by("code", "i").alias("target"), F.count(F.lit(1)).alias("_n"))
    found = pair.filter("_n = 2").drop("_n").join(events.select("doc").distinct(), "doc", "left_anti")
    return found.limit(0) if mode == "off" else found


def silent_sentences(sentences: DataFrame) -> DataFrame:
    """non_events of sentences (doc, units, busy), a row each: units in order as structs (i, wtype, code), busy saying whether
    there is an event. No row leaves its task."""
    codes = F.array_distinct(F.transform(F.filter("units", lambda u: (u["wtype"] == "actor") & u["code"].isNotNull()), lambda u: u["code"]))
    at = sentences.filter(~F.coalesce("busy", F.lit(False))).select("doc", codes.alias("_c")).filter(F.size("_c") > 1)
    return at.select("doc", F.col("_c")[0].alias("source"), F.col("_c")[1].alias("target"))


def complexity_filter(units: DataFrame, limits: dict[str, int | bool]) -> DataFrame:
    """(doc, reason) of sentences at or over a limit, all reasons in order: verbs, actors, pronouns, conjunctions (outside
    compounds), "verb position" (of the first verb of a code, from 0), and whether to demand "actor before verb", "actor after
    verb" and a "verb". Without a verb the position is no reason where the verb itself is demanded. units have `compound`."""
    n = lambda kind: F.count_if(F.col("wtype") == kind)
    verb = F.min(F.when((F.col("wtype") == "verb") & (F.coalesce("code", F.lit("")) != "---"), F.col("i")))
    actors = F.array_sort(F.collect_list(F.when(F.col("wtype") == "actor", F.col("i"))))
    at = units.groupBy("doc").agg(n("verb").alias("v"), n("actor").alias("a"), n("pron").alias("p"), F.count_if((F.col("wtype") == "conj") & F.col("compound").isNull()).alias("c"), verb.alias("_v"), F.min("i").alias("_from"), actors.alias("_as"))
    over = lambda name, value: F.when(value >= limits[name], F.lit(name)) if limits.get(name, 0) > 0 else F.lit(None)
    need = lambda name, ok: F.when(~ok, F.lit(f"no {name}")) if limits.get(name) else F.lit(None)
    late = F.when(F.col("_v").isNotNull(), over("verb position", F.col("_v") - F.col("_from")))
    reasons = [over("verbs", F.col("v")), over("actors", F.col("a")), over("pronouns", F.col("p")), over("conjunctions", F.col("c")), late]
    reasons += [need("actor before verb", F.exists("_as", lambda x: F.coalesce(x < F.col("_v"), F.lit(True)))), need("actor after verb", F.exists("_as", lambda x: F.coalesce(x > F.col("_v"), F.lit(False)))), need("verb", F.col("v") > 0)]
    return at.select("doc", F.concat_ws(", ", *reasons).alias("reason")).filter("reason <> ''")


def discard_filter(units: DataFrame) -> DataFrame:
    """(doc) of sentences with a phrase of the discard code."""
    return units.filter("code = '###'").select("doc").distinct()


def length_limits(tokens: DataFrame, least: int = 8, most: int = 128) -> DataFrame:
    """tokens of sentences with at least `least` words; what lies beyond `most` words isn't coded, as the coder's rule says."""
    at = tokens.withColumns({"_n": F.count(F.lit(1)).over(whole()), "_r": F.row_number().over(order())})
    return at.filter((F.col("_n") >= least) & (F.col("_r") <= most)).drop("_n", "_r")


#: What an event's output can have besides its day, source, target and code, and the columns of it.
OUTPUTS = {"attrib": ("attrib",), "label": ("label",), "pattern": ("pattern",), "match": ("match",), "actors": ("source_phrase", "target_phrase"), "shift": ("shift",), "places": ("source_at", "target_at", "verb_at"), "story": ("story",), "seq": ("seq",), "text": ("text",)}


def format_events(events: DataFrame, records: DataFrame, labels: DataFrame, options: tuple[str, ...] = ("label", "pattern")) -> DataFrame:
    """(doc, day, source, target, code, and the columns of OUTPUTS that options name, in its order): events with the days of records
    (doc, day) and labels (code, label). What is asked for must be a column of events or records; ties in the order are the caller's."""
    wanted = [c for name, cols in OUTPUTS.items() if name in options for c in cols]
    if unknown := set(options) - set(OUTPUTS):
        raise ValueError(f"no output {sorted(unknown)}")
    from_records = [c for c in wanted if c in records.columns and c not in events.columns]
    at = events.drop("day") if "day" in records.columns else events
    at = at.join(records.select("doc", "day", *from_records), "doc").join(labels, "code", "left")
    return at.select("doc", "day", "source", "target", "code", *wanted)


def by_date(events: DataFrame) -> DataFrame:
    """events (doc, n, day) in the order of their days, records and numbers: shifted dates may have left it."""
    return events.orderBy("day", "doc", "n")


def problem_table(records: DataFrame, discarded: DataFrame, complicated: DataFrame, raw: DataFrame, valid: DataFrame) -> DataFrame:
    """(doc, problem) of each record (doc, text) without a valid event, by the first cause that holds; raw and valid are events
    (doc, code) before and after precedence, self and repeats."""
    marks = raw.groupBy("doc").agg(F.bool_and(F.col("code") == "---").alias("_null"), F.bool_or(F.col("code") == "###").alias("_discard"), F.bool_or(F.col("code") == "+++").alias("_complex"))
    at = records.join(discarded.withColumn("_d", F.lit(True)), "doc", "left").join(complicated.withColumnRenamed("reason", "_r"), "doc", "left").join(marks, "doc", "left").join(valid.select("doc").distinct(), "doc", "left_anti")
    cause = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "record contains no text").when(F.col("_d"), "discard code in text").when(F.col("_r").isNotNull(), F.concat(F.lit("complex text: "), "_r"))
    cause = cause.when(F.col("_null").isNull(), "no events").when(F.col("_null"), "only null events").when(F.col("_discard"), "discard code in pattern").when(F.col("_complex"), "complex code in pattern").otherwise("no valid events")
    return at.select("doc", cause.alias("problem"))


def parse_gold(text: Column) -> Column:
    """Events (source, target, code) of a comment {SRC / TGT / CODE}, in order; the marks --- (none), ### and +++ stand alone."""
    inner = F.regexp_extract_all(text, F.lit(r"\{([^}]*)\}"), F.lit(1))
    parts = F.transform(inner, lambda s: F.transform(F.split(s, "/"), lambda x: F.trim(x)))
    return F.transform(parts, lambda p: F.struct(F.when(F.size(p) > 1, F.get(p, F.lit(0))).alias("source"), F.get(p, F.lit(1)).alias("target"), F.when(F.size(p) > 1, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(0))).alias("code")))


@dataclass(frozen=True)
class Options:
    """How a coder reads records. limits are complexity_filter's; longest is the most words of a phrase without a gap; dominant and
    subordinate are codes by precedence; comma, comma_begin and comma_end are the word limits of subordinate clauses (None:
    none is looked for); source and target are codes for roles that nothing fills, with prior and after only what stands
    before and behind the verb fills them; scope says where coding stops at a main event; mode is non_events'; categories are issues'."""

    limits: dict[str, int | bool] = field(default_factory=dict)
    longest: int = 4
    dominant: tuple[str, ...] = ()
    subordinate: tuple[str, ...] = ()
    comma: tuple[int, int] | None = None
    comma_begin: tuple[int, int] | None = None
    comma_end: tuple[int, int] | None = None
    source: str | None = None
    target: str | None = None
    prior: bool = False
    after: bool = False
    scope: str = "clause"
    mode: str = "off"
    brackets: bool = False
    allow_self: bool = False
    convert_agents: bool = False
    categories: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    word_categories: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dictionaries:
    """What a coder knows: words (phrase, wtype, code, ord), verb patterns and, if reporters depend on patterns, attribution
    patterns (root, ord, pattern, code), time phrases (phrase, days, code), dated codes of actors (name, ord, code, valid_from,
    valid_to), and the words of issues (phrase, category, code, value) and of counted categories (word, category)."""

    words: DataFrame
    patterns: DataFrame
    reporters: DataFrame | None = None
    shifts: DataFrame | None = None
    dated: DataFrame | None = None
    issues: DataFrame | None = None
    counted: DataFrame | None = None


def dated_codes(units: DataFrame, days: DataFrame, dated: DataFrame) -> DataFrame:
    """units whose actors with a name in dated (name, ord, code, valid_from, valid_to) have its code on their record's day
    (days: doc, day); an actor without a code on that day has none. Other actors keep theirs."""
    who = units.filter("wtype = 'actor' AND code IS NOT NULL").select("doc", F.col("code").alias("name")).distinct()
    known = dated.select("name").distinct()
    ask = who.join(known, "name").join(days.select("doc", "day"), "doc").select(F.struct("doc", "name").alias("id"), "name", "day")
    found = K.actor_codes_at(ask, dated).select(F.col("id.doc").alias("doc"), F.lit("actor").alias("wtype"), F.col("id.name").alias("code"), F.col("code").alias("_now"), F.lit(True).alias("_known"))
    return units.join(found, ["doc", "wtype", "code"], "left").withColumn("code", F.when(F.col("_known"), F.col("_now")).otherwise(F.col("code"))).select(units.columns)


def pronouns_to_actors(units: DataFrame, story: DataFrame | None) -> DataFrame:
    """units whose pronouns are actors where K.resolve_pronouns finds whom they mean."""
    own = units.withColumns({"_code": F.col("code"), "code": F.when(F.col("wtype") == "actor", F.col("code")), "word": F.col("text")})
    at = K.resolve_pronouns(own, story)
    who = (F.col("wtype") == "pron") & F.col("actor").isNotNull()
    return at.withColumns({"code": F.when(who, F.col("actor")).otherwise(F.col("_code")), "wtype": F.when(who, "actor").otherwise(F.col("wtype"))}).select(units.columns)


def clause_openers(units: DataFrame) -> DataFrame:
    """(doc, clause, i): the actor right behind the conjunction that begins a clause, for clauses but the first."""
    first = units.filter("clause > 0 AND wtype <> 'conj'").groupBy("doc", "clause").agg(F.min_by(F.struct("wtype", "i"), "i").alias("u"))
    return first.filter("u.wtype = 'actor'").select("doc", "clause", F.col("u.i").alias("i"))


def roles_in_order(verbs: DataFrame, actors: DataFrame, prior: bool = False, after: bool = False) -> DataFrame:
    """verbs (doc, clause, i, passive, opener, given_source, given_target) with source and target as the coder finds them, verb by verb:
    actors are (doc, clause, pos, actor).

    A source is what the verb's pattern gave, or the actor that opens its clause (on the clause's first verb), and then holds for the sentence's
    further verbs until another is given or a passive verb has gone by; where none holds it is the clause's first actor that
    isn't the given target. A target is given, or the first actor behind the verb that isn't the source, else the nearest before
    it. With `prior` a source that is looked for must stand before the verb, with `after` a target behind it; a role that nothing fills is null.
    Verbs and actors meet by what stands before and behind in one order, not in pairs: each actor knows the nearest other one on both sides."""
    clause = W.partitionBy("doc", "clause")
    by, around = clause.orderBy("pos"), lambda lo, hi: clause.orderBy("pos").rowsBetween(lo, hi)
    at = actors.withColumns({"_begins": F.coalesce(F.lag("actor").over(by) != F.col("actor"), F.lit(True)), "_ends": F.coalesce(F.lead("actor").over(by) != F.col("actor"), F.lit(True))})
    at = at.withColumns({
        "_other_next": F.first(F.when(F.col("_begins"), F.col("actor")), ignorenulls=True).over(around(1, W.unboundedFollowing)),
        "_other_last": F.last(F.when(F.col("_ends"), F.col("actor")), ignorenulls=True).over(around(W.unboundedPreceding, -1)),
    })
    person = F.struct("actor", "_other_next", "_other_last")
    line = verbs.withColumns({"_at": F.col("i"), "_verb": F.lit(True)}).unionByName(at.select("doc", "clause", F.col("pos").alias("_at"), person.alias("_p")), allowMissingColumns=True)
    order = clause.orderBy("_at")
    held, place = F.col("_p.actor"), F.when(F.col("_p").isNotNull(), F.col("_at"))
    line = line.withColumns({
        "_next": F.first("_p", ignorenulls=True).over(order.rangeBetween(1, W.unboundedFollowing)), "_last": F.last("_p", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, -1)),
        "_one": F.min_by(F.struct(held.alias("a"), F.col("_at").alias("p"), F.col("_p._other_next").alias("o")), place).over(clause), "_lead": F.min(F.when(F.col("_verb"), F.col("_at"))).over(clause),
    })
    other = F.when(held != F.col("_one.a"), F.col("_at"))
    line = line.withColumn("_two", F.min_by(F.struct(held.alias("a"), F.col("_at").alias("p")), other).over(clause))
    found = F.when(F.coalesce(F.col("_one.a") != F.col("given_target"), F.lit(True)), F.struct("_one.a", "_one.p")).otherwise(F.struct("_two.a", "_two.p"))
    line = line.filter("_verb").withColumn("_found", found)
    fits = F.col("_found.p") < F.col("i") if prior else F.lit(True)
    given = F.coalesce("given_source", F.when(F.col("i") == F.col("_lead"), F.col("opener")))
    line = line.withColumns({"_given": given, "_plain": F.when(fits, F.col("_found.a"))})
    fresh = F.col("_given").isNotNull() | F.coalesce(F.lag("passive").over(order_of_verbs()), F.lit(False))
    line = line.withColumn("_fresh", fresh).withColumn("_stretch", F.count_if("_fresh").over(order_of_verbs().rowsBetween(W.unboundedPreceding, 0)))
    line = line.withColumn("source", F.first(F.coalesce("_given", "_plain"), ignorenulls=True).over(W.partitionBy("doc", "_stretch").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    but = lambda p, side: F.when(F.coalesce(F.col(f"{p}.actor") != F.col("source"), F.lit(True)), F.col(f"{p}.actor")).otherwise(F.col(f"{p}._other_{side}"))
    looked = but("_next", "next") if after else F.coalesce(but("_next", "next"), but("_last", "last"))
    return line.select("doc", "clause", "i", "source", F.coalesce("given_target", looked).alias("target"))


def order_of_verbs() -> WindowSpec:
    return W.partitionBy("doc").orderBy("i")


def stop_at_main(events: DataFrame, scope: str, subordinate: tuple[str, ...] = ()) -> DataFrame:
    """events (doc, clause, n, code) up to the first main one (neither null nor subordinate) of each clause or sentence; with "all"
    all of them."""
    if scope == "all":
        return events
    by = W.partitionBy("doc", "clause") if scope == "clause" else whole()
    main = (F.col("code") != "---") & ~F.col("code").isin(*subordinate) if subordinate else F.col("code") != "---"
    return events.withColumn("_m", F.min(F.when(main, F.col("n"))).over(by)).filter("_m IS NULL OR n <= _m").drop("_m")


def read_units(records: DataFrame, days: DataFrame, known: Dictionaries, options: Options) -> tuple[DataFrame, DataFrame]:
    """The marked units of records (doc, text, and where pronouns carry over story and seq) and the reporters of their sentences."""
    text = K.clean_text(F.col("text"), options.brackets)
    tokens = records.select("doc", F.posexplode(F.filter(F.split(text, " "), lambda w: w != "")).alias("i", "word"))
    units = mark_nouns(type_tokens(tokens, known.words, options.longest))
    if known.dated is not None:
        units = dated_codes(units, days, known.dated)
    units = mark_compounds(attach_agents(units, convert=options.convert_agents))
    # A conjunction inside a list of actors begins no clause.
    listed = (F.col("wtype") == "conj") & F.col("compound").isNotNull()
    units = units.withColumn("wtype", F.when(listed, "list").otherwise(F.col("wtype")))
    if options.comma or options.comma_begin or options.comma_end:
        marked = K.mark_subordinate(units.withColumn("word", F.col("text")), *(options.comma or (1, 0)), begin=options.comma_begin, end=options.comma_end)
        units = marked.select(*units.columns, "nulled")
    else:
        units = units.withColumn("nulled", F.lit(False))
    story = records.select("doc", "story", "seq") if {"story", "seq"} <= set(records.columns) else None
    units = cut(pronouns_to_actors(K.mark_clauses(units), story))
    reported = attribution(units, known.reporters)
    gone = F.col("nulled")
    return units.withColumns({"code": F.when(~gone, F.col("code")), "wtype": F.when(gone, "null").otherwise(F.col("wtype"))}), reported


def code_events(records: DataFrame, known: Dictionaries, options: Options = Options()) -> dict[str, DataFrame]:  # noqa: B008
    """Tables `events` (doc, n, day, source, target, code, pattern, attrib, source_at, target_at, verb_at), `non_events` (doc, source, target),
    `problems` (doc, problem) and, where the dictionaries have them, `issues` and `counts` of records (doc, day, text; with story and seq,
    pronouns carry over). The order is the coder's: time, dated codes, nouns, agents, lists, subordinate clauses, pronouns,
    attribution, discards, complexity, verbs by clause, defaults, precedence, compounds, repeats, issues, counts.

    A record is a sentence: its words are one group. Units, verbs and raw events, which several steps read, are cut in the shared folder."""
    days = records.select(F.col("doc").alias("id"), "day", K.clean_text(F.col("text"), options.brackets).alias("text"))
    days = days.withColumn("mark", F.lit(None).cast("string")) if known.shifts is None else K.shift_dates(days, known.shifts)
    days = days.select(F.col("id").alias("doc"), "day", "mark")
    units, reported = read_units(records, days, known, options)
    marked = lambda code: days.filter(F.col("mark") == code).select("doc")
    told = lambda code: reported.filter(F.col("code") == code).select("doc")
    out = discard_filter(units).union(marked("###")).union(told("###")).distinct()
    timed = marked("+++").withColumn("reason", F.lit("complex code in time phrase")).union(told("+++").withColumn("reason", F.lit("complex code in attribution")))
    hard = complexity_filter(units, options.limits).union(timed).groupBy("doc").agg(F.min("reason").alias("reason"))
    kept = units.join(out, "doc", "left_anti").join(hard, "doc", "left_anti")
    full = F.when(F.col("wtype") == "actor", K.composite_code(F.col("code"), F.col("agent")))
    # A compound's members are one actor, at its first unit.
    actors = kept.withColumn("_full", full).filter("_full IS NOT NULL").groupBy("doc", F.coalesce("compound", "i").alias("pos")).agg(F.min("clause").alias("clause"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "_full"))), lambda x: x["_full"]), "/").alias("actor"), F.collect_list("i").alias("at"))
    verbs = cut(match_verb_patterns(kept, known.patterns))
    each = actors.select("doc", F.explode("at").alias("_at"), "actor")
    named = lambda df, key, role: df.join(each.select("doc", F.col("_at").alias(key), F.col("actor").alias(role)), ["doc", key], "left")
    at = named(named(named(verbs, "src_i", "given_source"), "tgt_i", "given_target"), "rep_i", "_r").join(passive_verbs(kept).select("doc", "i", "passive"), ["doc", "i"])
    opened = named(clause_openers(kept), "i", "opener").drop("i")
    asked = at.join(opened, ["doc", "clause"], "left").select("doc", "clause", "i", "passive", "opener", "given_source", "given_target")
    roles = roles_in_order(asked, actors.select("doc", "clause", "pos", "actor"), options.prior, options.after)
    at = swap_passive(at.join(roles, ["doc", "clause", "i"]))
    none = F.lit(None).cast("string")
    at = K.default_actors(at, options.source or none, options.target or none).withColumn("n", F.col("i"))
    raw = cut(stop_at_main(at, options.scope, options.subordinate).select("doc", F.lit(0).alias("sent"), "n", "source", "target", "code", "pattern", F.col("_r").alias("reporter"), F.col("src_i").alias("source_at"), F.col("tgt_i").alias("target_at"), F.col("i").alias("verb_at")))
    plain = raw.select("doc", "sent", "n", "source", "target", "code")
    paired = K.expand_compounds(K.split_paired(K.resolve_precedence(plain, list(options.dominant), list(options.subordinate)).filter("source IS NOT NULL AND target IS NOT NULL")))
    valid = K.drop_self_and_dups(paired, options.allow_self).join(raw.drop("sent", "source", "target", "code"), ["doc", "n"])
    idle = non_events(kept, raw.filter("code <> '---'"), options.mode)
    events = valid.join(days.drop("mark"), "doc").join(reported.select("doc", "attrib"), "doc", "left").select("doc", "n", "day", "source", "target", "code", "pattern", F.coalesce("reporter", "attrib").alias("attrib"), "source_at", "target_at", "verb_at")
    tables = {"events": events.limit(0) if options.mode == "only" else events, "non_events": idle, "problems": problem_table(records.select("doc", "text"), out, hard, raw, valid)}
    if known.issues is not None:
        tables["issues"] = issues(kept, known.issues, options.categories)
    if known.counted is not None:
        tables["counts"] = K.category_counts(kept.select("doc", F.col("text").alias("word")), known.counted, list(options.word_categories))
    return tables
