"""Readers of the text formats and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TUPLES = "docid STRING, tupleid STRING, day DATE, src STRING, rec STRING, path STRING"
CALENDAR = "t INT, day DATE, bucket STRING, left DATE"
SENTENCE = "tokens ARRAY<ARRAY<STRING>>, deps ARRAY<ARRAY<STRING>>"


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="")


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """Event tuples: six columns separated by tabs; tupleid is JSON [sent, n]."""
    ids = F.from_json("tupleid", "array<int>")
    return _tsv(spark, path, TUPLES).withColumns({"sent": ids[0], "n": ids[1]}).drop("tupleid")


def read_datefile(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, CALENDAR)


def parse_jsent(lines: DataFrame) -> DataFrame:
    """Sentences of lines (value): docid, S<n>, ..., JSON; rows whose second column doesn't begin with S are dropped, and
    has_parse is false if every relation is X."""
    cols = F.split("value", "\t")
    rows = lines.select(cols[0].alias("docid"), F.get(cols, F.lit(1)).alias("sentid"), F.from_json(F.element_at(cols, -1), SENTENCE).alias("j")).filter(F.col("sentid").startswith("S"))
    return rows.select("docid", "sentid", "j.tokens", "j.deps", (~F.forall("j.deps", lambda d: d[0] == "X")).alias("has_parse"))


def read_jsent(spark: SparkSession, path: str) -> DataFrame:
    return parse_jsent(spark.read.text(path))


def parse_docs(lines: DataFrame) -> DataFrame:
    """Documents of lines (value): the last two columns are JSON sentence texts and tokens, all before is the id."""
    cols = F.split("value", "\t")
    return lines.select(F.array_join(F.slice(cols, 1, F.size(cols) - 2), "\t").alias("doc_id"), F.from_json(F.element_at(cols, -2), "array<string>").alias("sent_texts"), F.from_json(F.element_at(cols, -1), "sentences ARRAY<STRUCT<tokens ARRAY<ARRAY<STRING>>>>")["sentences"].alias("sentences"))


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    return parse_docs(spark.read.text(path))


def parse_actor_list(lines: DataFrame) -> DataFrame:
    """(code, name) of lines (value); === lines are skipped, codes lose other than capitals at their ends, names final _."""
    cols = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("===")).select(F.regexp_replace(cols[0], "^[^A-Z]+|[^A-Z]+$", "").alias("code"), F.regexp_replace(F.get(cols, F.lit(1)), "_+$", "").alias("name"))
    return rows.filter("name IS NOT NULL")


def read_actor_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_actor_list(spark.read.text(path))


def parse_dated_actors(lines: DataFrame) -> DataFrame:
    """(name, code, until) of lines (file, line, value): comments after ; go, NOUN and ADJECTIVE sections are skipped, each
    [CODE <yymmdd] is a row with its limit, and a name without codes has NO_CODE."""
    section = F.last(F.when(F.col("value").rlike("^(NOUN|ADJECTIVE|ACTOR)"), F.regexp_extract("value", "^([A-Z]+)", 1)), ignorenulls=True).over(W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("section", F.coalesce(section, F.lit("ACTOR"))).filter(~F.col("section").isin("NOUN", "ADJECTIVE") & ~F.col("value").rlike("^(NOUN|ADJECTIVE|ACTOR)"))
    body = F.trim(F.split("value", ";")[0])
    rows = rows.select(F.trim(F.split(body, r"\[")[0]).alias("name"), F.regexp_extract_all(body, F.lit(r"\[([^\]]*)\]"), F.lit(1)).alias("codes")).filter("name <> ''")
    each = rows.select("name", F.explode(F.when(F.size("codes") == 0, F.array(F.lit("NO_CODE"))).otherwise(F.col("codes"))).alias("c"))
    return each.select("name", F.split(F.trim("c"), " ")[0].alias("code"), F.nullif(F.regexp_extract("c", r"<(\d{6})", 1), F.lit("")).alias("until"))


def country_names(countries: DataFrame, extras: DataFrame | None = None, merges: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """(code, ord, name) of countries (place, code, name, nationality): each code's distinct names in the order in which they were
    first seen. A country's own name comes first, then its nationalities, one a line. Blanks and _ of a name are one _.
    A country without a code gets that of its name in extras (name, code), and none if there is none; codes become those that
    merges (old, code) has for them; pairs in blacklist (code, name) are left out."""
    own = F.trim("name")
    at = countries.withColumns({"_own": own, "_old": F.nullif(F.trim("code"), F.lit(""))})
    if extras is not None:
        at = at.join(extras.select(F.col("name").alias("_own"), F.col("code").alias("_extra")), "_own", "left").withColumn("_old", F.coalesce("_old", "_extra"))
    if merges is not None:
        at = at.join(merges.select(F.col("old").alias("_old"), F.col("code").alias("_new")), "_old", "left").withColumn("_old", F.coalesce("_new", "_old"))
    names = F.concat(F.array("_own"), F.coalesce(F.split(F.trim("nationality"), "\n"), F.array().cast("array<string>")))
    each = at.filter("_old IS NOT NULL").select(F.col("_old").alias("code"), "place", F.posexplode(names).alias("k", "_n"))
    each = each.select("code", "place", "k", F.regexp_replace(F.trim(F.regexp_replace("_n", r"[_\s]+", " ")), " ", "_").alias("name")).filter("name <> ''")
    if blacklist is not None:
        each = each.join(blacklist.select("code", "name").distinct(), ["code", "name"], "left_anti")
    once = each.groupBy("code", "name").agg(F.min(F.struct("place", "k")).alias("_at"))
    return once.select("code", F.row_number().over(W.partitionBy("code").orderBy("_at", "name")).alias("ord"), "name")


def read_country_xml(spark: SparkSession, path: str, extras: DataFrame | None = None, merges: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """country_names of the Country elements of a file."""
    rows = spark.read.format("xml").options(rowTag="Country").schema("CountryCode STRING, CountryName STRING, Nationality STRING").load(path)
    at = rows.select(F.monotonically_increasing_id().alias("place"), F.col("CountryCode").alias("code"), F.col("CountryName").alias("name"), F.col("Nationality").alias("nationality"))
    return country_names(at, extras, merges, blacklist)


def name_ambiguity(names: DataFrame) -> DataFrame:
    """Names with more than one code, and how many."""
    return names.groupBy("name").agg(F.count_distinct("code").alias("codes")).filter("codes > 1")


def unpivot_coefs(wide: DataFrame, word: str) -> DataFrame:
    """(word, class, coef) of a wide table with a column for each class."""
    return wide.unpivot(word, [c for c in wide.columns if c != word], "class", "coef").withColumnRenamed(word, "word")


def read_coefs(spark: SparkSession, path: str) -> DataFrame:
    wide = spark.read.csv(path, header=True, inferSchema=True)
    return unpivot_coefs(wide, wide.columns[0])


def read_scales(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "code STRING, score DOUBLE, gloss STRING")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "code STRING, label STRING")


def conflict_episodes(rows: DataFrame, iso: DataFrame) -> DataFrame:
    """Episodes (a, b, start_day, end_day, host_a, host_b) of rows with year, month and day parts; day -9 is the 1st of the
    start and the 28th of the end; numeric codes become those of iso (number, code)."""
    day = lambda y, m, d, unknown: F.make_date(y, m, F.when(F.col(d) == -9, unknown).otherwise(F.col(d)))
    at = lambda s: F.broadcast(iso.select(F.col("number").alias(f"_{s}"), F.col("code").alias(s)))
    out = rows.join(at("a"), F.col("CCodeA") == F.col("_a"), "left").join(at("b"), F.col("CCodeB") == F.col("_b"), "left")
    return out.select("a", "b", day("StYear", "StMon", "StDay", 1).alias("start_day"), day("EndYear", "EndMon", "EndDay", 28).alias("end_day"), F.col("HostlevA").alias("host_a"), F.col("HostlevB").alias("host_b"))


def read_samples(spark: SparkSession, path: str, variables: list[str], lo: int | None = None, hi: int | None = None, step: int = 1) -> DataFrame:
    """Draws of a table partitioned by iter and var, from iteration lo to hi; without lo only the last one up to hi (null: of all).
    Other partitions aren't read."""
    rows = spark.read.parquet(path).filter(F.col("var").isin(variables))
    rows = rows if hi is None else rows.filter(F.col("iter") <= hi)
    if lo is None:
        # One number, from the names of the partitions.
        return rows.filter(F.col("iter") == rows.agg(F.max("iter")).first()[0])
    return rows.filter((F.col("iter") >= lo) & ((F.col("iter") - lo) % step == 0))


def import_matrix_files(spark: SparkSession, path: str) -> DataFrame:
    """(iter, var, i, j, value) of text files model.<iter>.<var>, a line a row of white-space separated numbers."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"model\.(\d+)\.(\w+)$", 0)
    rows = spark.read.text(path).select("value", name.alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("name").orderBy("block", "line")) - 1)
    cells = rows.select("name", "i", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("j", "v"))
    return cells.select(F.split_part("name", F.lit("."), F.lit(2)).cast("int").alias("iter"), F.split_part("name", F.lit("."), F.lit(3)).alias("var"), "i", "j", F.col("v").cast("double").alias("value"))


def parse_train_log(lines: DataFrame) -> DataFrame:
    """(run, iter, name, values) of lines (run, line, text): `name = v1 v2 ...` belongs to the last `ITER n` before it; kept
    are iterations up to 500 and each hundredth."""
    it = F.last(F.nullif(F.regexp_extract("text", r"^ITER (\d+)", 1), F.lit("")).cast("int"), ignorenulls=True).over(W.partitionBy("run").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("iter", it).filter(F.col("text").rlike(r"^\w+ = ") & ((F.col("iter") <= 500) | (F.col("iter") % 100 == 0)))
    values = F.transform(F.split(F.trim(F.split("text", " = ")[1]), r"\s+"), lambda v: v.cast("double"))
    return rows.select("run", "line", "iter", F.split("text", " = ")[0].alias("name"), values.alias("values"))


def parse_log_matrices(lines: DataFrame, name: str) -> DataFrame:
    """(run, iter, i, j, value) of the matrices `name` in lines (run, line, text). One begins behind a line that begins with the name and
    ends before the line ]; each line between is a row, whose brackets and commas are blanks. It belongs to the last
    `ITER n` before it; of an iteration the first whole one counts, and kept are iterations up to 500 and each hundredth."""
    by = W.partitionBy("run").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(by)
    number = F.nullif(F.regexp_extract("text", r"^ITER (\d+)", 1), F.lit("")).cast("int")
    begins, ends = F.startswith("text", F.lit(name)), F.col("text") == "]"
    at = lines.withColumns({"iter": last(number), "_open": last(F.when(begins, F.col("line"))), "_shut": last(F.when(ends | number.isNotNull(), F.col("line")))})
    # A matrix is an island of lines behind its name and before anything that shuts it.
    inside = at.filter(~begins & (F.col("_open") > F.coalesce("_shut", F.lit(-1))) & ((F.col("iter") <= 500) | (F.col("iter") % 100 == 0)))
    shut = at.filter(ends & F.col("_open").isNotNull()).groupBy("run", "_open").agg(F.min("line").alias("_end"))
    rows = inside.join(shut, ["run", "_open"]).filter("line < _end")
    rows = rows.withColumn("_first", F.min("_open").over(W.partitionBy("run", "iter"))).filter("_open = _first")
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("run", "_open").orderBy("line")) - 1)
    cells = F.filter(F.split(F.regexp_replace("text", r"[\[\],]", " "), r"\s+"), lambda v: v != "")
    return rows.select("run", "iter", "i", F.posexplode(cells).alias("j", "v")).select("run", "iter", "i", "j", F.col("v").cast("double").alias("value"))


def news_date(text: Column) -> Column:
    """Date of YYMMDD or YYYYMMDD; two-digit years over 30 are of the last century; null if it isn't one."""
    d = F.regexp_extract(text, r"^(\d{8}|\d{6})", 1)
    year = F.when(F.substring(d, 1, 2) > "30", F.lit("19")).otherwise(F.lit("20"))
    return F.try_to_date(F.nullif(F.when(F.length(d) == 6, F.concat(year, d)).otherwise(d), F.lit("")), "yyyyMMdd")


def parse_news(records: DataFrame) -> DataFrame:
    """(day, id, text, bad) of records (value): a line `date id`, then text that may be wrapped; bad marks dates that aren't."""
    head = F.split(F.col("value"), "\n", 2)
    day = news_date(F.trim(head[0]))
    return records.filter(F.trim("value") != "").select(day.alias("day"), F.regexp_extract(F.trim(head[0]), r"^\d+\s+(\S+)", 1).alias("id"), F.trim(F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s+", " ")).alias("text"), day.isNull().alias("bad"))


def read_news_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_news(spark.read.text(path, lineSep="\n\n"))


def strip_markup(text: Column) -> Column:
    """Tagged text without IGNORE and BRACKET blocks, tags and unprintable characters."""
    out = F.regexp_replace(text, r"(?s)<(IGNORE|BRACKET)>.*?</(IGNORE|BRACKET)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[\x00-\x08\x0e-\x1f\x7f]", ""), r"\s+", " "))


#: The lines and tags of tagged news.
RECORD, DATE_LINE = "SERIAL:", "INFODATE:"
#: Stands around the words that a name replaces, which keep their place but mean nothing.
KEPT = "~"


def tagged_text(body: Column) -> Column:
    """The text of a tagged sentence: IGNORE and BRACKET blocks are left out; the normalised name (WDN) of an NE or PRONOUN comes
    before its words, which stay between two marks; other tags and unprintable characters are left out, line ends are blanks."""
    out = F.regexp_replace(body, r"(?s)<(IGNORE|BRACKET)>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?s)<(?:NE|PRONOUN) [^>]*?WDN=\"([^\"]*)\"[^>]*>(.*?)</(?:NE|PRONOUN)>", f"$1 {KEPT} $2 {KEPT} ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", ""), r"[\r\n]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\x20-\x7E]", ""), " +", " "))


def parse_tagged_news(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences (id, day, seq, text) and errors (id, problem) of records (value), each what stands behind a record line's name up to the next. The
    rest of that line is the id; the first digits behind the date line's name are the date; sentences are the S elements
    of the TEXT blocks, seq their ID. A record without a date, text or sentence gives its problem and no sentences; what
    comes before the first record is no record."""
    at = records.filter(F.col("value").contains(DATE_LINE) | F.col("value").contains("<TEXT>"))
    day = news_date(F.regexp_extract("value", DATE_LINE + r"[^0-9\n]*([0-9]+)", 1))
    text = F.array_join(F.regexp_extract_all("value", F.lit(r"(?s)<TEXT>(.*?)</TEXT>"), F.lit(1)), "\n")
    at = at.select(F.trim(F.regexp_extract("value", r"^([^\n]*)", 1)).alias("id"), day.alias("day"), text.alias("_text"))
    sentence = r"(?s)<S [^>]*?ID=\"([0-9]+)\"[^>]*>(.*?)</S>"
    pairs = F.arrays_zip(F.regexp_extract_all("_text", F.lit(sentence), F.lit(1)).alias("seq"), F.regexp_extract_all("_text", F.lit(sentence), F.lit(2)).alias("body"))
    at = at.withColumn("_s", pairs)
    problem = F.when(F.col("id") == "", "no id").when(F.col("day").isNull(), "no date").when(F.col("_text") == "", "no text").when(F.size("_s") == 0, "no sentences")
    at = at.withColumn("problem", problem)
    good = at.filter("problem IS NULL").select("id", "day", F.explode("_s").alias("s"))
    return good.select("id", "day", F.col("s.seq").cast("int").alias("seq"), tagged_text(F.col("s.body")).alias("text")), at.filter("problem IS NOT NULL").select("id", "problem")


def read_tagged_news(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """parse_tagged_news of text files, which Spark splits at record lines, so a file of any size is read by many tasks."""
    return parse_tagged_news(spark.read.text(path, lineSep=RECORD))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: tuple[str, ...] = ()) -> None:
    """Write a table as parquet, json or tsv."""
    out = df.write.partitionBy(*partition) if partition else df.write
    out.option("sep", "\t").option("quote", "").csv(path) if fmt == "tsv" else getattr(out, fmt)(path)


def matrix_lines(cells: DataFrame) -> DataFrame:
    """(iter, var, i, line) of cells (iter, var, i, j, value): a text line for each matrix row, its values in order of j."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("j", F.col("value").cast("string").alias("v")))), lambda x: x["v"])
    return cells.groupBy("iter", "var", "i").agg(F.array_join(values, " ").alias("line"))


def write_matrices(cells: DataFrame, path: str) -> None:
    """Matrix rows as text in folders by iteration and variable, in order of i."""
    rows = matrix_lines(cells).repartitionByRange("iter", "var", "i").sortWithinPartitions("iter", "var", "i")
    rows.select("iter", "var", F.col("line").alias("value")).write.partitionBy("iter", "var").text(path)


def write_vocabulary(names: DataFrame, path: str) -> None:
    """One name a line of names (id, name), in order of id."""
    names.repartitionByRange("id").sortWithinPartitions("id").select("name").write.text(path)


def news_text(sents: DataFrame) -> DataFrame:
    """(value): a record for each sentence of sents (docid, day, sents), its id docid:S<n>, its date YYMMDD."""
    each = sents.select("docid", "day", F.posexplode("sents").alias("n", "text"))
    return each.select(F.concat(F.date_format("day", "yyMMdd"), F.lit(" "), F.col("docid").cast("string"), F.lit(":S"), F.col("n").cast("string"), F.lit("\n"), "text").alias("value"))
