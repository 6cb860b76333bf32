"""Alert text: headers, sections, full text, mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.tables import materialised, tasks_for


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def header_field(header: Column, pattern: str) -> Column:
    """Group 1 of the pattern, null if it isn't found or empty."""
    return F.nullif(F.regexp_extract(header, pattern, 1), F.lit(""))


def parsed_header(header: Column) -> Column:
    """struct(date, subject, archive_number); the time zone at the date's end is cut off and not applied."""
    date = header_field(header, r"Published Date: (.+)\n")
    cut = F.substring(date, F.lit(1), F.length(date) - 4)
    return F.struct(
        F.to_timestamp_ntz(F.when(cut.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), cut), F.lit("yyyy-MM-dd HH:mm:ss")).alias("date"),
        stripped(header_field(header, r"Subject:(.+?)\n")).alias("subject"),
        header_field(header, r"Archive Number: (\d{8}\.\d+)").alias("archive_number"),
    )


def sections(body: Column) -> Column:
    """Titled sections of a body, as array<struct<title, content>>.

    A line that starts with `---` or `******` opens a section titled by the
    line before it, in the first line by the last one; `--` ends it and may end
    it again. Lines between are joined by spaces. What a section gathered is
    lost if another opens or none ends it. An end before any opening stops the
    parse.
    """
    found = "array<struct<title:int,first:int,n:int>>"
    start = F.struct(F.lit(None).cast("int").alias("opened"), F.lit(None).cast("int").alias("closed"), F.lit(False).alias("failed"), F.array().cast(found).alias("out"))

    def step(s: Column, mark: Column) -> Column:
        """Only places of lines are gathered; mark has a marker's place and whether it opens."""
        go, opens = ~s["failed"], mark["opens"]
        failed = s["failed"] | (~opens & s["opened"].isNull())
        closed = F.coalesce(s["closed"], mark["at"])
        ended = F.array(F.struct((s["opened"] - 1).alias("title"), (s["opened"] + 1).alias("first"), (closed - s["opened"] - 1).alias("n")))
        return F.struct(
            F.when(go & opens, mark["at"]).otherwise(s["opened"]).alias("opened"),
            F.when(go & opens, F.lit(None).cast("int")).when(go, closed).otherwise(s["closed"]).alias("closed"),
            failed.alias("failed"),
            F.when(~failed & ~opens, F.concat(s["out"], ended)).otherwise(s["out"]).alias("out"),
        )

    def of_lines(lines: Column) -> Column:
        kind = lambda line: F.when(line.startswith("---") | line.startswith("******"), True).when(line == "--", False)
        marks = F.filter(F.transform(lines, lambda raw, i: F.struct(i.alias("at"), kind(stripped(raw)).alias("opens"))), lambda m: m["opens"].isNotNull())
        places = F.aggregate(marks, start, step, lambda s: s["out"])
        title = lambda p: F.element_at(lines, F.when(p["title"] < 0, F.lit(-1)).otherwise(p["title"] + 1))
        content = lambda p: F.array_join(F.transform(F.slice(lines, p["first"] + 1, p["n"]), stripped), " ")
        return F.transform(places, lambda p: F.struct(title(p).alias("title"), content(p).alias("content")))

    return let(F.split(body, "\n", -1), of_lines)


def full_text(subject: Column, parts: Column) -> Column:
    """Subject, blank line, then title and content of each section with a blank line behind either."""
    return F.concat(F.coalesce(subject, F.lit("")), F.lit("\n\n"), F.array_join(F.transform(parts, lambda p: F.concat(p["title"], F.lit("\n\n"), p["content"], F.lit("\n\n"))), ""))


def without_keys(properties: Column, *names: str) -> Column:
    """A map without the named keys."""
    return F.map_filter(properties, lambda k, v: ~k.isin(*names))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use names it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Greek letters as they are spelled out, in the order of the alphabet from U+03B1 on; the final sigma counts as sigma.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma sigma tau upsilon phi chi psi omega".split()
#: Roman numbers from one to twenty.
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()


def plain_words(text: Column) -> Column:
    """Words of a text or a name in lower case, parted at dashes and other marks, Greek letters spelled out."""
    out = lower = F.lower(text)
    for i, name in enumerate(GREEK):
        out = F.replace(out, F.lit(chr(0x3B1 + i)), F.lit(f" {name} "))
    # Few texts have any, and each letter costs a pass.
    out = F.when(F.rlike(lower, F.lit("[\u03b1-\u03c9]")), out).otherwise(lower)
    return F.filter(F.split(out, r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def later_word(word: Column) -> Column:
    """A word as it stands behind another one: Roman numbers as digits."""
    numbers = F.create_map(*[F.lit(x) for n, r in enumerate(ROMAN, 1) for x in (r, str(n))])
    return F.when(word.isin(*ROMAN), F.element_at(numbers, word)).otherwise(word)


def normalised(text: Column) -> Column:
    """A name as dictionaries hold it: lower case, dashes and other marks as spaces, Greek letters spelled out, Roman numbers behind another word as digits, single spaces."""
    return F.array_join(F.transform(plain_words(text), lambda w, i: F.when(i > 0, later_word(w)).otherwise(w)), " ")


def trimmed_front(text: Column, characters: str) -> Column:
    """text without the leading characters that are in a set."""
    return F.ltrim(text, F.lit(characters))


#: Words of a text that are looked at together.
CHUNK_WORDS = 1024


def places(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc, at, start, surface: where the longest dictionary entries (entry) stand in doc, text, none inside another; at is the chunk's first word, start counts the text's words from 1.

    Texts are cut into chunks that overlap by an entry's length on both sides,
    so that a chunk tells by itself what covers what. Each of its words, with
    as many behind it as an entry may have, meets the entries' first words and
    the lengths of the entries that begin so; only these runs are built, and
    they meet the entries as a whole. The words and the entries are stored, so
    that Spark knows their size and sends them to the texts if they are small;
    if not, both joins are by key. What is found is short rows, dealt by chunk
    to as many tasks as their count needs.
    """
    words = F.split("entry", " ")
    entries = materialised(dictionary.select("entry").where(F.col("entry").isNotNull()).distinct().select("entry", words[0].alias("first"), F.size(words).alias("n")))
    firsts = materialised(entries.groupBy("first").agg(F.array_sort(F.collect_set("n")).alias("lengths")))
    behind = entries.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0] - 1

    def chunks(plain: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(plain), F.lit(CHUNK_WORDS)), lambda at: at < F.size(plain))
        before = lambda at: F.greatest(at - behind, F.lit(0))
        return F.transform(starts, lambda at: F.struct(at.alias("at"), before(at).alias("before"), F.slice(plain, before(at) + 1, at - before(at) + CHUNK_WORDS + behind).alias("words")))

    def runs(later: Column) -> Column:
        """A word that begins a run is taken as it is, others as later words."""
        own = F.slice("words", F.lit(1), F.col("at") - F.col("before") + CHUNK_WORDS)
        # A few words are got one by one, which costs less; what would lie behind the chunk is null then.
        tail = lambda i: F.array(*[F.get(later, i + k) for k in range(1, behind + 1)]) if 0 < behind <= 8 else F.slice(later, i + 2, F.lit(behind))
        return F.transform(own, lambda w, i: F.struct((F.col("before") + i + 1).alias("start"), w.alias("first"), tail(i).alias("tail")))

    # The outer forms, since for the others Spark would compute the arrays a second time, to leave out empty ones; rows without a first word meet nothing.
    parts = documents.select("doc", F.inline_outer(let(plain_words(F.col("text")), chunks)))
    each = parts.select("doc", "at", F.inline_outer(let(F.transform("words", later_word), runs)))
    begun = each.join(firsts, "first").select("doc", "at", "start", "first", "tail", F.explode("lengths").alias("n")).where((F.col("n") == 1) | F.get("tail", F.col("n") - 2).isNotNull())
    spans = begun.select("doc", "at", "start", "n", F.array_join(F.concat(F.array("first"), F.slice("tail", F.lit(1), F.col("n") - 1)), " ").alias("surface"))
    found = materialised(spans.join(entries.select(F.col("entry").alias("surface")), "surface", "left_semi"))

    reach = Window.partitionBy("doc", "at").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    dealt = found.repartition(tasks_for(found), "doc", "at")
    kept = dealt.withColumn("top", F.max("n").over(Window.partitionBy("doc", "at", "start"))).withColumn("covered", F.max(F.col("start") + F.col("n")).over(reach))
    # The words before a chunk's own only cover.
    own = (F.col("start") > F.col("at")) & (F.col("n") == F.col("top")) & (F.col("covered").isNull() | (F.col("covered") < F.col("start") + F.col("n")))
    return kept.where(own).select("doc", "at", "start", "surface")


def mentions(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc, surface, start, db, id, name: the longest dictionary entries in doc, text, none inside another.

    dictionary has entry (a normalised name of any number of words), db, id,
    name; texts are normalised alike, so a Greek letter or a Roman number may
    be spelled either way. start counts the text's words from 1.
    """
    known = materialised(dictionary.select(F.col("entry").alias("surface"), "db", "id", "name"))
    return places(documents, known.select(F.col("surface").alias("entry"))).join(known, "surface").select("doc", "surface", "start", "db", "id", "name")


def first_mentions(documents: DataFrame, best: DataFrame) -> DataFrame:
    """doc, surface, start and best's columns: mentions by one row for each entry, a place once."""
    known = materialised(best)
    once = places(documents, known.select("entry")).dropDuplicates(["doc", "at", "start", "surface"])
    return once.join(known.withColumnRenamed("entry", "surface"), "surface").drop("at")
