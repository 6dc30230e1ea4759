"""Lines that repeat an earlier line, whole or with one word changed: deletion neighbourhoods.

A line is its sequence of words. Two lines are near if they are equal, or if both have at
least `LEAST_WORDS` words and one word inserted, deleted or replaced makes them equal. Every
line that has a near line before it (by document, then by place) is a repeat of the earliest
such line.

A line that may have a near one emits a hashed key for each deleted word: the other words in
their places with the deleted place (equal keys: one word replaced), and the shorter
sequence itself (equal to the key of a whole line: one word inserted). In a group of equal
keys all lines are near its earliest, or near its whole line, so a group of any size gives
one pair a line and never all its pairs. The edit distance of each pair is then verified.

One edit leaves the first or the last half of both lines as it was. Lines that share
neither half with any other line have no near one, and emit nothing.

Only DataFrame functions are used; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridecast.llm.scratch import written

LEAST_WORDS = 8
#: Bits of the filter that keeps lines without a candidate out of the shuffle of their texts: one
#: broadcast row of two megabytes, whatever the input.
FILTER_BITS = 1 << 23


def _canonical(line: Column) -> Column:
    """The words of a line with one space between; most lines are like that already."""
    white = "\t\r\x0b\f"
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for sign in white:
        odd |= line.contains(sign)
    words = F.filter(F.split(F.translate(line, white, "    "), " "), lambda w: w != "")
    return F.when(odd, F.array_join(words, " ")).otherwise(line)


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every line with its document and place."""
    text = F.col(text_column)
    return docs.where(text.isNotNull()).select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("doc_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )


def _halves(line: Column, size: Column) -> Column:
    """Keys of the first and last k words. k depends on the number of words alone, and a line one
    word short of the next k has the keys of both, so lines a word apart have a common k."""

    def keys(n: Column) -> list[Column]:
        k = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double") + 0.25)) - 1).cast("int")
        first, last = (F.call_function("substring_index", line, F.lit(" "), x) for x in (k, -k))
        return [F.xxhash64(F.lit("first"), k, first), F.xxhash64(F.lit("last"), k, last)]

    next_k = F.array_distinct(F.array(*keys(size), *keys(size + 1)))
    one_k = F.array(*keys(size))
    # size + 1 is a power of two: the only sizes with two lengths of half.
    both = size.bitwiseAND(size + 1) == 0
    return F.when(size < LEAST_WORDS, F.array().cast("array<bigint>")).when(both, next_k).otherwise(one_k)


def _emitted(lines: DataFrame) -> DataFrame:
    """For each deleted word of each line (line, words): `hole`, the other words in their places,
    and `rest`, the sequence without it; and `whole`, the sequence itself, once a line.

    A sequence's hash is the sum of its words' hashes with their places, in two halves of
    32 bits, so a deletion changes the sum by what running sums know. Where `lines` are dealt by
    `line` already, the windows take their words where they are."""
    words = lines.select("line", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))
    here, before = F.xxhash64("word", F.col("at")), F.xxhash64("word", F.col("at") - 1)
    parts = {"h1": F.shiftrightunsigned(here, 32), "h2": here.bitwiseAND(F.lit(0xFFFFFFFF)),
             "b1": F.shiftrightunsigned(before, 32), "b2": before.bitwiseAND(F.lit(0xFFFFFFFF))}
    words = words.select("line", "size", "at", *[c.alias(n) for n, c in parts.items()])
    line = W.partitionBy("line")
    upto = line.orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    total = {n: F.sum(n).over(line.orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for n in parts}
    after = {n: total[n] - F.sum(n).over(upto) for n in ("b1", "b2")}
    until = {n: F.sum(n).over(upto) - F.col(n) for n in ("h1", "h2")}
    return words.select(
        "line",
        F.xxhash64(F.lit("hole"), total["h1"] - F.col("h1"), total["h2"] - F.col("h2"), "at", "size").alias("hole"),
        F.xxhash64(F.lit("seq"), until["h1"] + after["b1"], until["h2"] + after["b2"], F.col("size") - 1).alias("rest"),
        F.when(F.col("at") == 0, F.xxhash64(F.lit("seq"), total["h1"], total["h2"], "size")).alias("whole"),
    )


def _maybe(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """`lines` without most of those whose place is not among the places of `wanted`.

    The filter only spares work: the join behind it decides, however full the filter gets.
    """

    def place(prefix: str, part: int) -> Column:
        bit = F.pmod(F.xxhash64(*[f"{prefix}{c}" for c in ("doc_id", "doc_hash", "line_no")]), F.lit(FILTER_BITS))
        return (F.floor(bit / 32) if part == 0 else bit % 32).cast("int")

    words = wanted.select(place("_", 0).alias("at"), place("_", 1).alias("bit"))
    words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = lines.sparkSession.range(FILTER_BITS // 32).select(F.col("id").cast("int").alias("word"))
    every = every.join(words, F.col("word") == F.col("at"), "left")
    ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    row = written(every.agg(F.transform(ordered, lambda x: x["bits"]).alias("_bits")), "line-filter")
    marked = lines.withColumns({"_word": place("", 0), "_bit": place("", 1)})
    set_bit = F.expr("shiftright(get(_bits, _word), _bit) % 2 <> 0")
    return marked.join(F.broadcast(row), set_bit, "left_semi").drop("_word", "_bit")


def _earlier(rows: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """(line, match): rows joined by key with the earliest line of the key, if it is earlier."""
    least = least.select(F.col(key).alias("_key"), "match")
    return rows.join(least, F.col(key) == F.col("_key")).where(F.col("match") < F.col("line")).select("line", "match")


def _pairs(keys: DataFrame) -> DataFrame:
    """(line, match): lines with the earliest line before them that has an equal key.

    Keys are grouped first. Most groups with a pair have no third line, and give it at once;
    the rows of larger groups alone are joined with the earliest line.
    """
    holes = keys.select("hole", "line")
    of_hole = holes.groupBy("hole").agg(F.min("line").alias("match"), F.max("line").alias("last"), F.count(F.lit(1)).alias("n"))
    of_hole = written(of_hole.where("match < last"), "shared-holes")
    rests = keys.select(F.col("rest").alias("key"), "line")
    wholes = keys.where("whole IS NOT NULL").select(F.col("whole").alias("key"), "line")
    null = F.lit(None).cast("bigint")
    both = wholes.select("key", F.col("line").alias("whole"), null.alias("rest"))
    both = both.unionByName(rests.select("key", null.alias("whole"), F.col("line").alias("rest"))).groupBy("key")
    both = both.agg(*[f(c).alias(f"{n}_{c}") for c in ("whole", "rest") for n, f in (("first", F.min), ("last", F.max))])
    both = written(both.where("first_whole IS NOT NULL AND first_rest IS NOT NULL"), "shared-sequences")

    def matched(line: str, match: str, rows: DataFrame) -> DataFrame:
        one = both.where(F.col(f"first_{line}") == F.col(f"last_{line}"))
        one = one.where(F.col(f"first_{match}") < F.col(f"first_{line}"))
        more = both.where(F.col(f"first_{line}") < F.col(f"last_{line}")).withColumn("match", F.col(f"first_{match}"))
        return one.select(F.col(f"first_{line}").alias("line"), F.col(f"first_{match}").alias("match")).unionByName(_earlier(rows, "key", more))

    return (
        of_hole.where("n = 2").select(F.col("last").alias("line"), "match")
        .unionByName(_earlier(holes, "hole", of_hole.where("n > 2")))
        .unionByName(matched("rest", "whole", rests))
        .unionByName(matched("whole", "rest", wholes))
        .distinct()
    )


def _distance(a: Column, b: Column) -> Column:
    """0 or 1 edits between two arrays of words, or 2 for more."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    n = F.size(shorter)
    differ = F.zip_with(F.slice(longer, F.lit(1), n), shorter, lambda x, y: x != y)
    place = F.array_position(differ, True).cast("int")  # from 1; 0 if none
    place = F.when(place == 0, n + 1).otherwise(place)
    after_both = F.slice(longer, place + 1, F.greatest(n - place, F.lit(0))) == F.slice(shorter, place + 1, F.greatest(n - place, F.lit(0)))
    after_long = F.slice(longer, place + 1, F.greatest(n - place + 1, F.lit(0))) == F.slice(shorter, place, F.greatest(n - place + 1, F.lit(0)))
    return (
        F.when((F.size(longer) == n) & (place > n), 0)
        .when((F.size(longer) == n) & after_both, 1)
        .when((F.size(longer) == n + 1) & after_long, 1)
        .otherwise(2)
    )


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each line that repeats an earlier one: doc_id, doc_hash, line_no (from 0),
    first_doc_id, first_line_no, distance.

    "Earlier" is by document id (null first), then the text's hash among documents of one id,
    then the place of the line. The first line is the earliest of all lines near this one,
    whether or not it is a repeat itself. Lines without a word, and null texts, are never
    repeats; rows repeated whole (id and text) count as one document. Other columns are
    ignored. An empty table gives no rows.
    """
    lines = _lines(docs, id_column, text_column)
    place = F.struct("doc_id", "doc_hash", "line_no")
    line = F.col("line")
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    seen = lines.withColumn("line", _canonical(line)).withColumn("size", F.when(line == "", 0).otherwise(spaces + 1))
    seen = written(
        seen.select("doc_id", "doc_hash", "line_no", "size", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), _halves(line, F.col("size")).alias("halves")),
        "lines",
    ).where("size > 0")
    identity = ["h", "g", "size"]
    distinct = seen.groupBy(*identity).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.first("halves").alias("halves")
    )
    distinct = written(distinct, "distinct-lines")
    halves = distinct.select("first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("half").alias("_half"))
    wanted = halves.join(shared, F.col("half") == F.col("_half"), "left_semi").select("first").distinct()
    # Numbers in the order of the lines stand for their places; only places are sorted, not texts.
    number = F.monotonically_increasing_id().alias("number")
    fields = ("doc_id", "doc_hash", "line_no")
    wanted = written(wanted.orderBy("first").select(number, *[F.col(f"first.{c}").alias(f"_{c}") for c in fields]), "wanted-lines")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("doc_hash") == F.col("_doc_hash")) & (F.col("line_no") == F.col("_line_no"))
    candidates = written(
        _maybe(lines, wanted)
        .join(wanted, same)
        .select(F.col("number").alias("line"), place.alias("first"), F.split(_canonical(line), " ").alias("words")),
        "candidate-lines",
    )
    # Rows repeated whole give a line once; the lines are dealt by number, as the windows and joins below want them.
    texts = candidates.dropDuplicates(["line"])
    keys = written(_emitted(texts), "line-keys")
    pairs = _pairs(keys)
    own = texts.select(F.col("line").alias("_line"), "first", F.col("words").alias("own"))
    other = texts.select(F.col("line").alias("_other"), F.col("first").alias("match_first"), "words")
    checked = (
        pairs.join(own, F.col("line") == F.col("_line"))
        .join(other, F.col("match") == F.col("_other"))
        .where(_distance(F.col("own"), F.col("words")) <= 1)
    )
    near = checked.groupBy(F.col("first").alias("_first")).agg(F.min("match_first").alias("match"))
    earliest = distinct.join(near, F.col("first") == F.col("_first"), "left").select(
        *identity, "first", "last", F.coalesce("match", "first").alias("earliest"), F.col("match").isNotNull().cast("int").alias("distance")
    )
    # A line that occurs once and has no near line before it repeats nothing.
    earliest = earliest.where((F.col("last") != F.col("first")) | (F.col("distance") == 1)).drop("last", "first")
    return (
        seen.drop("halves")
        .join(earliest, identity)
        .where(place > F.col("earliest"))
        .select(
            "doc_id",
            "doc_hash",
            "line_no",
            F.col("earliest.doc_id").alias("first_doc_id"),
            F.col("earliest.line_no").alias("first_line_no"),
            "distance",
        )
    )


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` without the lines that repeat an earlier one; a document left without any line goes.

    Lines without a word stay where another line of the document stays. Null texts, and texts
    that had no word before, stay as they are. All columns are kept.
    """
    repeats = repeated_lines(docs, id_column, text_column).distinct()
    gone = repeats.groupBy(F.col("doc_id").alias("_doc_id"), F.col("doc_hash").alias("_doc_hash")).agg(
        F.sort_array(F.collect_list("line_no")).alias("_gone")  # no longer than the document
    )
    gone = written(gone, "gone-lines")
    text = F.col(text_column)
    same = F.col(id_column).eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text) == F.col("_doc_hash"))
    lines = F.split(text, "\n")
    # The runs of lines between those that go.
    starts = F.concat(F.array(F.lit(-1)), F.col("_gone"))
    ends = F.concat(F.col("_gone"), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 2, e - s - 1)))
    left = docs.join(gone, same, "left")
    changed = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    left = left.withColumn(text_column, changed)
    return left.where(F.col("_gone").isNull() | F.col(text_column).rlike(r"\S")).select(*docs.columns)


#: DuckDB SQL of the rows of `repeated_lines` over `documents` (ids are unique there).
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
seen AS (
  SELECT doc_id, line_no, list_filter(string_split(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda w: w <> '') AS words
  FROM lines),
full_lines AS (SELECT * FROM seen WHERE len(words) > 0),
firsts AS (
  SELECT words, len(words) AS size, min(struct_pack(d := doc_id, n := line_no)) AS first FROM full_lines GROUP BY words),
holes AS (
  SELECT first, size, i, list_concat(words[1:i - 1], words[i + 1:]) AS rest
  FROM (SELECT first, size, words, unnest(range(1, size + 1)) AS i FROM firsts WHERE size >= 8)),
near AS (
  SELECT a.first, b.first AS match FROM holes a JOIN holes b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND b.first < a.first
  UNION ALL
  SELECT a.first, b.first FROM holes a JOIN firsts b ON a.rest = b.words AND b.size >= 8 AND b.first < a.first
  UNION ALL
  SELECT b.first, a.first FROM holes a JOIN firsts b ON a.rest = b.words AND b.size >= 8 AND a.first < b.first),
best AS (SELECT first, min(match) AS match FROM near GROUP BY first),
earliest AS (
  SELECT f.words, coalesce(b.match, f.first) AS e, CAST(b.match IS NOT NULL AS INTEGER) AS distance
  FROM firsts f LEFT JOIN best b ON f.first = b.first)
SELECT s.doc_id, CAST(s.line_no AS INTEGER) AS line_no, e.e.d AS first_doc_id, CAST(e.e.n AS INTEGER) AS first_line_no, e.distance
FROM full_lines s JOIN earliest e ON s.words = e.words
WHERE struct_pack(d := s.doc_id, n := s.line_no) > e.e
"""
