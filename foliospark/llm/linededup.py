"""Line deduplication by an exact set-similarity join, in DataFrame expressions only.

A line is the set of its lower-cased words. Equal lines are one class, held by its first occurrence. Words are ordered by
rarity: by the number of different lines, over the whole corpus, that hold a word of the same hash bucket, then by the
word's hash. Any such order makes the join exact; the bucket table, of one fixed size whatever the corpus, tells frequent
words from rare ones, which is what makes it fast. The prefix of a class holds its rarest words, and two classes of Jaccard
similarity NUM / DEN or more share a word of their prefixes. Words meet only within a class of sizes; a line near the next class
stands in both. Candidates must also pass filters on length, on the position of
the shared word, and on a parity sketch that the size of the sets' difference bounds; those left are verified on the words
themselves. A line is removed if an equal line or one as similar occurs earlier, by doc_id and line number.

Arrays are taken apart by the outer forms of explode: for the others Spark adds a filter on the array's size, which repeats
all that made the array. All joins that look for partners are semi joins, so no group of similar lines is written out as pairs, and Spark may split a
partition that one prefix word makes large. Steps end in tables in the shared folder; what a step shuffled goes with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The least similarity is NUM / DEN.
NUM, DEN = 4, 5
#: Buckets of the words' rarity table, an array of as many numbers in the plan.
BUCKETS = 1 << 16
#: Lines of more words than this have a sketch of 128 bits, others one of 64.
SHORT = 64
#: Parts that the lines of one word are dealt to where they are only looked up.
SALT = 16
#: White space that parts words.
BLANKS = ("\t", "\r", "\x0b", "\x0c")
#: What names a line: the document, and a number that holds the line's own below a tag of the document's text.
PLACE = ("doc_id", "line")


def _plain(c: Column) -> Column:
    """Lower case, white space other than line feeds as spaces."""
    out, some = F.lower(c), F.lit(False)
    for blank in BLANKS:
        out, some = F.replace(out, F.lit(blank), F.lit(" ")), some | F.contains(c, F.lit(blank))
    return F.when(some, out).otherwise(F.lower(c))  # to look for a character costs less than to replace none


def _words(c: Column) -> Column:
    """The different words of a line."""
    return F.array_except(F.split(c, " "), F.array(F.lit("")))


def _common(a: Column, b: Column) -> Column:
    """How many words two lines share; an intersection holds each once."""
    return F.size(F.array_remove(F.array_intersect(F.split(a, " "), F.split(b, " ")), ""))


def _tag() -> Column:
    """31 bits of the text's hash above 32 free ones: texts that share a doc_id are told apart, and come in this order."""
    return F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)), 32)


def _number(line: Column) -> Column:
    return line.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def first_occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line and words (as one string) of the first of all equal lines that have a word."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), _tag().alias("t"), _plain(F.col("text")).alias("x"))
    lines = rows.select("doc_id", "t", F.posexplode_outer(F.split("x", "\n")).alias("n", "words")).where(F.trim("words") != "")
    place = F.struct("doc_id", F.col("t").bitwiseOR(F.col("n").cast("bigint")).alias("line"))
    first = lines.groupBy(F.xxhash64("words").alias("h"), "words").agg(F.min(place).alias("p"))
    return first.select("p.doc_id", "p.line", "words")


def rarity_table(lines: DataFrame) -> bytes:
    """By bucket of a word's hash a byte from 33 to 126 that grows with the logarithm of the lines that hold such a word. Only
    this table of fixed size comes to the driver."""
    word = lines.select(F.explode_outer(F.split("words", " ")).alias("w"))
    counts = word.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count()
    level = F.chr(F.least(F.lit(126), F.lit(33) + F.floor(F.log2("count") * 3)).cast("bigint"))
    every = lines.sparkSession.range(BUCKETS).withColumnRenamed("id", "b")
    rows = (
        every.join(counts.select("b", level.alias("c")), "b", "left")
        .select(F.expr("b div 4096").alias("g"), F.struct("b", F.coalesce("c", F.lit("!")).alias("c")).alias("x"))
        .groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "").alias("s"))
    )
    return "".join(r["s"] for r in sorted(rows.collect(), key=lambda r: r["g"])).encode("ascii")


def _keys(words: Column, rarity: bytes) -> Column:
    """A key for each different word of a line, rarest first: the rarity's byte above 56 bits of the hash.

    The bytes are numbers of an array that folds to a constant. None of it may be null: arrays that can't hold nulls are
    sorted as plain numbers."""
    table = F.split(F.lit(",".join(map(str, rarity))), ",").cast("array<bigint>")

    def key(h: Column) -> Column:
        level = F.coalesce(F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("bigint"))
        return F.shiftleft(level, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.transform(F.transform(_words(words), lambda w: F.xxhash64(w)), key))


def _parity(keys: Column) -> Column:
    """64 bits, each the parity of the words whose hash has its number: two sets differ in at least as many words as bits."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(bit(k)))


def _prefix(n: Column, num: int, den: int) -> Column:
    return n - F.ceil(n * num / F.lit(den)).cast("int") + 1


def _packed(n: Column, at: Column) -> Column:
    """Size and place of a word in one number; rows are many, and each column of them is paid for."""
    return F.shiftleft(n.cast("bigint"), 32).bitwiseOR(at.cast("bigint"))


def _size(side: str) -> Column:
    return F.shiftright(f"{side}.size_at", 32)


def _at(side: str) -> Column:
    return F.col(f"{side}.size_at").bitwiseAND(F.lit((1 << 32) - 1))


def _like(num: int, den: int) -> Column:
    """What two lines a, b that share a word must pass before they are compared: length, position and sketch. The two halves
    of a long line's sketch have the sketch of a short line as their sum."""
    x, y = _size("a"), _size("b")
    left = F.least(x - _at("a"), y - _at("b"))
    even, odd = F.col("a.even").bitwiseXOR(F.col("b.even")), F.col("a.odd").bitwiseXOR(F.col("b.odd"))
    differ = F.when((x > SHORT) & (y > SHORT), F.bit_count(even) + F.bit_count(odd)).otherwise(F.bit_count(even.bitwiseXOR(odd)))
    return (
        (x * num <= y * den)
        & (y * num <= x * den)
        & ((left * (num + den)) >= (x + y) * num)
        & (differ * (num + den) <= (x + y) * (den - num))
    )


def _step(num: int, den: int) -> int:
    """Binary digits of a size class: sizes of like lines lie in one class or in two that follow each other."""
    return next(s for s in range(1, 64) if num << s >= den)


def _prefix_rows(lines: DataFrame, rarity: bytes, num: int, den: int) -> DataFrame:
    """A row for each prefix word of each line: k (its key), size_at (the line's size, the word's place in the order), the line's
    place and sketch.

    k is the word's hash and a class of sizes, so that lines far apart in size don't meet. Two like lines meet in the class of
    the larger one: a line also stands in the next class if a line of that class can be like it, by those words of its prefix
    that can be the first they share."""
    sets = lines.select(*PLACE, _keys(F.col("words"), rarity).alias("keys")).withColumn("n", F.size("keys"))
    half = F.when(F.col("n") > SHORT, _parity(F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0))
    step = _step(num, den)
    kind = F.ceil(F.length(F.bin("n")) / F.lit(step)).cast("int")
    least = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("kind") * step)  # size of the next class
    # words at place j with (n - j) * (num + den) >= (n + least) * num
    more = F.floor((F.col("n") * den - least * num) / F.lit(num + den)).cast("int") + 1
    sized = sets.withColumn("kind", kind).withColumn("own", _prefix(F.col("n"), num, den)).withColumn("next", F.greatest(F.lit(0), F.least("own", more)))
    ready = sized.select(
        *PLACE, "n", "kind", "own", _parity(F.col("keys")).alias("all"), half.alias("odd"),
        F.concat(F.slice("keys", F.lit(1), F.col("own")), F.slice("keys", F.lit(1), F.col("next"))).alias("prefix"),
    )
    each = ready.select(*PLACE, "n", "kind", "own", F.col("all").bitwiseXOR(F.col("odd")).alias("even"), "odd", F.posexplode_outer("prefix").alias("at", "k"))
    again = F.col("at") >= F.col("own")
    k = F.shiftleft((F.col("kind") + again.cast("int")).cast("bigint"), 56).bitwiseOR(F.col("k").bitwiseAND(F.lit((1 << 56) - 1)))
    at = F.when(again, F.col("at") - F.col("own")).otherwise(F.col("at"))
    return each.select(*PLACE, k.alias("k"), _packed(F.col("n"), at).alias("size_at"), "even", "odd")


def _another() -> Column:
    return (F.col("a.doc_id") != F.col("b.doc_id")) | (F.col("a.line") != F.col("b.line"))


def _earlier() -> Column:
    return (F.col("b.doc_id") < F.col("a.doc_id")) | ((F.col("b.doc_id") == F.col("a.doc_id")) & (F.col("b.line") < F.col("a.line")))


def _partners(a: DataFrame, b: DataFrame, condition: Column) -> DataFrame:
    """The rows of a that have a row of b with their word and the condition."""
    return a.alias("a").join(b.alias("b"), (F.col("a.k") == F.col("b.k")) & condition, "left_semi")


def _near_copies(lines: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, line of the first occurrences that are like an earlier one."""
    like = _like(num, den)
    rows = _prefix_rows(lines, rarity_table(lines), num, den)
    shared = common.cut(_partners(rows, rows, like & _another()))
    later = common.cut(_partners(shared, shared, like & _earlier()))
    texts = common.cut(lines.join(shared.select(*PLACE).distinct(), list(PLACE), "left_semi"))
    alike = _common(F.col("a.words"), F.col("b.words")) * (num + den) >= (_size("a") + _size("b")) * num

    def verified(some: DataFrame) -> DataFrame:
        # words that very many lines share are dealt to several tasks
        keys = some.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        salted = shared.withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.lit(SALT)).cast("int"))
        others = salted.join(keys, ["k", "salt"], "left_semi").drop("salt")
        found = _partners(some.join(texts, list(PLACE)), others.join(texts, list(PLACE)), like & _earlier() & alike)
        return common.cut(found.select(*PLACE).distinct())

    # a line's rarest shared word nearly always shows its earlier like line; lines left over are compared by all their words
    order = Window.partitionBy(*PLACE).orderBy("size_at", "k")
    found = verified(common.cut(later.withColumn("r", F.row_number().over(order)).where(F.col("r") == 1).drop("r")))
    return found.unionByName(verified(common.cut(later.join(found, list(PLACE), "left_anti"))))


def kept_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, tag and kept (the numbers of the lines that stay) of each document that keeps a line."""
    with common.stored(first_occurrences(docs), "lines", "words") as lines:
        kept = lines.select(*PLACE).join(_near_copies(lines, num, den), list(PLACE), "left_anti")
        own = kept.groupBy("doc_id", F.col("line").bitwiseAND(F.lit(((1 << 31) - 1) << 32)).alias("tag"))
        return common.cut(own.agg(F.collect_list(_number(F.col("line"))).alias("kept")))


def _decided(rows: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """rows (with doc_id, __tag and __full, the numbers of the lines with a word) and __gone, the numbers of those that go."""
    kept = kept_lines(docs, num, den).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__own"), F.col("kept").alias("__kept"))
    joined = rows.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__tag") == F.col("__own")), "left")
    none = F.array().cast("array<int>")
    gone = F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except("__full", F.coalesce("__kept", none)))
    return joined.withColumn("__gone", gone).drop("__id", "__own", "__kept")


def _full() -> Column:
    numbers = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.ltrim(x, F.lit("".join(BLANKS) + " ")) != "", i))
    return F.coalesce(F.filter(numbers, lambda i: i.isNotNull()), F.array().cast("array<int>"))


def line_decisions(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of docs: doc_id, n_lines (lines with a word), n_removed, removed (numbers of the lines that go, from 0).

    Lines without a word are never removed. Null and empty texts have no lines. Rows with a null doc_id take no part and lose
    none. Rows of one doc_id and one text get the same decision; different texts of one doc_id are documents of their own, in
    an order that their hashes give. Texts and lines of any length are taken whole. Of equal or like lines in one document the
    later goes; columns besides doc_id and text are not looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _tag().alias("__tag"), _full().alias("__full"))
    out = _decided(rows, docs, num, den)
    return out.select("doc_id", F.size("__full").alias("n_lines"), F.size("__gone").alias("n_removed"), F.col("__gone").alias("removed"))


def drop_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with the removed lines taken out of text, n_chars (if there is one) counted anew; other columns, whatever their
    names, as they are. A document that loses no line keeps its text as it was."""
    rows = _decided(docs.withColumns({"__tag": _tag(), "__full": _full()}), docs, num, den)
    some = F.size("__gone") > 0
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    rows = rows.withColumn("__text", F.when(some, left).otherwise(F.col("text")))
    named = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(some, F.length("__text")).otherwise(F.col("n_chars"))
    return rows.select(*[named[c].cast(docs.schema[c].dataType).alias(c) if c in named else F.col(f"`{c}`") for c in docs.columns])
