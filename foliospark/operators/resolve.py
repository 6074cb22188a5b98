"""Matching of read values to reference tables: by key, by containment, by chains of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import canonical_document, is_traffic_insurer
from ..functions.text import digits, filled, squash
from ..sources.session import settled

#: Rows of a catalogue that is part of the plan itself; of one that is sent to all tasks; larger ones go by their rarest part.
TINY, SMALL = 256, 2000
#: Parts that larger catalogues are looked up by: so many different lengths are all used; from how many characters on fewer are.
FEW, GRAM = 4, 8
#: The least length of a name that is looked up.
LEAST_NAME = 8


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the least by order."""
    over = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(over)).where(F.col("__n") == 1).drop("__n")


def _employees(employees: DataFrame) -> DataFrame:
    return employees.select(
        F.col("id").alias("emp_id"), F.col("full_name").alias("emp_name"), F.col("insurer").alias("emp_insurer"), F.col("id_number").alias("__number")
    )


def employee_by_number(df: DataFrame, employees: DataFrame, number: Column) -> DataFrame:
    """Adds emp_id, emp_name, emp_insurer of the employee whose id number has the digits of `number`."""
    catalogue = first_by(_employees(employees).where(F.col("__number").isNotNull()), "__number", "emp_id")
    key = F.nullif(digits(number.cast("string")), F.lit(""))
    return df.withColumn("__key", key).join(catalogue, F.col("__key") == F.col("__number"), "left").drop("__key", "__number")


def _grams(key: Column, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - size + 1), lambda k: F.substring(key, k, size)))


def _pieces(c: Column, sizes: list[int]) -> Column:
    """The different parts of a text of these few lengths."""
    every = [F.when(F.length(c) >= n, _grams(c, n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.concat(*every) if every else F.array().cast("array<string>")


def _lengths(df: DataFrame, column: str) -> list[int]:
    """The different lengths of the column: as many numbers as its longest text has characters at most."""
    return sorted(r[0] for r in df.select(F.length(column)).distinct().collect())


def _sizes(lengths: list[int]) -> list[int]:
    """Lengths of parts, so that each text has one of its own length or less: all lengths if they are few; else those under GRAM
    and, from there on, the first of each doubling."""
    if len(lengths) <= FEW:
        return lengths
    out = []
    for n in lengths:
        if n < GRAM or not out or out[-1] < GRAM or n >= 2 * out[-1]:
            out.append(n)
    return out


def _own_size(c: Column, sizes: list[int]) -> Column:
    """The largest of the sizes that the text has characters for."""
    return F.array_max(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.length(c)))


def _merged(left: DataFrame, right: DataFrame, *args) -> DataFrame:
    """A join of sorted shuffles. Spark knows a table's bytes on disk, but not how many rows explode makes of it, and would send
    the parts of millions of names through the driver as a small table."""
    return left.join(right.hint("merge"), *args)


def _rarest(df: DataFrame, column: str, sizes: list[int], counts: DataFrame) -> DataFrame:
    """df with __g, for each row the part of its text of its own size that counts (__g, __df) has the least of."""
    size = _own_size(F.col(column), sizes)
    parts = df.withColumn("__g", F.explode(_grams(F.col(column), size)))
    weighed = _merged(parts, counts, "__g", "left")
    return weighed.groupBy(*df.columns).agg(F.min_by("__g", F.struct(F.coalesce("__df", F.lit(0)), "__g")).alias("__g"))


def containment(reads: DataFrame, catalogue: DataFrame, both_ways: bool, small: int = SMALL) -> DataFrame:
    """__read, __order: of each row of reads (__read, __text) the first row of catalogue (__order, __key) whose key the text
    holds, or also, both ways, whose key holds the text. Empty keys and texts match nothing.

    A small catalogue, counted first, is sent to all tasks and compared with every text. A larger one is indexed: different keys
    and different texts are looked up once each, by equality with parts of the other side. Parts have few lengths (_sizes). What
    is as long as a part is looked up as a whole, what is longer by the part of it that the fewest keys share, and then verified.
    """
    reads = reads.where(F.length("__text") > 0)
    catalogue = catalogue.where(F.length("__key") > 0)
    holds = F.contains(F.col("__text"), F.col("__key"))
    if catalogue.limit(small + 1).count() <= small:
        good = holds | F.contains(F.col("__key"), F.col("__text")) if both_ways else holds
        pairs = reads.join(F.broadcast(catalogue), good).select("__read", "__order")
        return pairs.groupBy("__read").agg(F.min("__order").alias("__order"))

    keys = settled(catalogue.groupBy("__key").agg(F.min("__order").alias("__order")))
    texts = settled(reads.select("__text").distinct())
    lengths = _lengths(keys, "__key")
    sizes = _sizes(lengths)
    index = keys.where(F.length("__key").isin(sizes)).withColumn("__g", F.col("__key"))
    if sizes != lengths:
        longer = keys.where(~F.length("__key").isin(sizes))
        parts = longer.select(F.explode(_grams(F.col("__key"), _own_size(F.col("__key"), sizes))).alias("__g"))
        index = index.unionByName(_rarest(longer, "__key", sizes, parts.groupBy("__g").agg(F.count("*").alias("__df"))))
    parts = texts.select("__text", F.explode(_pieces(F.col("__text"), sizes)).alias("__g"))
    found = _merged(parts, index, "__g").where(holds).select("__text", "__order")
    if both_ways and lengths:
        own = texts.where(F.length("__text") <= lengths[-1])  # no key holds a longer one
        lengths = _lengths(own, "__text")
        sizes = _sizes(lengths)
        parts = keys.select("__order", "__key", F.explode(_pieces(F.col("__key"), sizes)).alias("__g"))
        least = parts.groupBy("__g").agg(F.min("__order").alias("__order"), F.count("*").alias("__df"))
        whole = own.where(F.length("__text").isin(sizes))
        found = found.unionByName(_merged(whole, least, F.col("__text") == F.col("__g")).select("__text", "__order"))
        if sizes != lengths:
            longer = _rarest(own.where(~F.length("__text").isin(sizes)), "__text", sizes, least.select("__g", "__df"))
            inside = _merged(longer, parts, "__g").where(F.contains(F.col("__key"), F.col("__text")))
            found = found.unionByName(inside.select("__text", "__order"))
    first = found.groupBy("__text").agg(F.min("__order").alias("__order"))
    hits = _merged(reads, first, "__text").select("__read", "__order")
    return hits.groupBy("__read").agg(F.min("__order").alias("__order"))


def employee_by_name(df: DataFrame, employees: DataFrame, key: str, name: Column) -> DataFrame:
    """key and emp_id, emp_name, emp_insurer of the first employee by id whose name equals, holds or is held by the name
    read, both folded and without spaces; names under LEAST_NAME characters match nothing."""
    catalogue = _employees(employees)
    text = squash(name)
    reads = df.select(F.col(key).alias("__read"), text.alias("__text")).where(F.length("__text") >= LEAST_NAME)
    found = containment(reads, catalogue.select(F.col("emp_id").alias("__order"), squash(F.col("emp_name")).alias("__key")), True)
    own = _merged(found, catalogue, F.col("__order") == F.col("emp_id"))
    return own.select(F.col("__read").alias(key), "emp_id", "emp_name", "emp_insurer")


def employee(df: DataFrame, employees: DataFrame, key: str, number: Column, name: Column) -> DataFrame:
    """The employee by id number, or else by name; only rows left without one are looked up by name, and only their key and
    name go that way."""
    first = employee_by_number(df, employees, number)
    rest = employee_by_number(df.select(key, number.alias("__asked"), name.alias("__name")), employees, F.col("__asked"))
    rest = rest.where(F.col("emp_id").isNull() & filled(F.col("__name")).isNotNull()).select(key, "__name")
    second = employee_by_name(rest, employees, key, F.col("__name")).select(
        F.col(key).alias("__k"), F.col("emp_id").alias("__i"), F.col("emp_name").alias("__n"), F.col("emp_insurer").alias("__e")
    )
    joined = first.join(second, F.col(key) == F.col("__k"), "left")
    by_number = F.col("emp_id").isNotNull()
    pick = lambda a, b: F.when(by_number, F.col(a)).otherwise(F.col(b)).alias(a)
    return joined.select(*df.columns, pick("emp_id", "__i"), pick("emp_name", "__n"), pick("emp_insurer", "__e"))


def diagnosis(df: DataFrame, diagnoses: DataFrame, code: Column) -> DataFrame:
    """Adds dx_id and dx_text of the diagnosis of this code, dots left out on both sides, capitals on the read one."""
    catalogue = diagnoses.select(
        F.col("id").alias("dx_id"), F.col("description").alias("dx_text"), F.replace("code", F.lit("."), F.lit("")).alias("__code")
    )
    catalogue = first_by(catalogue.where(F.col("__code").isNotNull()), "__code", "dx_id")
    key = F.nullif(F.upper(F.replace(code, F.lit("."), F.lit(""))), F.lit(""))
    return df.withColumn("__key", key).join(catalogue, F.col("__key") == F.col("__code"), "left").drop("__key", "__code")


def insurer_by_keyword(df: DataFrame, insurers: DataFrame, text: Column, prefix: str = "ins") -> DataFrame:
    """Adds <prefix>_id, _kind, _name of the first insurer by id whose keyword the text holds, both folded and without
    spaces. A tiny catalogue, read first, becomes part of the plan; otherwise each distinct text is looked up once."""
    names = [f"{prefix}_{c}" for c in ("id", "kind", "name")]
    catalogue = insurers.select(F.col("id").alias(names[0]), F.col("kind").alias(names[1]), F.col("keyword").alias(names[2]))
    keys = insurers.select(F.col("id").alias("__order"), squash(F.col("keyword")).alias("__key"), "kind", "keyword")
    few = keys.where(F.length("__key") > 0).orderBy("__order").limit(TINY + 1).collect()
    if len(few) <= TINY:
        kinds = dict(zip(names, (catalogue.schema[n].dataType for n in names)))
        rows = [F.struct(F.lit(r["__key"]).alias("key"), *[F.lit(r[c]).cast(kinds[n]).alias(n) for n, c in zip(names, ("__order", "kind", "keyword"))]) for r in few]
        if not rows:
            return df.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()})
        held = df.withColumn("__text", squash(text))
        # named twice, so that the text is folded once a row and not for each keyword
        first = F.get(F.filter(F.array(*rows), lambda r: F.contains(F.col("__text"), r["key"])), F.lit(0))
        held = held.withColumn("__hit", F.when(F.length("__text") > 0, first))
        return held.withColumns({n: F.col("__hit")[n] for n in names}).drop("__text", "__hit")
    keyed = settled(df.withColumn("__text", squash(text)))
    reads = keyed.select("__text").distinct().withColumn("__read", F.col("__text"))
    found = containment(reads, keys.select("__order", "__key"), False)
    hits = _merged(found, catalogue, F.col("__order") == F.col(names[0])).select("__read", *names)
    return _merged(keyed, hits, F.col("__text") == F.col("__read"), "left").drop("__text", "__read")


def insurer(df: DataFrame, insurers: DataFrame, text: Column, employee_insurer: Column, applies: Column) -> DataFrame:
    """Adds ins_id, ins_kind, ins_name, ins_from_employee, ins_unknown, is_traffic.

    The insurer read, unless it is a traffic insurer; else the employee's; else 1 of kind 1 and ins_unknown. Nothing where
    it doesn't apply (permits and holidays)."""
    own = df.withColumn("is_traffic", is_traffic_insurer(text))
    own = insurer_by_keyword(own, insurers, F.when(applies & ~F.col("is_traffic"), text), "__a")
    own = insurer_by_keyword(own, insurers, F.when(applies & F.col("__a_id").isNull(), employee_insurer), "__b")
    unknown = applies & F.coalesce("__a_id", "__b_id").isNull()
    return own.withColumns(
        {
            "ins_id": F.coalesce("__a_id", "__b_id", F.when(unknown, F.lit(1))),
            "ins_kind": F.when(F.col("__a_id").isNotNull(), F.col("__a_kind")).otherwise(F.coalesce("__b_kind", F.when(unknown, F.lit(1)))),
            "ins_name": F.coalesce("__a_name", "__b_name"),
            "ins_from_employee": F.col("__a_id").isNull() & F.col("__b_id").isNotNull(),
            "ins_unknown": unknown,
        }
    ).drop("__a_id", "__a_kind", "__a_name", "__b_id", "__b_kind", "__b_name")


def requirements(df: DataFrame, table: DataFrame, insurer_id: Column, type_id: Column) -> DataFrame:
    """Adds required: the table's documents for this insurer and type, by id, canonical; null if it has none."""
    own = table.groupBy(F.col("insurer_id").alias("__i"), F.col("type_id").alias("__t")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", "document"))), lambda r: canonical_document(r["document"])).alias("required")
    )
    keyed = df.withColumns({"__x": insurer_id, "__y": type_id})
    return keyed.join(own, (F.col("__x") == F.col("__i")) & (F.col("__y") == F.col("__t")), "left").drop("__x", "__y", "__i", "__t")
