"""File names to cases: parsing, grouping, documents required and present, run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import BASE_DOCUMENTS, RECEPTION, canonical_document, default_requirements, document_group, missing_documents
from ..functions.text import stem, strip, suffix

#: Extensions taken in, the folder of misnamed files, and the grammar of names: number, type, counter.
EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
MISNAMED = "sin_nomenclatura"
NAME = r"^([0-9]{5,15})[_-]([A-Za-zÑñ]+)(?:[_-]([0-9]{1,3}))?$"


def channel_of(path: Column) -> Column:
    """The reception channel named by the first folder that names one, else WHATSAPP."""
    parts = F.transform(F.split(path, "/"), F.upper)
    known = F.filter(parts, lambda p: p.isin(list(RECEPTION)))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("WHATSAPP"))


def inbox_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Of files with a path under the inbox those to take in, with their channel."""
    p = F.col(path)
    taken = suffix(p).isin(list(EXTENSIONS)) & (F.get(F.split(p, "/"), F.lit(0)) != MISNAMED)
    return files.where(taken).withColumn("channel", channel_of(p))


def parse_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds id_number, doc_type (capitals), counter and case_id from the file name; all null if it breaks the grammar."""
    named = files.withColumn("__stem", stem(F.col(path)))
    # the grammar holds no other separators than these two, so one match and one split give all parts
    named = named.withColumn("__parts", F.when(F.col("__stem").rlike(NAME), F.split(F.translate("__stem", "-", "_"), "_")))
    part = lambda k: F.get("__parts", F.lit(k))
    return named.withColumns({"id_number": part(0), "doc_type": F.upper(part(1)), "counter": part(2), "case_id": part(0)}).drop("__stem", "__parts")


def split_names(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of cases, misnamed files)."""
    return parsed.where(F.col("case_id").isNotNull()), parsed.where(F.col("case_id").isNull())


def cases(parsed: DataFrame, path: str = "path") -> DataFrame:
    """One row per case, whatever its files' channels: present (canonical types, sorted), n_files, n_base, base (path of the
    first base document by path), first_path, channel (of the first file). Aggregates keep sets and least values only, so
    a case of very many files is summed up before the shuffle."""
    is_base = F.col("doc_type").isin(list(BASE_DOCUMENTS))
    return (
        parsed.where(F.col("case_id").isNotNull())
        .groupBy("case_id")
        .agg(
            F.collect_set("doc_type").alias("present"),
            F.count("*").alias("n_files"),
            F.count_if(is_base).alias("n_base"),
            F.min(F.when(is_base, F.col(path))).alias("base"),
            F.min(F.when(is_base, F.struct(F.col(path).alias("p"), F.col("doc_type").alias("t"))))["t"].alias("base_type"),
            F.min(path).alias("first_path"),
            F.min_by("channel", path).alias("channel"),
        )
        .withColumn("present", F.array_sort(F.array_distinct(F.filter(F.transform("present", canonical_document), lambda x: x.isNotNull()))))
    )


def check_documents(df: DataFrame, present: Column, required: Column) -> DataFrame:
    """Adds missing (required documents, in order, that no present one stands for) and documents (COMPLETA or INCOMPLETA)."""
    return df.withColumn("missing", missing_documents(required, present)).withColumn(
        "documents", F.when(F.size("missing") == 0, F.lit("COMPLETA")).otherwise(F.lit("INCOMPLETA"))
    )


def check_default_documents(df: DataFrame, type_id: Column, present: Column) -> DataFrame:
    return check_documents(df, present, default_requirements(type_id))


def missing_by_anti_join(required: DataFrame, present: DataFrame, case_id: str = "case_id", document: str = "document") -> DataFrame:
    """The rows of required (case, document) whose group has no row in present (case, document); nulls match nothing.

    Keys are made free of nulls, a side's own text in their place: for keys that may be null Spark adds a filter that repeats
    all that made them at the scan.
    """
    group = lambda c: document_group(canonical_document(c))
    own = present.select(F.col(case_id).alias("__c"), F.col(document).alias("__d")).distinct()
    own = own.select(F.coalesce("__c", F.lit("?present")).alias("__c"), F.coalesce(group(F.col("__d")), F.lit("?present")).alias("__g"))
    asked = required.withColumns({"__k": F.coalesce(case_id, F.lit("?required")), "__x": F.coalesce(group(F.col(document)), F.lit("?required"))})
    return asked.join(own, (F.col("__k") == F.col("__c")) & (F.col("__x") == F.col("__g")), "left_anti").drop("__k", "__x")


def run_summary(done: DataFrame, misnamed: DataFrame, complete: Column, failed: Column) -> DataFrame:
    """One row of counters: cases, complete ones, incomplete ones (all others that didn't fail), failed ones, misnamed files."""
    own = done.agg(
        F.count("*").alias("casos_total"),
        F.count_if(complete & ~failed).alias("procesados"),
        F.count_if(~complete & ~failed).alias("incompletos"),
        F.count_if(failed).alias("cuarentena"),
    )
    stray = misnamed.agg(F.count("*").alias("sin_nomenclatura"))
    return own.withColumn("__one", F.lit(1)).join(stray.withColumn("__one", F.lit(1)), "__one").drop("__one")


def inbox_counts(parsed: DataFrame) -> DataFrame:
    """One row: files, well named, misnamed, distinct cases."""
    return parsed.agg(
        F.count("*").alias("archivos"),
        F.count("case_id").alias("con_nomenclatura"),
        F.count_if(F.col("case_id").isNull()).alias("sin_nomenclatura"),
        F.count_distinct("case_id").alias("casos"),
    )


def first_cases(df: DataFrame, limit: int, order: str = "first_path") -> DataFrame:
    """The batch: the first cases in the order of their files."""
    return df.orderBy(order, "case_id").limit(limit)


def first_pages(pages: DataFrame, most: int, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """The first pages of each document by number, and truncated: whether it has more."""
    over = Window.partitionBy(doc).orderBy(page)
    ranked = pages.withColumn("__n", F.row_number().over(over)).where(F.col("__n") <= most + 1)
    total = F.max("__n").over(Window.partitionBy(doc))
    return ranked.withColumn("truncated", total > most).where(F.col("__n") <= most).drop("__n")


def page_text(
    pages: DataFrame, relevant: Column, doc: str = "doc_id", page: str = "page_no", text: str = "text", error: str | None = None
) -> DataFrame:
    """Per document the text of its relevant pages in order, of all pages if none is, joined by line feeds and stripped; with
    an error column also its greatest value."""
    own = F.struct(F.col(page).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(relevant, F.lit(False)).alias("r"))
    more = [F.max(error).alias(error)] if error else []
    rows = pages.groupBy(doc).agg(F.sort_array(F.collect_list(own)).alias("p"), *more)
    chosen = F.filter("p", lambda x: x["r"] | ~F.exists("p", lambda y: y["r"]))
    return rows.select(doc, strip(F.array_join(F.transform(chosen, lambda x: x["t"]), "\n")).alias("text"), *([error] if error else []))
