"""One set of rules for start, end and days of an absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import MAX_DAYS, days_between, in_range


def reconcile(df: DataFrame, start: str, end: str, days: str, anchored: Column, calculated: str = "start_calculated") -> DataFrame:
    """Replaces the three columns and adds `calculated`.

    Days outside 1 to MAX_DAYS count as unknown but stay. Start and days give the end if it is missing or disagrees; end and
    days give a missing start, which is then calculated; start and end give missing days. Of a start and end that lie
    impossibly the end goes if the start is anchored to its label, else the start.
    """
    s, e, n = F.col(start), F.col(end), F.when(in_range(F.col(days)), F.col(days))
    has_s, has_e, has_n = s.isNotNull(), e.isNotNull(), n.isNotNull()
    last = F.date_add(s, n - 1)
    new_end = F.when(has_s & has_n & (~has_e | (F.datediff(e, s) + 1 != n)), last).otherwise(e)
    derived = has_e & has_n & ~has_s
    new_start = F.when(derived, F.date_sub(e, n - 1)).otherwise(s)
    new_days = F.when(has_s & has_e & ~has_n, F.coalesce(days_between(s, e), F.col(days))).otherwise(F.col(days))
    df = df.withColumns({"__s": new_start, "__e": new_end, "__n": new_days, calculated: derived})
    odd = F.coalesce(~F.datediff("__e", "__s").between(0, MAX_DAYS), F.lit(False))
    held = F.coalesce(anchored, F.lit(False))
    return df.withColumns(
        {
            start: F.when(odd & ~held, F.lit(None)).otherwise(F.col("__s")),
            end: F.when(odd & held, F.lit(None)).otherwise(F.col("__e")),
            days: F.col("__n").cast("int"),
        }
    ).drop("__s", "__e", "__n")


def fill_in(df: DataFrame, start: str, end: str, days: str, calculated: str) -> DataFrame:
    """The mapper's shorter rules, after corrections by hand: a missing start from end and days, missing days from both."""
    s, e, n = F.col(start), F.col(end), F.col(days)
    derived = F.coalesce(s.isNull() & e.isNotNull() & in_range(n), F.lit(False))
    df = df.withColumns({start: F.when(derived, F.date_sub(e, n - 1)).otherwise(s), calculated: F.coalesce(F.col(calculated), F.lit(False)) | derived})
    unknown = n.isNull() | (n == 0)
    return df.withColumn(days, F.when(unknown, F.coalesce(days_between(F.col(start), e), n)).otherwise(n).cast("int"))
