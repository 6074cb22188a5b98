"""Text columns. Patterns are Java regular expressions; IU makes them ignore case and know Unicode, with \\n as the only
line end. A pattern's labels must hold no capturing group of their own."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ignore case, Unicode classes, \n as the only line end; with lines: ^ and $ at each line.
IU, U, IUM = "(?iUd)", "(?Ud)", "(?iUdm)"


def _accents() -> tuple[str, str]:
    """Lower-case letters that are one letter and marks, and those letters, by Unicode decomposition."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        for char in (chr(code), chr(code).lower()):
            parts = unicodedata.normalize("NFD", char)
            base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
            if len(char) == 1 and base != char and len(base) == 1:
                pairs[char] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


#: White space by Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of the value, which is computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def filled(c: Column) -> Column:
    """The column without white space at its ends; null if nothing is left."""
    return blank_to_null(strip(c))


def blank_to_null(c: Column) -> Column:
    return once(c, lambda x: F.when(x != "", x))


def find(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, stripped; null without a match or if empty."""
    return filled(F.regexp_extract(c, pattern, group))


def found(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def window_after(c: Column, label: str, width: int, flags: str = IU) -> Column:
    """The width characters after the first label; empty without a label."""
    return F.regexp_extract(c, f"{flags}(?:{label})([\\s\\S]{{0,{width}}})", 1)


def near(c: Column, label: str, value: str, width: int = 80) -> Column:
    """The first value (group 1) that begins and ends in the width characters after the first label."""
    return find(window_after(c, label, width), value)


def after_each(c: Column, label: str, width: int = 60) -> Column:
    """For every label the first line with text of the width characters after it."""
    parts = F.regexp_extract_all(c, F.lit(f"{IU}(?:{label})(?=([\\s\\S]{{0,{width}}}))"), F.lit(1))

    def line(part: Column) -> Column:
        lines = F.transform(F.split(F.regexp_replace(part, r"(?U)^\s*[:\-]?\s*", ""), "\n"), strip)
        return F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1))

    return F.filter(F.transform(parts, line), lambda x: x.isNotNull())


def fold(c: Column) -> Column:
    """Lower case, no accents, single spaces, none at the ends; of null the empty text."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM, _TO)
    return strip(F.regexp_replace(F.regexp_replace(plain, r"\p{Mn}", ""), r"(?U)\s+", " "))


def unaccent(c: Column) -> Column:
    """Accents off, case as it is."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def squash(c: Column) -> Column:
    """Folded and without spaces: recognised text often runs words together."""
    return F.replace(fold(c), F.lit(" "), F.lit(""))


def ascii_upper(c: Column) -> Column:
    return F.translate(F.upper(c), "ÁÉÍÓÚÜÑ", "AEIOUUN")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def megabytes(size: Column) -> Column:
    """Bytes as megabytes of 1,048,576 bytes with one decimal."""
    return F.round(size / F.lit(1 << 20), 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _extension(path: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(file name, length of its last extension with the dot; 0 without one)."""
    after = lambda n: F.length(F.substring_index(n, ".", -1))
    return once(base_name(path), lambda n: once(F.length(n) - after(n), lambda k: use(n, F.when((k >= 2) & (k < F.length(n)), F.length(n) - k + 1).otherwise(F.lit(0)))))


def suffix(path: Column) -> Column:
    """The last extension in lower case with its dot; empty without one."""
    return F.lower(_extension(path, lambda n, k: F.right(n, k)))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return _extension(path, lambda n, k: F.left(n, F.length(n) - k))


def join_present(sep: str, *parts: Column, limit: int | None = None) -> Column:
    """The parts that aren't null, joined; cut to limit characters."""
    joined = F.concat_ws(sep, *parts)
    return F.left(joined, F.lit(limit)) if limit else joined


def safe_folder(c: Column) -> Column:
    """A folder name: no accents, no characters that paths forbid, single spaces, 60 characters."""
    plain = F.regexp_replace(unaccent(F.coalesce(c, F.lit(""))), r'[\\/:*?"<>|]+', " ")
    plain = F.regexp_replace(plain, r"(?U)\s+", " ")
    return F.left(F.regexp_replace(plain, r"^[ .]+|[ .]+$", ""), F.lit(60))
