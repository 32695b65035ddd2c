"""Formatting as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

U64 = 18446744073709551615


def unsigned(text: Column) -> Column:
    """Decimal digits, a plus sign allowed, as decimal(20,0); null for anything else or beyond 64 bits."""
    digits = F.regexp_extract(text, r"^\+?0*([0-9]{1,20})$", 1)
    value = F.when(digits != "", digits).cast("decimal(20,0)")
    return F.when(value <= F.lit(str(U64)).cast("decimal(20,0)"), value)


def address(text: Column) -> Column:
    """Hex digits, a plus sign allowed, as 16 lower-case digits; null for anything else or beyond 64 bits."""
    digits = F.regexp_extract(text, r"^\+?0*([0-9A-Fa-f]{1,16})$", 1)
    return F.lpad(F.lower(F.nullif(digits, F.lit(""))), 16, "0")


def words_to_bytes(words: Column) -> Column:
    """Eight bytes a word, no more than 64 bits hold."""
    return F.least(words.cast("decimal(38,0)") * F.lit(8).cast("decimal(38,0)"), F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def bytes_text(n: Column) -> Column:
    """1.5K, 2.0M, 3.2G, 100B; ties of the digit shown go to the even one."""

    def scaled(bits: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n.cast("double") / (1 << bits), 1)), F.lit(unit))

    return F.when(n >= 1 << 30, scaled(30, "G")).when(n >= 1 << 20, scaled(20, "M")).when(n >= 1 << 10, scaled(10, "K")).otherwise(F.concat(n.cast("string"), F.lit("B")))


def words_text(words: Column, short: bool = False) -> Column:
    return F.concat(words.cast("string"), F.lit(" (" if short else " words ("), bytes_text(words_to_bytes(words)), F.lit(")"))


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where some are left out."""
    if most == 0:
        return F.lit("")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def url_encoded(text: Column) -> Column:
    """All but letters, digits and -_.~ as percent codes."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def flags(table: dict[str, Column], letters: bool = False) -> Column:
    """Of an ETS table's four switches: their letters, or their names and "-" for none."""
    if letters:
        return F.concat(*(F.when(c, name[0].upper()).otherwise("") for name, c in table.items()))
    return F.coalesce(F.nullif(F.concat_ws(", ", *(F.when(c, name) for name, c in table.items())), F.lit("")), F.lit("-"))


def short_name(name: Column) -> Column:
    """The first word; a blank name stays as it is."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\S+)", 1), F.lit("")), name)


def byte_list(data: Column) -> Column:
    """[68, 69] in two hex digits each."""
    h = F.lower(F.hex(data))
    return F.concat(F.lit("["), F.array_join(F.regexp_extract_all(h, F.lit("(..)"), F.lit(1)), ", "), F.lit("]"))


class Pager:
    """Places of a page among total items."""

    def __init__(self, total: int, offset: int, limit: int):
        self.total, self.offset, self.limit = total, offset, limit
        self.has_prev, self.has_next = offset > 0, offset + limit < total
        self.prev_offset, self.next_offset = max(0, offset - limit), offset + limit
        self.total_pages = -(-total // limit) if limit else 0
        self.page = offset // limit if limit else 0
        self.last_page = max(0, self.total_pages - 1)
        self.start, self.end = (min(offset + 1, total), min(offset + limit, total)) if limit else (0, 0)
