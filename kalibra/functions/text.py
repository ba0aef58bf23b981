"""Scalar text functions of identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(x: Column, upper: bool = False) -> Column:
    """Without any white space; null as empty."""
    out = F.regexp_replace(F.trim(F.coalesce(x.cast("string"), F.lit(""))), r"\s+", "")
    return F.upper(out) if upper else out


def trimmed_upper(x: Column) -> Column:
    """The variant that keeps inner white space."""
    return F.upper(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^\s+|\s+$", ""))


def aliased(x: Column, names: dict[str, str]) -> Column:
    """By a small fixed dictionary; unknown names stay."""
    if not names:
        return x
    table = F.create_map(*[F.lit(y) for pair in names.items() for y in pair])
    return F.coalesce(table[x], x)


def formula_name(x: Column, fragments: list[str]) -> Column:
    """Lower case, without the fragments, runs of other characters as one blank."""
    out = F.lower(F.coalesce(x, F.lit("")))
    for part in fragments:
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def without_version(x: Column) -> Column:
    return F.regexp_replace(x, r"\.\d+$", "")


def only_symbol(x: Column, entries: str = " /// ", fields: str = " // ", at: int = 2) -> Column:
    """The one symbol that all entries of an annotation agree on, else null."""
    symbols = F.transform(F.split(x, entries, -1), lambda e: F.trim(F.get(F.split(e, fields, -1), F.lit(at - 1))))
    symbols = F.array_distinct(F.filter(symbols, lambda s: s.isNotNull() & (s != "") & (s != "---")))
    return F.when(F.size(symbols) == 1, symbols[0])


def first_token(x: Column, sep: str = "_") -> Column:
    return F.split_part(x, F.lit(sep), F.lit(1))


def restart_label(r: float) -> str:
    """SC14."""
    return f"r{r:.2f}".replace(".", "p")


def decoded(x: Column, prefixes: dict[str, str], other: str = "OTHER") -> Column:
    """A label by the first prefix that fits."""
    out = F.lit(other)
    for prefix, label in reversed(prefixes.items()):
        out = F.when(x.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def number(x: Column) -> Column:
    """As double, null where it is none."""
    return x.try_cast("double")
