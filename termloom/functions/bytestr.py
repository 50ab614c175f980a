"""Functions on the UTF-8 bytes of strings, out of Spark's own.

Spark's string functions count characters. ``latin1`` maps a string to one with a
character for each of its bytes, in the same order, so they count bytes on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latin1(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a: Column, b: Column, limit: int | None = None) -> Column:
    """Edit distance over bytes; -1 beyond ``limit``."""
    if limit is None:
        return F.levenshtein(latin1(a), latin1(b))
    return F.levenshtein(latin1(a), latin1(b), limit)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the common prefix of two ``latin1`` views; 0 with a null. Steps of falling
    powers of two are taken while the substrings ahead are equal."""
    n = F.least(F.length(a), F.length(b))
    powers = F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    found = F.aggregate(
        powers,
        F.lit(0),
        lambda done, p: F.when((done + p <= n) & (F.substring(a, done + 1, p) == F.substring(b, done + 1, p)), done + p).otherwise(done),
    )
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(found)


def prefixes(term: Column, least: int = 0) -> Column:
    """All prefixes of a term by characters, from ``least`` characters on."""
    return F.when(
        F.char_length(term) >= least,
        F.transform(F.sequence(F.lit(least), F.char_length(term)), lambda n: F.substring(term, F.lit(1), n)),
    ).otherwise(F.array().cast("array<string>"))


def deletions(view: Column) -> Column:
    """A ``latin1`` view, and it with any one byte left out."""
    dropped = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(view), F.lit(1))),
        lambda i: F.concat(F.substring(view, F.lit(1), i - 1), F.substring(view, i + 1, F.length(view))),
    )
    return F.array_distinct(F.concat(F.array(view), dropped))


def deletion_neighbours(view: Column, edits: int) -> Column:
    """A view with up to ``edits`` bytes left out; two strings within ``edits`` edits of
    each other share one."""
    out = F.array(view)
    for _ in range(edits):
        out = F.array_distinct(F.flatten(F.transform(out, deletions)))
    return out


def row_minimum(row: Column) -> Column:
    """Smallest of an array, 0 if it is empty."""
    return F.coalesce(F.array_min(row), F.lit(0))


def initial_row(n: Column) -> Column:
    return F.sequence(F.lit(0), n)


def next_row(row: Column, query: Column, letter: Column) -> Column:
    """The next row of the edit distance matrix for one more letter of the term.

    ``query`` is an array of letters. The row is a fold over the columns, where each
    entry needs the one just made on its left.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.size(row) - 1),
        F.array(F.element_at(row, 1) + 1),
        lambda made, j: F.concat(
            made,
            F.array(
                F.least(
                    F.element_at(row, j + 1) + 1,
                    F.element_at(made, -1) + 1,
                    F.element_at(row, j) + F.when(F.element_at(query, j) == letter, 0).otherwise(1),
                )
            ),
        ),
    )


def encode_key(tenant: Column, term: Column) -> Column:
    return F.concat_ws("\0", tenant, term)


def decode_key(key: Column) -> Column:
    """``struct(tenant, term)`` at the first NUL; null if there is none."""
    at = F.instr(key, "\0")
    return F.when(
        at > 0,
        F.struct(
            F.substring(key, F.lit(1), at - 1).alias("tenant"),
            F.substring(key, at + 1, F.char_length(key)).alias("term"),
        ),
    )


def decode_frequency(value: Column) -> Column:
    """A little-endian 8-byte number; null for any other width or beyond BIGINT."""
    pairs = F.array_join(
        F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda i: F.substring(F.hex(value), i * 2 - 1, F.lit(2))), ""
    )
    number = F.conv(pairs, 16, 10).cast("decimal(20,0)")
    return F.when((F.octet_length(value) == 8) & (number <= 2**63 - 1), number.cast("bigint"))
