"""Column expressions on residue sequences; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 20-letter residue alphabet; the index of a letter is its id.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
PAD = "A"
START_ID = len(ALPHABET)
END_ID = len(ALPHABET) + 1
MAX_TOKENS = 1024
SPECIAL_TOKENS = 2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Upper-case and keep only alphabet letters."""
    return F.regexp_replace(F.upper(_col(c)), f"[^{ALPHABET}]+", "")


def has_residue(c: Column | str) -> Column:
    """True if cleaning leaves anything; stops at the first letter it finds.

    Filter on this ahead of ``clean``: a filter on the cleaned text would be
    pushed down and clean every row twice.
    """
    return F.upper(_col(c)).rlike(f"[{ALPHABET}]")


def has_invalid(c: Column | str) -> Column:
    """True if any character lies outside the alphabet."""
    return _col(c).rlike(f"[^{ALPHABET}]")


def fixed_length(c: Column | str, length: Column | int) -> Column:
    """Right-pad with the pad letter, then cut, to exactly ``length``."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.rpad(_col(c), n, F.lit(PAD))


def encode(c: Column | str) -> Column:
    """Letters to ids 0..19."""
    return F.transform(F.split(_col(c), ""), lambda x: (F.instr(F.lit(ALPHABET), x) - 1).cast("int"))


def decode(ids: Column | str) -> Column:
    """Ids 0..19 back to letters."""
    table = F.split(F.lit(ALPHABET), "")
    return F.array_join(F.transform(_col(ids), lambda i: F.element_at(table, i + 1)), "")


def n_tokens(c: Column | str, max_tokens: int = MAX_TOKENS) -> Column:
    """Token count after adding start and end and cutting at ``max_tokens``."""
    return F.least(F.length(_col(c)) + SPECIAL_TOKENS, F.lit(max_tokens))


def tokenize(c: Column | str, max_tokens: int = MAX_TOKENS) -> Column:
    """Ids with a start and an end token, cut to ``max_tokens``."""
    body = F.substring(_col(c), 1, max_tokens - SPECIAL_TOKENS)
    ids = F.when(F.length(body) > 0, encode(body)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(START_ID)), ids, F.array(F.lit(END_ID)))


def strip_special(tokens: Column | str, both: bool = False) -> Column:
    """Drop the start row; the end row stays unless ``both`` is set."""
    t = _col(tokens)
    return F.slice(t, F.lit(2), F.greatest(F.size(t) - (2 if both else 1), F.lit(0)))


def kmers(c: Column | str, k: int) -> Column:
    """Distinct overlapping words of length ``k``."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(f"(?=(.{{{k}}}))"), F.lit(1)))


def composition(c: Column | str) -> Column:
    """Share of each alphabet letter: a 20-wide embedding of the sequence; nulls for an empty one."""
    s = _col(c)
    n = F.length(s)
    return F.array(*[F.try_divide(n - F.length(F.replace(s, F.lit(a), F.lit(""))), n) for a in ALPHABET])


def hash32(*parts: Column | int | str) -> Column:
    """A reproducible 32-bit hash of the parts joined by ``|`` (no ``rand``)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def substitutions(a: Column | str, b: Column | str) -> Column:
    """Positions at which two sequences differ, over the shorter length."""
    n = F.least(F.length(_col(a)), F.length(_col(b)))
    x, y = (F.split(F.substring(_col(c), F.lit(1), n), "") for c in (a, b))
    return F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"] != p["y"]))
