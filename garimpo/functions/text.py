"""Text helpers as column expressions: they stay in generated code and push nothing to Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Every Unicode space, as JavaScript and Python see it (Java's \s is ASCII only without the flag).
SPACES = r"(?U)[\s\x{FEFF}]+"


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and their bases, from the Unicode decomposition rule."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _fold_table()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Accents off: precomposed letters to their bases, loose combining marks away."""
    return F.regexp_replace(F.translate(col(c), _FROM, _TO), "[̀-ͯ]", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def strip(c: Column | str) -> Column:
    """White space of any kind off both ends. Text that begins and ends with a plain character, as nearly all does, skips the expression."""
    c = col(c)
    plain = lambda x: F.ascii(x).between(33, 127)
    return F.when((c == "") | (plain(c) & plain(F.right(c, F.lit(1)))), c).otherwise(F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", ""))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def pad_left(c: Column | str, n: int) -> Column:
    """Zeros in front up to ``n`` characters; longer text is kept whole (``lpad`` alone would cut it)."""
    c = col(c)
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: it is bound as a lambda's variable, so that long chains
    of expressions don't multiply by substitution."""
    return F.get(F.transform(F.array(value), use), 0)


def bound(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once, here: they leave a generator as one row, so that what follows reads them instead of repeating their expressions."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_bound")).select("_bound.*")


def any_of(tests: list[Column]) -> Column:
    """OR over tests; false for none."""
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def group(c: Column | str, pattern: str, n: int = 1) -> Column:
    """A regular expression's group, null where it doesn't match or matches nothing."""
    return F.nullif(F.regexp_extract(col(c), pattern, n), F.lit(""))
