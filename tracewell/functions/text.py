"""String expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"

# The Unicode characters that count as white space in a line of text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every white-space character on both ends."""
    return F.btrim(_col(c), F.lit(SPACES))


def tokens(c: str | Column) -> Column:
    """White-space tokens; a blank text has none."""
    plain = F.translate(_col(c), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def non_empty(parts: Column) -> Column:
    return F.array_remove(parts, "")


def comma_parts(c: str | Column) -> Column:
    """Stripped parts of a comma list, empty ones kept."""
    return F.transform(F.split(strip(c), ","), strip)


def phrase_parts(c: str | Column) -> Column:
    """Parts between runs of commas and line breaks, stripped, empty ones dropped."""
    return non_empty(F.transform(F.split(_col(c), r"[,\n]+"), strip))


def text_lines(c: str | Column) -> Column:
    """Stripped non-blank lines of a text."""
    return non_empty(F.transform(F.split(_col(c), r"\n"), strip))


def mask(c: str | Column, patterns: list[str]) -> Column:
    """Replace every pattern, in the given sequence, by the wildcard."""
    out = _col(c)
    for pattern in patterns:
        out = F.regexp_replace(out, pattern, F.lit(WILDCARD))
    return out


def short_id(c: str | Column) -> Column:
    """First eight hex digits of the text's md5."""
    return F.substring(F.md5(_col(c)), 1, 8)


def hash60(c: str | Column) -> Column:
    """First 60 bits of the text's md5 as a non-negative long."""
    return F.conv(F.substring(F.md5(_col(c)), 1, 15), 16, 10).cast("long")


def joined_template(c: str | Column) -> Column:
    """A template stored as pieces becomes one string; a missing one becomes ''."""
    return F.coalesce(F.array_join(_col(c), ""), F.lit(""))


def piece_text(c: str | Column) -> Column:
    """A VARIANT that is a string, or a list of strings joined to one; null for anything else."""
    kind = F.schema_of_variant(_col(c))
    pieces = F.try_variant_get(_col(c), "$", "array<variant>")
    whole = F.forall(pieces, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    joined = joined_template(F.transform(pieces, lambda x: F.try_variant_get(x, "$", "string")))
    return F.when(kind == "STRING", F.try_variant_get(_col(c), "$", "string")).when(kind.startswith("ARRAY") & whole, joined)
