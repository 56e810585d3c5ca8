"""Text functions as column expressions: everything stays in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.schema import STORED_CHARS

#: White space in the sense of str.strip.
_WS = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Longest turn text and the mark put after a cut.
TURN_CHARS = 8000
CUT_MARK = "\n\n[truncated]"
LEAST_CHARS = 20
#: Latin letters with diacritics and their base letters, place by place, by Unicode's decomposition.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and len(unicodedata.normalize("NFD", c)) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def strip(c: Column) -> Column:
    """Without white space at both ends, any of Unicode's."""
    return F.regexp_replace(c, f"^{_WS}|{_WS}$", "")


def cut(c: Column, chars: int = TURN_CHARS) -> Column:
    """Texts beyond ``chars`` characters are cut there and marked."""
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit(CUT_MARK))).otherwise(c)


def stored(c: Column) -> Column:
    return F.substring(c, 1, STORED_CHARS)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def slug(root: Column) -> Column:
    """The folder name that stands for a project root."""
    return F.translate(root, "/.", "--")


def slug_of_path(path: Column, base: str) -> Column:
    """First component below ``base``, empty for paths outside it (a separator must follow the base)."""
    prefix = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.element_at(F.split(F.substr(path, F.lit(len(prefix) + 1)), "/"), 1)).otherwise("")


def shown_time(c: Column) -> Column:
    return F.substring(c, 1, 19)


def cutoff_time(now: Column, days: int) -> Column:
    """ISO time ``days`` before ``now`` (the session's time zone is UTC); compares as a string."""
    return F.date_format(now - F.make_dt_interval(days=F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss")


def tokens(c: Column) -> Column:
    """Search terms: runs of letters and digits, case and Latin diacritics folded; null has none."""
    # Text of one byte a character has nothing to fold but case.
    plain = F.split(F.lower(c), "[^a-z0-9]+")
    folded = F.lower(F.translate(F.regexp_replace(c, "[\u0300-\u036f]", ""), ACCENTED, PLAIN))
    parts = F.when(F.octet_length(c) == F.length(c), plain).otherwise(F.split(folded, r"[^\p{L}\p{N}]+"))
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))
