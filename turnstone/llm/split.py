"""Splitting oversized items at natural boundaries (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 8000
OVERLAP = 200


def pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """A Java pattern of which each match is the next stretch of new text.

    The alternatives stand in order of boundary strength: the rest of the item,
    then the longest stretch in the upper half of the allowance that ends at a
    paragraph, a line, a sentence or a word, then characters (not before a
    combining mark), then characters anyhow. Bounded quantifiers consume up to
    the limit; lookbehind looks at the boundary without consuming more. The
    first stretch may take the whole limit, later ones leave room for the
    overlap.
    """
    # What ends a paragraph, a line, a sentence and a word.
    ends = [
        r"(?<=\n\n|\n\r\n|\r\r)",
        r"(?:(?<=\n)|(?<=\r)(?!\n))",
        r"""(?:(?<=[.!?…]["'”’)\]]{0,2}\s)|(?<=[。！？｡]))""",
        r"(?<=\s)",
        r"(?!\p{M})",
    ]

    def upto(most: int) -> str:
        least = max(1, most // 2)
        tries = [rf".{{1,{most}}}+\z", *(rf".{{{least},{most}}}{end}" for end in ends), rf".{{1,{most}}}"]
        return "(?:" + "|".join(tries) + ")"

    return rf"(?s)(?:\A{upto(limit)}|(?!\A){upto(limit - overlap)})"


def split_oversized(
    items: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of every item of more than ``limit`` code points.

    Columns: the id, ``piece`` (from 0), ``n_pieces``, ``overlap`` (code points
    taken again from the piece before) and ``text`` of at most ``limit`` code
    points. Without their overlaps the pieces put together are the item.
    Items within the limit, empty and null ones yield no row; they stay as they
    are. Repeated rows are split once per distinct id and text when the caller
    removes repetitions, and once each otherwise. No shuffle.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be less than a quarter of the limit")
    large = items.where(F.length(text_col) > limit).select(id_col, F.col(text_col).alias("_text"))
    # The matches are bound to a lambda's variable, so that they are found once and not for every piece.
    matches = F.regexp_extract_all("_text", F.lit(pattern(limit, overlap)), F.lit(0))

    def pieces(new: Column) -> Column:
        lead = lambda i: F.when(i == 0, F.lit("")).otherwise(F.substring(F.get(new, i - 1), -max(overlap, 1), overlap))
        return F.transform(new, lambda x, i: F.struct(lead(i).alias("lead"), x.alias("new")))

    cut = large.select(id_col, F.get(F.transform(F.array(matches), pieces), F.lit(0)).alias("_all"))
    return cut.select(id_col, F.size("_all").alias("n_pieces"), F.posexplode("_all").alias("piece", "_p")).select(
        id_col, "piece", "n_pieces", F.length("_p.lead").alias("overlap"), F.concat("_p.lead", "_p.new").alias("text")
    )
