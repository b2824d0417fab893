"""The measures and dimensions that are shown: markers of two sides in one table, readability, and one pronoun for the whole chamber.

Pattern tables are data, so the dimensions that need one are registered by `launch` when a table is loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomquill.functions.text import Patterns
from loomquill.operators import tone

CHAMBER = "chamber"
HEN = Patterns(("hen", "hens"))
HEN_PER = 100_000.0


def measure_folk(df: DataFrame, sides: Patterns, text_col: str = "text") -> DataFrame:
    """Sentences with an in-group marker; for the census, no dimension of its own."""
    return tone.measure(df, sides.subset("ingroup"), text_col)


def measure_antielit(df: DataFrame, sides: Patterns, text_col: str = "text", subtype: str = "elite") -> DataFrame:
    """Sentences with a marker of an elite; for the census, no dimension of its own."""
    return tone.measure(df, sides.subset("outgroup", subtype), text_col)


def measure_klasskonflikt(df: DataFrame, sides: Patterns, text_col: str = "text", subtype: str = "economic") -> DataFrame:
    """Sentences with a marker of a wealthy counterpart."""
    return tone.measure(df, sides.subset("outgroup", subtype), text_col)


def measure_hen(df: DataFrame, text_col: str = "text", patterns: Patterns = HEN) -> DataFrame:
    """Sentences with the pronoun, in one group for all: by party it is too rare."""
    return tone.measure_constant_group(df, patterns, CHAMBER, text_col)


LIX_DIMENSION = tone.register(tone.Dimension("lix", "stylometric", tone.measure_lix, tone.aggregate_lix, evidentiary=False, launched=True, min_cell_speeches=0))
HEN_DIMENSION = tone.register(tone.Dimension("hen", "structural", measure_hen, launched=True, group_col=CHAMBER, min_cell_speeches=0, per=HEN_PER))


def klasskonflikt(sides: Patterns, subtype: str = "economic") -> tone.Dimension:
    patterns = sides.subset("outgroup", subtype)
    return tone.Dimension("klasskonflikt", "lexical", lambda df: measure_klasskonflikt(df, sides, subtype=subtype), launched=True, min_cell_speeches=8, patterns=patterns)


def launch(sides: Patterns) -> dict[str, tone.Dimension]:
    """Register what needs the table of sides, once, and return all launched dimensions."""
    if "klasskonflikt" not in tone.REGISTRY:
        tone.register(klasskonflikt(sides))
    return {k: d for k, d in tone.REGISTRY.items() if d.launched}
