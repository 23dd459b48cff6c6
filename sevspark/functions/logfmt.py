"""Log lines of the form ``event=x key=value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = r"(\w+)=(\S+)"
LEVEL = r".*(DEBUG|INFO|WARNING|ERROR|CRITICAL).*"
RUN_ID = r".*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}).*"


def parse_pairs(line: Column) -> Column:
    """Map of the line's pairs; the last value of a repeated key wins.

    The line is matched once; the pairs are then split and looked up from the end.
    """
    def build(pairs: Column) -> Column:
        pairs = F.reverse(pairs)
        names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
        latest = F.filter(pairs, lambda p, i: F.array_position(names, F.substring_index(p, "=", 1)) == i + 1)
        return F.map_from_entries(
            F.transform(
                latest,
                lambda p: F.struct(
                    F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v")
                ),
            )
        )

    # a one-element transform binds the matches to a variable, so they are computed once
    return F.transform(F.array(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0))), build)[0]


def field(line: Column, name: str) -> Column:
    """One field without building the whole map; NULL when absent, last value wins."""
    hits = F.regexp_extract_all(line, F.lit(rf"\b{name}=(\S+)"), F.lit(1))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1))


def level(line: Column) -> Column:
    """Last level word of the line, NULL when there is none."""
    return F.nullif(F.regexp_extract(line, LEVEL, 1), F.lit(""))


def run_id(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, RUN_ID, 1), F.lit(""))
