"""Text and code-cleaning expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
BLANKS = " \t\n\r\f\u000b"


def strip_text(c: Column) -> Column:
    """Drop no-break spaces, then trim blanks on both sides."""
    return F.btrim(F.replace(c, F.lit(NBSP), F.lit("")), F.lit(BLANKS))


def decimal_comma(c: Column) -> Column:
    """'48,60' -> 48.6; anything unreadable becomes NULL."""
    return F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def replace_all(c: Column, pairs: Mapping[str, str]) -> Column:
    """Apply literal text replacements one after the other."""
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def int_or_zero(c: Column) -> Column:
    """Number in text truncated to int; non-numbers give 0."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))


def hour_of(c: Column, strict_hhmm: bool = False) -> Column:
    """Hour of a 'HH:MM' text: the text without its last three characters.

    With ``strict_hhmm`` a value without a colon is read as 'HHMM' instead.
    """
    head = F.substring(c, F.lit(1), F.greatest(F.length(c) - 3, F.lit(0)))
    if strict_hhmm:
        bare = F.substring(F.lpad(c, 4, "0"), 1, 2)
        head = F.when(F.contains(c, F.lit(":")), head).otherwise(bare)
    return int_or_zero(head)


def recode(c: Column, mapping: Mapping) -> Column:
    """Replace all mapped values at once; others are kept."""
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[c], c)


def letters_to_int(c: Column, letters: Mapping[str, str]) -> Column:
    """Codes written with letters ('A', 'B') as numbers; unreadable -> NULL."""
    return replace_all(c, letters).try_cast("int")


def typed_text(c: Column) -> Column:
    """Which type a stored text stands for: bool, none, int, float or str, tried in that order."""
    return (
        F.when(c.isin("True", "False"), F.lit("bool"))
        .when(c == "None", F.lit("none"))
        .when(c.try_cast("bigint").isNotNull(), F.lit("int"))
        .when(c.try_cast("double").isNotNull(), F.lit("float"))
        .otherwise(F.lit("str"))
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _longest_block(a: Column, b: Column) -> Column:
    """``(size, back, at)`` of the longest common run of two texts: the first one in ``a`` (at ``-back``), then in ``b``."""

    def run(i: Column, n: Column) -> Column:
        return _let(F.instr(b, F.substring(a, i, n)), lambda at: F.struct(
            F.when(at > 0, n).otherwise(0).alias("size"), (-i).alias("back"), at.alias("at"),
        ))

    lengths = lambda i: F.transform(F.sequence(F.lit(1), F.length(a) - i + 1), lambda n: run(i, n))
    return F.array_max(F.flatten(F.transform(F.sequence(F.lit(1), F.length(a)), lengths)))


def block_ratio(a: Column, b: Column) -> Column:
    """2 * matched characters / characters of both, in [0, 1]: the longest common block, then the same left and right of it.

    The texts are open pieces on a stack, as many steps long as ``a`` can be cut: at most ``2 * length(a) + 1``. The work grows
    with the square of ``a``, so ``a`` is the short side, a name. Null gives null; two empty texts are alike.
    """

    def piece(x: Column, y: Column) -> Column:
        return F.struct(x.alias("a"), y.alias("b"))

    def step(state: Column, _: Column) -> Column:
        def cut(top: Column) -> Column:
            def parts(block: Column) -> Column:
                i, at, n = -block["back"], block["at"], block["size"]
                left = piece(F.substring(top["a"], F.lit(1), i - 1), F.substring(top["b"], F.lit(1), at - 1))
                right = piece(F.substring(top["a"], i + n, F.length(top["a"])), F.substring(top["b"], at + n, F.length(top["b"])))
                fresh = F.filter(F.array(left, right), lambda p: (p["a"] != "") & (p["b"] != "") & (n > 0))
                rest = F.slice(state["open"], 2, F.size(state["open"]))
                return F.struct((state["matched"] + n).alias("matched"), F.concat(fresh, rest).alias("open"))

            return _let(_longest_block(top["a"], top["b"]), parts)

        return F.when(F.size(state["open"]) == 0, state).otherwise(cut(F.get(state["open"], F.lit(0))))

    whole = F.filter(F.array(piece(a, b)), lambda p: (p["a"] != "") & (p["b"] != ""))
    start = F.struct(F.lit(0).alias("matched"), whole.alias("open"))
    matched = F.aggregate(F.sequence(F.lit(0), 2 * F.length(a)), start, step, lambda state: state["matched"])
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(F.lit(2.0) * matched / both)


def strip_trailing_number(c: Column) -> Column:
    """'Caract_2024' -> 'caract'."""
    return F.regexp_replace(F.lower(c), r"[\s_-]*\d+$", "")
