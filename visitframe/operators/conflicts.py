"""Conflicts between rows of one visit: codes, duplicates, and two sources column by column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.operators.visits import best_row, consolidate, merge_two_sources


def valid_code(code: Column) -> Column:
    """Whether a visit code is bl or starts with m; NULL isn't valid."""
    return F.coalesce((code == "bl") | code.startswith("m"), F.lit(False))


def resolve_codes(df: DataFrame, keys: Sequence[str], code: str, order: Sequence[str]) -> DataFrame:
    """Within a group: NULL codes take the first code there is; then, if some are valid, those that aren't take the
    first valid one. Groups without a valid code, and valid codes that differ, stay."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.col(code), F.first(code, ignorenulls=True).over(w))
    # a filled code is the group's first, so the first valid one is among the codes that were there
    first_valid = F.first(F.when(valid_code(F.col(code)), F.col(code)), ignorenulls=True).over(w)
    return df.withColumn(code, F.when(valid_code(filled), filled).otherwise(F.coalesce(first_valid, filled)))


def drop_duplicate_rows(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], order: Sequence[str], hierarchies: Mapping[str, Sequence[str]] | None = None,
    fill: Sequence[str] = (), status: str | None = None, strength: str | None = None,
) -> DataFrame:
    """One row per key: NULLs take the group's first values and ranked columns the highest of their hierarchy, then the
    best row stays by the criteria of its category (fewest NULL measures as they came, status, strength, order)."""
    had = [f"__had_{k}" for k in range(len(measures))]
    marked = df.withColumns({h: F.when(F.col(f"`{c}`").isNotNull(), F.lit(1)) for h, c in zip(had, measures, strict=True)})
    whole = consolidate(marked, keys, fill, order, hierarchies)
    return best_row(whole, keys, had, order, status, strength).drop(*had)


def better_status(a: Column, b: Column) -> Column:
    """complete before partial before the first that is there."""
    return F.when((a == "complete") | (b == "complete"), "complete").when((a == "partial") | (b == "partial"), "partial").otherwise(F.coalesce(a, b))


def higher_rank(a: Column, b: Column, hierarchy: Sequence[str]) -> Column:
    """The value further on in the hierarchy; one that isn't in it gives way; of two such the first."""
    names = F.array(*[F.lit(h) for h in hierarchy])
    place = [F.coalesce(F.array_position(names, c), F.lit(0)) for c in (a, b)]
    return F.when(place[0] + place[1] == 0, F.coalesce(a, b)).when(place[0] >= place[1], a).otherwise(b)


def merge_pairs(
    pairs: DataFrame, subject: str, date: str, columns: Sequence[str], rules: Mapping[str, object] | None = None, suffixes: tuple[str, str] = ("_1", "_2")
) -> DataFrame:
    """Two rows of one visit, side by side, as one: for each column the rule of its kind. A column that only one side has
    keeps its values. Rules: `first` (the default, the first value that is there), `status`, a sequence (a hierarchy) or a
    tuple (low, high, rising) for measures, of which the value in range that continues the subject's trend stays."""
    out = pairs
    plain: dict[str, Column] = {}
    for c in columns:
        one, two = c + suffixes[0], c + suffixes[1]
        rule = (rules or {}).get(c, "first")
        if one not in pairs.columns or two not in pairs.columns:
            plain[c] = F.col(f"`{one if one in pairs.columns else two}`")
        elif isinstance(rule, tuple):
            low, high, rising = rule
            out = merge_two_sources(out, subject, date, one, two, c, low, high, rising)
            plain[c] = F.col(f"`{c}`")
        elif rule == "status":
            plain[c] = better_status(F.col(f"`{one}`"), F.col(f"`{two}`"))
        elif isinstance(rule, list):
            plain[c] = higher_rank(F.col(f"`{one}`"), F.col(f"`{two}`"), rule)
        else:
            plain[c] = F.coalesce(F.col(f"`{one}`"), F.col(f"`{two}`"))
    rest = [c for c in pairs.columns if c.removesuffix(suffixes[0]) not in columns and c.removesuffix(suffixes[1]) not in columns]
    return out.select(*[F.col(f"`{c}`") for c in rest], *[e.alias(c) for c, e in plain.items()])
