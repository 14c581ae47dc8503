"""Joining irregular visit tables: exact, within a tolerance, one to one, as of, nearest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations as pairs

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.operators.nearest import nearest_in_grid
from visitframe.operators.visits import best_rank
from visitframe.session import materialize


def exact_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_1", "_2")) -> DataFrame:
    """Equi-join; columns of both sides besides the keys get suffixes."""
    both = (set(a.columns) & set(b.columns)) - set(keys)
    a = a.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = b.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, list(keys), how)


def outer_natural(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on all common columns, NULL matching NULL."""
    common = [c for c in a.columns if c in b.columns]
    right = b.withColumnsRenamed({c: f"__{c}" for c in common})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in common])
    joined = a.join(right, on, "full_outer")
    keys = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in common]
    return joined.select(*keys, *[c for c in a.columns if c not in common], *[c for c in b.columns if c not in common])


#: Stretches of the calendar are so many tolerances long; a row also goes to the next one if it lies within a tolerance of it.
STRETCH = 8


def buffered_pairs(
    a: DataFrame, b: DataFrame, subject: str, date1: str, date2: str, buffer_days: int,
    equal: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Pairs of rows of a subject within the tolerance whose dates take part in no exact pair. Rows of both sides go once to
    stretches of the subject's calendar, with a tolerance on either end, and a window finds the exact dates there: a row meets those of
    its stretch, not all of its subject's. a and b share only the subject column; `equal` pairs match NULL-safely. Columns
    of both sides travel under common names in their order, so that both sides of the join read the same shuffle."""
    buffer, width = max(buffer_days, 0), max(buffer_days, 1) * STRETCH
    own = [[c for c in df.columns if c not in (subject, date)] for df, date in ((a, date1), (b, date2))]
    kinds = [[dict(df.dtypes)[c] for c in names] for df, names in ((a, own[0]), (b, own[1]))]
    dated = dict(a.dtypes)[date1] == dict(b.dtypes)[date2] == "date"  # then the day tells the date
    shared = [k for k in range(min(map(len, own))) if kinds[0][k] == kinds[1][k]]
    places = [{c: f"__c{k}" if k in shared else f"__{side}{k}" for k, c in enumerate(names)} for side, names in (("a", own[0]), ("b", own[1]))]

    def spread(df: DataFrame, date: str, side: int) -> DataFrame:
        day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
        rows = df.where(F.col(subject).isNotNull() & F.col(date).isNotNull())
        ends = [F.floor((F.col("__day") + k) / F.lit(width)).cast("int") for k in (-buffer, buffer)]
        rows = rows.select(F.col(subject).alias("__s"), day.alias("__day"), *([] if dated else [F.col(date).alias("__date")]), *[F.col(c).alias(n) for c, n in places[side].items()])
        rows = rows.withColumn("__at", F.explode(F.sequence(*ends)))
        home = F.floor(F.col("__day") / F.lit(width)) == F.col("__at")
        return rows.withColumn("__side", F.lit(1) if side else F.when(home, 0).otherwise(2))  # 1: b, 0: a at home, 2: a beyond an end

    # what is filtered behind the window isn't on its keys: Spark would push that below the shuffle, of which there would then be two
    both = spread(a, date1, 0).unionByName(spread(b, date2, 1), allowMissingColumns=True).repartition("__s", "__at")
    same = Window.partitionBy("__s", "__at", "__day")
    in_b = F.col("__side") == 1
    left_over = both.withColumn("__exact", F.max(in_b).over(same) & F.max(~in_b).over(same)).where("not __exact")
    day_or_date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("__day")) if dated else F.col("__date")
    left = left_over.where("__side = 0").select("__s", "__at", F.col("__day").alias("__day1"), day_or_date.alias(date1), *[F.col(n).alias(c) for c, n in places[0].items()])
    right = left_over.where("__side = 1").select("__s", "__at", F.col("__day").alias("__day2"), day_or_date.alias(date2), *[F.col(n).alias(c) for c, n in places[1].items()])
    near = F.abs(F.col("__day1") - F.col("__day2")) <= buffer_days
    for x, y in equal:  # not as keys of the join, by which the rows would move again
        near = near & F.coalesce(F.col(x) == F.col(y), F.col(x).isNull() & F.col(y).isNull())
    found = left.join(right, ["__s", "__at"]).where(near)
    return found.select(F.col("__s").alias(subject), date1, *own[0], date2, *own[1])


def _greedy(days1: list[int], days2: list[int], buffer_days: int) -> list[tuple[int, int]]:
    """Pairs of days in ascending gap (ties: day1, day2), every day used once."""
    a, b = np.unique(days1), np.unique(days2)
    low = np.searchsorted(b, a - buffer_days)
    counts = np.searchsorted(b, a + buffer_days, "right") - low
    i = np.repeat(np.arange(len(a)), counts)
    j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    order = np.lexsort((b[j], a[i], np.abs(a[i] - b[j])))
    used1, used2, out = set(), set(), []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if x not in used1 and y not in used2:
            used1.add(x)
            used2.add(y)
            out.append((int(a[x]), int(b[y])))
    return out


def match_visits(
    a: DataFrame, b: DataFrame, subject: str, date: str, row_id: str = "row_id", buffer_days: int = 80
) -> DataFrame:
    """(subject, date1, date2, ids1, ids2, kind): one-to-one matching of visits. All exact
    (subject, date) groups match; of the other dates the nearest pairs within the tolerance,
    greedily by ascending gap, each date used once.

    Rows combine into dates first, and a subject's dates into two arrays, which hold no more than the
    days of the calendar; only subjects with dates left on both sides reach Python, in Arrow batches of
    many subjects.
    """
    days = F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date"))

    def dates(df: DataFrame, side: str) -> DataFrame:
        valid = df.where(F.col(subject).isNotNull() & F.col(date).isNotNull())
        return valid.groupBy(F.col(subject).alias("subject"), days.alias("day")).agg(
            F.array_sort(F.collect_list(row_id)).alias(f"ids{side}")
        )

    d1, d2 = dates(a, "1"), dates(b, "2")
    both = d1.join(d2, ["subject", "day"], "full_outer")
    exact = both.where("ids1 is not null and ids2 is not null").select(
        "subject", F.col("day").alias("day1"), F.col("day").alias("day2"), "ids1", "ids2", F.lit("exact").alias("kind")
    )
    left_over = both.where("ids1 is null or ids2 is null")
    arrays = left_over.groupBy("subject").agg(
        F.array_sort(F.collect_list(F.when(F.col("ids1").isNotNull(), F.col("day")))).alias("days1"),
        F.array_sort(F.collect_list(F.when(F.col("ids2").isNotNull(), F.col("day")))).alias("days2"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (s, x, y)
                for s, own1, own2 in zip(batch["subject"], batch["days1"], batch["days2"], strict=True)
                for x, y in _greedy(list(own1), list(own2), buffer_days)
            ]
            yield pd.DataFrame(found, columns=["subject", "day1", "day2"])

    kind = dict(d1.dtypes)["subject"]
    candidates = arrays.where((F.size("days1") > 0) & (F.size("days2") > 0))
    near = candidates.mapInPandas(run, f"subject {kind}, day1 int, day2 int")
    buffered = (
        near.join(d1.withColumnRenamed("day", "day1"), ["subject", "day1"])
        .join(d2.withColumnRenamed("day", "day2"), ["subject", "day2"])
        .select("subject", "day1", "day2", "ids1", "ids2", F.lit("buffer").alias("kind"))
    )
    to_date = [F.date_add(F.lit("1970-01-01").cast("date"), F.col(f"day{k}")).alias(f"date{k}") for k in (1, 2)]
    return exact.unionByName(buffered).select("subject", *to_date, "ids1", "ids2", "kind")


def cardinality(matches: DataFrame) -> DataFrame:
    """matches with their class: 1:1, 1:N, N:1 or N:N."""
    side = [F.when(F.size(c) == 1, "1").otherwise("N") for c in ("ids1", "ids2")]
    return matches.withColumn("cardinality", F.concat(side[0], F.lit(":"), side[1]))


def matched_ids(matches: DataFrame, side: str) -> DataFrame:
    return matches.select(F.explode(f"ids{side}").alias("row_id")).distinct()


def overlap_of_kinds(matches: DataFrame, side: str) -> DataFrame:
    """Ids that are in both exact and buffered matches: there must be none."""
    of = [matches.where(F.col("kind") == k).select(F.explode(f"ids{side}").alias("row_id")) for k in ("exact", "buffer")]
    return of[0].intersect(of[1])


def decide_buffered(code1: Column, code2: Column, gap: Column, max_gap: int = 30) -> Column:
    """manual: both codes contain m and differ; merge: equal codes or a gap below max_gap days; else
    skip. A NULL code equals nothing."""
    m = [F.coalesce(F.contains(F.lower(c), F.lit("m")), F.lit(False)) for c in (code1, code2)]
    same = F.coalesce(code1 == code2, F.lit(False))
    return F.when(~same & m[0] & m[1], "manual").when(same | (F.abs(gap) < max_gap), "merge").otherwise("skip")


def align_dates(base: DataFrame, add: DataFrame, links: DataFrame, date: str, row_id: str = "row_id", base_date: str | None = None) -> DataFrame:
    """add with the date of the base row that a row is linked to (links: id1, id2); rows without a link keep theirs. A row
    with several links takes the smallest base id's date; NULL dates of the base count as they are. Where links have that date in a column
    already, base_date names it, and base isn't read."""
    if base_date is not None:
        known = links.select("id1", "id2", F.col(base_date).alias("__d"))
    else:
        known = links.join(base.select(F.col(row_id).alias("id1"), F.col(date).alias("__d")), "id1")
    first = known.groupBy("id2").agg(F.min_by(F.struct("__d"), "id1").alias("__hit"))
    joined = add.join(first.withColumnRenamed("id2", row_id), row_id, "left")
    return joined.select(*[(F.when(F.col("__hit").isNotNull(), F.col("__hit.__d")).otherwise(F.col(c)) if c == date else F.col(f"`{c}`")).alias(c) for c in add.columns])


def _row_links(
    base: DataFrame, add: DataFrame, subject: str, date: str, code: str | None, measures: Sequence[str], row_id: str,
    buffer_days: int, status: str | None, strength: str | None,
) -> DataFrame:
    """(subject, day, id2, id1, code1, code2, gap, kind, n2, copies): the row of add on `day` goes with the base row id1, `copies` times. Matches are
    those of match_visits; a visit of many base rows counts by its best one. Only ids, codes and days move, of base once, to the subject: rows combine into dates,
    and a subject's dates into arrays no longer than the calendar. An id on several dates of a subject goes with all of them. No filter or join on the keys
    comes before the arrays, since Spark would push it below the aggregates of add, whose shuffle other branches of the plan read too."""
    has = code is not None and code in base.columns and code in add.columns
    kinds = {c: dict(base.dtypes)[c] for c in (subject, row_id)}
    code_kind = dict(base.dtypes)[code] if has else "string"

    def dates(df: DataFrame, rank: Sequence[Column], side: str) -> DataFrame:
        mark = F.col(code) if has else F.lit(None).cast("string")
        row = F.struct(*[c.alias(f"r{k}") for k, c in enumerate(rank)], F.col(row_id).alias("id"), mark.alias("code")).alias("row")
        rows = df.select(F.col(subject).alias("subject"), F.col(date).cast("date").alias("date"), row)
        # base rows move to their subjects as they are, and no more; those of add lie by visits, and only their arrays move
        found = (rows.repartition("subject") if side == "one" else rows).groupBy("subject", "date").agg(F.min("row").alias("best"), F.count("*").alias("n"), F.collect_list("row.id").alias("ids"))
        same = F.size(F.filter("ids", lambda x: x == F.col("best.id")))
        day = F.datediff("date", F.lit("1970-01-01").cast("date"))
        row = F.struct(day.alias("day"), F.col("best.id").alias("id"), F.col("best.code").alias("code"), F.col("n").cast("int").alias("n"), same.alias("same"))
        dated = F.when(F.col("subject").isNotNull() & F.col("date").isNotNull(), row)
        return found.groupBy("subject").agg(F.collect_list(dated).alias(side))

    # a full join, and no filter behind it: those of an inner one would go below the aggregates of add
    both = dates(base, best_rank(measures, status, strength), "one").join(dates(add, [], "two"), "subject", "full_outer")
    parts = [F.col(f"{side}.{c}").alias(f"{c}{k}") for k, side in ((1, "one"), (2, "two")) for c in ("day", "id", "code", "n", "same")]
    columns = ["subject", "day", "id2", "id1", "code1", "code2", "gap", "kind", "n2", "copies"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.day1 is None or r.day2 is None:
                    continue
                at1, at2 = ({d: k for k, d in enumerate(days.tolist())} for days in (r.day1, r.day2))
                exact = at1.keys() & at2.keys()
                pairs = [(d, d, "exact") for d in exact]
                pairs += [(x, y, "buffer") for x, y in _greedy([d for d in at1 if d not in exact], [d for d in at2 if d not in exact], buffer_days)]
                times: dict[object, int] = {}
                for i, n in zip(r.id1, r.same1, strict=True):
                    times[i] = times.get(i, 0) + int(n)
                places: dict[object, list[int]] = {}
                for k, i in enumerate(r.id2):
                    places.setdefault(i, []).append(k)
                for x, y, how in pairs:
                    i, j = at1[x], at2[y]
                    here = places[r.id2[j]]
                    copies = times[r.id1[i]] * sum(int(r.same2[k]) for k in here) if has else 1  # codes are looked up by id, one row each
                    out += [(r.subject, int(r.day2[k]), r.id2[j], r.id1[i], r.code1[i], r.code2[j], x - y, how, int(r.n2[j]), copies) for k in here]
            yield pd.DataFrame(out, columns=columns)

    schema = f"subject {kinds[subject]}, day int, id2 {dict(add.dtypes)[row_id]}, id1 {kinds[row_id]}, code1 {code_kind}, code2 {code_kind}, gap int, kind string, n2 int, copies int"
    return both.select("subject", *parts).mapInPandas(run, schema)


def merge_pair(
    base: DataFrame, add: DataFrame, subject: str, date: str, code: str | None, measures: Sequence[str],
    row_id: str = "row_id", buffer_days: int = 80, status: str | None = None, strength: str | None = None,
) -> DataFrame:
    """One step of the incremental merge: match, check, reduce, decide, merge. Base rows get the add-only columns of the row they are linked
    to, then the add rows without a link follow; common columns keep the base's value. An add side with several rows on one matched visit
    fails the job. The links go to the rows of add, which needn't move for it if they are partitioned by visits already, and only linked ones go on to base."""
    links = _row_links(base, add, subject, date, code, measures, row_id, buffer_days, status, strength)
    guard = F.assert_true(F.col("n2") == 1, F.lit("a matched visit has several rows to add"))
    decision = decide_buffered(F.col("code1"), F.col("code2"), F.col("gap")) if code is not None and code in base.columns and code in add.columns else F.lit("merge")
    kept = links.where(guard.isNull()).where((F.col("kind") == "exact") | (decision == "merge"))
    on_day = kept.groupBy(F.col("subject").alias("__subject"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("__date")).agg(
        F.collect_list(F.struct("id1", "id2", "copies")).alias("__links")
    )
    own = F.filter("__links", lambda x: x["id2"] == F.col(f"`{row_id}`"))
    to = F.flatten(F.transform(own, lambda x: F.array_repeat(x["id1"], x["copies"])))
    # the explode isn't taken apart by a filter on its result, so both branches read one shuffle of add
    told = add.join(on_day, (add[subject] == on_day["__subject"]) & (add[date].cast("date") == on_day["__date"]), "left").select(
        *[add[c] for c in add.columns], F.explode_outer(to).alias("__id1")
    )
    only = [c for c in add.columns if c not in base.columns]
    linked = told.where(F.col("__id1").isNotNull()).select("__id1", *[F.col(f"`{c}`") for c in only])
    merged = base.join(linked, base[row_id] == linked["__id1"], "left").drop("__id1")
    rest = told.where(F.col("__id1").isNull()).select(*[F.col(f"`{c}`") for c in add.columns])
    return merged.unionByName(rest, allowMissingColumns=True)


def merge_all(tables: Sequence[DataFrame], row_id: str = "row_id", **kw) -> DataFrame:
    """Left fold of merge_pair in the given order, which matters: base values win. Row ids come out as
    text, `table:id`, which tells the rows of all tables apart. What three tables, five and so on were merged into is kept before the next."""
    named = [t.withColumn(row_id, F.concat(F.lit(f"{k}:"), F.col(row_id).cast("string"))) for k, t in enumerate(tables)]
    merged = named[0]
    for k, t in enumerate(named[1:]):
        merged = merge_pair(materialize(merged) if k and k % 2 == 0 else merged, t, row_id=row_id, **kw)
    return merged


#: Combinations of filter values at most: their list goes to every task.
MOST_COMBINATIONS = 10_000


def filter_values(
    tables: Mapping[str, DataFrame], filters: Mapping[str, str], whitelist: Mapping[str, Sequence[object] | None] | None = None,
    most: int = MOST_COMBINATIONS,
) -> dict[str, list[str]]:
    """The values of each filter column that its tables hold, as text, cut to the whitelist (None: all, empty: no such filter; of a list of
    which the tables hold nothing, all). Over `most` values raise an error."""
    from visitframe.operators.profiling import distinct_values

    allowed = whitelist or {}
    out: dict[str, list[str]] = {}
    for column in dict.fromkeys(filters.values()):
        wanted = allowed.get(column)
        if wanted is not None and not wanted:
            continue
        found = [distinct_values(tables[n], [column]) for n, c in filters.items() if c == column and n in tables and c in tables[n].columns]
        if not found:
            continue
        values = reduce(DataFrame.unionByName, found).select("value").distinct()
        texts = list(dict.fromkeys(map(str, wanted or ())))
        held = {r["value"] for r in values.where(F.col("value").isin(texts)).collect()} if texts else set()
        own = [v for v in texts if v in held] or sorted(r["value"] for r in values.limit(most + 1).collect())
        if len(own) > most:
            raise ValueError(f"over {most} values of {column}: pass a whitelist")
        if own:
            out[column] = own
    return out


def merge_combinations(
    tables: Mapping[str, DataFrame], filters: Mapping[str, str], subject: str, date: str,
    whitelist: Mapping[str, Sequence[object] | None] | None = None, row_id: str = "row_id", most: int = MOST_COMBINATIONS, **kw,
) -> DataFrame:
    """The incremental merge for every combination of filter values, in one plan: `filters` names the filter column of a
    table, the values are those of filter_values. A row belongs to the combinations whose values it has in
    the filter columns of its table, and is exploded by their names; then all combinations are matched and merged at once, keyed by
    (combination, subject). A table without rows for a combination adds nothing to it, and a combination without any
    row isn't there. The result has the column `combination`, and row ids `combination|table:id`; over `most` combinations raise an error."""
    from visitframe.sources.catalog import combination_name, combinations

    listed = combinations(filter_values(tables, filters, whitelist, most))
    if len(listed) > most:
        raise ValueError(f"over {most} combinations: pass a whitelist")
    columns = sorted(listed[0])
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame(
        [(combination_name(c), *[c[k] for k in columns]) for c in listed],
        ", ".join(["combination string", *[f"`__f_{k}` string" for k in columns]]),
    )

    def exploded(df: DataFrame, number: int) -> DataFrame:
        own = [c for c in columns if c in df.columns]
        on = reduce(lambda x, y: x & y, [F.col(f"`{c}`").cast("string") == F.col(f"`__f_{c}`") for c in own], F.lit(True))
        rows = df.join(F.broadcast(names), on).drop(*[f"__f_{c}" for c in columns])  # `most` rows at most
        key = F.concat("combination", F.lit("|"), F.col(subject).cast("string"))
        return rows.withColumns({"__key": key, row_id: F.concat("combination", F.lit(f"|{number}:"), F.col(row_id).cast("string"))})

    numbered = [exploded(t, k) for k, t in enumerate(tables.values())]
    merged = numbered[0]
    for k, t in enumerate(numbered[1:]):
        merged = merge_pair(materialize(merged) if k and k % 2 == 0 else merged, t, "__key", date, row_id=row_id, **kw)
    return merged.drop("__key")


def as_of_nearest(
    left: DataFrame, right: DataFrame, subject: str, time: str, value: str, tolerance: float | None = None,
    direction: str = "nearest", order: Sequence[str] = (),
) -> DataFrame:
    """left plus the right `value` and its time (`<value>_time`) nearest in time for the subject; on
    equal distance the earlier, of rows at one time the last by `order`. One sort of the union by
    (subject, time): what lies before and after comes from two windows, not from a join."""
    time_type = dict(left.dtypes)[time]
    mine = left.select(F.col(subject), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"))
    latest = right.where(F.col(time).isNotNull()).groupBy(subject, F.col(time).cast(time_type).alias("__t")).agg(
        F.max_by(value, F.struct(*order) if order else F.lit(0)).alias("__v")
    )
    other = latest.select(subject, "__t", F.lit(0).alias("__side"), F.struct("__t", F.col("__v").alias("v")).alias("__hit"))
    both = mine.withColumn("__hit", F.lit(None).cast(other.schema["__hit"].dataType)).unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(subject).orderBy("__t", "__side")
    back = F.last("__hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumns({"__back": back, "__ahead": ahead}).where("__side = 1")
    seconds = time_type.startswith("timestamp")

    def at(c: Column) -> Column:
        """Microseconds of timestamps, days of dates, numbers as they are."""
        if time_type == "date":
            return F.datediff(c, F.lit("1970-01-01").cast("date"))
        return F.unix_micros(c.cast("timestamp")) if seconds else c.cast("double")

    gap_back, gap_ahead = at(F.col("__t")) - at(F.col("__back.__t")), at(F.col("__ahead.__t")) - at(F.col("__t"))
    nearest = F.when(F.col("__ahead").isNull() | (gap_back <= gap_ahead), F.col("__back")).otherwise(F.col("__ahead"))
    hit = {"nearest": nearest, "backward": F.col("__back"), "forward": F.col("__ahead")}[direction]
    if tolerance is not None:
        hit = F.when(F.abs(at(hit["__t"]) - at(F.col("__t"))) <= tolerance, hit)
    return seen.select("__row.*", hit.alias("__h")).select(
        *[F.col(f"`{c}`") for c in left.columns], F.col("__h.v").alias(value), F.col("__h.__t").alias(f"{value}_time")
    )


def key_overlap(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(left, right, common): distinct keys shared by every two tables, and a table's own count on
    the diagonal. One pass: keys carry the set of tables they are in."""
    tagged = reduce(DataFrame.unionByName, [t.select(*keys).withColumn("__t", F.lit(n)) for n, t in tables.items()])
    names = list(tables)
    sets = tagged.groupBy(*keys).agg(F.collect_set("__t").alias("__in"))
    counts = sets.agg(
        *[
            F.count_if(F.array_contains("__in", a) & F.array_contains("__in", b)).alias(f"{a}|{b}")
            for a, b in [*pairs(names, 2), *[(n, n) for n in names]]
        ]
    )
    long = counts.unpivot([], counts.columns, "pair", "common")
    part = F.split("pair", r"\|")
    return long.select(F.get(part, F.lit(0)).alias("left"), F.get(part, F.lit(1)).alias("right"), "common")


def overlap_report(one: DataFrame, others: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(other, common, only_left, only_right) of distinct keys."""
    out = []
    for name, t in others.items():
        a = one.select(*keys).distinct().withColumn("__a", F.lit(1))
        b = t.select(*keys).distinct().withColumn("__b", F.lit(1))
        j = a.join(b, list(keys), "full_outer")
        out.append(
            j.agg(
                F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("common"),
                F.count_if(F.col("__b").isNull()).alias("only_left"),
                F.count_if(F.col("__a").isNull()).alias("only_right"),
            ).select(F.lit(name).alias("other"), "common", "only_left", "only_right")
        )
    return reduce(DataFrame.unionByName, out)


def row_difference(pairs_df: DataFrame, columns: Sequence[str], suffixes: tuple[str, str] = ("_1", "_2")) -> Column:
    """Names of the columns whose two values differ, NULL equalling NULL."""
    names = [F.when(~F.col(c + suffixes[0]).eqNullSafe(F.col(c + suffixes[1])), F.lit(c)) for c in columns]
    return F.concat_ws(",", *names)


def paired_rows(a: DataFrame, b: DataFrame, links: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Matched rows side by side, columns suffixed _1 and _2, and the unmatched ones of both."""
    left = a.withColumnsRenamed({c: f"{c}_1" for c in a.columns})
    right = b.withColumnsRenamed({c: f"{c}_2" for c in b.columns})
    return (
        left.join(links, left[f"{row_id}_1"] == links["id1"], "left")
        .join(right, F.col("id2") == right[f"{row_id}_2"], "full_outer")
        .drop("id1", "id2")
    )


def _distance_of(metric: str, flags: np.ndarray, scale: np.ndarray):
    """Distances of all rows of u to all of v."""

    def euclidean(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        square = (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * (u @ v.T)
        return np.sqrt(np.maximum(square, 0.0))

    def gower(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(u), len(v)))
        for f in range(u.shape[1]):
            d = u[:, f, None] - v[None, :, f]
            out += (d != 0) if flags[f] else np.abs(d) / scale[f]
        return out / u.shape[1]

    return euclidean if metric == "euclidean" else gower


#: Copies of queries that a task holds as vectors while it sends them to cells.
SENT_AT_ONCE = 4096


def sent_to_cells(asks: pd.DataFrame, rows: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> Iterator[pd.DataFrame]:
    """A copy of the query at rows[i] for cells[i]. In many dimensions a query goes to every cell: copies leave in pieces, never all at once."""
    for lo in range(0, len(rows), SENT_AT_ONCE):
        some = rows[lo : lo + SENT_AT_ONCE]
        yield asks.iloc[some].assign(reach=reach[some], cell=cells[lo : lo + SENT_AT_ONCE].astype(np.int32))


class Approximation:
    """Vectors in a byte per numeric feature: the middles of 256 equal stretches of its range. Other features stay as they are."""

    def __init__(self, low: np.ndarray, high: np.ndarray, flags: np.ndarray):
        self.low, self.flags = low, flags
        self.step = np.where(high > low, (high - low) / 256, 1.0)

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.step), 0, 255).astype(np.uint8)[:, ~self.flags]

    def decoded(self, codes: np.ndarray, kept: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.flags)))
        out[:, ~self.flags] = self.low[~self.flags] + (codes + 0.5) * self.step[~self.flags]
        out[:, self.flags] = kept
        return out


def nearest_candidates(
    queries: DataFrame, base: DataFrame, id_col: str, features: Sequence[str], k: int, metric: str = "euclidean",
    categorical: Sequence[str] = (), ranges: Mapping[str, float] | None = None, same_id: bool = True, block: int = 1 << 16,
    most_pivots: int = 256,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, queries, base): pairs of query_id and base_id among which are the k nearest base rows of every query, and the vectors
    (id, x) of both sides. Of base rows with the same vector only the first k + 1 ids are there, as no other can be among the k.

    Base rows are approximated by a byte per feature, and keep their distance to their approximation, so the distance of a
    query to the approximation bounds that to the row from both sides. They belong to the nearest of some pivots (at most
    most_pivots rows by a hash of the id, the only vectors that reach the driver). A query first meets the cell of its nearest pivot,
    whose k-th upper bound is its reach; then it meets the other cells that the triangle inequality doesn't rule
    out. Cells come in parts of `block` approximations; a row whose lower bound is beyond the reach, or beyond
    the k-th upper bound among the rows next to it, is never fetched.
    """
    spark = queries.sparkSession
    packed = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    q, b = (t.select(F.col(id_col).alias("id"), packed.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))) for t in (queries, base))
    # -0.0 and 0.0 are the same; the limit of the window is applied before rows move
    b = b.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    again = Window.partitionBy("x").orderBy("id")
    b = b.withColumn("__no", F.row_number().over(again)).where(F.col("__no") <= k + 1).drop("__no")
    q, b = materialize(q), materialize(b)
    kind = dict(queries.dtypes)[id_col]
    pair_schema = f"query_id {kind}, base_id {kind}, low double, high double"
    # a row per feature reaches the driver
    by_place = b.select(F.posexplode("x")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high"), F.count("*").alias("n"))
    stats = by_place.orderBy("pos").collect()
    n_base = stats[0]["n"] if stats else 0
    if not n_base:
        return spark.createDataFrame([], pair_schema).select("query_id", "base_id"), q, b
    count = min(most_pivots, max(1, math.isqrt(n_base) // 4))
    pivots = np.stack([r["x"] for r in b.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(count).collect()])
    flags = np.array([c in set(categorical) for c in features])
    scale = np.array([1.0 if not ranges else ranges.get(c, 1.0) or 1.0 for c in features])
    distances = _distance_of(metric, flags, scale)
    coder = Approximation(*(np.array([r[end] for r in stats]) for end in ("low", "high")), flags)

    def off_by(x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Distance of each row to its approximation."""
        if metric == "euclidean":
            return np.sqrt(((x - near) ** 2).sum(axis=1))
        return (np.abs(x - near) / scale)[:, ~flags].sum(axis=1) / len(flags)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.iloc[lo : lo + 4096]
                x = np.stack(part["x"])
                d = distances(x, pivots)
                cell = d.argmin(axis=1)
                codes, kept = coder.encoded(x), x[:, flags]
                yield pd.DataFrame({
                    "id": part["id"], "code": [c.tobytes() for c in codes], "kept": list(kept), "off": off_by(x, coder.decoded(codes, kept)),
                    "cell": cell.astype(np.int32), "away": d[np.arange(len(part)), cell],
                })

    dealt = materialize(b.mapInPandas(assign, f"id {kind}, code binary, kept array<double>, off double, cell int, away double"))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    filled = np.array(sorted(cells))
    radius = np.array([cells[c][1] for c in filled])
    large = np.array([cells[c][0] for c in filled]) > k  # one more than asked for, as a row may meet itself
    blocks = F.element_at(F.create_map(*[F.lit(v) for c in filled.tolist() for v in (c, -(-cells[c][0] // block))]), F.col("cell"))
    parts = dealt.select("cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "code", "kept", "off")

    def visits(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    part = batch.iloc[lo : lo + 4096]
                    d = distances(np.stack(part["x"]), pivots)[:, filled]
                    own = np.where(large[None, :], d, np.inf).argmin(axis=1) if large.any() else d.argmin(axis=1)
                    reach = np.full(len(part), np.inf) if first else part["reach"].fillna(np.inf).to_numpy(float)
                    if first:
                        rows, at = np.arange(len(part)), own
                    else:
                        # no row of a cell is nearer than this; rounding gets a little room
                        least = np.maximum(d - radius[None, :], (d - d.min(axis=1)[:, None]) / 2)
                        needed = least <= reach[:, None] * (1 + 1e-9) + 1e-9
                        needed[np.arange(len(part)), own] = False
                        rows, at = np.nonzero(needed)
                    yield from sent_to_cells(part[["id", "x"]], rows, reach, filled[at])

        return run

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by (cell, part), base rows first: a part's base rows are held, its queries stream by."""
        key, held, ready = None, [], None
        for batch in batches:
            for own, rows in batch.groupby(["cell", "part"], sort=False):
                if own != key:
                    key, held, ready = own, [], None
                asks = rows["asks"].to_numpy(bool)
                if not asks.all():
                    held.append(rows.loc[~asks, ["id", "code", "kept", "off"]])
                ask = rows[asks]
                if not len(ask) or not held:
                    continue
                if ready is None:
                    ready = pd.concat(held)
                for at in range(0, len(ready), 8192):
                    near = ready.iloc[at : at + 8192]
                    codes = np.frombuffer(b"".join(near["code"]), np.uint8).reshape(len(near), -1)
                    v = coder.decoded(codes, np.stack(near["kept"]))
                    for lo in range(0, len(ask), 256):
                        yield _bounded(ask.iloc[lo : lo + 256], near["id"].to_numpy(), v, near["off"].to_numpy(float))

    def _bounded(ask: pd.DataFrame, ids: np.ndarray, v: np.ndarray, off: np.ndarray) -> pd.DataFrame:
        own, u, reach = ask["id"].to_numpy(), np.stack(ask["x"]), ask["reach"].to_numpy(float)
        d = distances(u, v)
        # what the matrix product may round off, of squares for euclidean distances
        room = 1e-7 * (1 + np.sqrt((u * u).sum(axis=1).max() + (v * v).sum(axis=1).max()))
        low, high = d - off[None, :] - room, d + off[None, :] + room
        if not same_id:
            me = own[:, None] == ids[None, :]
            low[me] = high[me] = np.inf
        if high.shape[1] >= k:
            reach = np.minimum(reach, np.partition(high, k - 1, axis=1)[:, k - 1])
        rows, at = np.nonzero((low <= reach[:, None]) & np.isfinite(low))
        return pd.DataFrame({"query_id": own[rows], "base_id": ids[at], "low": low[rows, at], "high": high[rows, at]})

    def found_in(asked: DataFrame) -> DataFrame:
        parts_of = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("part")
        rows = parts.unionByName(asked.select("cell", parts_of, F.lit(True).alias("asks"), "id", "x", "reach"), allowMissingColumns=True)
        return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks").mapInPandas(meet, pair_schema)

    def reached(pairs: DataFrame) -> DataFrame:
        """(id, reach): the k-th upper bound of every query that has so many."""
        w = Window.partitionBy("query_id").orderBy("high")
        return pairs.withColumn("__no", F.row_number().over(w)).where(F.col("__no") == k).select(F.col("query_id").alias("id"), F.col("high").alias("reach"))

    sent = f"id {kind}, x array<double>, reach double, cell int"
    near = materialize(found_in(q.mapInPandas(visits(True), sent)))
    rest = q.join(reached(near), "id", "left").mapInPandas(visits(False), sent)
    pairs = materialize(near.unionByName(found_in(rest)))
    kept = pairs.join(reached(pairs), pairs["query_id"] == F.col("id"), "left").where(F.col("low") <= F.coalesce("reach", F.lit(math.inf)))
    return kept.select("query_id", "base_id").distinct(), q, b


#: From so many features on the triangle inequality rules out next to nothing, and blocks of rows meet instead of cells.
GRID_FEATURES = 16


def blocked_nearest(
    queries: DataFrame, base: DataFrame, id_col: str, features: Sequence[str], k: int, metric: str = "euclidean",
    categorical: Sequence[str] = (), ranges: Mapping[str, float] | None = None, same_id: bool = True, block: int = 1 << 16,
    most_pivots: int = 256, by_square: bool = False,
) -> DataFrame:
    """(query_id, base_id, distance, rank): the k nearest base rows of every query, exactly; of equal distances the smaller
    id comes first. same_id: a row may be its own neighbour. metric: euclidean, or gower (mean of 0/1 mismatches of categorical and
    range-scaled absolute differences of the other features). Ids are unique on either side. by_square: euclidean distances
    are ordered by their squares, which may differ where their roots round to the same number.

    Candidates come from approximations (nearest_candidates). Only their vectors are fetched, and compared in
    column expressions. From GRID_FEATURES features on, all blocks of rows meet instead (nearest_in_grid)."""
    if len(features) >= GRID_FEATURES:
        flags = np.array([c in set(categorical) for c in features])
        scale = np.array([1.0 if not ranges else ranges.get(c, 1.0) or 1.0 for c in features])
        near = nearest_in_grid(queries, base, id_col, features, k, metric, flags, scale, same_id, by_square)
        distance = F.sqrt("key") if metric == "euclidean" and by_square else F.col("key")
        first = Window.partitionBy("query_id").orderBy("key", "base_id")
        near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        return near.select("query_id", "base_id", distance.alias("distance"), "rank")
    pairs, q, b = nearest_candidates(queries, base, id_col, features, k, metric, categorical, ranges, same_id, block, most_pivots)
    both = pairs.join(b.select(F.col("id").alias("base_id"), F.col("x").alias("v")), "base_id").join(
        q.select(F.col("id").alias("query_id"), F.col("x").alias("u")), "query_id"
    )
    if metric == "euclidean":
        square = F.zip_with("u", "v", lambda x, y: (x - y) * (x - y))
        key = F.aggregate(square, F.lit(0.0), lambda t, x: t + x)
        distance = F.sqrt(key)
    else:
        scale = [1.0 if not ranges else ranges.get(c, 1.0) or 1.0 for c in features]
        off = [
            (F.col("u")[i] != F.col("v")[i]).cast("double") if c in set(categorical) else F.abs(F.col("u")[i] - F.col("v")[i]) / F.lit(scale[i])
            for i, c in enumerate(features)
        ]
        key = distance = F.aggregate(F.array(*off), F.lit(0.0), lambda t, x: t + x) / len(features)
    w = Window.partitionBy("query_id").orderBy("__key", "base_id")
    found = both.select("query_id", "base_id", distance.alias("distance"), (key if by_square else distance).alias("__key"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__key")
