"""Row numbers and running totals that stay parallel when one group holds most rows.

A window partitioned by a group runs each group in one task. Here a group larger than its
fair share is cut into consecutive ranges of the ordering key. Each range is numbered (or
summed) on its own, and the totals of the earlier ranges are added as an offset, so the
result equals that of the plain window.

The ranges end at quantiles of a sample that depends on hashes of the ordering columns only. So
they are the same wherever the plan uses them and whenever a task is retried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.operators.skew import PARTS, ROWS, LargeGroups, large_groups, same
from trialspark.sources.workspace import settle

_RANGE, _ENDS, _BEFORE = "__range", "__grp_ends", "__grp_before"

# Rows sampled for each range; with so many a range seldom has twice its share.
SAMPLE_PER_PART = 50


def _prefixed(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in columns})


def _place(keys: Sequence[str]) -> Column:
    """The ordering columns as one comparable value; nulls come first, as in the sort."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _bounds(df: DataFrame, group: Sequence[str], keys: Sequence[str], large: LargeGroups) -> LargeGroups:
    """The over-full groups with the sorted places at which their ranges end.

    The places are quantiles of a sample of the group. Whether a place is sampled depends on its hash
    only, so the bounds are the same in every run and for every task; they decide where ranges end, never
    what a row's number is.
    """
    share = F.lit(SAMPLE_PER_PART) * F.col(PARTS) / F.col(ROWS)
    inside = large.attach(df).filter(F.col(ROWS).isNotNull())
    hashed = F.pmod(F.xxhash64(*keys), F.lit(1 << 20))
    sample = inside.filter(hashed < share * (1 << 20)).select(*group, PARTS, _place(keys).alias("__place"))
    whole = Window.partitionBy(*group)
    row = F.row_number().over(whole.orderBy("__place"))
    size = F.count(F.lit(1)).over(whole)
    part = F.floor(F.col("__row") * F.col(PARTS) / F.col("__size"))
    before = F.floor((F.col("__row") - 1) * F.col(PARTS) / F.col("__size"))
    ends = (
        sample.withColumns({"__row": row, "__size": size})
        .filter((part != before) & (F.col("__row") < F.col("__size")))
        .groupBy(*group).agg(F.array_sort(F.collect_list("__place")).alias(_ENDS))
    )
    match = same(group, "__e_")
    table = large.table.join(_prefixed(ends, group, "__e_"), match, "left")
    return LargeGroups(large.group, table.drop(*["__e_" + c for c in group]))


def split_ranges(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    large: LargeGroups | None = None,
    checked: bool = False,
    **limits,
) -> DataFrame:
    """Add the range and the size of over-full groups (both null for other groups).

    Without an over-full group the frame is returned as it is. ``large`` gives the over-full
    groups if they were found before (``checked``).

    Ranges end at quantiles of all ordering columns together, compared as one value, so outliers, texts,
    ties on the first column and every type that can be sorted are cut evenly. Rows that are equal in
    all ordering columns stay in one range.
    """
    if large is None and not checked:
        large = large_groups(df, group, **limits)
    if large is None:
        return df
    ends, place = F.coalesce(F.col(_ENDS), F.array()), _place(keys)
    # Number of ends below the place, found by halving steps.
    steps = F.array(*[F.lit(1 << i) for i in range(20, -1, -1)])
    index = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(ends)) & (F.try_element_at(ends, at + step) < place), at + step
        ).otherwise(at),
    )
    return (
        _bounds(df, group, keys, large).attach(df)
        .withColumn(_RANGE, F.when(F.col(ROWS).isNotNull(), index))
        .drop(PARTS, _ENDS)
    )


def _is_split(marked: DataFrame) -> bool:
    return _RANGE in marked.columns


def _drop_ranges(df: DataFrame) -> DataFrame:
    return df.drop(_RANGE, ROWS)


def _with_offsets(
    marked: DataFrame, group: Sequence[str], sums: Mapping[str, Column], offsets: Mapping[str, Column]
) -> DataFrame:
    """Join per-range offsets (window expressions over the range sums) to the rows of ranges."""
    cells = marked.filter(F.col(_RANGE).isNotNull()).groupBy(*group, _RANGE).agg(
        *[value.alias(name) for name, value in sums.items()]
    )
    table = cells.select(*group, _RANGE, *[e.alias(n) for n, e in offsets.items()])
    table = _prefixed(table, [*group, _RANGE], "__o_")
    match = same([*group, _RANGE], "__o_")
    return marked.join(table, match, "left").drop(
        "__o_" + _RANGE, *["__o_" + c for c in group]
    )


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    total: str | None = None,
    dtype: str = "long",
    **split,
) -> DataFrame:
    """Row number 1..n inside each group, and optionally the group size.

    ``order`` must identify a row inside its group; rows that tie on all of it are numbered in
    any order. The data is shuffled once, by (group, range).
    ``split`` takes the options of ``split_ranges``.
    """
    group, order = list(group), list(order)
    marked = split_ranges(df, group, order, **split)
    if not _is_split(marked):
        w = Window.partitionBy(*group)
        out = df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast(dtype))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out
    earlier = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    marked = _with_offsets(
        marked, group, {"__rows": F.count(F.lit(1))}, {_BEFORE: F.sum("__rows").over(earlier)}
    )
    cell = Window.partitionBy(*group, _RANGE)
    position = F.row_number().over(cell.orderBy(*order)) + F.coalesce(F.col(_BEFORE), F.lit(0))
    out = marked.withColumn(name, position.cast(dtype))
    if total:
        size = F.coalesce(F.col(ROWS), F.count(F.lit(1)).over(cell))
        out = out.withColumn(total, size.cast("long"))
    return _drop_ranges(out).drop(_BEFORE)


def accumulate(
    marked: DataFrame,
    group: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    descending: bool = False,
    products: Sequence[str] = (),
    group_totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running totals over the rows of ``split_ranges``, which has one row per (group, order).

    ``totals`` maps new columns to the summed values, up to and including each row; names listed
    in ``products`` are multiplied instead. ``group_totals`` maps new columns to names of totals
    whose value over the whole group is wanted.
    """
    group, group_totals = list(group), dict(group_totals or {})

    def merge(name: str, value: Column) -> Column:
        return F.product(value) if name in products else F.sum(value)

    direction = F.desc if descending else F.asc
    whole = Window.partitionBy(*group)
    valued = marked.withColumns({f"__v_{n}": v for n, v in totals.items()})
    split = _is_split(marked)
    if split:
        before = whole.orderBy(direction(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
        valued = _with_offsets(
            valued,
            group,
            {f"__c_{n}": merge(n, F.col(f"__v_{n}")) for n in totals},
            {
                **{f"__b_{n}": merge(n, F.col(f"__c_{n}")).over(before) for n in totals},
                **{f"__t_{n}": F.sum(f"__c_{n}").over(whole) for n in group_totals.values()},
            },
        )
    cell = Window.partitionBy(*group, _RANGE) if split else whole
    upto = cell.orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    new = {n: merge(n, F.col(f"__v_{n}")).over(upto) for n in totals}
    new.update({n: F.sum(f"__v_{source}").over(cell) for n, source in group_totals.items()})
    if split:
        for n in totals:
            if n in products:
                new[n] = new[n] * F.coalesce(F.col(f"__b_{n}"), F.lit(1.0))
            else:
                new[n] = new[n] + F.coalesce(F.col(f"__b_{n}"), F.lit(0))
        for n, source in group_totals.items():
            new[n] = F.coalesce(F.col(f"__t_{source}"), new[n])
    return valued.withColumns(new).select(*marked.columns, *new)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    descending: bool = False,
    products: Sequence[str] = (),
    group_totals: Mapping[str, str] | None = None,
    **split,
) -> DataFrame:
    """Running totals per group in one step; see ``accumulate`` and ``split_ranges``."""
    marked = split_ranges(df, group, [order], **split)
    return _drop_ranges(
        accumulate(marked, group, order, totals, descending, products, group_totals)
    )


def sequence_within(
    df: DataFrame, subject: str, order: Sequence[str], name: str, **limits
) -> DataFrame:
    """Sequence 1..n per subject in the given order."""
    return numbered(df, [subject], order, name, dtype="int", **limits)


def allocate_arms(
    df: DataFrame, site: str, order: Sequence[str], arms: int = 3, name: str = "TRT01PN", **limits
) -> DataFrame:
    """Rotate subjects over the arms within each site, in the given order."""
    out = numbered(df, [site], order, "__n_in_site", **limits)
    return out.withColumn(name, ((F.col("__n_in_site") - 1) % arms).cast("int")).drop(
        "__n_in_site"
    )


def global_sequence(
    df: DataFrame, group: str, order: Sequence[str], name: str, **limits
) -> DataFrame:
    """Number all rows 1..N by (group, order) without a window over the whole table.

    Rows are numbered inside their group; the rows of all earlier groups come from running
    totals over the table of group sizes.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    sizes = settle(counts.withColumn("__all", F.lit(0)))
    upto = running(sizes, ["__all"], group, {"__upto": F.col("__size")}, **limits)
    starts = upto.select(
        F.col(group).alias("__of"), (F.col("__upto") - F.col("__size")).alias("__start")
    )
    inside = numbered(df, [group], order, "__in_group", **limits)
    return (
        inside.join(starts, F.col(group).eqNullSafe(F.col("__of")), "left")
        .withColumn(name, (F.col("__in_group") + F.col("__start")).cast("long"))
        .drop("__of", "__start", "__in_group")
    )


def first_last(
    df: DataFrame,
    subject: str,
    order: Sequence[str],
    first: str = "FIRSTFL",
    last: str = "LASTFL",
    **limits,
) -> DataFrame:
    """'Y'/'N' flags of the first and last record of each subject."""
    out = numbered(df, [subject], order, "__i", total="__of", **limits)
    return out.withColumns(
        {
            first: F.when(F.col("__i") == 1, "Y").otherwise("N"),
            last: F.when(F.col("__i") == F.col("__of"), "Y").otherwise("N"),
        }
    ).drop("__i", "__of")
