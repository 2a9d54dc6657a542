"""Exact ranks, rank bins and quantiles without a single-partition window.

An unpartitioned ``Window.orderBy`` moves every row into one task.  Here the
order is computed the distributed way (the one piece of real design):

1. ``repartitionByRange(order)`` - Spark samples bounds and splits the rows
   into ordered, balanced ranges, as many as the adaptive planner sees fit.
   The order ends with a unique tie column, so a hot value (even a third of
   all rows) is split across ranges.
2. ``sortWithinPartitions(order)`` + ``monotonically_increasing_id()`` - the
   id carries the range number (high bits) and the row's position inside its
   sorted range (low bits); no second shuffle.
3. The numbered rows are stored once in the checkpoint folder.  Counts per
   range and the rows themselves are both read from there, so they can never
   belong to different ranges, whatever columns each of them reads.
4. Per-range counts -> prefix sums (a frame of one row per range, not per
   data row) -> joined back -> global rank = offset + position + 1.

Rank bins and split points rank a *narrow* projection; the handful of
boundary rows goes back to the main table as a scalar subquery, and the wide
table is binned by comparison, never reshuffled.  Quantile values need no
ties and no order of the rows: rounds of counts by cells of values narrow
each wanted rank down to one value (``_selected``).

Inputs whose values are recomputed (e.g. a double aggregated after a shuffle)
must be deterministic; money sums go through decimals (``money_sum``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.functions.expr import comes_after
from insight.operators.joins import hint_if_small
from insight.session import materialize

_POS_MASK = (1 << 33) - 1
CELLS = 4096  # cells an interval of values is cut into by a round of quantile selection
Order = Sequence[tuple[str, bool]]  # (column, ascending)


def _sort_keys(order: Order) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def _numbered(df: DataFrame, keys: Sequence[Column], num_partitions: int | None) -> DataFrame:
    """Rows in range order, stored, with ``_pid`` (range) and ``_pos`` (position in the range)."""
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    kept = materialize(ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    return kept.withColumns({"_pid": F.shiftright("_mid", 33), "_pos": F.col("_mid").bitwiseAND(F.lit(_POS_MASK))}).drop("_mid")


def rank_rows(df: DataFrame, order: Order, by: Sequence[str] = (), rank_col: str = "_rank",
              total_col: str = "_n", num_partitions: int | None = None) -> DataFrame:
    """Attach the exact 1-based ``row_number`` over ``order`` (within ``by`` groups).

    ``order`` must make rows unique (end it with an id) for a deterministic
    result.  Adds ``rank_col`` and ``total_col`` (row count of the group).
    Runs one job at build time that stores the ordered rows; the offsets
    frame has at most one row per range and group.
    """
    by = list(by)
    ranged = _numbered(df, [F.col(b).asc() for b in by] + _sort_keys(order), num_partitions)
    grp = ["_pid"] + by
    counts = ranged.groupBy(*grp).agg(F.count(F.lit(1)).alias("_cnt"),
                                      F.min("_pos").alias("_first"))
    prior = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = counts.select(
        *grp, "_first",
        F.coalesce(F.sum("_cnt").over(prior), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias(total_col),
    )
    offsets = offsets.withColumnsRenamed({c: f"_of_{c}" for c in grp})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in grp]
    joined = ranged.join(offsets, on=same, how="inner").drop(*[f"_of_{c}" for c in grp])
    return joined.withColumn(
        rank_col, F.col("_off") + (F.col("_pos") - F.col("_first")) + F.lit(1)
    ).drop("_pid", "_pos", "_first", "_off")


def global_rank(df: DataFrame, value: str, tie: str, ascending: bool = True,
                rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """``Series.rank(method='first', ascending=...)`` (B1).

    Ties take the tie column's ascending order in both directions (F6);
    null values get a null rank, as in pandas.
    """
    ranked = rank_rows(df.where(F.col(value).isNotNull()), [(value, ascending), (tie, True)],
                       rank_col=rank_col, num_partitions=num_partitions).drop("_n")
    nulls = df.where(F.col(value).isNull()).withColumn(rank_col, F.lit(None).cast("long"))
    return ranked.unionByName(nulls)


def qcut_rank_bin(rank: Column, n: Column, q: int) -> Column:
    """Bin of rank r in ``pandas.qcut(ranks, q)`` (F1), integer arithmetic.

    ``greatest(1, ((r-1)*q + n-2) div (n-1))``; n = 1 gives bin 1.
    """
    num = (rank - F.lit(1)) * F.lit(q) + n - F.lit(2)
    den = n - F.lit(1)
    quotient = ((num - num % den) / den).cast("long")  # exact: num is a multiple of den
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), quotient.cast("int")))


def order_statistics(narrow: DataFrame, ties: Sequence[str], targets: Sequence[object],
                     num_partitions: int | None = None) -> DataFrame:
    """Rows at given ranks of the order ``(_v, *ties)`` within each group ``_g``.

    ``narrow`` holds ``_g`` (group key), ``_v`` (sort key, no null/NaN) and
    the tie columns (ascending).  ``targets`` is a list of functions from the
    group size to a 1-based rank.  Returns ``_g, _j, _t`` (target index and
    rank), ``_n`` (group size), ``_v`` and ties for every target inside
    ``1..n``.  One path for every size: a range sort of the narrow rows.
    """
    rk = rank_rows(narrow, [("_v", True)] + [(c, True) for c in ties], by=["_g"], rank_col="_r",
                   num_partitions=num_partitions)
    n = F.col("_n")
    hit = F.array(*[F.when(F.col("_r") == rank_fn(n).cast("long"), F.lit(j)) for j, rank_fn in enumerate(targets)])
    picked = rk.select("_g", "_v", *ties, "_r", "_n", F.explode(F.array_compact(hit)).alias("_j"))
    return picked.select("_g", "_j", F.col("_r").alias("_t"), "_n", "_v", *ties)


def _common_key(types: Sequence[T.DataType]) -> str:
    """The type that holds every value of the given numeric types without losing their order."""
    if all(isinstance(t, T.IntegralType) for t in types):
        return "bigint"
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in types):
        return f"decimal(38,{max(t.scale for t in types if isinstance(t, T.DecimalType))})"
    return "double"


def _sortable(x: Column, ascending: bool, kind: str) -> Column:
    """Ascending sort key; descending keys are mirrored (integers bitwise, so none overflows)."""
    k = x.cast(kind)
    if ascending:
        return k
    return F.bitwise_not(k) if kind == "bigint" else F.lit(0).cast(kind) - k


def _present(x: Column, kind: str) -> Column:
    return x.isNotNull() & ~F.isnan(x) if kind == "double" else x.isNotNull()


def rank_bins_multi(df: DataFrame, specs: Sequence[tuple[str, bool, str]], q: int, tie: str,
                    labels: Sequence[str] | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Several rank-quantile columns, exact, from one pass of order statistics (B2 x m).

    ``specs`` holds ``(numeric value column, ascending, output column)``;
    ties take ``tie`` ascending in both directions.  The m value columns
    are unpivoted into ``(metric, key, tie)`` rows; only the q-1 boundary rows
    per metric (the last row of each bin, rank ``floor(b(n-1)/q) + 1``) are
    located (``order_statistics``) and returned as one scalar subquery.  A
    row's bin is 1 + the number of boundaries it sorts after; null -> bin 1.
    """
    if labels is not None and len(labels) != q:
        raise ValueError("need q labels")
    kind = _common_key([df.schema[v].dataType for v, _, _ in specs])
    entries = [F.struct(F.lit(i).alias("_g"), _sortable(F.col(v), asc, kind).alias("_v"))
               for i, (v, asc, _) in enumerate(specs)]
    narrow = (df.select(F.col(tie), F.explode(F.array(*entries)).alias("_p"))
              .select("_p._g", "_p._v", tie).where(_present(F.col("_v"), kind)))

    def edge(b):
        def rank_fn(n):
            x = (n - F.lit(1)) * F.lit(b)
            return (x - x % F.lit(q)) / F.lit(q) + F.lit(1)  # floor(b(n-1)/q) + 1, exact
        return rank_fn

    bounds = order_statistics(narrow, [tie], [edge(b) for b in range(1, q)],
                              num_partitions=num_partitions)
    lookup = bounds.select(F.map_from_entries(F.collect_list(F.struct(
        (F.col("_g").cast("long") * F.lit(1_000_000) + F.col("_j")).alias("k"),
        F.struct(F.col("_v").alias("x"), F.col(tie).alias("t")))))).scalar()
    out = df.withColumn("_bounds", lookup)
    for i, (v, asc, name) in enumerate(specs):
        key = _sortable(F.col(v), asc, kind)
        binc = F.lit(1)
        for j in range(q - 1):
            e = F.try_element_at(F.col("_bounds"), F.lit(i * 1_000_000 + j))
            after = comes_after([key, F.col(tie)], [e["x"], e["t"]], [True, True])
            binc = binc + F.when(after, 1).otherwise(0)
        binc = F.when(~_present(key, kind), F.lit(1)).otherwise(binc)
        if labels is not None:
            binc = F.element_at(F.array(*[F.lit(x) for x in labels]), binc)
        out = out.withColumn(name, binc)
    return out.drop("_bounds")


def rank_bins(df: DataFrame, value: str, q: int, tie: str, ascending: bool = True,
              out: str = "bin", labels: Sequence[str] | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """``qcut(Series.rank(method='first'), q)`` as a column, null -> bin 1 (B2).

    Only ``(value, tie)`` is range-shuffled; the q-1 boundary rows return as a
    scalar subquery and every row of ``df`` is binned by comparison.  Works
    for any orderable value type (numeric values may use ``rank_bins_multi``).
    """
    if isinstance(df.schema[value].dataType, T.NumericType):
        return rank_bins_multi(df, [(value, ascending, out)], q, tie, labels=labels,
                               num_partitions=num_partitions)
    order = [(value, ascending), (tie, True)]
    narrow = df.select(value, tie).where(F.col(value).isNotNull())
    rk = rank_rows(narrow, order, num_partitions=num_partitions)
    rk = rk.withColumn("_bin", qcut_rank_bin(F.col("_rank"), F.col("_n"), q))
    bounds = rk.groupBy("_bin").agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col(tie).alias("t")), F.col("_rank")).alias("b"))
    lookup = bounds.select(F.map_from_entries(F.collect_list(
        F.struct(F.col("_bin"), F.col("b"))))).scalar()
    row = [F.col(value), F.col(tie)]
    binc = None
    for b in range(1, q + 1):
        e = F.try_element_at(F.col("_bounds"), F.lit(b))
        cond = ~comes_after(row, [e["v"], e["t"]], [ascending, True])
        binc = F.when(cond, F.lit(b)) if binc is None else binc.when(cond, F.lit(b))
    binc = F.when(F.col(value).isNull(), F.lit(1)).otherwise(binc.otherwise(F.lit(1)))
    if labels is not None:
        if len(labels) != q:
            raise ValueError("need q labels")
        binc = F.element_at(F.array(*[F.lit(x) for x in labels]), binc)
    return df.withColumn("_bounds", lookup).withColumn(out, binc).drop("_bounds")


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """Number of the equal-width cell of ``[lo, hi]`` that holds ``v``.

    Never falls as ``v`` grows.  Both ends have a cell of their own, so every
    cut splits the interval, whatever lies between (also infinite ends).
    """
    half = F.lit(0.5)
    share = F.nanvl((v * half - lo * half) / (hi * half - lo * half), F.lit(0.0))
    inner = F.least(F.floor(share * F.lit(float(CELLS - 1))), F.lit(CELLS - 2)) + F.lit(1)
    return F.when(v == lo, F.lit(0)).when(v == hi, F.lit(CELLS)).otherwise(inner).cast("int")


def _selected(narrow: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of ``_v`` per ``_g``: ``_g``, ``_q`` (array in ``probs`` order).

    Selection by cells: an interval of values per group and its wanted ranks
    start at the group's smallest and largest value.  A round counts the rows
    of each open interval by cell, with each cell's smallest and largest
    value; running counts over the cells (at most ``CELLS + 1`` an interval)
    give the cells that hold the ranks, and these are the next intervals.  An
    interval of one value is settled.  Only counts travel while the stored
    intervals are measured small: no row is shuffled, sorted or stored, and a
    hot group or value is counted where it lies.  With more groups than that
    the rows of open intervals are shuffled to them, hot ones split by AQE.  Money and counts settle after two or three rounds; values over
    many orders of magnitude take one more per factor of ``CELLS``.
    """
    pos = [(F.col("_n") - F.lit(1)).cast("double") * F.lit(float(p)) for p in probs]
    wanted = F.array_distinct(F.array(*[r for x in pos for r in (F.floor(x) + F.lit(1), F.ceil(x) + F.lit(1))]))
    spans = narrow.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = materialize(spans.select("*", F.lit(0).cast("long").alias("_base"), wanted.alias("_ranks")))
    settled = []
    while True:
        settled.append(state.where("_lo = _hi"))
        opened, still_open = hint_if_small(state.where("_lo < _hi").select(F.col("_g").alias("_og"), "_n", "_lo", "_hi", "_base"))
        if not still_open:
            break
        inside = narrow.join(opened, (F.col("_g") == F.col("_og")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        cells = inside.groupBy("_g", "_n", "_lo", "_base", _cell(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_cell")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        so_far = Window.partitionBy("_g", "_lo").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        run = cells.withColumn("_upto", F.col("_base") + F.sum("_c").over(so_far)).select(
            "_g", "_n", "_from", "_to", "_upto", (F.col("_upto") - F.col("_c")).alias("_before"))
        here = F.filter(wanted, lambda r: (r > F.col("_before")) & (r <= F.col("_upto")))
        state = materialize(run.select("_g", "_n", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"),
                                       F.col("_before").alias("_base"), here.alias("_ranks"))
                            .where(F.size("_ranks") > 0))
    found = reduce(DataFrame.unionByName, settled).select("_g", "_n", F.col("_lo").alias("_x"), F.explode("_ranks").alias("_r"))

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_r") == rank, F.col("_x")))

    ends = found.groupBy("_g", "_n").agg(
        *[at(F.floor(x) + F.lit(1)).alias(f"_lo{k}") for k, x in enumerate(pos)],
        *[at(F.ceil(x) + F.lit(1)).alias(f"_hi{k}") for k, x in enumerate(pos)])
    vals = [F.when(F.floor(x) == F.ceil(x), F.col(f"_lo{k}")).otherwise(
        F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (x - F.floor(x))) for k, x in enumerate(pos)]
    return ends.select("_g", F.array(*vals).alias("_q"))


def quantile_values_multi(df: DataFrame, cols: Sequence[str | Column], probs: Sequence[float]) -> Column:
    """Exact linear-interpolated quantiles of several columns in one pass.

    Returns a scalar-subquery ``map<int, array<double>>``: column index ->
    quantiles in ``probs`` order.  Same definition as ``percentile`` /
    ``quantile_cont`` / numpy 'linear'.  Only the columns asked for are read.
    Nulls and NaN are ignored; a column without values has no entry.
    """
    entries = [F.struct(F.lit(i).alias("_g"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_v"))
               for i, c in enumerate(cols)]
    narrow = df.select(F.inline(F.array(*entries))).where(_present(F.col("_v"), "double"))
    per = _selected(narrow, probs)
    return per.select(F.map_from_entries(F.collect_list(F.struct("_g", "_q")))).scalar()


def grouped_quantiles(df: DataFrame, col: str, by: Sequence[str], probs: Sequence[float],
                      out: str = "_q") -> DataFrame:
    """Exact quantiles of ``col`` per group: one row per group with ``out`` = array.

    Any number of groups; a hot group collapses to counts per cell before the
    shuffle.  Null keys and values are skipped.
    """
    by = list(by)
    x = F.col(col).cast("double")
    valid = _present(x, "double")
    for b in by:
        valid = valid & F.col(b).isNotNull()
    key = F.struct(*[F.col(b).alias(f"g{i}") for i, b in enumerate(by)])
    per = _selected(df.where(valid).select(key.alias("_g"), x.alias("_v")), probs)
    return per.select(*[F.col("_g")[f"g{i}"].alias(b) for i, b in enumerate(by)], F.col("_q").alias(out))


def quantile_values(df: DataFrame, col: str | Column, probs: Sequence[float]) -> Column:
    """Exact quantiles of one column as an ``array<double>`` (see ``quantile_values_multi``)."""
    return F.try_element_at(quantile_values_multi(df, [col], probs), F.lit(0))


def quantile_tiers(df: DataFrame, col: str, q: int | None = None,
                   probs: Sequence[float] | None = None, labels: Sequence[str] | None = None,
                   out: str = "tier") -> DataFrame:
    """``pandas.qcut(x, q, labels)`` on raw values.

    Bins are right-closed on the exact interpolated percentiles; the lowest
    bin includes the minimum.  Ties make the tiers unequal, as in pandas.
    """
    if probs is None:
        if not q:
            raise ValueError("give q or probs")
        probs = [i / q for i in range(1, q)]
    edges = F.col("_edges")
    x = F.col(col)
    idx = F.lit(1)
    for i in range(len(probs)):
        idx = idx + F.when(x > F.element_at(edges, i + 1), 1).otherwise(0)
    tier = F.when(x.isNotNull() & ~F.isnan(x), idx)
    if labels is not None:
        tier = F.element_at(F.array(*[F.lit(v) for v in labels]), tier)
    return (df.withColumn("_edges", quantile_values(df, col, probs))
            .withColumn(out, tier).drop("_edges"))


def label_top_share(df: DataFrame, col: str, pct: float, out: str = "label") -> DataFrame:
    """``(x >= np.percentile(x, pct)).astype(int)``."""
    thr = F.element_at(quantile_values(df, col, [pct / 100.0]), 1)
    return df.withColumn(out, F.when(F.col(col) >= thr, 1).otherwise(0))


def split_point_flags(df: DataFrame, order: Order, fraction: float, out: str = "is_test",
                      by: Sequence[str] = (), num_partitions: int | None = None,
                      lead: Column | None = None) -> DataFrame:
    """Flag the first ``ceil(fraction * n)`` rows in ``order`` (per ``by`` group).

    ``lead`` is an optional double that is monotone in ``order``'s first
    column (e.g. the leading hex digits of an md5 key); with it the boundary
    row is found by ``order_statistics`` (only a sliver sorted), otherwise
    by ranking every row of the narrow key.  Only the boundary key per
    group travels back (scalar subquery); rows are flagged by comparison.
    """
    by = list(by)
    cols = [c for c, _ in order]
    key = F.struct(*[F.col(b).alias(f"g{i}") for i, b in enumerate(by)]) if by else F.lit(0)
    if lead is not None and all(a for _, a in order):
        narrow = df.select(key.alias("_g"), lead.cast("double").alias("_v"), *cols)
        for b in by:  # map keys cannot be null; a null stratum is never flagged
            narrow = narrow.where(F.col("_g")[f"g{by.index(b)}"].isNotNull())
        bounds = order_statistics(narrow, cols, [lambda n: F.ceil(n.cast("double") * F.lit(float(fraction)))],
                                  num_partitions=num_partitions)
        bounds = bounds.select(F.col("_g").alias("_grp_key"), *cols)
    else:
        narrow = df.select(*by, *cols)
        rk = rank_rows(narrow, order, by=by, num_partitions=num_partitions)
        cut = F.ceil(F.col("_n").cast("double") * F.lit(float(fraction)))
        bounds = rk.where(F.col("_rank") == cut)
        for b in by:
            bounds = bounds.where(F.col(b).isNotNull())
        bounds = bounds.select(key.alias("_grp_key"), *cols)
    value = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(cols)])
    lookup = bounds.select(F.map_from_entries(F.collect_list(F.struct(F.col("_grp_key"), value)))).scalar()
    mine = F.col("_bound")
    after = comes_after([F.col(c) for c in cols], [mine[f"o{i}"] for i in range(len(cols))],
                        [a for _, a in order])
    return (df.withColumn("_bound", F.try_element_at(lookup, key))
            .withColumn(out, F.when(mine.isNull(), F.lit(False)).otherwise(~after))
            .drop("_bound"))


def prefix_sums(df: DataFrame, order: Order, cols: Sequence[str], suffix: str = "_cum",
                num_partitions: int | None = None) -> DataFrame:
    """Running sums of ``cols`` along ``order`` (inclusive), exact and distributed.

    Meant for frames with unique keys (e.g. one row per distinct score):
    rows are range-partitioned, summed within each range, and each range
    adds the total of all ranges before it (a k-row frame, broadcast).
    """
    ranged = _numbered(df, _sort_keys(order), num_partitions)
    running = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(running).alias(f"_loc_{c}") for c in cols])
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[
        F.coalesce(F.sum(f"_tot_{c}").over(prior), F.lit(0)).alias(f"_off_{c}") for c in cols])
    out = local.join(offsets, on="_pid", how="inner")
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_off_{c}") + F.col(f"_loc_{c}"))
    return out.drop("_pid", "_pos", *[f"_loc_{c}" for c in cols], *[f"_off_{c}" for c in cols])
