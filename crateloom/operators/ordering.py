"""Ordered work without one task per key.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task.  These
helpers keep the exact result while splitting long series:

* :func:`index_rows` numbers rows per key; a key with many rows is cut at quantiles of its order into
  parts that are numbered apart;
* :func:`halo_window` evaluates bounded frames per fixed-size chunk of that numbering, copying
  only the few border rows neighbouring chunks need;
* :func:`carry_last` and :func:`running_sum` combine per-chunk results with a prefix over the
  (thousands of times smaller) chunk summaries.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from crateloom.session import by_key, cut

CHUNK = 16384
#: More rows than these are numbered in the shuffle's own number of parts.
MANY = 1 << 20
#: A key with this share of all rows is always cut; cuts are looked up in stretches of this many.
PARTS, STRETCH = 32768, 64


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               idx: str = "idx", total: str | None = None, limit: int = CHUNK, at_most: DataFrame | None = None) -> DataFrame:
    """Add the 0-based position of each row inside its key (and optionally the key's size).

    ``keys + order`` must identify a row, otherwise equal rows are numbered arbitrarily; ``order``
    ascends, nulls first.  A key of at most ``limit`` rows (and at least a 32,768th of all) is numbered
    by one window.  A larger one is cut at quantiles of a sample of its order: each row finds its
    part, the parts are counted, and a row's number is the sum of the parts before plus its number
    in its part.  The rows themselves are shuffled once and nothing is written.

    ``at_most`` is a table with at least as many rows of each key (or of the keys that it has) that is cheaper to
    count; where it shows that all keys are small, ``df`` is not counted.
    """
    keys, order = list(keys), [F.col(c) if isinstance(c, str) else c for c in order]
    rows, limit, large = _counted(df, keys, limit, at_most)
    if large is None:
        w = Window.partitionBy(*keys)
        out = _dealt(df, rows, *keys).withColumn(idx, (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
        return out.withColumn(total, F.count("*").over(w)) if total else out
    facts = _cuts(df, keys, order, large, limit)
    placed = _dealt(_in_parts(df, keys, order, facts), rows, *keys, "_ix_part")
    w = Window.partitionBy(*keys, "_ix_part")
    out = placed.withColumn(idx, (F.coalesce(F.get("_ix_before", F.col("_ix_part")), F.lit(0)) + F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
    if total:
        out = out.withColumn(total, F.coalesce(F.col("_ix_rows"), F.count("*").over(w)).cast("long"))
    return out.drop("_ix_part", "_ix_before", "_ix_rows")


def _dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df``, which has about ``rows`` rows, by ``cols``: narrow rows pack so well that few tasks would be left to sort millions of them."""
    return by_key(df, *cols) if rows > MANY and cols else df


def _counted(df: DataFrame, keys: list[str], limit: int, at_most: DataFrame | None) -> tuple[int, int, DataFrame | None]:
    """As :func:`_large_keys`; ``df`` is not counted where ``at_most`` shows that all its keys are small."""
    if at_most is not None:
        rows, limit_there, large = _large_keys(at_most, [k for k in keys if k in at_most.columns], limit)
        if large is None:
            return rows, limit_there, None
    return _large_keys(df, keys, limit)


def _large_keys(df: DataFrame, keys: list[str], limit: int) -> tuple[int, int, DataFrame | None]:
    """All rows, the rows a key may have to be numbered by one window, and the keys with more (None if there are none)."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_ix_rows"))
    rows, most = sizes.agg(F.sum("_ix_rows"), F.max("_ix_rows")).first()
    limit = max(limit, (rows or 0) // PARTS)
    return rows or 0, limit, None if (most or 0) <= limit else sizes.filter(F.col("_ix_rows") > limit)


def _cuts(df: DataFrame, keys: list[str], order: list[Column], large: DataFrame, limit: int) -> DataFrame:
    """A row per large key: its size, its cuts in stretches of ``STRETCH``, and the rows before each part.

    There are at most ``PARTS`` large keys with 4 * ``PARTS`` parts in all, so this table is sent to the
    tasks whatever the size of ``df``.
    """
    spark, names = df.sparkSession, [f"_ix_k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names)]
    big = large.select(*own, "_ix_rows", F.ceil(F.col("_ix_rows") * 2 / limit).alias("_ix_parts"))
    big = F.broadcast(spark.createDataFrame(big.collect(), big.schema))
    step = F.greatest(F.lit(1), F.expr("_ix_rows div (_ix_parts * 16)"))                    # about 16 sampled rows a part
    point = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.select(*own, point.alias("_ix_o"))
    seen = _meet(rows, big, names).filter(F.pmod(F.xxhash64("_ix_o"), step) == 0)
    cuts = seen.groupBy(*names, "_ix_rows", "_ix_parts").agg(F.array_sort(F.collect_set("_ix_o")).alias("_ix_s"))
    cuts = cuts.select(*names, "_ix_rows", F.expr("filter(_ix_s, (x, i) -> i > 0 and i % greatest(1, size(_ix_s) div cast(_ix_parts as int)) = 0)").alias("_ix_s"))
    cuts = cuts.select(*names, "_ix_rows", F.expr(f"transform(sequence(0, size(_ix_s) div {STRETCH}), b -> slice(_ix_s, b * {STRETCH} + 1, {STRETCH}))").alias("_ix_cuts"))
    table = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))
    counts = _meet(rows, table, names).groupBy(*names, _part("_ix_o").alias("_ix_part")).agg(F.count("*").alias("_ix_n"))
    counts = counts.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_ix_part", "_ix_n"))).alias("_ix_m"))
    before = F.expr("transform(sequence(0, cast(array_max(map_keys(_ix_m)) as int)), p -> aggregate(map_keys(_ix_m), 0L, (a, q) -> a + if(q < p, _ix_m[q], 0L)))")
    facts = _meet(counts, table, names).select(*names, "_ix_rows", "_ix_cuts", before.alias("_ix_before"))
    return spark.createDataFrame(facts.collect(), facts.schema)


def _meet(rows: DataFrame, table: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join by the columns ``names`` of both, nulls equal."""
    if not names:
        return rows.crossJoin(table)                                                  # one row: the whole table is the key
    right = table.select(*[F.col(n).alias(f"{n}_") for n in names], *[c for c in table.columns if c not in names])
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return rows.join(right, cond, how).drop(*[f"{n}_" for n in names])


def _part(point: str) -> Column:
    """The number of cuts at or before a point: the stretch by its first cuts, the place in it by the others."""
    stretch = f"greatest(size(filter(_ix_cuts, (s, i) -> i > 0 and size(s) > 0 and s[0] <= {point})), 0)"
    return F.expr(f"cast({stretch} * {STRETCH} + size(filter(_ix_cuts[{stretch}], c -> c <= {point})) as int)")


def _in_parts(df: DataFrame, keys: list[str], order: list[Column], facts: DataFrame) -> DataFrame:
    """``df`` with the part of each row (0 for small keys), its key's rows and the rows before each part."""
    names = [f"_ix_k{i}" for i in range(len(keys))]
    work = df.withColumns({n: F.col(k) for k, n in zip(keys, names)} | {"_ix_o": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])})
    work = _meet(work, F.broadcast(facts), names, "left")
    return work.withColumn("_ix_part", F.when(F.col("_ix_cuts").isNull(), 0).otherwise(_part("_ix_o"))).drop("_ix_cuts", "_ix_o", *names)


def halo_window(df: DataFrame, keys: Sequence[str], idx: str, before: int, after: int,
                *stages: Callable[[WindowSpec], dict[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """Add windowed columns whose frames reach at most ``before``/``after`` rows.

    Each stage gets a window over ``keys`` ordered by ``idx`` and returns columns; later stages
    see earlier ones, so ``before``/``after`` must cover the sum of their reaches.  The first and
    last row of a series are always the first/last row of the chunk of any row whose frame
    would cross them, so ``first``/``last`` over the whole window serve as edge values.
    """
    if before > chunk or after > chunk:
        raise ValueError("frame longer than a chunk")
    home = F.floor(F.col(idx) / chunk)
    offset = F.pmod(F.col(idx), F.lit(chunk))
    targets = F.array(
        home,
        F.when(offset >= chunk - before, home + 1) if before else F.lit(None).cast("long"),
        F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"))
    cols = df.columns
    work = (df.withColumn("_home", home)
            .withColumn("_chunk", F.explode(F.filter(targets, lambda c: c.isNotNull()))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    for stage in stages:
        work = work.withColumns(stage(w))
        cols = cols + [c for c in work.columns if c not in cols and c not in ("_home", "_chunk")]
    return work.filter(F.col("_chunk") == F.col("_home")).select(*cols)


def _chunked(df: DataFrame, idx: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(idx) / chunk))


def carry_last(df: DataFrame, keys: Sequence[str], idx: str, event: str, out: str,
               inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Latest non-null ``event`` at or before each row (or strictly before it)."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    upto = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    work = _chunked(df, idx, chunk)
    local = work.withColumn("_local", F.last(event, ignorenulls=True).over(upto))
    ends = (work.filter(F.col(event).isNotNull()).groupBy(*keys, "_chunk")
            .agg(F.max_by(event, idx).alias("_end")))
    chunks = work.select(*keys, "_chunk").distinct().join(ends, [*keys, "_chunk"], "left")
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(prior).alias("_carry"))
    return (local.join(carry, [*keys, "_chunk"], "left")
            .withColumn(out, F.coalesce("_local", "_carry"))
            .select(*[c for c in df.columns if c != out], out))


def along(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str] | None = None,
          lasts: dict[str, str] | None = None, limit: int = CHUNK) -> DataFrame:
    """Running totals (output -> value column) and latest non-null values (output -> column) up to each row.

    As :func:`index_rows`, small keys take one window; the parts of a large key are summed apart and what
    the parts before them leave is added.
    """
    keys, order = list(keys), [F.col(c) if isinstance(c, str) else c for c in order]
    sums, lasts = sums or {}, lasts or {}
    rows, limit, large = _large_keys(df, keys, limit)
    if large is None:
        df = _dealt(df, rows, *keys)
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: F.sum(c).over(upto) for o, c in sums.items()} | {o: F.last(c, ignorenulls=True).over(upto) for o, c in lasts.items()})
    facts = _cuts(df, keys, order, large, limit)
    placed = _dealt(_in_parts(df, keys, order, facts).drop("_ix_before", "_ix_rows"), rows, *keys, "_ix_part")
    upto = Window.partitionBy(*keys, "_ix_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({o: F.sum(c).over(upto) for o, c in sums.items()} | {o: F.last(c, ignorenulls=True).over(upto) for o, c in lasts.items()})
    # what each part leaves: a row a part, so small that one window a key takes them
    point = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    left = placed.groupBy(*keys, "_ix_part").agg(*[F.sum(c).alias(f"_ix_s{i}") for i, c in enumerate(sums.values())],
                                              *[F.max_by(c, F.when(F.col(c).isNotNull(), point)).alias(f"_ix_l{i}") for i, c in enumerate(lasts.values())])
    prior = Window.partitionBy(*keys).orderBy("_ix_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_ix_k{i}" for i in range(len(keys))]
    carry = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_ix_part").alias(f"_ix_k{len(keys)}"),
                        *[F.sum(f"_ix_s{i}").over(prior).alias(f"_ix_s{i}") for i in range(len(sums))],
                        *[F.last(f"_ix_l{i}", ignorenulls=True).over(prior).alias(f"_ix_l{i}") for i in range(len(lasts))])
    marked = out.withColumns({n: F.col(k) for k, n in zip([*keys, "_ix_part"], [*names, f"_ix_k{len(keys)}"])})
    out = _meet(marked, carry, [*names, f"_ix_k{len(keys)}"], "left")
    out = out.withColumns({o: F.when(F.col(f"_ix_s{i}").isNull(), F.col(o)).otherwise(F.col(f"_ix_s{i}") + F.coalesce(o, F.lit(0))) for i, o in enumerate(sums)}
                          | {o: F.coalesce(o, f"_ix_l{i}") for i, o in enumerate(lasts)})
    return out.select(*df.columns, *sums, *lasts)


def running_sum(df: DataFrame, keys: Sequence[str], idx: str, value: str, out: str,
                chunk: int = CHUNK) -> DataFrame:
    """Inclusive running total of ``value`` along ``idx``."""
    keys = list(keys)
    work = _chunked(df, idx, chunk)
    upto = (Window.partitionBy(*keys, "_chunk").orderBy(idx)
            .rowsBetween(Window.unboundedPreceding, 0))
    local = work.withColumn("_local", F.sum(value).over(upto))
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (work.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
            .select(*keys, "_chunk", F.sum("_sum").over(prior).alias("_base")))
    return (local.join(base, [*keys, "_chunk"], "left")
            .withColumn(out, F.coalesce("_base", F.lit(0)) + F.coalesce("_local", F.lit(0)))
            .select(*[c for c in df.columns if c != out], out))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      quantiles: dict[str, float], at_most: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated percentiles per key from the global order, one row per key.

    Unlike the built-in ``percentile`` aggregate no task has to hold all values of a key.  Where a key is large, equal
    values are counted first and places come from running totals of the counts, so that a frequent value is one row.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    size, _, large = _counted(rows, keys, CHUNK, at_most)
    if large is None:
        return _placed(_small_places(rows, keys, value, size), keys, value, quantiles)
    spark, names = df.sparkSession, [f"_ix_k{i}" for i in range(len(keys))]
    big = large.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_ix_rows").alias("_ix_all"))
    big = F.broadcast(spark.createDataFrame(big.collect(), big.schema))
    rows = _meet(rows.withColumns({n: F.col(k) for k, n in zip(keys, names)}), big, names, "left").drop(*names)
    counts = cut(rows.filter("_ix_all IS NOT NULL").groupBy(*keys, value, "_ix_all").agg(F.count("*").alias("_ix_c")))
    many = _placed(along(counts, keys, [value], {"_ix_to": "_ix_c"}), keys, value, quantiles)
    if not keys:
        return many
    few = _small_places(rows.filter("_ix_all IS NULL").drop("_ix_all"), keys, value, size)
    return many.unionByName(_placed(few, keys, value, quantiles))


def _small_places(rows: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """``rows``, about ``size`` in all, with their number from 1 inside their key and the key's size, by one window a key."""
    w = Window.partitionBy(*keys)
    return _dealt(rows, size, *keys).withColumns({"_ix_to": F.row_number().over(w.orderBy(value)).cast("long"), "_ix_all": F.count("*").over(w), "_ix_c": F.lit(1)})


def _placed(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles of rows that stand for ``_ix_c`` equal values each, the last of which is number ``_ix_to`` of ``_ix_all``."""
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("_ix_all") - 1)
        lo, frac = F.floor(pos), pos - F.floor(pos)

        def at(place: Column) -> Column:
            return F.max(F.when((F.col("_ix_to") > place) & (F.col("_ix_to") - F.col("_ix_c") <= place), F.col(value)))
        low, high = at(lo), at(F.least(lo + 1, F.col("_ix_all") - 1))
        aggs.append((low + (high - low) * F.max(frac)).alias(name))
    return rows.groupBy(*keys).agg(*aggs)
