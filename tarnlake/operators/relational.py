"""Joins, windows and set operations that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import content_hash


def band(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first edge that the value lies below, the last label beyond; null stays null."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    case = F.when(col.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        case = case.when(col < edge, label)
    return case.otherwise(labels[-1])


def filter_valid(df: DataFrame, amount: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a positive amount and all keys."""
    return df.filter(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(amount) > 0))


def add_total_with_tax(df: DataFrame, amount: str, rate: float, out: str = "total_with_tax") -> DataFrame:
    return df.withColumn(out, F.round(F.col(amount) * (1 + rate), 2))


def typed(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Cast columns; text that doesn't fit the type becomes null instead of an error."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in spec.items()})


def hot_keys(df: DataFrame, key: str, share: float, tracked: int = 10_000) -> DataFrame:
    """Keys that hold at least this share of the rows, found in one pass with a sketch of bounded size.

    There are fewer than 1 / share of them. The sketch never counts too few, so none is missed; one that is
    a little below the share may be among them.
    """
    most = max(1, int(1 / share))
    if most > tracked:
        raise ValueError(f"a share of at least {1 / tracked} is needed")
    named = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top"), F.count("*").alias("n"))
    found = named.select(F.explode("top").alias("t"), "n").filter(F.col("t.count") >= F.col("n") * share)
    return found.select(F.col("t.item").alias(key))


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16, how: str = "inner", share: float = 0.01) -> DataFrame:
    """Equi-join that deals keys with at least this share of the rows of ``big`` to ``salts`` tasks.

    Fewer than 1 / share keys are hot, so they are held as literals, and the big side is read once more, for its
    key alone. Only the rows of ``small`` with such a key are repeated. The salt comes from a row's
    content, so that a task that runs again gives the same rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on this side")
    salt = fresh_names([*big.columns, *small.columns], "salt")[0]
    hot = [r[0] for r in hot_keys(big, key, share).collect()]  # fewer than 1 / share
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    dealt = big.withColumn(salt, F.when(is_hot, F.pmod(content_hash(big), F.lit(salts))).otherwise(F.lit(0).cast("long")))
    copies = small.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return dealt.join(copies, [key, salt], how).drop(salt)


def fresh_names(taken: Sequence[str], *stems: str) -> list[str]:
    """A column name for each stem that none of the taken ones has, in any case."""
    low, out = {c.lower() for c in taken}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def interval_join(left: DataFrame, right: DataFrame, key: str | None, lt: str, rt: str, lo: str, hi: str, how: str = "inner") -> DataFrame:
    """Rows of equal key with rt within [lt + lo, lt + hi]; ``lo`` and ``hi`` are interval texts.

    Time is cut into buckets as wide as the interval, and a right row stands in each bucket from which
    a left row can reach it, two or three, so that the equi-join is on the key and the bucket: a hot
    key meets only its own times, and without a key there is still one to join by.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left interval joins keep each left row once")
    epoch, micros = F.lit("1970-01-01").cast("timestamp"), lambda x: F.unix_micros(x.cast("timestamp"))
    low, high = F.expr(f"INTERVAL {lo}"), F.expr(f"INTERVAL {hi}")
    width = F.greatest(micros(epoch + high) - micros(epoch + low), F.lit(1_000_000))
    bucket = lambda x: F.floor(micros(x) / width)
    mine = left.withColumn("__bucket", bucket(F.col(lt)))
    reach = F.sequence(bucket(F.col(rt).cast("timestamp") - high) - 1, bucket(F.col(rt).cast("timestamp") - low) + 1)
    other = right.select(*([F.col(c).alias("__key") if c == key else F.col(c) for c in right.columns]), F.explode(reach).alias("__reach"))
    within = (F.col("__bucket") == F.col("__reach")) & (F.col(rt) >= F.col(lt) + low) & (F.col(rt) <= F.col(lt) + high)
    met = mine.join(other, within if key is None else (F.col(key) == F.col("__key")) & within, how)
    return met.drop("__key", "__bucket", "__reach")


def attribution(clicks: DataFrame, purchases: DataFrame, key: str, click_ts: str, purchase_ts: str, window: str) -> DataFrame:
    """Each click with the purchases within the window after it, and whether there was one."""
    met = interval_join(clicks, purchases, key, click_ts, purchase_ts, "0 SECONDS", window, how="left")
    return met.withColumn("converted", F.col(purchase_ts).isNotNull())


def as_of(history: DataFrame, at: Column, start: str = "__START_AT", end: str = "__END_AT") -> DataFrame:
    """The rows of a history that held at a time."""
    return history.filter((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def check_reference(fact: DataFrame, dim: DataFrame, key: str, flag: str = "missing_reference") -> DataFrame:
    """Flag rows whose key the dimension lacks; a null key is missing."""
    known = dim.select(F.col(key).alias("__known")).distinct()
    return fact.join(known, F.col(key) == F.col("__known"), "left").withColumn(flag, F.col("__known").isNull()).drop("__known")


def pivot(df: DataFrame, keys: Sequence[str], col: str, val: str, values: Sequence | None = None) -> DataFrame:
    """One column per value of ``col`` with the sum of ``val``; name the values to spare a pass."""
    return df.groupBy(*keys).pivot(col, list(values) if values else None).agg(F.sum(val))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def dedup_latest(df: DataFrame, keys: Sequence[str], order: str, tie_break: Sequence[str] = (), ties: bool = False) -> DataFrame:
    """The latest row of each key: a partial maximum, no sort. ``ties`` keeps all rows of the latest value; else
    ``tie_break``, and at last the content, decides, so that the result never depends on the row order.
    A row without a value in ``order`` comes before all others."""
    if ties:
        name = fresh_names(df.columns, "r")[0]
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        if keys:
            # the sorts read all partitions as they are: joined to a few, as adaptive execution does, they grow with the input
            df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        return df.withColumn(name, F.rank().over(w)).filter(F.col(name) == 1).drop(name)
    names = fresh_names(df.columns, *[f"k{i}" for i in range(len(keys))], "row")
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(order, *tie_break, content_hash(df)))
    by = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=False)]).agg(last.alias(names[-1]))
    return by.select(f"{names[-1]}.*")


def running_count(df: DataFrame, keys: Sequence[str], order: Column, out: str) -> DataFrame:
    """Rows of a key up to a row's place in the order, its peers included.

    The window runs over one row a key and place, so that a key with a large share of all rows isn't
    one task; null keys and places count like any other.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    placed = df.withColumn("__place", order)
    counted = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__place").alias("__at")).agg(F.count("*").alias("__n"))
    so_far = counted.withColumn(out, F.sum("__n").over(Window.partitionBy(*names).orderBy("__at"))).drop("__n")
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.col("__place").eqNullSafe(F.col("__at")))
    return placed.join(so_far, met).drop("__place", "__at", *names)


def cumprod(col: Column, w) -> Column:
    """Running product along the window's order."""
    return F.product(col).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def drawdown(equity: Column, w) -> Column:
    """Distance from the running maximum, as a share of it; at most 0."""
    peak = F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return equity / peak - 1


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each layer, one row a layer."""
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows") for name, df in layers.items()]
    return reduce(DataFrame.unionByName, counted)


def bucket_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.groupBy(F.pmod(F.col(col), F.lit(n)).alias("bucket")).agg(F.count("*").alias("n"))


def star_revenue(fact: DataFrame, dims: Sequence[tuple[DataFrame, Column]], keys: Sequence[str], measure: Column) -> DataFrame:
    """Join a fact to its dimensions, then sum a measure; Spark broadcasts what is small enough."""
    joined = reduce(lambda df, d: df.join(d[0], d[1]), dims, fact)
    return joined.groupBy(*keys).agg(F.round(F.sum(measure), 4).alias("revenue"))


def run_sql(spark: SparkSession, text: str, frames: Mapping[str, DataFrame] | None = None, **args) -> DataFrame:
    """A query with named parameters (``:name``), bound as literals and never spliced into the text, over frames
    (``{name}``), which leave no view in the session."""
    return spark.sql(text, args=args, **(frames or {}))


def skew(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys, the largest and the median row count, and their ratio."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    out = counts.agg(F.count("*").alias("n_keys"), F.max("n").alias("max_rows"), F.median("n").alias("median_rows"))
    return out.withColumn("ratio", F.round(F.col("max_rows") / F.col("median_rows"), 4))
