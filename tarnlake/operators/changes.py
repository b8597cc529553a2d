"""Table changes as DataFrame functions: (target, source) -> new target, on any file format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cdc
from .hashing import content_hash

START, END = "__START_AT", "__END_AT"


class AmbiguousMerge(ValueError):
    """More than one source row matches a target row."""


def _expr(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def update(df: DataFrame, cond: Column | str, values: Mapping[str, Column | str]) -> DataFrame:
    """UPDATE ... SET ... WHERE; all right sides see the old row."""
    hit = F.coalesce(_expr(cond), F.lit(False))
    return df.select(*[F.when(hit, _expr(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, cond: Column | str) -> DataFrame:
    """DELETE WHERE: a null condition keeps the row."""
    return df.filter(~F.coalesce(_expr(cond), F.lit(False)))


def purge(df: DataFrame, col: str, cutoff: Column) -> DataFrame:
    """Drop rows older than the cutoff."""
    return delete(df, F.col(col) < cutoff)


def merge(
    target: DataFrame,
    source: DataFrame,
    on: Sequence[str],
    *,
    update: Mapping[str, Column | str] | None = None,
    update_if: Column | str | None = None,
    delete_if: Column | str | None = None,
    insert: bool = True,
    delete_missing: bool = False,
    check: bool = True,
) -> DataFrame:
    """MERGE as a full outer join, columns of the target.

    Conditions and update expressions refer to ``t.column`` and ``s.column``. By default a match takes
    all source columns that the target has. ``delete_if`` removes matched rows and keeps unmatched
    source rows for which it is true out; ``delete_missing`` removes rows that the source lacks.
    Null keys match nothing, as in SQL. A source with several rows of one key raises unless
    ``check`` is off, which is for sources that are already unique.
    """
    if check and not source.dropna(subset=list(on)).groupBy(*on).count().filter("count > 1").isEmpty():
        raise AmbiguousMerge(f"the source has several rows for one of {list(on)}")
    # null keys match nothing: they stay out of the join, where they would be one task
    whole = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in on])
    loose = [] if delete_missing else [target.filter(~whole)]
    if insert:
        extra = source.filter(~whole).alias("s")
        if delete_if is not None:
            # conditions may name the target's columns, which are null here
            extra = extra.join(target.limit(0).alias("t"), F.lit(False), "left").filter(~F.coalesce(_expr(delete_if), F.lit(False)))
        loose.append(extra.select(*[(F.col(f"s.{c}") if c in source.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns]))
    target, source = target.filter(whole), source.filter(whole)
    shared = [c for c in target.columns if c in source.columns and c not in on]
    values = {c: F.col(f"s.{c}") for c in shared} if update is None else {c: _expr(e) for c, e in update.items()}
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    joined = t.join(s, reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]), "full")
    matched, only_source = F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull(), F.col("t.__t").isNull()
    true = F.lit(True)
    gone = F.coalesce(_expr(delete_if), F.lit(False)) if delete_if is not None else F.lit(False)
    change = matched & (F.coalesce(_expr(update_if), F.lit(False)) if update_if is not None else true)
    keep = F.when(matched, ~gone).when(only_source, F.lit(insert) & ~gone).otherwise(F.lit(not delete_missing))

    def column(c: str) -> Column:
        fresh = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        return F.when(only_source, fresh).when(change, values[c] if c in values else F.col(f"t.{c}")).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c)

    return reduce(DataFrame.unionByName, loose, joined.filter(keep).select(*[column(c) for c in target.columns]))


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the source rows whose key the target lacks, one for each key."""
    fresh = source.join(target.select(*keys).distinct(), list(keys), "left_anti")
    w = Window.partitionBy(*keys).orderBy(content_hash(source))
    one = fresh.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return target.unionByName(one.select(*target.columns))


def _latest(events: DataFrame, keys: Sequence[str], sequence_by: Sequence[str]) -> DataFrame:
    """The event of the highest sequence of each key; a partial maximum, no sort.

    Of equal sequences the content decides, so that the result never depends on the row order.
    """
    row = F.max_by(F.struct(*events.columns), F.struct(*sequence_by, content_hash(events))).alias("__row")
    return events.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(row).select("__row.*")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join on keys in which null equals null."""
    other = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return left.join(other, [left[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)], how)


def apply_changes(
    events: DataFrame,
    keys: Sequence[str],
    sequence_by: Sequence[str],
    *,
    deletes: Column | str | None = None,
    truncates: Column | str | None = None,
    columns: Sequence[str] | None = None,
    except_columns: Sequence[str] = (),
    ignore_nulls: bool = False,
    state: DataFrame | None = None,
) -> DataFrame:
    """Current rows after all events (SCD type 1): only the event of the highest sequence decides.

    ``state`` is what ``cdc.fold_changes`` gave for earlier events; it alone remembers deletes and truncates, so
    rows of an earlier result can't stand for it.
    """
    folded = cdc.fold_changes(events, keys, sequence_by, deletes=deletes, truncates=truncates, ignore_nulls=ignore_nulls, state=state)
    # in the order of the events' columns
    return cdc.current_rows(folded, keys, columns or events.columns, except_columns)


def scd2(
    events: DataFrame,
    keys: Sequence[str],
    sequence_by: str,
    *,
    deletes: Column | str | None = None,
    tie_break: Sequence[str] = (),
    track: Sequence[str] | None = None,
    track_except: Sequence[str] = (),
    except_columns: Sequence[str] = (),
) -> DataFrame:
    """History of all versions (SCD type 2), from events in any order.

    A version starts at its event's sequence and ends at the next one's, or is open. A delete closes
    the version before it and adds none. With ``track`` or ``track_except`` only changes of those
    columns start a version; other columns show their last value within it. Of events with the same
    sequence the last by ``tie_break`` holds.
    """
    gone = F.coalesce(_expr(deletes), F.lit(False)) if deletes is not None else F.lit(False)
    rows = events.withColumn("__gone", gone)
    rows = _latest(rows, [*keys, sequence_by], [*tie_break, "__gone"] if tie_break else ["__gone"])
    payload = [c for c in events.columns if c not in {*keys, sequence_by, *except_columns}]
    by_key = Window.partitionBy(*keys).orderBy(sequence_by)
    if track is not None or track_except:
        tracked = [c for c in (track or payload) if c not in track_except]
        mark = F.struct("__gone", *tracked)
        rows = rows.withColumn("__mark", mark).withColumn("__new", ~F.col("__mark").eqNullSafe(F.lag("__mark").over(by_key)))
        rows = rows.withColumn("__run", F.sum(F.col("__new").cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        last = F.max_by(F.struct(*payload), F.col(sequence_by)).alias("__last")
        rows = rows.groupBy(*keys, "__run", "__gone").agg(F.min(sequence_by).alias(sequence_by), last).select(*keys, sequence_by, "__gone", "__last.*")
    made = rows.withColumn(START, F.col(sequence_by)).withColumn(END, F.lead(sequence_by).over(by_key))
    return made.filter(~F.col("__gone")).select(*keys, *payload, START, END)


def scd2_merge(history: DataFrame, batch: DataFrame, keys: Sequence[str], sequence_by: str, *, deletes: Column | str | None = None) -> DataFrame:
    """Bring a batch of events, newer than the open versions, into a history.

    Keys that the batch lacks pass through. An event equal to the open version changes nothing. A null
    key is a key like any other.
    """
    payload = [c for c in history.columns if c not in {*keys, START, END}]
    touched = batch.select(*keys).distinct()
    same, old = same_keys(history, touched, keys, "left_anti"), same_keys(history, touched, keys, "left_semi")
    closed = old.filter(F.col(END).isNotNull())
    gone = F.coalesce(_expr(deletes), F.lit(False)) if deletes is not None else F.lit(False)
    open_ = old.filter(F.col(END).isNull()).select(*keys, *payload, F.col(START).alias(sequence_by), F.lit(False).alias("__delete"))
    fresh = batch.select(*keys, *payload, sequence_by, gone.alias("__delete"))
    events = open_.unionByName(fresh)
    again = scd2(events, keys, sequence_by, deletes="__delete", track=payload, except_columns=["__delete"])
    return same.unionByName(closed).unionByName(again.select(*history.columns))


def current(history: DataFrame) -> DataFrame:
    return history.filter(F.col(END).isNull())


def with_is_current(history: DataFrame) -> DataFrame:
    return history.withColumn("is_current", F.col(END).isNull())


def change_frequency(history: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """Keys with at least ``least`` versions: how many, the first and the last start."""
    by = history.groupBy(*keys).agg(F.count("*").alias("n_versions"), F.min(START).alias("first_change"), F.max(START).alias("last_change"))
    return by.filter(F.col("n_versions") >= least)


def deleted(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose last version is closed, with the time it was."""
    by = history.groupBy(*keys).agg(F.max_by(F.struct(END), F.col(START)).alias("__last"))
    return by.select(*keys, F.col("__last")[END].alias("deleted_at")).filter(F.col("deleted_at").isNotNull())


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """What turns the old state into the new one, row by row, with pre- and post-images of updates."""
    cols = old.columns
    a = old.select(F.struct(*cols).alias("o"), *[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)])
    b = new.select(F.struct(*cols).alias("n"), *[F.col(k).alias(f"__n{i}") for i, k in enumerate(keys)])
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(f"__o{i}").eqNullSafe(F.col(f"__n{i}")) for i in range(len(keys))]), "full")
    row = lambda kind, side: F.struct(F.lit(kind).alias("_change_type"), F.col(side).alias("r"))
    images = (
        F.when(F.col("o").isNull(), F.array(row("insert", "n")))
        .when(F.col("n").isNull(), F.array(row("delete", "o")))
        .when(~F.col("o").eqNullSafe(F.col("n")), F.array(row("update_preimage", "o"), row("update_postimage", "n")))
    )
    out = met.select(F.explode(images).alias("c"))
    return out.select("c.r.*", F.col("c._change_type").alias("_change_type"), F.lit(version).cast("long").alias("_commit_version"))


def apply_feed(target: DataFrame, feed: DataFrame, keys: Sequence[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Bring the changes of a range of versions into a table; of a key's changes the latest decides.

    Null keys equal each other, as they do in ``change_feed``.
    """
    part = feed.filter(F.col("_change_type") != "update_preimage")
    part = part if lo is None else part.filter(F.col("_commit_version") >= lo)
    part = part if hi is None else part.filter(F.col("_commit_version") <= hi)
    last = _latest(part.withColumn("__rank", (F.col("_change_type") != "delete").cast("int")), keys, ["_commit_version", "__rank"])
    rest = same_keys(target, last, keys, "left_anti")
    return rest.unionByName(last.filter("_change_type <> 'delete'").select(*target.columns))


def state_at(events: DataFrame, keys: Sequence[str], sequence_by: Sequence[str], at: Column, **options) -> DataFrame:
    """The current rows as they were at a point of the sequence."""
    return apply_changes(events.filter(F.col(sequence_by[0]) <= at), keys, sequence_by, **options)


def append_merge_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append; columns that one side lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def alter(df: DataFrame, add: Mapping[str, str] | None = None, rename: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Add (null for old rows), rename and drop columns."""
    out = df.withColumns({c: F.lit(None).cast(kind) for c, kind in (add or {}).items()}) if add else df
    return out.withColumnsRenamed(dict(rename or {})).drop(*drop)
