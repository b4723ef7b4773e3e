"""Running computations over ordered groups of any size.

``running`` carries values and sums; ``entries`` carries any small state.

A plain window puts a whole group into one task. Here a group is cut into chunks of
its order column: each chunk is scanned on its own, one row per chunk carries the
state across, and the two are combined. The result equals the plain window's, and no
task sees more than ``width`` order values of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrecon.stage import materialize

WIDTH = 1 << 18


def _chunked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / width).cast("bigint"))


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add running columns per ``keys``, ordered by the integer column ``order``.

    last    newest non-null value up to and including the row
    before  newest non-null value strictly before the row
    total   running sum up to and including the row
    """
    last, before, total = last or {}, before or {}, total or {}
    rows = _chunked(df, order, width)
    newest = {**last, **before}
    carried = rows.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"_end_{name}")
            for name, value in newest.items()
        ],
        *[F.sum(value).alias(f"_end_{name}") for name, value in total.items()],
    )
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *keys,
        "_chunk",
        *[F.last(f"_end_{name}", ignorenulls=True).over(past).alias(f"_in_{name}") for name in newest],
        *[F.coalesce(F.sum(f"_end_{name}").over(past), F.lit(0)).alias(f"_in_{name}") for name in total],
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.select(
        "*",
        *[F.last(value, ignorenulls=True).over(upto).alias(f"_at_{name}") for name, value in last.items()],
        *[F.last(value, ignorenulls=True).over(earlier).alias(f"_at_{name}") for name, value in before.items()],
        *[F.coalesce(F.sum(value).over(upto), F.lit(0)).alias(f"_at_{name}") for name, value in total.items()],
    )
    joined = scanned.join(carried, [*keys, "_chunk"])
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_at_{name}", f"_in_{name}").alias(name) for name in newest],
        *[(F.col(f"_at_{name}") + F.col(f"_in_{name}")).alias(name) for name in total],
    )


def ordinal(df: DataFrame, keys: list[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """1-based position of each row within its group."""
    return running(df, keys, order, total={name: F.lit(1)}, width=width)


def ranged(df: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """Rows in order over all tasks, each with ``_part``, the number of its stretch, computed once.

    Stretches are cut by the number of rows, whatever the values of ``order``: a long group
    spans several, short ones share one. Without ``parts`` their number follows the session.
    """
    by = [*keys, order]
    dealt = (df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    return materialize(dealt.withColumn("_part", F.spark_partition_id()))


def entries(
    rows: DataFrame,
    key: str,
    order: str,
    events: list[str],
    step: Callable[[tuple, tuple], tuple],
    start: tuple,
    possible: list[tuple],
    join: Callable[[tuple, tuple], tuple],
    finite: Callable[[tuple], tuple],
    schema: str,
) -> DataFrame:
    """_part, key and the state in which each stretch of a group begins, where that isn't ``start``.

    ``rows`` come from ``ranged``. ``step`` takes a state over one event (the values of the columns
    ``events``, rows where all are null left out). A group that begins within a stretch is followed
    from ``start``; the one that a stretch begins with may have begun before, so it is followed
    from every state in ``possible``. Stretches are then composed in order, one or two
    rows each: ``finite`` picks which of the possible ones a state is, and ``join`` puts the
    state in which a stretch ended, seen from there, behind the state in which it began.
    """
    told = rows.select("_part", key, order, *events)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For the first and the last group of each stretch: ends[k] is where possible[k] leads.
        part, group, first, ends = None, None, True, None
        out: list[tuple] = []
        for batch in batches:
            for p, g, _, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part or g != group:
                    if part is not None and (first or p != part):
                        out.append((part, group, first, repr(ends)))
                    first = p != part
                    part, group, ends = p, g, [*possible] if first else [start]
                if any(v is not None for v in event):
                    ends = [step(state, tuple(event)) for state in ends]
        if part is not None:
            out.append((part, group, first, repr(ends)))
        columns = zip(*out, strict=True) if out else [[]] * 4
        types = (pa.int32(), batch_type, pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_part", key, "first", "ends"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[key].dataType
    batch_type = to_arrow_type(kind)
    # A stretch is one partition of the stage as written and is read by one task, in order.
    cut = told.repartition("_part").sortWithinPartitions("_part", key, order)
    ends = cut.mapInArrow(summaries, f"_part int, `{key}` {kind.simpleString()}, first boolean, ends string")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        group, state, out = None, start, []
        for batch in batches:
            for p, g, first, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leads = ast.literal_eval(ends)
                if not first or g != group:
                    state = start
                elif state != start:
                    out.append((p, g, *state))
                state = join(state, leads[possible.index(finite(state))] if first else leads[0])
                group = g
        columns = zip(*out, strict=True) if out else [[]] * (2 + len(types))
        arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int32(), batch_type, *types], strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["_part", key, *names])

    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    # At most two rows a stretch, which only one task can put in a row.
    in_order = ends.repartition(1).sortWithinPartitions("_part", F.col("first").desc())
    return in_order.mapInArrow(compose, f"_part int, `{key}` {kind.simpleString()}, {schema}")
