"""Ordered work on any amount of rows: positions, running sums, ranks, carried values, row blocks.

A window over a whole table (or over one hot key) is a single task. Here the order is cut into chunks at keys taken
from a sample, whole keys of all order columns and any sortable type. Each chunk gets its own window, and chunk totals, of which there are
few, carry the running state across. Cut points only balance the load; results do not depend on them.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyfold.plans.scale import DEFAULT, Scale

CHUNK = "_chunk"
POSITION = "_position"
BLOCK = "_block"
HALO = "_halo"
#: Keys looked at per chunk.
SAMPLED = 20
_SLOTS = 1 << 30


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
    return condition


def attach(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with one fact row per key, where null keys are keys too.

    A key may hold a large share of the rows: they meet a single row each, and adaptive execution splits a partition of
    such an inner join among tasks."""
    renamed = facts.select(
        *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in facts.columns if c not in keys],
    )
    condition = null_safe(rows, renamed, [(k, f"_k{i}") for i, k in enumerate(keys)])
    return rows.join(renamed, condition, "inner").drop(*[f"_k{i}" for i in range(len(keys))])


def with_chunk(df: DataFrame, order_by: list[str], rows: int, scale: Scale = DEFAULT) -> DataFrame:
    """Adds ``_chunk``: non-decreasing in the order, balanced in rows. Few rows are one chunk.

    Rows whose keys agree in all order columns lie in one chunk; any other difference, also far behind in a text, can be cut at."""
    parts = scale.chunks(rows)
    if parts == 1:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order_by)])
    cuts, kind = _cuts(df, key, parts, rows)
    return df.withColumn(CHUNK, _cuts_up_to(key, cuts, kind))


def _cuts(df: DataFrame, key: Column, parts: int, rows: int) -> tuple[list, str]:
    """Keys that cut the order into about ``parts`` even chunks, from the keys with the least hashes, and their type. At most about ``SAMPLED`` keys per chunk are
    looked at, whatever the data."""
    keys = df.select(key.alias("key"))
    share = min(1.0, SAMPLED * parts / max(rows, 1))
    some = keys.filter(F.pmod(F.xxhash64("key"), F.lit(_SLOTS)) < int(np.ceil(share * _SLOTS)))
    text = some.agg(F.to_json(F.sort_array(F.collect_set("key"))).alias("keys")).first()["keys"]
    found = json.loads(text) if text else []
    places = sorted({i * len(found) // parts for i in range(1, parts)}) if found else []
    return [found[i] for i in places], keys.schema["key"].dataType.simpleString()


def _cuts_up_to(key: Column, cuts: list, kind: str) -> Column:
    """How many of the cuts are not above the key, by binary search. Cuts are sorted again once they have their own types, so that
    the number never falls along the order."""
    listed = F.sort_array(F.from_json(F.lit(json.dumps(cuts)), f"array<{kind}>"))
    state = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def halved(x: Column, _: Column) -> Column:
        middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
        right = F.get(listed, middle) <= key
        return F.when(x["low"] >= x["high"], x).when(right, state(middle + 1, x["high"])).otherwise(state(x["low"], middle))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))
    return F.aggregate(steps, state(F.lit(0), F.lit(len(cuts))), halved, lambda x: x["low"].cast("long"))


def _order(order_by: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() for c in order_by]


def running_sum(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    weight: Column,
    rows: int,
    output: str,
    scale: Scale = DEFAULT,
) -> DataFrame:
    """Adds the sum of ``weight`` over the earlier rows of the same key, the row itself left out."""
    return running_sums(df, keys, order_by, {output: weight}, rows, scale)


def running_sums(
    df: DataFrame, keys: list[str], order_by: list[str], weights: dict[str, Column], rows: int, scale: Scale = DEFAULT
) -> DataFrame:
    """``running_sum`` of several weights, by output name, in one pass over the order."""
    outputs = list(weights)
    weighted = df.withColumns({f"_rs_w{i}": w for i, w in enumerate(weights.values())})
    chunked = with_chunk(weighted, order_by, rows, scale)
    inside = (
        Window.partitionBy(*[F.col(f"`{k}`") for k in keys], CHUNK)
        .orderBy(*_order(order_by))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = [F.coalesce(F.sum(f"_rs_w{i}").over(inside), F.lit(0)) for i in range(len(outputs))]
    scratch = [CHUNK, *[f"{p}{i}" for i in range(len(outputs)) for p in ("_rs_w", "_rs_before", "_rs_local")]]
    if scale.chunks(rows) == 1:  # no earlier chunk to add
        return chunked.withColumns(dict(zip(outputs, local))).drop(*scratch)
    totals = chunked.groupBy(*[F.col(f"`{k}`") for k in keys], CHUNK).agg(
        *[F.sum(f"_rs_w{i}").alias(f"_rs_t{i}") for i in range(len(outputs))]
    )
    across = (
        Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = [F.coalesce(F.sum(f"_rs_t{i}").over(across), F.lit(0)).alias(f"_rs_before{i}") for i in range(len(outputs))]
    offsets = totals.select(*[F.col(f"`{k}`") for k in keys], CHUNK, *before)
    joined = attach(chunked.withColumns({f"_rs_local{i}": x for i, x in enumerate(local)}), offsets, [*keys, CHUNK])
    return joined.withColumns({o: F.col(f"_rs_before{i}") + F.col(f"_rs_local{i}") for i, o in enumerate(outputs)}).drop(*scratch)


def with_position(
    df: DataFrame, order_by: list[str], rows: int, partition_by: list[str] | None = None, scale: Scale = DEFAULT
) -> DataFrame:
    """Adds ``_position``: 0-based row number in the given order, per partition key."""
    return running_sum(df, partition_by or [], order_by, F.lit(1).cast("long"), rows, POSITION, scale)


def average_ranks(freq: DataFrame, keys: list[str], rows: int, scale: Scale = DEFAULT) -> DataFrame:
    """Average ranks (ties share the mean) from a value/count table ``(keys, value, n)``.

    Equal values are already one row, so neither a hot value nor the raw rows are sorted.
    """
    summed = running_sum(freq, keys, ["value"], F.col("n"), rows, "_below", scale)
    return summed.withColumn("avg_rank", F.col("_below") + (F.col("n") + 1) / F.lit(2.0)).drop("_below")


def carried(
    df: DataFrame,
    forward: dict[str, Column],
    order_by: list[str],
    rows: int,
    partition_by: list[str] | None = None,
    scale: Scale = DEFAULT,
    backward: dict[str, Column] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Adds, per entry of ``forward``, the last non-null value at or before the row, and per entry of
    ``backward`` the next one at or after it, per partition key, in one pass over the order.
    ``include_current=False`` leaves the row itself out."""
    keys = [F.col(f"`{k}`") for k in (partition_by or [])]
    wanted = [(n, e, True) for n, e in forward.items()] + [(n, e, False) for n, e in (backward or {}).items()]
    prepared = df.withColumns({f"_v_{name}": expr for name, expr, _ in wanted})
    chunked = with_chunk(prepared, order_by, rows, scale)
    edge = 0 if include_current else 1
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*_order(order_by))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -edge)
    later = inside.rowsBetween(edge, Window.unboundedFollowing)

    def nearest(source: str, ahead: bool, before: WindowSpec, after: WindowSpec) -> Column:
        return F.last(source, True).over(before) if ahead else F.first(source, True).over(after)

    local = chunked.withColumns({f"_l_{n}": nearest(f"_v_{n}", ahead, earlier, later) for n, _, ahead in wanted})
    scratch = [CHUNK, *[f"{p}{n}" for n, _, _ in wanted for p in ("_v_", "_l_", "_c_")]]
    if scale.chunks(rows) == 1:  # no other chunk hands anything on
        return local.withColumns({n: F.col(f"_l_{n}") for n, _, _ in wanted}).drop(*scratch)
    # Per key and chunk, the values it hands on: its last non-null ones in order, or its first.
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    handed = chunked.groupBy(*keys, CHUNK).agg(
        *[
            (F.max_by if ahead else F.min_by)(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), order)).alias(f"_e_{n}")
            for n, _, ahead in wanted
        ]
    )
    chain = Window.partitionBy(*keys).orderBy(CHUNK)
    past = chain.rowsBetween(Window.unboundedPreceding, -1)
    coming = chain.rowsBetween(1, Window.unboundedFollowing)
    entering = handed.select(
        *keys, CHUNK, *[nearest(f"_e_{n}", ahead, past, coming).alias(f"_c_{n}") for n, _, ahead in wanted]
    )
    joined = attach(local, entering, [*(partition_by or []), CHUNK])
    return joined.withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n, _, _ in wanted}).drop(*scratch)


def with_blocks(positioned: DataFrame, size: int, before: int, after: int = 0) -> DataFrame:
    """Copies each row of ``_position`` order into the blocks that need it as a neighbour.

    Blocks have ``size`` own rows; rows within ``before`` of a block start (``after`` of its end) from the
    neighbouring blocks join it marked ``_halo``. A window or Arrow group per block then sees every
    neighbour it needs, and no block grows with the data.
    """
    own = F.floor(F.col(POSITION) / F.lit(size)).cast("long")
    reach_back = F.floor((F.col(POSITION) + F.lit(before)) / F.lit(size)).cast("long")
    reach_front = F.greatest(F.lit(0), F.floor((F.col(POSITION) - F.lit(after)) / F.lit(size))).cast("long")
    return (
        positioned.withColumn("_own", own)
        .withColumn(BLOCK, F.explode(F.sequence(reach_front, reach_back)))
        .withColumn(HALO, F.col(BLOCK) != F.col("_own"))
        .drop("_own")
    )
