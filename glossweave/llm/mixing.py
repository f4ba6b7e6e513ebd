"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight for its share of the mix and a schedule, the density of
its words over training time. The schedule is integrated and inverted: a
document copy whose words begin after ``c`` words of its source is trained at the
time at which the source's cumulative demand reaches ``c``. Documents are then
range-sorted by time. All of it is DataFrame functions.

Defined results: a null text has size 0; the null source is a source of its own,
last in order; a null key sorts first; rows that are equal in all that is read
are placed one after the other; sources of no words, and an empty table, have
target 0. Only the columns named by the caller are read, so extra columns cannot
clash, except in :func:`mixed_documents`, which keeps the given columns as they are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.headwords import with_position
from ..session import cut
from .common import WORD

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Schedule by weight: densities at equally spaced times, joined by straight lines.
SCHEDULES: Mapping[int, Sequence[float]] = {5: (0.5, 1.0, 1.5), 2: (1.0, 1.0), 1: (1.5, 1.0, 0.5)}
#: Rows of one block of the running sum; the number of blocks grows with the rows.
BLOCK_ROWS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """Target words per source, from (source, source_size).

    Shares follow the weights; a share beyond ``max_repeat`` times the source's
    size is cut, and what is over goes to the others by weight. In the order of
    limit over weight the cut sources come first, so one running sum finds them.
    One row per source is read, documents are not.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w).cast("double") for w in weights]), (rank % len(weights)).cast("int"))
    limit = F.col("source_size").cast("double") * max_repeat
    ranked = sizes.select(
        "source", "source_size", rank.alias("_rank"), weight.alias("weight"), limit.alias("_limit")
    )
    everything = W.partitionBy()
    before = W.orderBy(F.col("_limit") / F.col("weight"), "_rank").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    judged = ranked.select("*", total.alias("_total"), (F.col("_limit") / F.col("weight") < level).alias("_cut"))
    free = F.when(~F.col("_cut"), F.col("weight"))
    taken = F.when(F.col("_cut"), F.col("_limit")).otherwise(0.0)
    level = F.try_divide(F.col("_total") - F.sum(taken).over(everything), F.sum(free).over(everything))
    target = F.when(F.col("_cut"), F.col("_limit")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return judged.select("source", "source_size", "weight", target.alias("target"))


def time_of_share(share: Column, schedule: Sequence[float]) -> Column:
    """Time in [0, 1] at which the integral of a schedule reaches ``share`` of its whole.

    Between two knots the density is a line, so the integral is a square and its
    inverse a square root.
    """
    steps = len(schedule) - 1
    if steps < 1 or min(schedule) < 0 or max(schedule) <= 0:
        raise ValueError("a schedule needs two densities or more, none below 0")
    width = 1.0 / steps
    areas = [(a + b) / 2 * width for a, b in zip(schedule, schedule[1:])]
    whole = math.fsum(areas)
    result, done = F.lit(1.0), whole
    for k in reversed(range(steps)):
        first, last = float(schedule[k]), float(schedule[k + 1])
        done -= areas[k]
        rest = F.greatest(share * whole - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(first * first) + rest * (2 * (last - first) / width), F.lit(0.0)))
        inside = F.coalesce(F.try_divide(rest * 2.0, F.lit(first) + root), F.lit(0.0))
        at = F.least(inside, F.lit(width)) + F.lit(k * width)
        result = F.when(share * whole <= F.lit(done + areas[k]), at).otherwise(result)
    return result


def training_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    schedules: Mapping[int, Sequence[float]] = SCHEDULES,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target, passes, taken, positions.

    Inside its source a document stands in the order of a digest of its key. Copy
    ``p`` begins ``p`` sizes of the source later than the first; a copy is taken
    if its middle lies within the target. The running sum is taken in blocks of
    consecutive rows of a range sort, so a source, or a repeated key, with a third
    of all rows is many blocks.
    """
    narrow = docs.select(
        F.col(source).alias("source"),
        F.col(key).alias(key),
        word_count(F.col(text)).alias("size"),
        F.coalesce(F.md5(F.col(key).cast("string").cast("binary")), F.lit("")).alias("_order"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    stored = cut(narrow, "mix-sizes")
    sizes = stored.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat)
    order = [F.col(c) for c in ("source", "_order", key, "size", "_tie")]
    placed = with_position(stored, order, "_row").withColumn("_block", F.floor(F.col("_row") / block_rows))
    blocks = placed.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("source").alias("_source"), F.col("_block").alias("_of"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = W.partitionBy("source", "_block").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same_block = (F.col("_block") == F.col("_of")) & F.col("source").eqNullSafe(F.col("_source"))
    begun = summed.join(offsets, same_block).select(
        "source", key, "size", (F.col("_offset") + F.col("_inside")).alias("_begin")
    )
    aims = targets.withColumnRenamed("source", "_source")
    rows = begun.join(aims, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.sequence(F.lit(0), F.lit(max_repeat - 1))

    def middle(p: Column) -> Column:
        return p * F.col("source_size") + F.col("_begin") + F.col("size") / 2.0

    taken = F.filter(F.transform(copies, middle), lambda at: at <= F.col("target"))
    share = F.when(F.col("target") > 0, F.lit(1.0) / F.col("target")).otherwise(0.0)

    def position(at: Column) -> Column:
        u = at * share
        time = time_of_share(u, (1.0, 1.0))
        for weight, schedule in schedules.items():
            time = F.when(F.col("weight") == float(weight), time_of_share(u, schedule)).otherwise(time)
        return time

    return rows.select(
        key, "source", "size", "source_size", "target",
        F.size(taken).alias("passes"),
        (F.size(taken) * F.col("size")).cast("long").alias("taken"),
        F.transform(taken, position).alias("positions"),
    )


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The documents of the mix in training order, a row for every copy taken, columns as given.

    A document finds its places by key, source and size. Rows that agree in all
    three are told apart by a running number, on a way of their own.
    """
    plan = training_plan(docs, key=key, text=text, source=source, **options)
    stored = cut(plan.select(key, "source", "size", "passes", "positions"), "mix-plan")
    same = [key, "source", "size"]
    names = [F.col(c).alias(f"_plan_{i}") for i, c in enumerate(same)]
    groups = stored.groupBy(*same).agg(
        F.count("*").alias("_n"), F.first("positions").alias("positions"), F.max("passes").alias("_most")
    )
    single = cut(groups.where("_n = 1 and _most > 0").select(*names, "positions"), "mix-single")
    repeated = cut(groups.where("_n > 1").select(*names), "mix-repeated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = rows.select(
        "_doc", F.col("_doc")[key].alias("_key_0"), F.col("_doc")[source].alias("_key_1"),
        word_count(F.col("_doc")[text]).alias("_key_2"),
    )

    def meets() -> Column:
        out = F.lit(True)
        for i in range(len(same)):
            out &= F.col(f"_key_{i}").eqNullSafe(F.col(f"_plan_{i}"))
        return out

    order = W.partitionBy(*same).orderBy("positions")
    numbered = stored.withColumn("_n", F.row_number().over(order)).select(*names, "_n", "positions")
    alike = W.partitionBy("_key_0", "_key_1", "_key_2").orderBy("_key_0")
    several = rows.join(repeated, meets(), "left_semi").withColumn("_m", F.row_number().over(alike))
    several = several.join(numbered, meets() & (F.col("_n") == F.col("_m")))
    taken = rows.join(single, meets()).select("_doc", "positions").unionByName(several.select("_doc", "positions"))
    copies = taken.select("_doc", F.posexplode("positions").alias("_pass", "_at"))
    ordered = copies.orderBy("_at", F.col("_doc")[source], F.col("_doc")[key], "_pass")
    return ordered.select("_doc.*")
