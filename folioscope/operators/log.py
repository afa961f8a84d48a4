"""Operators on message logs: nesting, collapsing, replay and filters.

A message is (seq, datetime, method, value, caller); ``key`` columns tell logs apart, seq orders one. Methods are Group, GroupEnd,
Log, Info, Warn, Error and Progress.
"""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line, words

#: How many values of seq a task takes of one log at a time.
STRETCH = 100_000
METHODS = ("Group", "GroupEnd", "Log", "Info", "Warn", "Error", "Progress")


def message(value: Column) -> Column:
    """A message's stored text: tabs are four spaces."""
    return F.replace(value, F.lit("\t"), F.lit("    "))


def enabled(messages: DataFrame, methods: dict[str, bool]) -> DataFrame:
    """Messages whose method is switched on; group ends go with groups, unknown methods are off."""
    switch = F.when(F.col("method") == "GroupEnd", "Group").otherwise(F.col("method"))
    on = [m for m, x in methods.items() if x]
    return messages.where(switch.isin(on) if on else F.lit(False))


def with_depth(messages: DataFrame, key: list[str], stretch: int = STRETCH, offset: int = 0) -> DataFrame:
    """Adds depth: a group is shown before it nests, its end after it unnests; surplus ends leave depth at 0.

    ``offset`` is the depth that a log starts at; a negative one is an error.

    The depth after each message is the running sum of steps above its lowest value so far. Both are worked out within
    stretches of a log and carried from one stretch to the next by a row each, so one long log is shared among tasks.
    """
    if offset < 0:
        raise ValueError("the offset isn't negative")
    step = F.when(F.col("method") == "Group", 1).when(F.col("method") == "GroupEnd", -1).otherwise(0)
    upto = Window.partitionBy(*key, "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = messages.withColumn("_stretch", F.floor(F.col("seq") / stretch)).withColumn("_s", F.sum(step).over(upto)).withColumn("_low", F.min("_s").over(upto))
    ends = s.groupBy(*key, "_stretch").agg(F.max_by("_s", "seq").alias("_sum"), F.min("_low").alias("_least"))
    before = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)) + offset)
    ends = ends.withColumn("_floor", F.least(F.lit(0), F.min(F.col("_at") + F.col("_least")).over(before))).select(*key, "_stretch", "_at", "_floor")
    carried = s.join(ends, [*key, "_stretch"])
    after = F.col("_at") + F.col("_s") - F.least(F.coalesce("_floor", F.lit(0)), F.col("_at") + F.col("_low"))
    depth = F.when(F.col("method") == "Group", after - 1).otherwise(after)
    return carried.withColumn("depth", depth.cast("long")).select(*messages.columns, "depth")


def with_next(messages: DataFrame, key: list[str], stretch: int = STRETCH) -> DataFrame:
    """Adds next_method and next_value: the message that follows in its log (null at the end)."""
    row = F.struct("method", "value")
    s = messages.withColumn("_stretch", F.floor(F.col("seq") / stretch))
    first = s.groupBy(*key, "_stretch").agg(F.min_by(row, "seq").alias("_first"))
    following = first.select(*key, "_stretch", F.lead("_first").over(Window.partitionBy(*key).orderBy("_stretch")).alias("_first"))
    near = F.lead(row).over(Window.partitionBy(*key, "_stretch").orderBy("seq"))
    n = s.withColumn("_near", near).join(following, [*key, "_stretch"]).withColumn("_next", F.coalesce("_near", "_first"))
    return n.select(*messages.columns, F.col("_next.method").alias("next_method"), F.col("_next.value").alias("next_value"))


def indent(depth: Column) -> Column:
    return F.repeat(F.lit("|"), depth.cast("int"))


def _sides(value: Column) -> tuple[Column, Column, Column, Column]:
    """For a text with 'of': is it interior, its place, what stands before the number, and after the total."""
    w = words(value)
    at = F.array_position(w, "of").cast("int")
    n = F.size(w)
    interior = (at > 1) & (at < n)
    before = F.array_join(F.slice(w, 1, F.greatest(at - 2, F.lit(0))), " ")
    after = F.array_join(F.slice(w, F.least(at + 2, n + 1), F.greatest(n - at - 1, F.lit(0))), " ")
    return interior, at, F.when(interior, before), F.when(interior, after)


def same(method: Column, value: Column, kept_method: Column, kept_value: Column) -> Column:
    """Whether a new message repeats the one kept. Progress texts like '2 of 5' are equal if their surroundings are.

    The relation has a direction: a counting text repeats a plain one that starts and ends like it, not the other way round.
    """
    mine, kept = F.contains(value, F.lit(" of ")), F.contains(kept_value, F.lit(" of "))
    i1, p1, before1, after1 = _sides(value)
    i2, p2, before2, after2 = _sides(kept_value)
    aligned = i1 & i2 & (p1 == p2) & (F.size(words(value)) == F.size(words(kept_value)))
    both = F.when(aligned, (before1 == before2) & (after1 == after2)).otherwise(value == kept_value)
    one = i1 & F.startswith(kept_value, before1) & F.endswith(kept_value, after1)
    plain = value == kept_value
    for start in ("Export", "Parse", "Update"):
        plain = plain | (F.startswith(value, F.lit(start)) & F.startswith(kept_value, F.lit(start)))
    progress = F.when(mine & kept, both).when(mine, one).when(kept, F.lit(False)).otherwise(plain)
    equal = (method == kept_method) & (value == kept_value)
    return F.coalesce(F.when((method == "Progress") & (kept_method == "Progress"), progress).otherwise(equal), F.lit(False))


def collapsed(messages: DataFrame, key: list[str], stretch: int = STRETCH) -> DataFrame:
    """A Progress message replaces the one right before it if it repeats it; the last of each run stays."""
    n = with_next(messages, key, stretch)
    replaced = (F.col("next_method") == "Progress") & same(F.col("next_method"), F.col("next_value"), F.col("method"), F.col("value"))
    return n.where(~F.coalesce(replaced, F.lit(False))).drop("next_method", "next_value")


def reset(messages: DataFrame, errors: bool = True, warnings: bool = True) -> DataFrame:
    """What is left after a reset: errors and warnings whose flag doesn't drop them too."""
    kept = [m for m, drop in (("Error", errors), ("Warn", warnings)) if not drop]
    return messages.where(F.col("method").isin(kept) if kept else F.lit(False))


def cleared(messages: DataFrame, key: list[str], prefix: str) -> DataFrame:
    """Cuts a log after its first open group: the first Group of that prefix, if no GroupEnd of the prefix follows."""
    prefix = prefix.split("\n")[0]
    starts = F.startswith("value", F.lit(prefix))
    group = messages.where((F.col("method") == "Group") & starts).groupBy(*key).agg(F.min("seq").alias("_from"))
    ends = messages.where((F.col("method") == "GroupEnd") & starts).groupBy(*key).agg(F.max("seq").alias("_to"))
    cut = group.join(ends, key, "left").where(F.col("_to").isNull() | (F.col("_to") < F.col("_from"))).drop("_to")
    return messages.join(cut, key, "left").where(F.col("_from").isNull() | (F.col("seq") <= F.col("_from"))).drop("_from")


def tail(messages: DataFrame, key: list[str], height: int) -> DataFrame:
    """The last ``height`` messages of each log; all if it is 0."""
    if height <= 0:
        return messages
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= height).drop("_n")


def appended(log: DataFrame, other: DataFrame) -> DataFrame:
    """One log after another."""
    return log.unionByName(other)


def lines(messages: DataFrame) -> DataFrame:
    """A row per line, with line_no from 0: '-' before lines that start with > or -, else a space."""
    split = F.posexplode(F.split("value", "\n")).alias("line_no", "_line")
    rows = messages.select(*messages.columns, split)
    mark = F.when(F.startswith("_line", F.lit(">")) | F.startswith("_line", F.lit("-")), "-").otherwise(" ")
    return rows.withColumn("line", F.concat(mark, F.col("_line"))).drop("_line")


def rendered(messages: DataFrame, key: list[str], offset: int = 0) -> DataFrame:
    """(key, seq, line_no, to_errors, shown): every line as a console shows it, indented by its depth; errors go to their own stream."""
    out = lines(with_depth(messages, key, offset=offset))
    return out.select(*key, "seq", "line_no", (F.col("method") == "Error").alias("to_errors"), F.concat(indent(F.col("depth")), F.col("line")).alias("shown"))


def to_console(messages: DataFrame, key: list[str], height: int, offset: int = 0, stdout: TextIO | None = None, stderr: TextIO | None = None) -> int:
    """Writes the last ``height`` messages of each log as ``rendered``, errors to ``stderr``; returns the number of lines.

    Lines come one partition at a time, in order of key and seq, so the driver holds no more than a partition of them. For a stream,
    give it as the function of ``foreachBatch``.
    """
    shown = rendered(messages, key, offset).join(tail(messages, key, height).select(*key, "seq"), [*key, "seq"], "left_semi")
    n = 0
    for r in shown.orderBy(*key, "seq", "line_no").select("to_errors", "shown").toLocalIterator():
        print(r.shown, file=(stderr or sys.stderr) if r.to_errors else (stdout or sys.stdout))
        n += 1
    return n


def group_title(value: Column) -> Column:
    """A group's text: its first line."""
    return first_line(value)


def summary(messages: DataFrame, key: list[str]) -> DataFrame:
    """(key, length, has_errors)."""
    return messages.groupBy(*key).agg(F.count("*").alias("length"), F.coalesce(F.bool_or(F.col("method") == "Error"), F.lit(False)).alias("has_errors"))
