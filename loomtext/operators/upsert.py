"""Snapshot tables: precedence-aware upserts, history, quarantine, plans and guards.

A table is a DataFrame snapshot; every operator returns the next one, so that a second run changes nothing. Keys are
joined or windowed by their own partitioning and rows never leave the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Precedence of the ways a text was matched.
METHOD_RANK = {"manual": 50, "pdf_heading_boundary": 45, "strict_unique": 40, "global_align": 30, "whole_unit": 20, "heuristic": 10}


def method_rank(c: Column) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), METHOD_RANK.items(), F.lit(0))


def same_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def precedence_upsert(current: DataFrame, incoming: DataFrame, keys: list[str], content: list[str], method: str = "method") -> DataFrame:
    """The next snapshot with `action` per row: insert, update, keep. A row is replaced by a higher method, or by an
    equal one with other content."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(method_rank(F.col(method))), *content))).filter("__n = 1").drop("__n")
    old, new = current.select(F.struct("*").alias("o"), *keys), first.select(F.struct(*current.columns).alias("n"), *keys)
    both = old.join(new, keys, "full")
    differ = reduce(lambda a, b: a | b, (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in content))
    a, b = method_rank(F.col(f"o.{method}")), method_rank(F.col(f"n.{method}"))
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "keep").when((b > a) | ((b == a) & differ), "update").otherwise("keep")
    return both.withColumn("action", action).withColumn("r", F.when(F.col("action") == "keep", F.col("o")).otherwise(F.col("n"))).select("r.*", "action")


def last_writer(current: DataFrame, incoming: DataFrame, keys: list[str], batch: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(batch))
    return current.unionByName(incoming).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def archive_split(current: DataFrame, stale: DataFrame, key: str, batch: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to the history with the batch that replaced it)."""
    return current.join(stale, key, "left_anti"), current.join(stale, key, "left_semi").withColumn("replaced_by_batch", F.lit(batch))


def append_new(current: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Incoming rows that the table does not have, null-safe over the columns; for tables without a key."""
    return incoming.join(current, same_rows(incoming, current, columns), "left_anti")


def plan(current: DataFrame, items: DataFrame, keys: list[str], content: list[str], blocked: Column) -> DataFrame:
    """Items with what applying them would do: blocked, insert, unchanged, update. Nothing is changed."""
    old = current.select(*keys, F.struct(*content).alias("__o"))
    both = items.join(old, keys, "left")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__o.{c}")) for c in content))
    return both.withColumn("action", F.when(blocked, "blocked").when(F.col("__o").isNull(), "insert").when(same, "unchanged").otherwise("update")).drop("__o")


def apply_plan(current: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot; refuses a plan that has a blocked item."""
    if not planned.filter("action = 'blocked'").isEmpty():
        raise ValueError("the plan has blocked items")
    changed = planned.filter("action in ('insert', 'update')").select(current.columns)
    return current.join(changed, keys, "left_anti").unionByName(changed)


def complete_runs(rows: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """(group, n, complete): whether the group's ranges follow each other without a gap."""
    w = Window.partitionBy(group).orderBy(start)
    gap = F.lag(end).over(w).isNotNull() & (F.lag(end).over(w) + 1 != F.col(start))
    return rows.withColumn("__g", gap.cast("int")).groupBy(group).agg(F.count("*").alias("n"), (F.sum("__g") == 0).alias("complete"))


def replaceable(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups whose old ranges the new ones may replace: the new are complete, span the old, and none is manual."""
    a = old.groupBy(group).agg(F.min("start").alias("os"), F.max("end").alias("oe"), F.count_if(F.col("method") == "manual").alias("manual"))
    b = new.groupBy(group).agg(F.min("start").alias("ns"), F.max("end").alias("ne"))
    return a.join(b, group).join(complete_runs(new, group), group).select(group, ((F.col("manual") == 0) & F.col("complete") & (F.col("ns") <= F.col("os")) & (F.col("ne") >= F.col("oe"))).alias("replaceable"))


def compare_and_swap(current: DataFrame, edits: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the edit (key, old, new) applied where the column still has the old value."""
    return current.join(edits, key, "left").withColumn(column, F.when(F.col(column).eqNullSafe(F.col("old")) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col(column))).drop("old", "new")


def repoint(rows: DataFrame, moves: DataFrame, key: str, target: str) -> DataFrame:
    """moves (key, to) with `action`: blocked if another row that does not move has the target, else move."""
    staying = rows.join(moves, key, "left_anti").select(F.col(target).alias("to"), F.lit(True).alias("__taken")).distinct()
    return moves.join(staying, "to", "left").withColumn("action", F.when(F.col("__taken"), "blocked").otherwise("move")).drop("__taken")


def sync_children(current: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What makes the children those wanted: insert, update, delete or keep per key."""
    o, n = current.select(key, F.struct(*columns).alias("o")), wanted.select(key, F.struct(*columns).alias("n"))
    same = reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns))
    return o.join(n, key, "full").select(key, F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(same, "keep").otherwise("update").alias("action"))


def bump_version(current: DataFrame, incoming: DataFrame, content: list[str]) -> DataFrame:
    """The incoming row with the version raised only if its content differs from the current row's."""
    a, b = current.alias("a"), incoming.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in content))
    return b.join(a, F.lit(True), "left").select(*(F.col(f"b.{c}") for c in content), F.when(same, F.col("a.version")).otherwise(F.coalesce("a.version", F.lit(0)) + 1).alias("version"))


def reshape_ranges(current: DataFrame, passages: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """current with the range rows of the given ids replaced by a row for each passage (doc_id, sort_order, passage_id, text)
    in their range."""
    going = current.filter(F.col(key).isin(ids) & F.col("start").isNotNull())
    stays = current.join(going.select(key), key, "left_anti")
    made = going.drop("text", "passage_id").join(passages, "doc_id").filter(F.col("sort_order").between(F.col("start"), F.coalesce("end", "start")))
    return stays.unionByName(made.withColumns({"start": F.lit(None).cast(current.schema["start"].dataType), "end": F.lit(None).cast(current.schema["end"].dataType)}).select(current.columns))


def owned_runs(rows: DataFrame, runs: DataFrame, key: str, at: str, owner: str) -> DataFrame:
    """(run, owned, strange_before, strange_after): whether all rows from a run's start to its end are the owner's, and whether
    the neighbours on both sides are another's. runs (run, key, owner, start, end)."""
    r = runs.select("run", key, F.col(owner).alias("__owner"), "start", "end")
    met = rows.join(r, key).filter(F.col(at).between(F.col("start") - 1, F.col("end") + 1))
    own, inside = F.col(owner).eqNullSafe(F.col("__owner")), F.col(at).between(F.col("start"), F.col("end"))
    n = met.groupBy("run").agg(F.count_if(inside & own).alias("a"), F.max(F.col("end") - F.col("start") + 1).alias("n"), F.count_if(own & (F.col(at) < F.col("start"))).alias("b"), F.count_if(own & (F.col(at) > F.col("end"))).alias("c"))
    return n.select("run", (F.col("a") == F.col("n")).alias("owned"), (F.col("b") == 0).alias("strange_before"), (F.col("c") == 0).alias("strange_after"))


def replacement_ids(old: DataFrame, new: DataFrame, group: str, content: list[str]) -> DataFrame:
    """(id) of old ranges that new ones replace, in groups that may be replaced and but for rows that stay as they are."""
    fine = replaceable(old, new, group).filter("replaceable").select(group)
    same = old.join(new.select(group, "start", "end", *content), [group, "start", "end", *content], "left_semi").select("id")
    return old.join(fine, group).join(same, "id", "left_anti").select("id")


def apply_repoint(current: DataFrame, moves: DataFrame, key: str, target: str) -> DataFrame:
    """current with the moves that are not blocked; refuses if any is."""
    if not moves.filter("action = 'blocked'").isEmpty():
        raise ValueError("a target is taken")
    to = moves.select(key, F.col("to").alias("__to"))
    return current.join(to, key, "left").withColumn(target, F.coalesce("__to", target)).drop("__to")


def staged_write(df: DataFrame, path: str) -> None:
    """Replaces a folder as a whole: written beside it first, so that a failure leaves the old one, and moved by two renames
    of the file system that holds it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.next")
    fs.delete(at(f"{path}.old"), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.next"), at(path))
    fs.delete(at(f"{path}.old"), True)


def backup_then_update(df: DataFrame, backup: str, keys: list[str], change: dict[str, Column]) -> DataFrame:
    """df with changed columns, after its rows that change were written to a backup that must not exist yet."""
    differ = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(x) for c, x in change.items()))
    df.filter(differ).select(*keys, *change).write.mode("errorifexists").parquet(backup)
    return df.withColumns(change)


def without(current: DataFrame, keys: list, key: str) -> DataFrame:
    """current without the rows of the given keys; all of them go if there are none: a truncation."""
    return current.filter(~F.coalesce(F.col(key).isin(keys), F.lit(False))) if keys else current.limit(0)
