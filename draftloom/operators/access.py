"""Audit rows and group membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from . import positions
from .graph import chain

TARGET_CHARS = 1000


def audit(rows: DataFrame, action: str | Column, at: Column) -> DataFrame:
    """What is appended to the audit log for rows of user and target; ``action``: one for all, or a column."""
    return rows.select("user", (action if isinstance(action, Column) else F.lit(action)).alias("action"), F.substring("target", 1, TARGET_CHARS).alias("target"), at.alias("at"))


def set_group(members: DataFrame, user: int, group: str) -> DataFrame:
    """Membership (user, group) after a user moves to a group; the last administrator stays one."""
    admins = members.where("group = 'Admin'").agg(F.count("*").alias("n_admins"), F.max(F.col("user") == user).alias("is_admin"))
    moved = members.join(admins, F.lit(True))
    last = (F.col("n_admins") == 1) & F.coalesce("is_admin", F.lit(False)) & F.lit(group != "Admin")
    return moved.select("user", F.when((F.col("user") == user) & ~last, group).otherwise(F.col("group")).alias("group"))


def settle_admins(members: DataFrame, changes: DataFrame) -> DataFrame:
    """(user, in_group, is_superuser) after a batch of changes. members: user, those in the group, who are superusers; changes: user,
    joins, n (their order, each once).

    Who joins the group becomes a superuser; who leaves it stops being one, unless no other is left: then that user stays, until a
    later change of theirs finds another one. That depends on all that came before, but only on who, if anyone, was kept: the
    group's size is a running sum of the changes; a leave that empties the group keeps its user, until that user joins, or leaves while the
    group has members; and the next to be kept is the first who then empties it. So those kept are a chain, followed by doubling.
    """
    first = members.select(F.col("user").alias("m_user")).distinct()
    known = changes.select("user", "joins", "n").join(first, F.col("user") == F.col("m_user"), "left")
    was = F.coalesce(F.lag("joins").over(Window.partitionBy("user").orderBy("n")), F.col("m_user").isNotNull())
    stepped = known.withColumn("delta", F.col("joins").cast("int") - was.cast("int")).drop("m_user")
    start = first.select(F.lit(None).cast("long").alias("user"), F.lit(True).alias("joins"), F.lit(-(1 << 62)).alias("n"), F.lit(1).alias("delta"))
    sized = positions.running_sum(stepped.withColumn("n", F.col("n").cast("long")).unionByName(start.withColumn("user", F.col("user").cast(stepped.schema["user"].dataType))), ["n"], "delta", "size")
    sized = written(sized.where(F.col("n") > -(1 << 62)), "sized")
    freed = F.when(F.col("joins") | (F.col("size") > 0), F.col("n"))
    # from the last change back: the nearest later change that frees the user
    later = Window.partitionBy("user").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    empties = written(sized.withColumn("freed", F.min(freed).over(later)).where((F.col("delta") == -1) & (F.col("size") == 0)).select("user", "n", "freed"), "empties")
    asked = empties.where("freed is not null").select(F.col("freed").alias("at"), F.lit(None).cast("long").alias("empty"), F.col("n").alias("of"))
    there = empties.select(F.col("n").alias("at"), F.col("n").alias("empty"), F.lit(None).cast("long").alias("of"))
    after = positions.last_before(asked.unionByName(there), [F.desc("at"), F.col("of").asc_nulls_last()], "empty", "next").where("of is not null")
    one = F.lit(1).alias("g")
    kept = chain(after.select(one, F.col("of").alias("n"), "next"), empties.agg(F.min("n").alias("n")).where("n is not null").select(one, "n"), ["g"], "n", "next")
    still = empties.join(kept.select(F.col("n").alias("k_n")), F.col("n") == F.col("k_n")).where("freed is null").select(F.col("user").alias("s_user"))
    last = changes.groupBy(F.col("user").alias("l_user")).agg(F.max_by("joins", "n").alias("joins"))
    users = members.select("user").unionByName(changes.select("user")).distinct()
    found = users.join(last, F.col("user") == F.col("l_user"), "left").join(first, F.col("user") == F.col("m_user"), "left").join(still, F.col("user") == F.col("s_user"), "left")
    inside = F.coalesce("joins", F.col("m_user").isNotNull())
    return found.select("user", inside.alias("in_group"), (inside | F.col("s_user").isNotNull()).alias("is_superuser"))
