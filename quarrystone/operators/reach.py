"""Reach over shared groups, to a fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.storage import Work


def hops(memberships: DataFrame, sources: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, hops): each node that `sources` (node) reach, and over how few groups.

    memberships: node, group. Two nodes of one group are one hop apart. A round goes from the nodes found last to their groups, and from the groups that are new to their
    nodes that are new: no pairs of a group's members are made, a group is opened once and a node visited once, and the round's joins
    move only what is new besides the memberships. Rounds end when one finds nothing; more than `most_rounds` raise RuntimeError.
    Each round is a table in the shared folder.

    Sources count 0 hops, whether they have memberships or not. Nulls on either side belong to nothing; repeated rows count once; no sources give no rows.
    """
    work = Work(memberships.sparkSession, "reach")
    rows = work.put(memberships.select("node", "group").where("node is not null and `group` is not null").distinct(), "memberships")
    seen = work.put(sources.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)), "nodes-0")
    opened = None
    last = seen
    for i in range(1, most_rounds + 1):
        groups = rows.join(last.select("node"), "node", "left_semi").select("group").distinct()
        if opened is not None:
            groups = groups.join(opened, "group", "left_anti")
        groups = work.put(groups, f"groups-{i}")
        opened = groups if opened is None else opened.union(groups)
        found = rows.join(groups, "group", "left_semi").select("node").distinct().join(seen, "node", "left_anti")
        last = work.put(found.withColumn("hops", F.lit(i)), f"nodes-{i}")
        if not last.limit(1).count():
            return seen
        seen = seen.union(last)
    raise RuntimeError(f"new nodes are still found after {most_rounds} rounds")
