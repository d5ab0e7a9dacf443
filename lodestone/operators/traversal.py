"""Iterative graph operators over many repositories at once: reach, closures, components, cycles, levels.

Edges are (repo_id, source_id, target_id); nothing crosses a repository. Each round joins the frontier with the edges and
stages what it found as a table in the shared folder, so that lineage stays short and a lost executor costs no more than
its part of a round. Hubs are left to adaptive skew joins and partial aggregation.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import join_small, ship, stage

KEY = ["repo_id", "id"]
#: A repository with at most this many edges is searched inside one task, which then holds a few tens of MB; a larger one by
#: rounds over all tasks. Both ways give the same rows.
LOCAL_EDGES = 100_000


def _by_size(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Staged edges of repositories with at most ``most`` of them, and those of the others."""
    edges = stage(edges)
    large = edges.groupBy("repo_id").count().where(F.col("count") > most).select("repo_id")
    salt = ["source_id", "target_id"]
    return join_small(edges, large, ["repo_id"], "left_anti", salt=salt), join_small(edges, large, ["repo_id"], "left_semi", salt=salt)


def _frame(edges: pd.DataFrame, ids: list[str], name: str, values: list[str]) -> pd.DataFrame:
    """Rows of one repository; typed, also when there are none."""
    return pd.DataFrame(
        {"repo_id": pd.Series([edges["repo_id"].iloc[0]] * len(ids), dtype="int64"), "id": pd.Series(ids, dtype="object"), name: pd.Series(values, dtype="object")}
    )


def _local_components(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(edges["source_id"], edges["target_id"]):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    return _frame(edges, ids, "component", [root(x) for x in ids])


def _local_cycles(edges: pd.DataFrame) -> pd.DataFrame:
    """Strong components of more than one node, without recursion."""
    out: dict[str, list[str]] = {}
    for a, b in zip(edges["source_id"], edges["target_id"]):
        out.setdefault(a, []).append(b)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    ids: list[str] = []
    names: list[str] = []
    for start in out:
        if start in order:
            continue
        work = [(start, iter(out[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        held.add(start)
        while work:
            at, ways = work[-1]
            for to in ways:
                if to not in order:
                    order[to] = low[to] = len(order)
                    stack.append(to)
                    held.add(to)
                    work.append((to, iter(out.get(to, ()))))
                    break
                if to in held:
                    low[at] = min(low[at], order[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == order[at]:
                    whole = []
                    while True:
                        x = stack.pop()
                        held.discard(x)
                        whole.append(x)
                        if x == at:
                            break
                    if len(whole) > 1:
                        ids += whole
                        names += [min(whole)] * len(whole)
    return _frame(edges, ids, "cycle", names)


def _local_reach(most: int | None):
    def run(roots: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for a, b in zip(edges["source_id"], edges["target_id"]):
            out.setdefault(a, []).append(b)
        depth = dict.fromkeys(roots["id"], 0)
        frontier, level = list(depth), 0
        while frontier and (most is None or level < most):
            level += 1
            new = []
            for a in frontier:
                for b in out.get(a, ()):
                    if b not in depth:
                        depth[b] = level
                        new.append(b)
            frontier = new
        repo = roots["repo_id"].iloc[0] if len(roots) else 0
        return pd.DataFrame({"repo_id": pd.Series([repo] * len(depth), dtype="int64"), "id": pd.Series(list(depth), dtype="object"), "depth": pd.Series(list(depth.values()), dtype="int32")})

    return run


def reach(edges: DataFrame, roots: DataFrame, *, group: list[str] | None = None, most: int | None = None, local: int = LOCAL_EDGES) -> DataFrame:
    """Nodes reachable from ``roots`` (repo_id, id and ``group`` columns) with their least ``depth``; roots have depth 0.

    Without groups a repository of at most ``local`` edges is searched inside one task; all others go level by level over
    all tasks.

    With ``group`` columns each group is a search of its own. Cycles end by themselves; ``most`` bounds the depth. Edges
    with null ends lead nowhere, repeated roots count once, and no roots give no rows.
    """
    group = group or []
    on = [*group, *KEY]
    if not group and local > 0:
        ship(edges.sparkSession)
        pairs = edges.select("repo_id", "source_id", "target_id").where("repo_id is not null and source_id is not null and target_id is not null").distinct()
        small, large = _by_size(pairs, local)
        good = roots.select(*KEY).where("repo_id is not null and id is not null").distinct()
        repos = large.select("repo_id").distinct()
        inner = join_small(good, repos, ["repo_id"], "left_anti", salt=["id"]).groupBy("repo_id").cogroup(small.groupBy("repo_id"))
        near = inner.applyInPandas(_local_reach(most), "repo_id bigint, id string, depth int")
        if not large.limit(1).count():
            return near
        far = reach(large, join_small(good, repos, ["repo_id"], "left_semi", salt=["id"]), most=most, local=0)
        return near.unionByName(far)
    frontier = stage(roots.select(*on).where("repo_id is not null and id is not null").distinct().withColumn("depth", F.lit(0)))
    parts, depth = [frontier], 0
    seen = frontier
    ways = stage(edges.select("repo_id", F.col("source_id").alias("id"), F.col("target_id").alias("next")).where("id is not null and next is not null").distinct())
    while most is None or depth < most:
        depth += 1
        step = frontier.join(ways, KEY).select(*group, "repo_id", F.col("next").alias("id")).distinct()
        frontier = stage(step.join(seen, on, "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        parts.append(frontier)
        seen = reduce(DataFrame.unionByName, parts)
    return reduce(DataFrame.unionByName, parts)


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """Weak components of the nodes that edges touch: (repo_id, id, component), named by their least id.

    In repositories of more than ``local`` edges least labels spread along edges in both directions and jump to the label's own label, so that rounds grow with the
    logarithm of the diameter rather than with it. A node whose only edge is a loop is a component of its own.
    """
    ship(edges.sparkSession)
    pairs = edges.select("repo_id", "source_id", "target_id").where("repo_id is not null and source_id is not null and target_id is not null").distinct()
    small, large = _by_size(pairs, local)
    near_ones = small.groupBy("repo_id").applyInPandas(_local_components, "repo_id bigint, id string, component string")
    both = large.select("repo_id", F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    if not large.limit(1).count():
        return near_ones
    both = stage(both.unionByName(both.select("repo_id", F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    labels = stage(both.groupBy(*KEY).agg(F.least(F.col("id"), F.min("other")).alias("label")))
    while True:
        near = (
            both.join(labels, KEY)
            .groupBy("repo_id", F.col("other").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        jump = labels.select("repo_id", F.col("id").alias("label"), F.col("label").alias("far"))
        moved = stage(
            labels.join(near, KEY, "left")
            .join(jump, ["repo_id", "label"], "left")
            .select(*KEY, F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        )
        changed = moved.where("label < old").limit(1).count()
        labels = moved.drop("old")
        if not changed:
            return labels.withColumnRenamed("label", "component").unionByName(near_ones)


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges that can't lie on a cycle: those whose source nothing leads to or whose target leads nowhere."""
    edges = stage(edges)
    size = edges.count()
    while size:
        entered = edges.select("repo_id", F.col("target_id").alias("source_id")).distinct()
        left = edges.select("repo_id", F.col("source_id").alias("target_id")).distinct()
        edges = stage(edges.join(entered, ["repo_id", "source_id"], "left_semi").join(left, ["repo_id", "target_id"], "left_semi"))
        now = edges.count()
        if now == size:
            break
        size = now
    return edges


def cycles(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """Strongly connected components that hold a cycle: (repo_id, id, cycle), named by their least id.

    A component has more than one node, or one with an edge to itself. In repositories of more than ``local`` edges those
    that can't lie on a cycle are trimmed; then every node takes the least id that leads to it, and the nodes of that colour which lead back to the id are its
    component. These leave, and the rest goes on until no edge is left.
    """
    ship(edges.sparkSession)
    pairs = edges.select("repo_id", "source_id", "target_id").where("repo_id is not null and source_id is not null and target_id is not null").distinct()
    small, large = _by_size(pairs, local)
    loops = small.unionByName(large).where("source_id = target_id").select("repo_id", F.col("source_id").alias("id"))
    inner = small.where("source_id != target_id").groupBy("repo_id").applyInPandas(_local_cycles, "repo_id bigint, id string, cycle string")
    rest = _trim(large.where("source_id != target_id"))
    found = [stage(inner)]
    while rest.limit(1).count():
        nodes = rest.select("repo_id", F.col("source_id").alias("id")).unionByName(rest.select("repo_id", F.col("target_id").alias("id"))).distinct()
        colours = stage(nodes.withColumn("colour", F.col("id")))
        while True:
            sent = (
                rest.join(colours, (rest["repo_id"] == colours["repo_id"]) & (rest["source_id"] == colours["id"]))
                .groupBy(rest["repo_id"], F.col("target_id").alias("id"))
                .agg(F.min("colour").alias("sent"))
            )
            moved = stage(colours.join(sent, KEY, "left").select(*KEY, F.col("colour").alias("old"), F.least("colour", "sent").alias("colour")))
            changed = moved.where("colour < old").limit(1).count()
            colours = moved.drop("old")
            if not changed:
                break
        source = colours.select("repo_id", F.col("id").alias("source_id"), F.col("colour").alias("from"))
        target = colours.select("repo_id", F.col("id").alias("target_id"), F.col("colour").alias("to"))
        inside = stage(rest.join(source, ["repo_id", "source_id"]).join(target, ["repo_id", "target_id"]).where("`from` = `to`"))
        back = inside.select("repo_id", F.col("from").alias("colour"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
        ways = back.select("repo_id", F.concat_ws("\x00", "colour", "source_id").alias("source_id"), F.concat_ws("\x00", "colour", "target_id").alias("target_id"))
        roots = inside.select("repo_id", F.concat_ws("\x00", "from", "from").alias("id")).distinct()
        home = stage(
            reach(ways, roots).select("repo_id", F.split("id", "\x00").alias("both")).select("repo_id", F.col("both")[1].alias("id"), F.col("both")[0].alias("cycle"))
        )
        sized = home.groupBy("repo_id", "cycle").count().where("count > 1").drop("count")
        found.append(stage(home.join(sized, ["repo_id", "cycle"], "left_semi").select(*KEY, "cycle")))
        gone = home.select(*KEY)
        rest = _trim(
            rest.join(gone.withColumnRenamed("id", "source_id"), ["repo_id", "source_id"], "left_anti").join(
                gone.withColumnRenamed("id", "target_id"), ["repo_id", "target_id"], "left_anti"
            )
        )
    many = reduce(DataFrame.unionByName, found)
    alone = loops.join(many, KEY, "left_anti").withColumn("cycle", F.col("id"))
    return many.unionByName(alone)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological levels of ``nodes`` (repo_id, id) under edges that point at prerequisites: (repo_id, id, level).

    A node comes one level after the last of its prerequisites; edges to nodes outside are ignored, as are loops. Nodes on
    a cycle or behind one have a null level.
    """
    left = stage(nodes.select(*KEY).where("id is not null").distinct())
    needs = edges.select("repo_id", F.col("source_id").alias("id"), F.col("target_id").alias("needs")).where("id != needs").distinct()
    inner = left.select("repo_id", F.col("id").alias("needs"))
    needs = stage(needs.join(inner, ["repo_id", "needs"], "left_semi").join(left, KEY, "left_semi"))
    parts, level = [], 0
    while True:
        ready = stage(left.join(needs.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            break
        parts.append(ready)
        left = stage(left.join(ready, KEY, "left_anti"))
        needs = stage(needs.join(ready.select("repo_id", F.col("id").alias("needs")), ["repo_id", "needs"], "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, [*parts, rest])
