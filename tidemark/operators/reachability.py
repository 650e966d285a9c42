"""What can be reached from roots along edges, and how a declared list differs from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): roots and all that follows them. ``edges`` has src and dst, ``roots`` node. Cycles are fine.

    Each round joins only the newly found nodes with the edges, and is checkpointed, so the plan doesn't grow with the
    depth; the session needs a checkpoint folder (see tidemark.session). What is known lies in few tables: two that stand for
    equally many rounds are written as one, so a round reads a logarithm of the rounds before it, not all of them.
    """
    frontier = roots.select("node").distinct().checkpoint()
    tables = [(0, frontier)]
    while True:
        fresh = edges.join(frontier, edges["src"] == frontier["node"]).select(edges["dst"].alias("node")).distinct()
        for _, known in tables:
            fresh = fresh.join(known, "node", "left_anti")
        frontier = fresh.checkpoint()
        if frontier.isEmpty():
            return reduce(DataFrame.union, [known for _, known in tables])
        tables.append((0, frontier))
        while len(tables) > 1 and tables[-1][0] == tables[-2][0]:
            (rank, one), (_, two) = tables.pop(), tables.pop()
            tables.append((rank + 1, one.union(two).checkpoint()))


def reachable_relations(relations: list[tuple[str, str, DataFrame]], roots: dict[str, DataFrame]) -> DataFrame:
    """(kind, node): what ``reachable`` finds where nodes are of few kinds, each with keys of one type.

    ``relations`` has, for each, the kinds at its ends and its edges (src, dst); ``roots`` the nodes (node) of some kinds. A
    round reads only the relations that begin at a kind with new nodes, so relations without cycles are read once, and
    keys are joined as they are. A null key is followed nowhere.
    """
    known = {kind: [rows.select("node").distinct().checkpoint()] for kind, rows in roots.items()}
    fresh = {kind: tables[0] for kind, tables in known.items()}
    while fresh:
        found: dict[str, DataFrame] = {}
        for start, end, edges in relations:
            if start in fresh:
                reached = edges.join(fresh[start], edges["src"] == fresh[start]["node"], "left_semi").select(edges["dst"].alias("node"))
                found[end] = found[end].union(reached) if end in found else reached
        fresh = {}
        for kind, rows in found.items():
            new = rows.distinct()
            for table in known.get(kind, []):
                new = new.join(table.withColumnRenamed("node", "known"), F.col("node").eqNullSafe(F.col("known")), "left_anti")
            new = new.checkpoint()
            if not new.isEmpty():
                fresh[kind] = new
                tables = [*known.get(kind, []), new]
                # Cycles add tables; eight are written as one, so a round reads few.
                known[kind] = tables if len(tables) < 8 else [reduce(DataFrame.union, tables).checkpoint()]
    return reduce(DataFrame.union, [table.select(F.lit(kind).alias("kind"), "node") for kind, tables in known.items() for table in tables])


def differences(declared: DataFrame, actual: DataFrame, existing: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, problem) of a declared list of unreachable nodes: undeclared, wrongly declared, unknown or repeated; unknown roots.

    A repeated node is one problem, and only existing nodes count as reached, whatever ``actual`` holds.
    """
    nodes = existing.select("node").distinct()
    reached = actual.select("node").join(nodes, "node", "left_semi")
    say = lambda rows, what: rows.select("node", F.lit(what).alias("problem"))
    found = (
        say(nodes.join(reached, "node", "left_anti").join(declared, "node", "left_anti"), "undeclared")
        .union(say(declared.join(reached, "node", "left_semi").distinct(), "declared-but-reachable"))
        .union(say(declared.join(nodes, "node", "left_anti").distinct(), "unknown"))
        .union(say(declared.groupBy("node").count().where("count > 1"), "repeated"))
    )
    return found if roots is None else found.union(say(roots.select("node").distinct().join(nodes, "node", "left_anti"), "unknown-root"))
