"""Breadth-first and depth-first traversal and shortest paths, level by level.

The steps of the graph are written once, clustered by the node they start from (heavy nodes are split
by the node they lead to) and sorted by it, so a level reads only the pages of its frontier: a frontier
of at most ``NAMED`` nodes is put into the filter that is pushed down to the scan, one of at most
``FEW`` counted rows is broadcast, a larger one is joined by shuffle. As long as no more than ``FEW``
nodes have been reached in all, the driver holds them and a level is a job or two; from there on levels
are written, which cuts lineage.

In a traversal, of the ways to a new node the one discovered first wins: by the place of its parent in
the queue, outgoing before incoming, then the edge's order. A level's places come from a range sort
and Spark's increasing numbers, which compare alike but need no single task. Paths need no places: the
search goes out from both ends, the smaller frontier first, until they meet; the path that
breadth-first discovery would find is the one whose steps come first, looked up hop by hop among the
nodes that lie on shortest paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph, GraphError, NotFound
from ..plans.language import MOST_HOPS
from ..runtime import materialize
from .reads import require_node

NAMED, FEW = 1_000, 100_000
#: Parts into which the steps from one node may be split.
SPLIT = 16
#: Nodes that a depth-first traversal, which is sequential, may hold in its one task.
MOST_DFS = 1_000_000


def ends(graph: Graph) -> DataFrame:
    """Source, target, order and id of the edges that have both ends."""
    return graph.edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select("source_id", "target_id", "ord", "edge_id")


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Edges as steps ``a -> b`` with ``way`` (0 with the edge, 1 against it) and ``ord``."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(0).alias("way"), "ord")
    into = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.lit(1).alias("way"), "ord")
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def adjacency(graph: Graph, direction: str) -> DataFrame:
    """The steps in that direction, ``a, b, way, ord, edge_id``, written in buckets of ``a`` that are sorted by it."""
    edges = ends(graph)
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(0).alias("way"), "ord", "edge_id")
    into = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.lit(1).alias("way"), "ord", "edge_id")
    chosen = {"outgoing": out, "incoming": into}.get(direction)
    if chosen is None:  # one scan of the edges for both ways
        ways = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.lit(w).alias("way")) for w, (x, y) in enumerate((("source_id", "target_id"), ("target_id", "source_id")))))
        chosen = edges.select(F.explode(ways).alias("s"), "ord", "edge_id").select("s.*", "ord", "edge_id")
    # by hash, since sampling for ranges would work the edges out twice; a heavy node is split by what it leads to
    return materialize(chosen.repartition("a", F.pmod("b", F.lit(SPLIT))).sortWithinPartitions("a"))


def _from(ways: DataFrame, frontier: DataFrame, size: int, named: list[int] | None = None) -> DataFrame:
    """The steps that start in ``frontier`` (a column ``a`` and others), of which only those files are read that may hold some."""
    if named is not None and size <= NAMED:
        ways = ways.where(F.col("a").isin(named))
    return ways.join(F.broadcast(frontier) if size <= FEW else frontier, "a")


def _existing(nodes: DataFrame, ids: list[int]) -> set[int]:
    """Which of at most ``FEW`` ids are nodes."""
    if len(ids) <= NAMED:
        found = nodes.where(F.col("id").isin(ids))
    else:
        found = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")), "id", "left_semi")
    return {r.id for r in found.select("id").distinct().collect()}


LEVEL = "id bigint, depth int, parent_id bigint, place bigint"


def _levels(graph: Graph, source: int, direction: str, max_depth: int, stop: Column | None = None) -> list[DataFrame]:
    """The reached nodes of each depth that exist: ``id, depth, parent_id, place``.

    ``stop``: a condition on nodes; the traversal ends with the first discovered node that meets it.
    """
    spark = graph.nodes.sparkSession
    held: list[tuple] = [(source, 0, None, 0)]  # all rows, as long as they are few
    if stop is not None and not graph.node(source).where(stop).isEmpty():
        return [spark.createDataFrame(held, LEVEL)]
    ways, seen, level, depth = adjacency(graph, direction), {source}, held, 0
    while depth < max_depth and level:
        depth += 1
        named = [r[0] for r in level]
        met = _from(ways, spark.createDataFrame([(r[0], r[3]) for r in level], "a bigint, place bigint"), len(level), named)
        # map-side combine leaves one way per new node and task
        best = met.groupBy("b").agg(F.min(F.struct("place", "way", "ord", "a")).alias("m"))
        rows = best.orderBy("m").select("b", F.col("m.a").alias("a")).limit(FEW + len(seen) + 1).collect()
        new = [r for r in rows if r.b not in seen]
        if len(new) + len(seen) > FEW:
            depth -= 1
            break
        there = _existing(graph.nodes, [r.b for r in new]) if new else set()
        level = [(r.b, depth, r.a, n) for n, r in enumerate(r for r in new if r.b in there)]
        if stop is not None and level:
            hits = _existing(graph.nodes.where(stop), [r[0] for r in level])
            first = next((n for n, r in enumerate(level) if r[0] in hits), None)
            if first is not None:
                return [spark.createDataFrame(held + level[: first + 1], LEVEL)]
        held = held + level
        seen.update(r[0] for r in level)
    else:
        return [spark.createDataFrame(held, LEVEL)]
    return _large_levels(graph, ways, held, len(level), depth, max_depth, stop)


def _large_levels(graph: Graph, ways: DataFrame, held: list[tuple], size: int, depth: int, max_depth: int, stop: Column | None) -> list[DataFrame]:
    """``_levels`` from ``depth`` on, by written tables."""
    spark = graph.nodes.sparkSession
    known = materialize(graph.nodes.select("id"))
    levels = [spark.createDataFrame(held, LEVEL)]
    frontier, visited = levels[0].where(F.col("depth") == depth), levels[0].select("id")
    for depth in range(depth + 1, max_depth + 1):
        met = _from(ways, frontier.select(F.col("id").alias("a"), "place"), size)
        best = met.groupBy("b").agg(F.min(F.struct("place", "way", "ord", "a")).alias("m"))
        new = best.join(visited, F.col("b") == F.col("id"), "left_anti").join(known, F.col("b") == F.col("id"), "left_semi")
        level = materialize(new.orderBy("m").select(F.col("b").alias("id"), F.lit(depth).alias("depth"), F.col("m.a").alias("parent_id"), F.monotonically_increasing_id().alias("place")))
        if stop is not None:
            first = level.join(graph.nodes.where(stop).select("id"), "id", "left_semi").agg(F.min("place").alias("p")).where("p is not null")
            if not first.isEmpty():
                levels.append(level.join(F.broadcast(first), F.col("place") <= F.col("p")).drop("p"))
                return levels
        size = level.count()  # from the files' footers
        if not size:
            break
        levels.append(level)
        frontier, visited = level, visited.unionByName(level.select("id"))
    return levels


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def bfs(graph: Graph, source: str | int, direction: str = "both", max_depth: int = 10, stop: Column | None = None) -> DataFrame:
    """``id, depth, parent_id, place``: every node within ``max_depth``, once, at its least depth; ``place`` sorts a depth in order of visit."""
    n = require_node(graph, source, "source node")
    return _union(_levels(graph, n, direction, max_depth if max_depth > 0 else 10, stop))


def depth_counts(visited: DataFrame) -> DataFrame:
    return visited.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def find_path(graph: Graph, source: str | int, target: str | int, max_hops: int = 5) -> DataFrame:
    """The shortest undirected path as ``pos, node_id, edge_id`` (the edge that led there); no rows if there is none.

    Of equally short paths it is the one breadth-first search discovers first. Both ends must exist; an
    inner node that doesn't is an error.
    """
    a, b = require_node(graph, source, "source node"), require_node(graph, target, "target node")
    spark = graph.nodes.sparkSession
    none = "pos int, node_id bigint, edge_id string"
    if a == b:
        return spark.createDataFrame([(0, a, None)], none)
    ways = adjacency(graph, "both")
    sides = _meet(ways, a, b, max(1, min(max_hops, MOST_HOPS)))
    if sides is None:
        return spark.createDataFrame([], none)
    rows, node = [(0, a, None)], a
    for pos, near in enumerate(_between(ways, *sides), 1):  # a row per hop
        onward = near.kept_in(ways.where(F.col("a") == node), "b")
        step = onward.orderBy("way", "ord").select("b", "edge_id").first()
        node = step.b
        rows.append((pos, node, step.edge_id))
    inner = [r[1] for r in rows[1:-1]]
    if inner and graph.nodes.where(F.col("id").isin(inner)).select("id").distinct().count() < len(set(inner)):
        raise NotFound("a node on the path is not found")
    return spark.createDataFrame(rows, none)


class _Ids:
    """A set of ids: on the driver if there are at most ``FEW``, else as a written table."""

    def __init__(self, spark, few: set[int] | None = None, many: DataFrame | None = None, size: int = 0):
        self.spark, self.few, self.many, self.size = spark, few, many, len(few) if few is not None else size

    @classmethod
    def of(cls, df: DataFrame) -> _Ids:
        """The distinct values of ``df``'s one column."""
        spark, column = df.sparkSession, df.columns[0]
        rows = df.distinct().limit(FEW + 1).collect()
        if len(rows) <= FEW:
            return cls(spark, {r[0] for r in rows})
        written = materialize(df.select(F.col(column).alias("id")).distinct())
        return cls(spark, many=written, size=written.count())

    def table(self) -> DataFrame:
        return self.many if self.few is None else self.spark.createDataFrame([(i,) for i in self.few], "id bigint")

    def kept_in(self, df: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
        """Rows of ``df`` whose ``column`` is in the set (or isn't, with ``left_anti``)."""
        if self.few is not None and len(self.few) <= NAMED:
            inside = F.col(column).isin(list(self.few)) if self.few else F.lit(False)
            return df.where(inside if how == "left_semi" else ~inside)
        mine = self.table().withColumnRenamed("id", "_id")
        return df.join(F.broadcast(mine) if self.size <= FEW else mine, F.col(column) == F.col("_id"), how)

    def steps(self, ways: DataFrame) -> DataFrame:
        """The ends of the steps that start in the set."""
        return self.kept_in(ways, "a").select("b")


def _meet(ways: DataFrame, a: int, b: int, most: int) -> tuple[list[_Ids], list[_Ids]] | None:
    """The levels of ids around ``a`` and around ``b`` up to and including where they meet; None beyond ``most`` hops."""
    spark = ways.sparkSession
    sides = [[_Ids(spark, {x})] for x in (a, b)]
    for _ in range(most):
        mine, other = (sides[0], sides[1]) if sides[0][-1].size <= sides[1][-1].size else (sides[1], sides[0])
        found = mine[-1].steps(ways)
        for old in mine[-2:]:  # steps go both ways, so they lead back no further than the level before
            found = old.kept_in(found, "b", "left_anti")
        level = _Ids.of(found)
        if not level.size:
            return None
        mine.append(level)
        last = other[-1]
        if level.few is not None and last.few is not None:
            met = not level.few.isdisjoint(last.few)
        else:
            met = not last.kept_in(level.table(), "id").isEmpty()
        if met:
            return sides[0], sides[1]
    return None


def _between(ways: DataFrame, near: list[_Ids], far: list[_Ids]) -> list[_Ids]:
    """For each hop from ``near``'s start, the nodes it may lead to on a shortest path.

    The levels last found on either side meet. Levels of the near side keep only what leads there.
    """
    if len(near) == 1:  # the far side came all the way
        return far[-2::-1]
    kept = [_Ids.of(far[-1].kept_in(near[-1].table(), "id"))]
    for level in reversed(near[1:-1]):  # the first level is the start itself
        kept.insert(0, _Ids.of(level.kept_in(kept[0].steps(ways), "b")))
    return [*kept, *far[-2::-1]]


def dfs(graph: Graph, source: str | int, direction: str = "both", max_depth: int = 10, stop: Column | None = None) -> DataFrame:
    """Pre-order of nodes at depths below ``max_depth``: ``visit_order, id, depth, parent_id``.

    Neighbours are followed by ascending id; a node that meets ``stop`` isn't gone beyond. The nodes in
    reach, at most ``MOST_DFS``, and their edges are found by levels; the walk itself is one task.
    """
    n = require_node(graph, source, "source node")
    limit = max_depth if max_depth > 0 else 10
    reach = materialize(_union(_levels(graph, n, direction, max(0, limit - 1))).select("id"))
    if reach.count() > MOST_DFS:
        raise GraphError(f"more than {MOST_DFS} nodes in reach of a depth-first traversal")
    ways = steps(ends(graph), direction).select("a", "b").join(reach, F.col("a") == F.col("id"), "left_semi").join(reach, F.col("b") == F.col("id"), "left_semi").distinct()
    closing = (graph.nodes.where(stop).select("id") if stop is not None else graph.nodes.where(F.lit(False)).select("id")).join(reach, "id", "left_semi")
    marked = ways.unionByName(closing.select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b")))
    root = graph.nodes.sparkSession.createDataFrame([(n, n)], "a bigint, b bigint")

    def walk(frames):
        import pandas as pd

        nexts: dict[int, list[int]] = {}
        closed: set[int] = set()
        for f in frames:
            for a, b in zip(f["a"], f["b"], strict=True):
                if pd.isna(b):
                    closed.add(int(a))
                else:
                    nexts.setdefault(int(a), []).append(int(b))
        seen, out, stack = {n}, [], [(n, 0, None)]
        order: list[tuple[int, int, int, int | None]] = []
        while stack:
            node, depth, parent = stack.pop()
            if parent is not None:
                if node in seen:
                    continue
                seen.add(node)
            order.append((len(order), node, depth, parent))
            if depth + 1 < limit and node not in closed:
                stack += [(b, depth + 1, node) for b in sorted(set(nexts.get(node, ())), reverse=True) if b not in seen]
        out.append(pd.DataFrame(order, columns=["visit_order", "id", "depth", "parent_id"]).astype({"parent_id": "Int64"}))
        yield from out

    return marked.unionByName(root).coalesce(1).mapInPandas(walk, "visit_order bigint, id bigint, depth int, parent_id bigint")
