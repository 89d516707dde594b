"""Graph versions in a folder: every commit writes Parquet and publishes a manifest, the last step.

Commits append small delta versions (changed and deleted entities). Readers take the newest deltas
first: the base keeps what no delta touches (an anti-join by the deltas' keys, so filters still reach
its files), and of the deltas the newest row of a key holds. Deltas are folded in tiers of like size,
so a row is rewritten a logarithmic number of times; the base is folded only when the deltas outgrow
it. Base files are clustered: nodes by id, edges by source and target.

Old files stay for readers: ``vacuum`` deletes what no version needs that was current within the
retention, was pinned by an open reader, or is being written (writers leave an intent before their
first file). Manifests go through Hadoop's file systems, whose rename without overwriting decides
which of two writers publishes a version.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..model import EDGE, EDGE_SCHEMA, NODE, NODE_SCHEMA, Graph, GraphError, NotFound
from .manifests import Manifests

NODE_DELTA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODE_SCHEMA) + ", gone boolean"
EDGE_DELTA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EDGE_SCHEMA) + ", gone boolean"
#: Seconds for which superseded files stay, and after which an intent without a version counts as abandoned.
RETENTION, ABANDONED = 3600.0, 86_400.0
#: Rows of deltas up to which their keys are broadcast; manifests count them.
FEW = 1_000_000


@dataclass(frozen=True)
class Manifest:
    """What a version consists of: delta folders on top of a base folder, oldest first, and the rows of each."""

    version: int
    committed_at: float
    folders: list[str] = field(default_factory=list)
    next_node: int = 1
    next_edge: int = 1
    n_ops: int = 0
    rows: list[int] = field(default_factory=list)


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, compact_after: int = 8):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self.manifests = Manifests(spark, f"{self.path}/manifests")
        self.pins: Counter[int] = Counter()
        if self._latest() is None:
            self._publish(Manifest(0, time.time()))

    # -- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        return self.manifests.numbers()

    def _latest(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def manifest(self, version: int | None = None) -> Manifest:
        v = self._latest() if version is None else version
        if v not in self.versions():
            raise NotFound(f"version not found: {version}")
        return Manifest(**self.manifests.read(v))

    def _publish(self, m: Manifest) -> Manifest:
        self.manifests.publish(m.version, asdict(m))
        return m

    # -- reading

    def _newest(self, folders: list[str], kind: str) -> DataFrame:
        """Of several deltas the newest row of each key, gone or not."""
        schema, key = (NODE_DELTA, "id") if kind == "nodes" else (EDGE_DELTA, "edge_id")
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}/{kind}").withColumn("_at", F.lit(i)) for i, f in enumerate(folders)]
        whole = parts[0]
        if len(parts) == 1:
            return whole.drop("_at")
        for p in parts[1:]:
            whole = whole.unionByName(p)
        last = whole.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_at").desc())))
        return last.where(F.col("_n") == 1).drop("_at", "_n")

    def _table(self, m: Manifest, kind: str) -> DataFrame:
        schema, key, columns = (NODE_DELTA, "id", NODE) if kind == "nodes" else (EDGE_DELTA, "edge_id", EDGE)
        if not m.folders:
            return self.spark.createDataFrame([], schema).select(*columns)
        base = self.spark.read.schema(schema).parquet(f"{self.path}/{m.folders[0]}/{kind}")
        living = base.where(~F.col("gone")).select(*columns)
        if len(m.folders) == 1:
            return living
        deltas = self._newest(m.folders[1:], kind)
        keys = deltas.select(key)
        keys = F.broadcast(keys) if len(m.rows) == len(m.folders) and sum(m.rows[1:]) <= FEW else keys
        return living.join(keys, key, "left_anti").select(*columns).unionByName(deltas.where(~F.col("gone")).select(*columns))

    def graph(self, version: int | None = None) -> Graph:
        """A snapshot: it stays what it is whatever is committed later."""
        m = self.manifest(version)
        return Graph(self._table(m, "nodes"), self._table(m, "edges"))

    def as_of(self, at: float) -> Graph:
        """The newest version committed at or before a time in seconds; the future is taken as now."""
        if at <= 0:
            raise GraphError("timestamp must be positive")
        fitting = [v for v, m in self.manifests.read_all().items() if m["committed_at"] <= min(at, time.time())]
        if not fitting:
            raise NotFound("no version that old")
        return self.graph(max(fitting))

    def pin(self, version: int) -> None:
        """Keep a version's files as long as it is pinned, whatever the retention."""
        self.pins[version] += 1

    def unpin(self, version: int) -> None:
        self.pins[version] -= 1

    # -- writing

    def _write(self, nodes: DataFrame, edges: DataFrame) -> str:
        name = uuid.uuid4().hex
        fs, p = self._fs(f"{self.path}/intents/{name}")
        fs.create(p, False).close()
        nodes.write.parquet(f"{self.path}/data/{name}/nodes")
        edges.write.parquet(f"{self.path}/data/{name}/edges")
        return f"data/{name}"

    def _done(self, folder: str) -> None:
        fs, p = self._fs(f"{self.path}/intents/{folder.removeprefix('data/')}")
        fs.delete(p, False)

    def _count(self, folder: str) -> int:
        """Rows of a folder, from the files' footers."""
        return sum(self.spark.read.parquet(f"{self.path}/{folder}/{kind}").count() for kind in ("nodes", "edges"))

    def _next(self, base: Manifest, folders: list[str], rows: list[int], next_node: int, next_edge: int, n_ops: int) -> Manifest:
        m = self._publish(Manifest(base.version + 1, max(time.time(), base.committed_at), folders, next_node, next_edge, n_ops, rows))
        for f in folders:
            if f not in base.folders:
                self._done(f)
        return m

    def commit(self, nodes: DataFrame, edges: DataFrame, base: Manifest, next_node: int, next_edge: int, n_ops: int = 0, n_rows: int | None = None) -> Manifest:
        """Publish changed and deleted entities (with ``gone``) on top of ``base``."""
        folder = self._write(nodes, edges)
        rows = base.rows if len(base.rows) == len(base.folders) else [self._count(f) for f in base.folders]
        m = self._next(base, [*base.folders, folder], [*rows, self._count(folder) if n_rows is None else n_rows], next_node, next_edge, n_ops)
        return self.compact_tier() if len(m.folders) > self.compact_after else m

    def compact_tier(self) -> Manifest:
        """Fold the newest deltas of like size into one; everything only if the deltas hold more rows than the base.

        If another writer publishes meanwhile, folding is left to the next commit.
        """
        m = self.manifest()
        if len(m.folders) < 3:
            return m
        if sum(m.rows[1:]) > m.rows[0]:
            return self.compact()
        start, held = len(m.folders) - 1, m.rows[-1]
        while start > 1 and (m.rows[start - 1] <= 4 * held or start > len(m.folders) - 2):
            start -= 1
            held += m.rows[start]
        folder = self._write(*(self._newest(m.folders[start:], kind) for kind in ("nodes", "edges")))
        try:
            return self._next(m, [*m.folders[:start], folder], [*m.rows[:start], self._count(folder)], m.next_node, m.next_edge, 0)
        except GraphError:
            self._done(folder)
            return self.manifest()

    @staticmethod
    def _clustered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ranges of ids and of edge ends, so that lookups skip files; a node with many edges is split by their targets."""
        return (
            nodes.repartitionByRange("id").sortWithinPartitions("id"),
            edges.repartitionByRange("source_id", "target_id").sortWithinPartitions("source_id", "target_id"),
        )

    def load(self, graph: Graph) -> Manifest:
        """Replace everything by a graph. New ids follow the highest ones; edge ids that aren't numbers don't count.

        An ``ord`` of another type than bigint is replaced by numbers in the same order, which a range
        sort gives without bringing the edges together.
        """
        edges = graph.edges
        if edges.schema["ord"].dataType != LongType():
            edges = edges.orderBy("ord").withColumn("ord", F.monotonically_increasing_id() + 1)
        last_node = graph.nodes.agg(F.max("id")).first()[0] or 0
        base = self.manifest()
        whole = lambda df, columns: df.select(*columns).withColumn("gone", F.lit(False))
        folder = self._write(*self._clustered(whole(graph.nodes, NODE), whole(edges, EDGE)))
        stored = self.spark.read.schema(EDGE_DELTA).parquet(f"{self.path}/{folder}/edges")
        last_edge = stored.agg(F.max(F.greatest(F.col("edge_id").try_cast("bigint"), "ord"))).first()[0] or 0
        return self._next(base, [folder], [self._count(folder)], last_node + 1, last_edge + 1, 0)

    def compact(self) -> Manifest:
        """Fold everything into one base."""
        m = self.manifest()
        folder = self._write(*self._clustered(*(self._table(m, kind).withColumn("gone", F.lit(False)) for kind in ("nodes", "edges"))))
        return self._next(m, [folder], [self._count(folder)], m.next_node, m.next_edge, 0)

    def vacuum(self, keep: int = 1, older_than: float = RETENTION) -> list[str]:
        """Delete versions beyond the newest ``keep`` that were superseded more than so many seconds ago, and folders nothing refers to.

        Pinned versions stay, and so do folders of commits under way.
        """
        now, all_of = time.time(), self.manifests.read_all()
        numbers = sorted(all_of)
        for v, following in zip(numbers[: max(0, len(numbers) - max(1, keep))], numbers[1:], strict=False):
            if now - all_of[following]["committed_at"] >= older_than and self.pins[v] <= 0:
                self.manifests.delete(v)
                del all_of[v]
        fs, p = self._fs(f"{self.path}/intents")
        writing = {f"data/{s.getPath().getName()}" for s in (fs.listStatus(p) if fs.exists(p) else []) if now - s.getModificationTime() / 1000 < ABANDONED}
        # a version published since then is read after the intents, so a folder is in one of the two
        used = {f for m in self.manifests.read_all().values() for f in m["folders"]}
        _, p = self._fs(f"{self.path}/data")
        gone = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = f"data/{s.getPath().getName()}"
            if name not in used and name not in writing and now - s.getModificationTime() / 1000 >= older_than:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return gone

    def stats(self) -> dict[str, int]:
        m, g = self.manifest(), self.graph()
        return {"version": m.version, "folders": len(m.folders), "nodes": g.nodes.count(), "edges": g.edges.count()}
