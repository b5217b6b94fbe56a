"""A graph derived from the lake, published only when it agrees with it.

Nodes and edges are Parquet frames. A canary asks one question twice, in SQL over
the lake and as a pattern over the *published* files; the two never share a plan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources.lake import Reader
from ..sources.publish import PublishTarget, publish_bytes, read_bytes
from .checks import Evidence, Verdict, multiset_difference


class GraphError(ValueError):
    pass


class ParityError(RuntimeError):
    def __init__(self, evidence: list[Evidence]) -> None:
        super().__init__("; ".join(map(str, evidence)))
        self.evidence = evidence


@dataclass(frozen=True)
class NodeSpec:
    name: str
    key: str
    sql: str


@dataclass(frozen=True)
class RelSpec:
    """``sql`` gives columns "from", "to" and properties."""

    name: str
    source: str
    target: str
    sql: str


@dataclass(frozen=True)
class Canary:
    name: str
    sql: str
    pattern: Callable[[Graph], DataFrame]


@dataclass(frozen=True)
class GraphSpec:
    name: str
    nodes: tuple[NodeSpec, ...]
    rels: tuple[RelSpec, ...]
    canaries: tuple[Canary, ...]

    def __post_init__(self) -> None:
        names = {n.name for n in self.nodes}
        for r in self.rels:
            if missing := {r.source, r.target} - names:
                raise GraphError(f"{r.name}: {sorted(missing)} are not declared")
        if not self.canaries:
            raise GraphError(f"{self.name} has no canary: nothing would show that it is wrong")


class Graph:
    """Read-only patterns over node and edge frames."""

    def __init__(self, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], keys: dict[str, str] | None = None, ends: dict[str, tuple[str, str]] | None = None) -> None:
        self._nodes, self._edges, self.keys, self.ends = nodes, edges, keys or {}, ends or {}

    def nodes(self, name: str) -> DataFrame:
        return self._nodes[name]

    def edges(self, name: str) -> DataFrame:
        return self._edges[name]

    def hop(self, rel: str, backward: bool = False) -> DataFrame:
        """(source columns, properties, target columns) along the edges, or against them. Both ends must be nodes."""
        source, target = self.ends[rel]
        a, b = self._named(source, "a_"), self._named(target, "b_")
        e = self.edges(rel)
        out = e.join(a, e["from"] == a[f"a_{self.keys[source]}"]).join(b, e["to"] == b[f"b_{self.keys[target]}"])
        first, last = (b, a) if backward else (a, b)
        return out.select(*first.columns, *[c for c in e.columns if c not in ("from", "to")], *last.columns)

    def _named(self, node: str, prefix: str) -> DataFrame:
        df = self.nodes(node)
        return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])

    def degree(self, rel: str, backward: bool = False, distinct: bool = True, name: str = "n") -> DataFrame:
        """(node, n): neighbours along the edges, or against them."""
        near, far = ("to", "from") if backward else ("from", "to")
        return self.edges(rel).groupBy(F.col(near).alias("node")).agg((F.count_distinct(far) if distinct else F.count(far)).alias(name))

    def meet(self, rel: str, where: Callable[[Column, Column], Column]) -> DataFrame:
        """Pairs of sources that point at the same target: (a)->(x)<-(b)."""
        e = self.edges(rel).select("from", "to").distinct()
        a, b = e.select(F.col("from").alias("a"), "to"), e.select(F.col("from").alias("b"), "to")
        return a.join(b, "to").where(where(F.col("a"), F.col("b"))).select("a", "b", F.col("to").alias("via"))

    def total(self, rel: str, prop: str) -> DataFrame:
        return self.edges(rel).agg(F.sum(prop).alias(prop))

    def reach(self, rel: str, start: DataFrame, max_hops: int) -> DataFrame:
        """(node, hops): nodes within so many hops of ``start`` (node), with the fewest hops.

        Each hop joins the frontier alone; what a hop has found is checkpointed, so that the next one doesn't find it again.
        """
        spark = start.sparkSession
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        e = self.edges(rel).select("from", "to").distinct()
        frontier = seen = start.select("node").distinct().withColumn("hops", F.lit(0))
        for k in range(1, max_hops + 1):
            step = frontier.join(e, F.col("node") == F.col("from")).select(F.col("to").alias("node")).distinct()
            frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k))
            if k < max_hops:
                frontier = frontier.checkpoint()
            seen = seen.unionByName(frontier)
        return seen


def build(spec: GraphSpec, reader: Reader, path: str) -> None:
    """Write node and edge frames; keys must be unique and edges must end at nodes."""
    for n in spec.nodes:
        df = reader.sql(n.sql)
        df.write.parquet(f"{path}/nodes/{n.name}")
        back = reader.spark.read.parquet(f"{path}/nodes/{n.name}")
        if back.groupBy(n.key).count().where(f"count > 1 or `{n.key}` is null").limit(1).count():
            raise GraphError(f"{n.name}: {n.key} is null or not unique")
    keys = {n.name: n.key for n in spec.nodes}
    for r in spec.rels:
        reader.sql(r.sql).write.parquet(f"{path}/rels/{r.name}")
        e = reader.spark.read.parquet(f"{path}/rels/{r.name}")
        for end, node in (("from", r.source), ("to", r.target)):
            n = reader.spark.read.parquet(f"{path}/nodes/{node}").select(F.col(keys[node]).alias("__k"))
            if e.join(n, e[end] == n["__k"], "left_anti").limit(1).count():
                raise GraphError(f"{r.name}: an edge's {end!r} is not a {node}")


def open_at(spark: SparkSession, spec_or_meta: GraphSpec | dict, path: str) -> Graph:
    meta = spec_or_meta if isinstance(spec_or_meta, dict) else describe(spec_or_meta)
    nodes = {n: spark.read.parquet(f"{path}/nodes/{n}") for n in meta["keys"]}
    edges = {r: spark.read.parquet(f"{path}/rels/{r}") for r in meta["ends"]}
    return Graph(nodes, edges, meta["keys"], {r: tuple(x) for r, x in meta["ends"].items()})


def describe(spec: GraphSpec) -> dict:
    return {"name": spec.name, "keys": {n.name: n.key for n in spec.nodes}, "ends": {r.name: [r.source, r.target] for r in spec.rels}}


def parity(spec: GraphSpec, reader: Reader, path: str) -> list[Evidence]:
    """Each canary's rows, as texts, must be equal multisets on both sides."""
    graph, out = open_at(reader.spark, spec, path), []
    for c in spec.canaries:
        # The two sides live in sessions of their own; rows meet in the reader's.
        lake, own = reader.sql(c.sql), c.pattern(graph)
        if len(lake.columns) != len(own.columns):
            out.append(Evidence(c.name, Verdict.FAIL, {"lake_columns": len(lake.columns), "graph_columns": len(own.columns)}))
            continue
        tmp = f"{path}/canaries/{c.name}"
        lake.write.mode("overwrite").parquet(tmp)
        lake = reader.spark.read.parquet(tmp)
        left, right = multiset_difference(lake, own.toDF(*lake.columns)).count(), multiset_difference(own, lake.toDF(*own.columns)).count()
        out.append(Evidence(c.name, Verdict.FAIL if left or right else Verdict.PASS, {"lake_rows": lake.count(), "graph_rows": own.count(), "only_in_lake": left, "only_in_graph": right}))
    return out


def _plain(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def publish(spec: GraphSpec, reader: Reader, graph_dir: str) -> dict:
    """Build in a folder of its own, compare, then move the pointer to it: what no pointer names isn't published, so nothing is renamed.

    ``graph_dir`` is a local folder or a URI that Hadoop's file systems know. On any failure the old pointer stays and the new folder goes.
    """
    spark, root = reader.spark, _plain(graph_dir)
    path = f"{root}/{spec.name}-{reader.snapshot}-{uuid.uuid4().hex[:8]}"
    try:
        build(spec, reader, path)
        evidence = parity(spec, reader, path)
        if any(e.verdict is not Verdict.PASS for e in evidence):
            raise ParityError(evidence)
        _delete(spark, f"{path}/canaries")
        meta = {**describe(spec), "path": path, **reader.provenance(), "evidence": [e.to_dict() for e in evidence]}
        publish_bytes(PublishTarget(root, spark), f"{spec.name}.current.json", json.dumps(meta, default=str).encode(), overwrite=True)
    except BaseException:
        _delete(spark, path)
        raise
    return meta


def open_current(spark: SparkSession, graph_dir: str, name: str) -> tuple[Graph, dict]:
    raw = read_bytes(PublishTarget(_plain(graph_dir), spark), f"{name}.current.json")
    if raw is None:
        raise FileNotFoundError(f"no graph {name} in {graph_dir}")
    meta = json.loads(raw)
    return open_at(spark, meta, meta["path"]), meta
