"""The reference graph: nodes, edges, reachability and clusters."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from .joins import MOST_LOG2_WORDS, SALTS, hot_keys, maybe_among, salted_join


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; on one machine a temporary one if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table of which nothing is read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_of(spark: SparkSession, path: str):
    """The file system of `path`, and the names in that folder; none if it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def build_nodes(components: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(key, kind, label, ctype, ref_id, is_entry_point, entry_reason) of components and files.

    A file is an entry if its type runs or is seen by itself, unless it is inactive or a test.
    """
    own = components.select(
        F.concat(F.lit("c:"), F.col("id").cast("string")).alias("key"), F.lit("component").alias("kind"), F.col("api_name").alias("label"), "ctype", F.col("id").alias("ref_id"),
        F.coalesce("is_entry_point", F.lit(False)).alias("is_entry_point"), F.when(F.col("is_entry_point"), "externally invocable").alias("entry_reason"),
    )
    runs = F.col("metadata_type").isin(*V.ENTRY_POINT_TYPES) & F.col("is_active") & ~F.col("is_test")
    files = artifacts.select(
        F.concat(F.lit("a:"), F.col("artifact_id").cast("string")).alias("key"), F.lit("artifact").alias("kind"), F.col("member_name").alias("label"), F.col("metadata_type").alias("ctype"), F.col("artifact_id").alias("ref_id"),
        runs.alias("is_entry_point"), F.when(runs, F.concat(F.lit("active "), F.col("metadata_type"))).alias("entry_reason"),
    )
    return own.unionByName(files)


def build_edges(edges: DataFrame, components: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(src, dst, kind): references of tier A and B, implements (component to its file), declares, member_of; no loops."""
    c, a = lambda x: F.concat(F.lit("c:"), F.col(x).cast("string")), lambda x: F.concat(F.lit("a:"), F.col(x).cast("string"))
    refs = edges.filter("tier in ('A', 'B')").select(a("artifact_id").alias("src"), c("component_id").alias("dst"), F.lit("reference").alias("kind"))
    named = components.select("id", F.col("ctype").alias("metadata_type"), F.lower("api_name").alias("name"))
    own = artifacts.select("artifact_id", "metadata_type", F.lower("member_name").alias("name")).join(named, ["metadata_type", "name"])
    implements = own.select(c("id").alias("src"), a("artifact_id").alias("dst"), F.lit("implements").alias("kind"))
    declares = own.select(a("artifact_id").alias("src"), c("id").alias("dst"), F.lit("declares").alias("kind"))
    member = components.filter("parent_id is not null").select(c("id").alias("src"), c("parent_id").alias("dst"), F.lit("member_of").alias("kind"))
    order = F.when(F.col("kind") == "declares", 3).when(F.col("kind") == "member_of", 2).otherwise(F.when(F.col("kind") == "implements", 1).otherwise(0))
    every = refs.unionByName(implements).unionByName(declares).unionByName(member).filter("src != dst")
    return every.groupBy("src", "dst").agg(F.min_by("kind", order).alias("kind"))


class _Levels:
    """Breadth-first levels of (start, node), each in a folder of its own, in parts by the node's hash.

    Nothing is written twice: a level reads the parts of the edges in which its frontier lies, and of the earlier levels
    the parts in which what it found lies, to leave that out. The edges of a source are lists, so a level that needs all
    of them shuffles a row for each source, and none for each edge. A source of more than a thousandth of all edges, and of
    more than 10,000, has many lists and is looked up apart (salted_join). A frontier of at most `MOST_SENT` rows is
    broadcast, and the lists stay where they are. Sorts go by a hash first, since numbers are compared sooner than names.
    """

    #: Edges of a part, about, and the bounds of the number of parts. A list of a hot source has about so many edges.
    EDGES_PER_PART, LEAST_PARTS, MOST_PARTS, LIST = 1_000_000, 4, 1024, 1000
    #: Rows of a frontier, or of earlier levels, that may be broadcast: names alone, and with their paths.
    MOST_SENT, MOST_PATHS_SENT = 1 << 20, 1 << 16
    #: A frontier of fewer rows than a WIDE-th of the edges sends a Bloom filter to the lists before they are shuffled.
    WIDE = 32

    def __init__(self, edges: DataFrame, keep_path: int):
        """`edges`: src, dst, first, which may repeat; an edge that isn't `first` leads on only from beyond the seeds. With
        `keep_path`, rows have the last so many nodes of their path and its first, the root."""
        self.spark, self.keep = edges.sparkSession, keep_path
        self.base = f"{shared_folder(self.spark)}/levels-{uuid.uuid4().hex}"
        plain = cut(edges, "edges")
        self.n = n = plain.count()
        self.parts = max(self.LEAST_PARTS, min(self.MOST_PARTS, n // self.EDGES_PER_PART))
        self.part = lambda c: F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")
        hot = hot_keys(plain, ["src"], 10_000).collect()  # fewer than 1000
        self.hot = self.spark.createDataFrame(hot, plain.select("src").schema) if hot else None
        self.kind = plain.schema["src"].dataType
        lists, own = plain.withColumn("hash", F.xxhash64("src")), ["hash", "src", "first"]
        if hot:
            lists, own = lists.withColumn("chunk", F.when(F.col("src").isin([r["src"] for r in hot]), F.pmod(F.xxhash64("dst"), F.lit(n // self.LIST + 1))).otherwise(0)), [*own, "chunk"]
        # dealt first: sums of each task's own edges would be nearly as many rows
        lists = lists.repartition(*own).groupBy(*own).agg(F.array_distinct(F.collect_list("dst")).alias("dsts"))
        self.edges = self._written(lists, "edges", "src", F.pmod("chunk", F.lit(SALTS)) if hot else F.lit(0))
        for path in {f.rsplit("/", 1)[0] for f in plain.inputFiles()}:
            remove(self.spark, path)
        self.levels: list[tuple[str, set[int], T.StructType]] = []

    def _written(self, df: DataFrame, name: str, by: str, dealt: Column | None = None) -> tuple[str, set[int], T.StructType]:
        """Write `df` in parts by column `by`; the folder, the parts that have rows, and the schema.

        A part is written by several tasks where `dealt` differs: by default, where many starts lead to one node.
        """
        path, dealt = f"{self.base}/{name}", F.pmod(F.xxhash64("start"), F.lit(8)) if dealt is None else dealt
        df.withColumn("part", self.part(by)).repartition("part", dealt).write.partitionBy("part").option("compression", "zstd").parquet(path)
        files = self.spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path).inputFiles()
        return path, {int(f.rsplit("part=", 1)[1].split("/", 1)[0]) for f in files}, df.schema

    def _read(self, tables: list[tuple[str, set[int], T.StructType]], parts: set[int]) -> DataFrame | None:
        """Those `parts` of the tables; whole folders where that is more than half of them, since each path is looked up."""
        paths = []
        for path, have, _ in tables:
            asked = sorted(have & parts)
            paths += [path] if len(asked) * 2 > len(have) else [f"{path}/part={k}" for k in asked]
        return self.spark.read.schema(tables[0][2]).option("recursiveFileLookup", True).parquet(*paths) if paths else None

    def _meet(self, rows: DataFrame, table: DataFrame, keys: list[str], source: str, few: bool) -> DataFrame:
        """`rows` joined with `table`, which is sent to all tasks if it has `few` rows; not for its small size on disk."""
        if few:
            return rows.join(F.broadcast(table), keys)
        if self.hot is None:
            return rows.join(table.hint("merge"), keys)
        return salted_join(rows, table, keys, hot=rows.join(F.broadcast(self.hot.withColumnRenamed("src", source)), source, "left_semi").select(*keys).distinct())

    def run(self, seeds: DataFrame, most_hops: int | None) -> DataFrame:
        """(start, node, hops, path, root) of all that `seeds` (start, node) lead to, themselves at 0 hops; of a node's
        predecessors in the level before, the path has the smallest. If anything is further away than `most_hops`, that is
        an error."""
        none = F.lit(None).cast(self.kind)
        own = seeds.select("start", "node").distinct().withColumn("hops", F.lit(0))
        own = own.withColumn("path", F.array("node")).withColumn("root", F.col("node")) if self.keep else own.withColumn("path", F.array().cast(T.ArrayType(self.kind))).withColumn("root", none)
        self.levels, known = [self._written(own, "level-0", "node")], 0
        for hop in itertools.count(1):
            path, parts, schema = self.levels[-1]
            ways, frontier = self._read([self.edges], parts), self._read([self.levels[-1]], parts)
            if ways is None or frontier is None:
                break
            n = frontier.count()  # of the files' footers
            known += n
            lists = (ways.filter("first") if hop == 1 else ways).select("hash", "src", "dsts")
            if self.MOST_SENT < n <= min(8 << MOST_LOG2_WORDS, self.n // self.WIDE):
                lists = maybe_among(lists, frontier.select(F.col("node").alias("src")), ["src"], n)
            onward = self._meet(lists, frontier.select(F.xxhash64("node").alias("hash"), "start", F.col("node").alias("src")), ["hash", "src"], "src", n <= self.MOST_SENT)
            onward = onward.select("start", F.explode("dsts").alias("node"), *(["src"] if self.keep else []))
            onward = onward.withColumn("hash", F.xxhash64("start", "node"))
            fresh = onward.groupBy("hash", "start", "node").agg(F.min("src").alias("via")) if self.keep else onward.distinct()
            touched, found = set(range(self.parts)), None
            if len(parts) < self.parts:  # a frontier that lies in all parts leads to all, too
                found = self._written(fresh, f"found-{hop}", "node")
                touched, fresh = found[1], self._read([found], found[1])
                if fresh is None:
                    break
            if (seen := self._read(self.levels, touched)) is not None:
                seen = seen.select(F.xxhash64("start", "node").alias("hash"), "start", "node")
                fresh = fresh.join(F.broadcast(seen) if known <= self.MOST_SENT else seen.hint("merge"), ["hash", "start", "node"], "left_anti")
            if self.keep:
                whole = F.concat("before", F.array("node"))
                last = F.slice(whole, F.greatest(F.size(whole) - self.keep + 1, F.lit(1)), F.lit(self.keep))
                fresh = self._meet(fresh.withColumn("hash", F.xxhash64("start", "via")), frontier.select(F.xxhash64("start", "node").alias("hash"), "start", F.col("node").alias("via"), F.col("path").alias("before"), "root"), ["hash", "start", "via"], "via", n <= self.MOST_PATHS_SENT).select("start", "node", F.lit(hop).alias("hops"), last.alias("path"), "root")
            else:
                fresh = fresh.select("start", "node", F.lit(hop).alias("hops"), F.array().cast(T.ArrayType(self.kind)).alias("path"), none.alias("root"))
            level = self._written(fresh, f"level-{hop}", "node")
            if found:
                remove(self.spark, found[0])
            if not level[1]:
                break
            if most_hops is not None and hop > most_hops:
                raise RuntimeError(f"nodes are still found after {most_hops} hops")
            self.levels.append(level)
        remove(self.spark, self.edges[0])
        return self.spark.read.schema(self.levels[0][2]).option("recursiveFileLookup", True).parquet(*[path for path, _, _ in self.levels])


def reachability(nodes: DataFrame, edges: DataFrame, most_hops: int | None = None, keep_path: int = 12) -> DataFrame:
    """(key, distance, path, root) of what can be reached from the entry points, level by level until nothing is new.

    ``declares`` is never crossed, ``member_of`` only from beyond an entry point. A node keeps its smallest predecessor;
    path lists the keys up to the node, the last `keep_path` of them, and root is the entry. If nodes are further away
    than `most_hops`, that is an error. `nodes` needs key and is_entry_point.
    """
    steps = edges.filter("kind != 'declares'").select("src", "dst", (F.col("kind") != "member_of").alias("first"))
    seeds = nodes.filter("is_entry_point").select(F.lit(0).alias("start"), F.col("key").alias("node"))
    return _Levels(steps, keep_path).run(seeds, most_hops).select(F.col("node").alias("key"), F.col("hops").alias("distance"), "path", "root")


def path_to_root(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, labels, root): the labels from the node back to its entry point, as far as its path is kept; its entry's label."""
    named = reached.select("key", F.posexplode("path").alias("n", "step")).join(nodes.select(F.col("key").alias("step"), "label"), "step")
    lists = named.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))).alias("l"))
    roots = reached.select("key", F.col("root").alias("step")).join(nodes.select(F.col("key").alias("step"), F.col("label").alias("root")), "step").select("key", "root")
    return lists.join(roots, "key", "left").select("key", F.transform("l", lambda x: x["label"]).alias("labels"), "root")


def reachability_evidence(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Evidence of reachability for each component node: being an entry point itself is no evidence of use."""
    inbound = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("inbound"))
    joined = nodes.filter("kind = 'component'").join(reached, "key", "left").join(inbound, "key", "left")
    entry = F.col("is_entry_point") & (F.col("distance") == 0)
    hit = F.col("distance").isNotNull() & ~entry
    payload = F.to_json(F.struct(F.col("distance").isNotNull().alias("reachable"), entry.alias("self_entry_point"), F.col("distance").alias("hops_from_entry_point"), "path", F.coalesce("inbound", F.lit(0)).alias("inbound_edges")))
    return joined.select(F.col("ref_id").alias("component_id"), F.lit(V.REACHABILITY).alias("collector_id"), F.when(hit, V.HIT).otherwise(V.MISS).alias("result"), F.when(hit, "A").alias("tier"), F.when(hit, 1.0).otherwise(0.0).alias("weight"), payload.alias("payload"))


#: A round of `components` is written by so many tasks at most, and by one more for each so many links.
LEAST_TASKS, LINKS_OF_TASK = 8, 10_000


def _with_least(links: DataFrame, key: str, least: DataFrame, hot: list) -> DataFrame:
    """`links` (a, b) with m, what `least` (a, m) says of column `key`, or null. Of the `hot` keys, fewer than 1000, m is
    fetched and broadcast, so that their links don't meet in one task. Nothing else is: written links are small files of
    many rows, which Spark would send through the driver each round for their size on disk."""
    named = least.select(F.col("a").alias(key), "m").hint("merge")
    if not hot:
        return links.join(named, key, "left").select("a", "b", "m")
    kind = links.schema[key].dataType.simpleString()
    known = {r[key]: r["m"] for r in named.filter(F.col(key).isin(hot)).collect()}  # at once: an iterator is a job for each partition
    few = links.sparkSession.createDataFrame([(k, known.get(k)) for k in hot], f"{key} {kind}, m {kind}")
    warm = links.filter(F.col(key).isin(hot)).join(F.broadcast(few), key).select("a", "b", "m")
    return links.filter(~F.col(key).isin(hot)).join(named, key, "left").select("a", "b", "m").unionByName(warm)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of `edges` (a, b): the smallest node that it is connected with.

    Alternating large and small stars: every round links nodes to the smallest node known near them, so that long chains
    shrink exponentially, until nothing changes; each round is written to the shared folder, few links by few tasks. A node with more than a
    thousandth of all links, and more than 100, would meet them in one task: there are fewer than 1000 such nodes a
    side, and they are looked up apart. Nothing else is collected but two numbers a round.
    """
    links = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = cut(links, "links"), None
    while True:
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
        tasks = after[0] // LINKS_OF_TASK + LEAST_TASKS
        ends = links.select(F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("node")) for c in ("a", "b")])).alias("e")).select("e.*")
        found = ends.groupBy("side", "node").agg(F.count("*").alias("n")).filter(F.col("n") * 1000 > F.greatest(F.lit(after[0]), F.lit(100_000))).collect()
        hot = {c: [r["node"] for r in found if r["side"] == c] for c in ("a", "b")}
        # large star: a takes the smallest neighbour of its smaller neighbour, or that one
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        large = _with_least(links, "b", least, hot["b"]).select("a", F.coalesce("m", "b").alias("b")).distinct()
        if hot["a"]:
            large = cut(large.coalesce(tasks), "links")
        # small star: all smaller neighbours of a take the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, "a", least, hot["a"]).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks), "links")


def clusters(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster): connected components of `edges` (src, dst) among `members` (node); cluster is the smallest node.
    A member without such an edge is its own cluster."""
    nodes = members.select("node").distinct()
    among = lambda c: nodes.select(F.col("node").alias(c)).hint("merge")
    inside = edges.select("src", "dst").distinct().join(among("src"), "src", "left_semi").join(among("dst"), "dst", "left_semi")
    found = components(inside.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, direction, other): one hop in and out of `nodes` (node)."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other"))
    return out.unionByName(back).join(nodes.select("node"), "node", "left_semi").distinct()


def closure(edges: DataFrame, starts: DataFrame, direction: str = "descendants", most_hops: int | None = None) -> DataFrame:
    """(start, node, hops) of all that `starts` (node) lead to, or with direction="ancestors" all that lead to them.

    If that is further than `most_hops`, it is an error.
    """
    step = edges.select("src", "dst") if direction == "descendants" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = _Levels(step.withColumn("first", F.lit(True)), 0).run(starts.select(F.col("node").alias("start"), "node"), most_hops)
    return found.filter("hops > 0").select("start", "node", "hops")


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): edges in and out."""
    return edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def sample_subgraph(nodes: DataFrame, edges: DataFrame, reached: DataFrame, most_nodes: int = 400, around: int = 6, hops: int = 6) -> DataFrame:
    """(key, place): at most `most_nodes` nodes worth drawing; unreachable ones first, then entry points, each with up to
    `around` neighbours in and out and the last `hops` nodes of its path."""
    from pyspark.sql import Window as W

    rank = F.when(F.col("distance").isNull(), 0).when(F.col("is_entry_point"), 1).otherwise(2)
    ranked = nodes.join(reached, "key", "left").withColumn("rank", rank).select("key", "rank", "path").orderBy("rank", "key").limit(most_nodes)
    # written, since it is read four times: at most most_nodes rows, which may be broadcast
    ranked = cut(ranked.withColumn("place", F.row_number().over(W.orderBy("rank", "key"))), "ranked")
    asked = F.broadcast(ranked.select("key", "place"))

    def few(own: str, other: str) -> DataFrame:
        near = edges.select(F.col(own).alias("key"), F.col(other).alias("add")).join(F.broadcast(ranked.select("key")), "key", "left_semi")  # Spark moves it below what makes edges distinct
        return near.join(asked, "key").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("add"))).filter(F.col("n") <= around).select("add", "place")

    chain = ranked.select(F.explode(F.slice(F.coalesce("path", F.array().cast("array<string>")), -1 * F.least(F.lit(hops), F.greatest(F.size(F.coalesce("path", F.array().cast("array<string>"))), F.lit(1))), F.lit(hops))).alias("add"), "place")
    every = ranked.select(F.col("key").alias("add"), "place").unionByName(few("src", "dst")).unionByName(few("dst", "src")).unionByName(chain)
    first = every.groupBy(F.col("add").alias("key")).agg(F.min("place").alias("first"))
    return first.orderBy("first", "key").limit(most_nodes).withColumn("place", F.row_number().over(W.orderBy("first", "key"))).select("key", "place")
