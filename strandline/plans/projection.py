"""Graph tables projected from the TPC-H-like tables (FIXTURES.md, section C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import mark
from ..tables import spread


class Projection:
    """The graph tables of one folder of tables, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._rows: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Rows of a table, from the footers of its files."""
        if name not in self._rows:
            self._rows[name] = self.table(name).count()
        return self._rows[name]

    def node(self) -> DataFrame:
        t = self.table("part").select((F.col("p_partkey").cast("long") + 1).alias("node"), F.col("p_brand").alias("chr"), F.col("p_size").cast("long").alias("len"), F.when(F.col("p_partkey") % 5 >= 2, 1).otherwise(0).alias("rank"))
        upto = F.sum(F.when(F.col("rank") == 0, F.col("len")).otherwise(0)).over(W.partitionBy("chr").orderBy("node"))
        ref = F.col("rank") == 0
        return t.withColumn("upto", upto).select("node", "chr", "len", "rank", F.when(ref, F.col("upto") - F.col("len") + 1).alias("start_pos"), F.when(ref, F.col("upto")).alias("end_pos"))

    def assembly(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("asm"), F.col("n_name").alias("name"))

    def offered(self) -> DataFrame:
        """Every node is offered to every assembly (a fixed list of 25), which visits some: asm, chr, node, ori, len, rank, by node."""
        n = self.node().select("node", "chr", "len", "rank").repartition("node")  # a small table is one split, which becomes many times as long here
        a = F.broadcast(self.assembly().select("asm"))
        visits = ((F.col("rank") == 0) & ((F.col("asm") == 0) | ((F.col("node") * 13 + F.col("asm") * 5) % 9 != 0))) | ((F.col("rank") == 1) & (F.col("asm") != 0) & ((F.col("node") + F.col("asm") * 7) % 3 == 0))
        return n.join(a, visits).withColumn("ori", F.when((F.col("rank") == 1) & ((F.col("node") * 31 + F.col("asm") * 7) % 11 == 0), "<").otherwise(">"))

    def step(self) -> DataFrame:
        """The nodes that each assembly visits, in order."""
        t = spread(self.offered(), self.rows("part") * 14, "asm", "chr")  # of 25 assemblies 14 visit a node
        w = W.partitionBy("asm", "chr").orderBy("node")
        return t.select("asm", "chr", "node", "ori", "len", "rank", (F.row_number().over(w).cast("long") - 1).alias("idx"), (F.sum("len").over(w) - F.col("len") + 1).alias("qpos"))

    def edge(self, step: DataFrame | None = None) -> DataFrame:
        w = W.partitionBy("asm", "chr").orderBy("idx")
        pairs = (self.step() if step is None else step).select(F.lag("node").over(w).alias("n1"), F.lag("ori").over(w).alias("o1"), F.col("node").alias("n2"), F.col("ori").alias("o2"))
        return pairs.filter("n1 is not null").select("n1", "n2", mark("o1", "o2", ">").alias("mark")).distinct()

    def _orders(self) -> DataFrame:
        """Lines of orders with their customers: the lines are moved once, by order, to what windows over orders need too."""
        order = self.table("orders").join(self.table("customer"), F.expr("o_custkey = c_custkey"))
        return spread(self.table("lineitem"), self.rows("lineitem"), "l_orderkey").join(order, F.expr("l_orderkey = o_orderkey"))

    def visit(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return self._orders().select(F.col("c_nationkey").cast("long").alias("asm"), F.col("l_orderkey").alias("path_id"), (F.col("l_partkey") + 1).alias("node"), F.when(F.col("l_returnflag") == "R", "<").otherwise(">").alias("ori"), (F.row_number().over(w).cast("long") - 1).alias("idx"))

    def alignment(self) -> DataFrame:
        n = self.node().select("node", "len")
        a, b = n.select(F.col("node").alias("node1"), F.col("len").alias("len1")), n.select(F.col("node").alias("node2"), F.col("len").alias("len2"))
        t = self._orders().join(a, F.expr("node1 = l_partkey + 1")).join(b, F.expr("node2 = l_partkey + 2 and l_linenumber % 3 <> 0"), "left")
        plen = F.col("len1") + F.coalesce("len2", F.lit(0))
        return t.select(F.col("c_nationkey").cast("long").alias("asm"), F.col("l_orderkey").alias("qname"), F.col("l_quantity").cast("long").alias("mapq"), "node1", "len1", "node2", "len2", plen.alias("plen"),
                        (F.col("l_suppkey") % F.col("len1")).alias("pstart"), (plen - F.when(F.col("node2").isNull(), 0).otherwise(F.col("l_orderkey") % F.col("len2"))).alias("pend"))

    def feature(self) -> DataFrame:
        start = 1 + (F.col("event_id") * 37) % 1000
        return self.table("events").select(F.col("event_id").alias("fid"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("chr"), start.alias("start_pos"), (start + F.floor("value").cast("long")).alias("end_pos"), F.col("event_type").alias("track"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"))

    def seq(self) -> DataFrame:
        h = F.translate(F.md5(F.col("node").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
        return self.node().select("node", F.substring(F.concat(h, h), F.lit(1), F.col("len").cast("int")).alias("seq"))

    def register(self) -> None:
        """Make the graph tables temporary views pg_node, pg_step, ... for spark.sql."""
        for name, make in {"node": self.node, "step": self.step, "edge": self.edge, "visit": self.visit, "aln": self.alignment, "feature": self.feature, "seq": self.seq}.items():
            make().createOrReplaceTempView(f"pg_{name}")
