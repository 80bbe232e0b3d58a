"""The driver's tables as a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathrank.sources.catalog import EdgeTable, GraphCatalog, NodeTable
from pathrank.sources.shared import cut

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def dealt(df: DataFrame, parts: int | None, column: str) -> DataFrame:
    return df.repartition(parts, column) if parts else df


class Tables:
    """Tables and edge tables of one scale; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def purchases(self, parts: int | None = None) -> DataFrame:
        """parts: tasks that lines are dealt to, by order before they are joined and by customer afterwards."""
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
        orders = self.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        return dealt(dealt(orders, parts, "o_orderkey").join(dealt(lines, parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")), parts, "o_custkey")

    def bought(self, parts: int | None = None) -> DataFrame:
        return self.purchases(parts).groupBy(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.count("*").alias("n"))

    def bought_monthly(self) -> DataFrame:
        return self.purchases().groupBy(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("part"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.count("*").alias("n"))

    def buys_from(self) -> DataFrame:
        return self.purchases().groupBy(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))

    def line(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))

    def in_nation_c(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"))

    def in_nation_s(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))

    def in_region(self) -> DataFrame:
        return self.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))

    def did(self) -> DataFrame:
        return self.events.groupBy(F.col("user_id").alias("user"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))

    def customers(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("acctbal"))

    def segments(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("customer"), *[F.when(F.col("c_mktsegment") == s, F.lit(1.0).cast("double")).otherwise(F.lit(0.0).cast("double")).alias(s) for s in SEGMENTS])

    def first_orders(self) -> DataFrame:
        return self.orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.min(F.year("o_orderdate")).alias("first_order_year"))

    def parts(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice"))

    def suppliers(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("acctbal"))

    def graph(self, parts: int | None = None) -> GraphCatalog:
        """parts: tasks that customers, their purchases and nations are dealt to by customer; None: as Spark deals them."""
        nodes = {
            "Customer": {"Base": NodeTable(dealt(self.customers(), parts, "customer"), "customer", ("acctbal",)), "Segment": NodeTable(self.segments(), "customer", tuple(SEGMENTS)), "First_Order": NodeTable(self.first_orders(), "customer", ("first_order_year",))},
            "Part": {"Base": NodeTable(self.parts(), "part", ("size", "retailprice"))},
            "Supplier": {"Base": NodeTable(self.suppliers(), "supplier", ("acctbal",))},
        }
        edges = {
            "bought": EdgeTable(self.bought(parts), {"customer": "Customer", "part": "Part"}, ("quantity", "price", "n")),
            "buys_from": EdgeTable(self.buys_from(), {"customer": "Customer", "supplier": "Supplier"}, ("quantity", "n")),
            "line": EdgeTable(self.line(), {"order_id": "Order", "part": "Part", "supplier": "Supplier"}, ("quantity", "price", "discount")),
            "in_nation_c": EdgeTable(dealt(self.in_nation_c(), parts, "customer"), {"customer": "Customer", "nation": "Nation"}),
            "in_nation_s": EdgeTable(self.in_nation_s(), {"supplier": "Supplier", "nation": "Nation"}),
            "in_region": EdgeTable(self.in_region(), {"nation": "Nation", "region": "Region"}),
            "did": EdgeTable(self.did(), {"user": "User", "event_type": "EventType"}, ("value", "n")),
        }
        return GraphCatalog(nodes, edges)

    def monthly_graph(self, months: Sequence[str] | None = None) -> GraphCatalog:
        """Purchases by month: the edges are partitioned, the nodes hold for all months.

        The edges of some ``months`` alone are materialised: they are read once for each hop, version and run.
        """
        bought = self.bought_monthly()
        if months is not None:
            bought = cut(bought.where(F.col("month").isin(list(months))))
        edges = {"bought": EdgeTable(bought, {"customer": "Customer", "part": "Part"}, ("quantity", "price", "n"))}
        return GraphCatalog(self.graph().nodes, edges, "month")


#: The same tables for DuckDB, as named subqueries.
SQL = """WITH
purchases AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
bought AS (SELECT o_custkey AS customer, l_partkey AS part, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, count(*) AS n FROM purchases GROUP BY 1, 2),
bought_monthly AS (SELECT o_custkey AS customer, l_partkey AS part, strftime(o_orderdate, '%Y-%m') AS month, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, count(*) AS n FROM purchases GROUP BY 1, 2, 3),
buys_from AS (SELECT o_custkey AS customer, l_suppkey AS supplier, sum(l_quantity) AS quantity, count(*) AS n FROM purchases GROUP BY 1, 2),
line AS (SELECT l_orderkey AS order_id, l_partkey AS part, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem),
in_nation_c AS (SELECT c_custkey AS customer, c_nationkey AS nation FROM customer),
in_nation_s AS (SELECT s_suppkey AS supplier, s_nationkey AS nation FROM supplier),
in_region AS (SELECT n_nationkey AS nation, n_regionkey AS region FROM nation),
did AS (SELECT user_id AS "user", event_type, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3),
customers AS (SELECT c_custkey AS customer, c_acctbal AS acctbal FROM customer),
segments AS (SELECT c_custkey AS customer, SEGMENTS FROM customer),
first_orders AS (SELECT o_custkey AS customer, min(year(o_orderdate)) AS first_order_year FROM orders GROUP BY 1),
parts AS (SELECT p_partkey AS part, p_size AS size, p_retailprice AS retailprice FROM part),
suppliers AS (SELECT s_suppkey AS supplier, s_acctbal AS acctbal FROM supplier)
""".replace("SEGMENTS", ", ".join(f"cast(c_mktsegment = '{s}' AS int)::double AS {s}" for s in SEGMENTS))
