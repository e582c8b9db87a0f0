"""Synthetic tables of any size from spark.range, deterministic by seed; no row depends on another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows at scale 1, as the usual decision-support benchmark has them.
ROWS = {"region": 5, "nation": 25, "supplier": 10_000, "customer": 150_000, "part": 200_000, "orders": 1_500_000}
LINES = 4
FLAGS, STATUSES, SEGMENTS = ("A", "N", "R"), ("F", "O", "P"), ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _draw(seed: int, name: str, n: int) -> Column:
    """0 to n - 1 by the row's id."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), F.col("id")), F.lit(n))


def _pick(seed: int, name: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_draw(seed, name, len(values)) + 1).cast("int"))


def tables(spark: SparkSession, scale: float, seed: int = 42) -> dict[str, DataFrame]:
    """region, nation, supplier, customer, part, orders, lineitem; keys of each point into the others."""
    n = {t: r if t in ("region", "nation") else max(1, int(r * scale)) for t, r in ROWS.items()}
    ids = lambda t: spark.range(n[t])
    money = lambda name, top: (_draw(seed, name, top * 100) / 100).cast("double")
    day = F.timestamp_seconds(F.lit(694_224_000) + _draw(seed, "day", 2400) * 86_400).cast("timestamp_ntz")
    lines = spark.range(n["orders"] * LINES)
    return {
        "region": ids("region").select(F.col("id").cast("int").alias("r_regionkey"), F.concat(F.lit("REGION "), "id").alias("r_name")),
        "nation": ids("nation").select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("NATION "), "id").alias("n_name"), (F.col("id") % 5).cast("int").alias("n_regionkey")),
        "supplier": ids("supplier").select(F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), _draw(seed, "sn", 25).cast("int").alias("s_nationkey"), (money("sb", 11_000) - 1000).alias("s_acctbal")),
        "customer": ids("customer").select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), _draw(seed, "cn", 25).cast("int").alias("c_nationkey"), (money("cb", 11_000) - 1000).alias("c_acctbal"), _pick(seed, "cs", SEGMENTS).alias("c_mktsegment")),
        "part": ids("part").select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), F.concat(F.lit("Brand#"), _draw(seed, "pb", 25)).alias("p_brand"), (_draw(seed, "ps", 50) + 1).cast("int").alias("p_size"), (money("pp", 1000) + 900).alias("p_retailprice")),
        "orders": ids("orders").select(F.col("id").alias("o_orderkey"), _draw(seed, "oc", n["customer"]).alias("o_custkey"), _pick(seed, "os", STATUSES).alias("o_orderstatus"), money("op", 400_000).alias("o_totalprice"), day.alias("o_orderdate")),
        "lineitem": lines.select((F.col("id") / LINES).cast("long").alias("l_orderkey"), _draw(seed, "lp", n["part"]).alias("l_partkey"), _draw(seed, "ls", n["supplier"]).alias("l_suppkey"), (F.col("id") % LINES + 1).cast("int").alias("l_linenumber"), (_draw(seed, "lq", 50) + 1).cast("double").alias("l_quantity"), money("le", 90_000).alias("l_extendedprice"), (_draw(seed, "ld", 11) / 100).alias("l_discount"), _pick(seed, "lf", FLAGS).alias("l_returnflag"), day.alias("l_shipdate")),
    }


#: Name -> function(spark, scale, seed) -> {table: DataFrame}; recipes for generated data name them.
GENERATORS = {"star": tables}
