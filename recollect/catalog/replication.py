"""Operation log, clock and ring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.operators import replication as RP

CHECKPOINT = 500


def oplog(spark, sf):
    """Every event as one log record; records whose k is 13 carry a broken checksum."""
    log = I.query_log(spark, sf)
    op = (
        F.when(F.col("event_type") == "error", RP.REMOVE).when(F.col("event_type") == "signup", RP.EVICT)
        .when(F.col("event_type") == "click", RP.UPDATE_THRESHOLD).otherwise(RP.STORE)
    )
    rows = log.select(
        (F.col("seq") + 1).alias("lsn"), op.alias("op"), (F.col("k") * 10 + F.col("tenant_id") % 10).alias("entry_id"),
        F.encode(F.concat(F.lit("v"), F.col("seq").cast("string")), "UTF-8").alias("payload"), "k",
    )
    crc = RP.record_crc(F.col("lsn"), F.col("op"), F.col("payload"))
    return rows.select("lsn", "op", "entry_id", "payload", (crc + F.when(F.col("k") == 13, 1).otherwise(0)).alias("crc"))


SQL_OPLOG = f"""{I.SQL_LOG},
oplog AS (SELECT seq + 1 AS lsn, CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 1 END AS op,
            k * 10 + tenant_id % 10 AS entry_id, 'v' || CAST(seq AS VARCHAR) AS payload, k <> 13 AS good FROM query_log),
valid AS (SELECT * FROM oplog WHERE good AND lsn > {CHECKPOINT})"""


@query(
    "replay_oplog",
    f"""WITH {SQL_OPLOG}, s AS (SELECT entry_id, max(lsn) FILTER (op = 1) AS stored, coalesce(max(lsn) FILTER (op IN (2, 3)), -1) AS gone,
            max_by(payload, lsn) FILTER (op = 1) AS payload, max(lsn) FILTER (op = 4) AS tuned, max_by(payload, lsn) FILTER (op = 4) AS threshold
          FROM valid GROUP BY entry_id)
        SELECT entry_id, stored AS lsn, payload, CASE WHEN tuned > gone THEN threshold END AS threshold FROM s WHERE stored > gone""",
)
def replay_oplog(spark, sf):
    state = RP.replay_oplog(oplog(spark, sf), CHECKPOINT)
    return state.select("entry_id", "lsn", F.decode("payload", "UTF-8").alias("payload"), F.decode("threshold", "UTF-8").alias("threshold"))


@query("checkpoint_oplog", f"WITH {SQL_OPLOG} SELECT lsn, op, entry_id FROM valid")
def checkpoint_oplog(spark, sf):
    return RP.checkpoint_oplog(oplog(spark, sf), CHECKPOINT).select("lsn", "op", "entry_id")


@query(
    "oplog_status",
    f"WITH {SQL_OPLOG} SELECT max(lsn) FILTER (good) AS current_lsn, count(*) FILTER (good) AS intact, count(*) FILTER (NOT good) AS broken FROM oplog",
)
def oplog_status(spark, sf):
    return RP.oplog_status(oplog(spark, sf))


@query("broken_records", f"WITH {SQL_OPLOG} SELECT lsn, op, entry_id FROM oplog WHERE NOT good")
def broken_records(spark, sf):
    return RP.broken_records(oplog(spark, sf)).select("lsn", "op", "entry_id")


def clocks(spark, sf):
    """Per entry and replica: how often each node wrote to it."""
    log = I.query_log(spark, sf)
    counts = log.groupBy(
        F.col("k").alias("entry_id"), F.concat(F.lit("r"), (F.col("tenant_id") % 2).cast("string")).alias("replica"),
        F.concat(F.lit("n"), (F.col("query_id") % 3).cast("string")).alias("node"),
    ).agg((F.count(F.lit(1)) / 10).cast("bigint").alias("n"))
    return counts.groupBy("entry_id", "replica").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("clock"))


SQL_CLOCKS = f"""{I.SQL_LOG},
clocks AS (SELECT k AS entry_id, 'r' || CAST(tenant_id % 2 AS VARCHAR) AS replica, 'n' || CAST(query_id % 3 AS VARCHAR) AS node,
             CAST(floor(count(*) / 10.0) AS BIGINT) AS n FROM query_log GROUP BY ALL)"""


@query("merge_clocks", f"WITH {SQL_CLOCKS} SELECT entry_id, node, max(n) AS n FROM clocks GROUP BY entry_id, node")
def merge_clocks(spark, sf):
    merged = RP.merge_clocks(clocks(spark, sf))
    return merged.select("entry_id", F.explode("clock").alias("node", "n"))


@query(
    "clock_order",
    f"""WITH {SQL_CLOCKS}, both_sides AS (
          SELECT coalesce(a.entry_id, b.entry_id) AS entry_id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y
          FROM (SELECT * FROM clocks WHERE replica = 'r0') a FULL JOIN (SELECT * FROM clocks WHERE replica = 'r1') b
            ON a.entry_id = b.entry_id AND a.node = b.node),
        t AS (SELECT entry_id, bool_or(x < y) AS less, bool_or(x > y) AS more FROM both_sides
              WHERE entry_id IN (SELECT entry_id FROM clocks GROUP BY 1 HAVING count(DISTINCT replica) = 2) GROUP BY 1)
        SELECT entry_id, CASE WHEN less AND more THEN 'concurrent' WHEN less THEN 'before' WHEN more THEN 'after' ELSE 'equal' END AS relation,
          less = more AS is_concurrent FROM t""",
)
def clock_order(spark, sf):
    c = clocks(spark, sf)
    return RP.clock_order(c.filter("replica = 'r0'"), c.filter("replica = 'r1'"))


NODES = ["node-1", "node-2", "node-3"]
MORE = [*NODES, "node-4"]


def _sql_ring(nodes: list[str], name: str = "ring") -> str:
    listed = ", ".join(f"'{n}'" for n in nodes)
    return f"""{name} AS (SELECT CAST(('0x' || substr(sha256(node || '#vn' || CAST(i AS VARCHAR)), 1, 16))::UBIGINT AS HUGEINT) AS pos, node
  FROM (SELECT unnest([{listed}]) AS node), (SELECT unnest(range(150)) AS i))"""


def _sql_assign(keys: str, ring: str, name: str) -> str:
    return f"""{name} AS (SELECT k.key, coalesce(r.node, (SELECT node FROM {ring} ORDER BY pos LIMIT 1)) AS node
  FROM {keys} k ASOF LEFT JOIN {ring} r ON k.pos < r.pos)"""


SQL_CUSTOMERS = """customers AS (SELECT c_name AS key, CAST(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT AS HUGEINT) AS pos FROM customer)"""


def customers(spark, sf):
    return I.table(spark, sf, "customer").select(F.col("c_name").alias("key"))


@query("ring_assign", f"WITH {_sql_ring(NODES)}, {SQL_CUSTOMERS}, {_sql_assign('customers', 'ring', 'assigned')} SELECT * FROM assigned")
def ring_assign(spark, sf):
    return RP.ring_assign(customers(spark, sf), "key", NODES).select("key", "node")


@query(
    "ring_replicas",
    f"""WITH {_sql_ring(MORE)}, {SQL_CUSTOMERS},
        near AS (SELECT key, node, min(CASE WHEN r.pos > c.pos THEN r.pos - c.pos ELSE r.pos - c.pos + 18446744073709551616::HUGEINT END) AS d
                 FROM customers c, ring r GROUP BY key, node)
        SELECT key, array_to_string(list(node ORDER BY d)[1:3], ',') AS replicas FROM near GROUP BY key""",
)
def ring_replicas(spark, sf):
    return RP.ring_assign(customers(spark, sf), "key", MORE).select("key", F.array_join("replicas", ",").alias("replicas"))


@query(
    "ring_rebalance",
    f"""WITH {_sql_ring(NODES, 'ring_a')}, {_sql_ring(MORE, 'ring_b')},
        ks AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS key, CAST(('0x' || substr(sha256('order-' || CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT AS HUGEINT) AS pos FROM orders),
        {_sql_assign('ks', 'ring_a', 'before')}, {_sql_assign('ks', 'ring_b', 'after')}
        SELECT b.node AS from_node, a.node AS to_node, count(*) AS keys, b.node <> a.node AS moved
        FROM before b JOIN after a USING (key) GROUP BY b.node, a.node""",
)
def ring_rebalance(spark, sf):
    keys = I.table(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("key"))
    return RP.ring_rebalance(keys, "key", NODES, MORE)


@query(
    "ring_load",
    f"WITH {_sql_ring(NODES)}, {SQL_CUSTOMERS}, {_sql_assign('customers', 'ring', 'assigned')} SELECT node, count(*) AS keys FROM assigned GROUP BY node",
)
def ring_load(spark, sf):
    return RP.ring_load(RP.ring_assign(customers(spark, sf), "key", NODES))
