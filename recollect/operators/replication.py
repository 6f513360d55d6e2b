"""Operation logs, version clocks and ring placement as table operators."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Operation codes of the log.
STORE, REMOVE, EVICT, UPDATE_THRESHOLD = 1, 2, 3, 4
VIRTUAL_NODES = 150
REPLICAS = 3
BROADCAST_RANGES = 1_000_000


# --- operation log ---------------------------------------------------------------------------


def record_crc(lsn: Column, op: Column, payload: Column) -> Column:
    """Checksum over header (length of operation and payload, lsn, operation) and payload.  Layout fixed by the contract."""
    header = F.unhex(
        F.concat(
            F.lpad(F.hex((F.octet_length(payload) + 1).cast("bigint")), 8, "0"),
            F.lpad(F.hex(lsn.cast("bigint")), 16, "0"),
            F.lpad(F.hex(op.cast("bigint")), 2, "0"),
        )
    )
    return F.crc32(F.concat(header, payload))


def _valid() -> Column:
    return F.col("crc") == record_crc(F.col("lsn"), F.col("op"), F.col("payload"))


def valid_records(oplog: DataFrame, checkpoint: int = 0) -> DataFrame:
    """Intact records after the checkpoint; the lsn filter reaches the scan."""
    return oplog.filter(F.col("lsn") > checkpoint).filter(_valid())


def replay_oplog(oplog: DataFrame, checkpoint: int = 0) -> DataFrame:
    """Latest state per entry: its last stored payload and threshold, unless removed since.

    One aggregation with map-side combining; the log order enters only through the lsn.
    """
    ops = valid_records(oplog, checkpoint)

    def last(*codes: int) -> Column:
        return F.max(F.when(F.col("op").isin(*codes), F.col("lsn")))

    def payload(code: int) -> Column:
        return F.max_by("payload", F.when(F.col("op") == code, F.col("lsn")))

    state = ops.groupBy("entry_id").agg(
        last(STORE).alias("stored"), last(REMOVE, EVICT).alias("gone"), payload(STORE).alias("payload"),
        last(UPDATE_THRESHOLD).alias("tuned"), payload(UPDATE_THRESHOLD).alias("threshold"),
    )
    removed = F.coalesce("gone", F.lit(-1))
    return state.filter(F.col("stored") > removed).select(
        "entry_id", F.col("stored").alias("lsn"), "payload",
        F.when(F.col("tuned") > removed, F.col("threshold")).alias("threshold"),
    )


def checkpoint_oplog(oplog: DataFrame, lsn: int) -> DataFrame:
    """The log without records up to ``lsn`` and without broken ones."""
    return valid_records(oplog, lsn)


def oplog_status(oplog: DataFrame) -> DataFrame:
    """Highest intact lsn, intact and broken records."""
    return oplog.agg(
        F.max(F.when(_valid(), F.col("lsn"))).alias("current_lsn"),
        F.count_if(_valid()).alias("intact"),
        F.count_if(~_valid()).alias("broken"),
    )


def broken_records(oplog: DataFrame) -> DataFrame:
    """Records whose checksum does not fit, for a look at what was lost."""
    return oplog.filter(~_valid())


# --- version clocks --------------------------------------------------------------------------


def merge_clocks(clocks: DataFrame) -> DataFrame:
    """entry_id -> element-wise maximum over all replicas."""
    top = clocks.select("entry_id", F.explode("clock").alias("node", "n")).groupBy("entry_id", "node").agg(
        F.max("n").alias("n")
    )
    return top.groupBy("entry_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias("clock")
    )


def clock_order(left: DataFrame, right: DataFrame) -> DataFrame:
    """before, after, equal or concurrent for two versions of the same entries.

    ``is_concurrent`` is the plain test "neither happens before the other", true for equal clocks.
    """
    pairs = left.select("entry_id", F.col("clock").alias("a")).join(
        right.select("entry_id", F.col("clock").alias("b")), "entry_id"
    )

    def either(op) -> Column:
        zero = F.lit(0).cast("bigint")
        diffs = F.map_values(F.map_zip_with("a", "b", lambda k, x, y: op(F.coalesce(x, zero), F.coalesce(y, zero))))
        return F.exists(diffs, lambda d: d)

    less, more = either(lambda x, y: x < y), either(lambda x, y: x > y)
    seen = pairs.withColumn("_less", less).withColumn("_more", more)
    order = (
        F.when(F.col("_less") & F.col("_more"), "concurrent")
        .when(F.col("_less"), "before").when(F.col("_more"), "after").otherwise("equal")
    )
    return seen.select("entry_id", order.alias("relation"), (F.col("_less") == F.col("_more")).alias("is_concurrent"))


# --- hash ring -------------------------------------------------------------------------------


def ring_hash(key: Column) -> Column:
    """Unsigned 64-bit position of a key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def _slice(position_hex: Column, digits: int) -> Column:
    return F.conv(F.substring(position_hex, 1, digits), 16, 10).cast("int")


def ring_ranges(
    spark: SparkSession, nodes: list[str], vnodes: int = VIRTUAL_NODES, replicas: int = REPLICAS, digits: int = 3
) -> DataFrame:
    """(slice, lo, hi, node, replicas): the key ranges [lo, hi) of the ring.

    A ring is configuration (nodes x virtual nodes), so it is laid out here once; ranges are
    cut at slices (leading hex digits of the position) to give an equality to join on.
    """
    placed = sorted(
        (int.from_bytes(hashlib.sha256(f"{n}#vn{i}".encode()).digest()[:8], "big"), n)
        for n in dict.fromkeys(nodes)
        for i in range(vnodes)
    )
    if not placed:
        return spark.createDataFrame([], "slice int, lo decimal(20,0), hi decimal(20,0), node string, replicas array<string>")
    positions = [p for p, _ in placed]
    width, top = 1 << (64 - 4 * digits), 1 << 64
    cuts = sorted({0, top, *positions, *range(0, top, width)})
    want = min(replicas, len(set(nodes)))
    # Positions of each node in ring order; a range's replicas are the nodes whose next position comes soonest.
    of_node: dict[str, list[int]] = {}
    for i, (_, node) in enumerate(placed):
        of_node.setdefault(node, []).append(i)

    def chain(owner: int) -> list[str]:
        def steps(node: str) -> int:
            at = of_node[node]
            after = bisect.bisect_left(at, owner)
            return at[after] - owner if after < len(at) else at[0] + len(placed) - owner

        return sorted(of_node, key=steps)[:want]

    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        owner = bisect.bisect_right(positions, lo) % len(positions)
        rows.append((lo // width, str(lo), str(hi), placed[owner][1], chain(owner)))
    ranges = spark.createDataFrame(rows, "slice int, lo string, hi string, node string, replicas array<string>")
    return ranges.select("slice", F.col("lo").cast("decimal(20,0)"), F.col("hi").cast("decimal(20,0)"), "node", "replicas")


def ring_assign(
    keys: DataFrame, key: str, nodes: list[str], vnodes: int = VIRTUAL_NODES, replicas: int = REPLICAS, digits: int = 3
) -> DataFrame:
    """Add node and replicas: the owner clockwise of each key and the next distinct nodes.

    Keys meet the ranges of their slice only.  The ranges are broadcast while nodes x vnodes
    plus slices stays below a fixed number of rows, else both sides are shuffled by slice.
    """
    ranges = ring_ranges(keys.sparkSession, nodes, vnodes, replicas, digits)
    if len(nodes) * vnodes + 16**digits <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    digest = F.sha2(F.col(key), 256)
    placed = keys.withColumn("_pos", ring_hash(F.col(key))).withColumn("slice", _slice(digest, digits))
    return (
        placed.join(ranges, "slice")
        .filter((F.col("_pos") >= F.col("lo")) & (F.col("_pos") < F.col("hi")))
        .select(*keys.columns, "node", "replicas")
    )


def ring_load(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))


def ring_rebalance(keys: DataFrame, key: str, before: list[str], after: list[str], vnodes: int = VIRTUAL_NODES) -> DataFrame:
    """How many keys go from which node to which when the ring changes (unmoved ones included)."""
    old = ring_assign(keys, key, before, vnodes, 1).withColumnRenamed("node", "from_node").drop("replicas")
    both = ring_assign(old, key, after, vnodes, 1).withColumnRenamed("node", "to_node")
    return both.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("keys")).withColumn(
        "moved", F.col("from_node") != F.col("to_node")
    )
