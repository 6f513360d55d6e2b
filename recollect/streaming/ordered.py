"""Sequential rules on streams, in order of event time whatever the order of arrival.

Rows of a key wait in its state until the watermark has passed them; a timer then hands them on in order of time and
seq.  So the result does not depend on how rows fall into micro-batches or files, as long as they come within the
lateness that the watermark allows (later ones are dropped, as by any watermark).  The state of a rule goes once it
says no more than a fresh one.  Keys share state in parts by a hash, as most have few rows and each call costs.  What still waits when a stream ends is read back from the stream's own state store.

Needs the RocksDB state store, which ``run_ordered`` asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from recollect.config import DEFAULT, CacheConfig
from recollect.functions import text as T
from recollect.operators import machines as MC
from recollect.operators import rules as RL
from recollect.plans.blockscan import micros
from recollect.streaming.parts import part_of, plain_values

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Takes the state (None at first) and the columns of rows in order; gives the state after them and columns of output rows.
Advance = Callable[[tuple | None, dict[str, np.ndarray]], tuple[tuple, dict[str, list]]]


@dataclass(frozen=True)
class OrderedRule:
    """A rule for the rows of a key: what it reads besides ``at`` and ``seq``, what it writes, and how long it remembers.

    ``forgets(state)`` is the time in microseconds from which the state says no more than none at all; None: never.
    """

    reads: str
    state: str
    writes: str
    advance: Advance
    forgets: Callable[[tuple], int | None]


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then runs the rule over them in order, key by key.

    It is called once for each part of the keys.  A part keeps its rows as Arrow batches, and its states in one value.
    """

    def __init__(self, rule: OrderedRule, key: str, columns: list[str], states: str):
        self.rule, self.key, self.columns, self.states = rule, key, columns, states

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.state = handle.getValueState("state", self.states)
        self.done = set()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.pending.appendValue(_chunk(batch[self.columns]))
                low = int(batch["at"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first, timerValues)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:  # another timer of the part; the first has done all that the watermark has passed
            return
        self.done.add(key)
        until = timerValues.getCurrentWatermarkInMs()
        waiting = _frame(self.pending.get() if self.pending.exists() else [], self.columns)
        passed = (waiting["at"] // 1000 <= until).to_numpy(dtype=bool)
        rest = waiting[~passed]
        known = self.state.get() if self.state.exists() else None
        states = {} if known is None else {k: s for k, *s in zip(*known, strict=True)}
        if passed.any():
            out = _scan(self.rule, self.key, states, waiting[passed])
            if len(rest):
                self.pending.put([_chunk(rest)])
            else:
                self.pending.clear()
            if len(out):
                yield out
        ends = {k: self.rule.forgets(tuple(s)) for k, s in states.items()}
        kept = {k: s for k, s in states.items() if ends[k] is None or ends[k] // 1000 > until}
        if not kept:
            if known is not None:
                self.state.clear()
        elif passed.any() or len(kept) < len(states):
            self.state.update(tuple(list(c) for c in zip(*((k, *s) for k, s in kept.items()), strict=True)))
        wakes = [ends[k] for k in kept if ends[k] is not None]
        if len(rest):
            wakes.append(int(rest["at"].min()))
        if wakes:
            self._wake(min(wakes), timerValues)

    def _wake(self, at: int, timerValues) -> None:
        self.handle.registerTimer(max(at // 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def _chunk(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one element of the list that waits: an Arrow batch."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _frame(chunks: Iterable[tuple], columns: list[str]) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(bytes(c[0])).read_pandas() for c in chunks]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)


def _scan(rule: OrderedRule, key: str, states: dict, rows: pd.DataFrame) -> pd.DataFrame:
    """The rule's output for the rows of all keys of a part, in order within each; ``states`` then holds the states after them."""
    codes, keys = pd.factorize(rows[key], use_na_sentinel=False)
    rows = rows.assign(_code=codes).sort_values(["_code", "at", "seq"], ignore_index=True)
    starts = np.flatnonzero(np.diff(rows.pop("_code").to_numpy(), prepend=-1)).tolist()
    arrays = {c: rows[c].to_numpy() for c in rows.columns if c != key}
    of: list = []
    made: dict[str, list] = {}
    for k, a, b in zip(plain_values(pd.Series(keys)), starts, [*starts[1:], len(rows)], strict=True):
        before = states.get(k)
        after, out = rule.advance(None if before is None else tuple(before), {c: v[a:b] for c, v in arrays.items()})
        states[k] = after
        of += [k] * len(out["seq"])
        for c, values in out.items():
            made.setdefault(c, []).extend(values)
    return pd.DataFrame({key: of, **made}) if of else pd.DataFrame()  # columns without rows have no type


def in_order(stream: DataFrame, key: str, rule: OrderedRule, late: str) -> DataFrame:
    """The rule's output for the rows of each ``key`` (with ts, seq and what the rule reads) of a stream."""
    reads = [c.split()[0] for c in rule.reads.split(", ")] if rule.reads else []
    rows = stream.withWatermark("ts", late).select(part_of(key).alias("_part"), key, "ts", micros().alias("at"), "seq", *reads)
    types = dict(rows.dtypes)
    columns = [key, "at", "seq", *reads]
    states = ", ".join(f"{c} array<{kind}>" for c, kind in [(key, types[key]), *_fields(rule.state)])
    out = StructType.fromDDL(f"{key} {types[key]}, {rule.writes}")
    return rows.groupBy("_part").transformWithStateInPandas(
        statefulProcessor=InOrder(rule, key, columns, states), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in ddl.split(", ")]


@contextmanager
def _provider(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def waiting(spark: SparkSession, checkpoint: str, key: str, rule: OrderedRule) -> DataFrame:
    """The rule's output for the rows that wait in the state of an ended stream."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    rows = read("pending").select("key._part", "list_element.rows")
    states = read("state").select("key._part", "value.*")
    fields = [c for c in states.columns if c != "_part"]
    types = dict(states.dtypes)
    writes = f"{key} {types[key].removeprefix('array<').removesuffix('>')}, {rule.writes}"

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        chunks, known = group["rows"].dropna(), group[group["rows"].isna()]
        if not len(chunks):
            return pd.DataFrame()
        before = [] if not len(known) else zip(*(plain_values(pd.Series(list(known[c].iloc[0]))) for c in fields), strict=True)
        return _scan(rule, key, {k: s for k, *s in before}, _frame(((c,) for c in chunks), []))

    both = rows.unionByName(states, allowMissingColumns=True)
    return both.groupBy("_part").applyInPandas(finish, writes)


def run_ordered(stream: DataFrame, key: str, rule: OrderedRule, out: str, checkpoint: str, late: str) -> DataFrame:
    """Process what is there, append it to Parquet, and return it with what waits in the state at the end."""
    spark = stream.sparkSession
    made = in_order(stream, key, rule, late)
    with _provider(spark):
        writer = made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    emitted = spark.read.schema(made.schema).parquet(out)
    return emitted.unionByName(waiting(spark, checkpoint, key, rule).select(*emitted.columns))


def bucket_rule(rate: float, burst: int) -> OrderedRule:
    """Token bucket; forgotten when it is full again."""
    rule = RL.token_bucket(rate, burst)
    cap = rule.start[0]

    def advance(state: tuple | None, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, list]]:
        entered = rule.start if state is None else [int(x) for x in state]
        after, columns = rule.run(entered, rows, [None] * len(rows["at"]))
        return tuple(after), {"seq": rows["seq"].tolist(), **columns}

    return OrderedRule(
        "", "tokens bigint, last bigint", "seq bigint, allowed boolean, tokens double, retry_after_s double", advance,
        lambda s: int(s[1]) + round(burst / rate * 1e6 * (1 - s[0] / cap)) + 1,
    )


def breaker_rule(cfg: CacheConfig = DEFAULT) -> OrderedRule:
    """Circuit breaker; forgotten as soon as it is closed without failures."""
    rule = RL.breaker(cfg.breaker_failures, cfg.breaker_reset_s)

    def advance(state: tuple | None, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, list]]:
        entered = rule.start if state is None else [int(x) for x in state]
        after, columns = rule.run(entered, rows, [None] * len(rows["at"]))
        return tuple(after), {"seq": rows["seq"].tolist(), "ok": rows["ok"].tolist(), **columns}

    return OrderedRule(
        "ok boolean", "failures bigint, failed_at bigint", "seq bigint, ok boolean, state string, rejected boolean, state_after string",
        advance, lambda s: 0 if s[0] == 0 else None,
    )


def fusion_rule(cfg: CacheConfig = DEFAULT) -> OrderedRule:
    """Fused vectors of a session; forgotten when it has been idle for the time out."""
    blend = MC.session_context(cfg.session_alpha, cfg.session_decay)
    idle = int(cfg.session_timeout_s * 1_000_000)

    def advance(state: tuple | None, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, list]]:
        inner, last = (None, None) if state is None else ((list(state[0]), int(state[1])), int(state[2]))
        at = rows["at"]
        before = np.concatenate([[at[0] if last is None else last], at[:-1]])
        fresh = at - before > idle
        fresh[0] |= inner is None
        inner, columns = blend(inner, pd.DataFrame({"embedding": rows["embedding"], "turn": 0}), fresh)
        out = {c: rows[c].tolist() for c in ("seq", "query_id")} | {c: list(columns[c]) for c in ("fused", "turn")}
        return (inner[0], int(inner[1]), int(at[-1])), out

    return OrderedRule(
        "query_id bigint, embedding array<float>", "context array<double>, turns bigint, last bigint",
        "seq bigint, query_id bigint, fused array<double>, turn bigint", advance, lambda s: int(s[2]) + idle + 1,
    )


def dedup_rule(ttl_s: int = 86_400) -> OrderedRule:
    """The first request of a key and the first after each time to live; forgotten when that has passed."""
    span = ttl_s * 1_000_000

    def advance(state: tuple | None, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, list]]:
        at, last, kept, i = rows["at"], None if state is None else int(state[0]), [], 0
        while (i := i if last is None else int(np.searchsorted(at, last + span, "left"))) < len(at):
            kept.append(i)
            last = int(at[i])
        return (last,), {c: rows[c][kept].tolist() for c in ("seq", "query_id", "at")}

    return OrderedRule("query_id bigint", "last bigint", "seq bigint, query_id bigint, at bigint", advance, lambda s: int(s[0]) + span)


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Requests with their exact key, as ``dedup_rule`` takes them."""
    return requests.withColumn("exact_key", T.exact_key(F.col("query_text"), F.col("tenant_id"))).select("exact_key", "query_id", "seq", "ts")
