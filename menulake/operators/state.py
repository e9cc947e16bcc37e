"""Operators with memory: a throttle and a spend ledger."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menulake.storage import saved

THROTTLE_US = 1_000_000


def throttle(events: DataFrame, keys: list[str], at: str, row_id: str, gap_us: int = THROTTLE_US) -> DataFrame:
    """Events at least gap_us after the last accepted one of their key.

    Rows are range partitioned and sorted by key and time, so a busy key is spread over many tasks.
    An event that far after its predecessor is accepted whatever was before, and so begins a burst.
    Each task decides its rows; only a burst that goes on from the task before is decided once more,
    with all its rows, as one group. One row a task tells where that is the case.
    """
    spark = events.sparkSession
    order = [*keys, at, row_id]
    names = events.columns
    named = F.to_json(F.struct(*keys))
    plain = events.withColumn("_key", F.coalesce(named, F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, burst, key, before, taken = TaskContext.get().partitionId(), -1, None, None, None
        for pdf in batches:
            bursts, keep = [], []
            for own, t in zip(pdf["_key"], pdf[at], strict=True):
                if own != key or t - before >= gap_us:
                    burst, taken = burst + 1, None
                ok = taken is None or t - taken >= gap_us
                key, before, taken = own, t, t if ok else taken
                bursts.append(burst)
                keep.append(ok)
            yield pdf.assign(_part=part, _burst=bursts, _ok=keep)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(plain.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(decide, f"{schema}, _part int, _burst long, _ok boolean"), "throttle")
    ends = F.struct(F.col("_burst"), F.col(at), F.col("_key"))
    border = rows.groupBy("_part").agg(F.min(ends).alias("first"), F.max(ends).alias("last")).orderBy("_part").collect()  # a row for each task
    owner: list[tuple[int, int, int]] = []  # a task whose first burst goes on, and the task and burst where it began
    last = None
    for i, b in enumerate(border):
        begins = (b["_part"], b["last"]["_burst"])
        if i and b["first"]["_key"] == border[i - 1]["last"]["_key"] and b["first"][at] - border[i - 1]["last"][at] < gap_us:
            owner.append((b["_part"], *last))
            if b["last"]["_burst"] == 0:
                begins = last
        last = begins
    if not owner:
        return rows.where("_ok").select(*names)
    goes_on = spark.createDataFrame([(p, 0, o, n_) for p, o, n_ in owner] + [(o, n_, o, n_) for o, n_ in {x[1:] for x in owner}], "_part int, _burst long, _of int, _nr long")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, row_id])
        keep, taken = [], None
        for t in pdf[at]:
            ok = taken is None or t - taken >= gap_us
            keep.append(ok)
            taken = t if ok else taken
        return pdf[keep][names]

    crossing = rows.join(F.broadcast(goes_on), ["_part", "_burst"]).groupBy("_of", "_nr").applyInPandas(again, events.schema)  # at most two rows a task are broadcast
    within = rows.join(F.broadcast(goes_on), ["_part", "_burst"], "left_anti").where("_ok").select(*names)
    return within.unionByName(crossing)


@dataclass
class Account:
    """What an account has spent and reserved, in the order of its calls."""

    spent: int = 0
    calls: int = 0
    unknown: int = 0
    open: dict = field(default_factory=dict)

    def decide(self, kind: str, ref: str, cents: int | None, call_cap: int, total_cap: int, max_calls: int | None) -> str:
        reserved = sum(self.open.values())
        if kind == "reserve":
            if cents is None or cents < 0 or cents > call_cap:
                return "over_call_cap"
            if ref in self.open:
                return "already_open"
            if max_calls is not None and self.calls + 1 > max_calls:
                return "over_calls"
            if self.spent + reserved + cents > total_cap:
                return "over_total_cap"
            self.calls += 1
            self.open[ref] = cents
            return "reserved"
        if ref not in self.open:
            return "no_reservation"
        held = self.open.pop(ref)
        if kind == "abandon" or cents is None:  # the call may have been paid: unknown is never free
            self.spent += held
            self.unknown += 1
            return "abandoned" if kind == "abandon" else "cost_unknown"
        self.spent += cents
        return "settled"


def in_order(calls: DataFrame, account: str, order: list[str]) -> DataFrame:
    """Rows of an account in one task and in order; tasks hold several accounts."""
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return calls.repartition(n, account).sortWithinPartitions(account, *order)


def ledger(calls: DataFrame, account: str, at: str, row_id: str, cost: str, call_cap: int, total_cap: int) -> DataFrame:
    """Each call accepted or refused: not over the cap of a call, nor over the account's with what
    was accepted before. A refused call costs nothing, so decisions depend on each other in order:
    an account's calls stream through one task, which holds two numbers of it."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, spent = object(), 0
        for pdf in batches:
            out = []
            for own, c in zip(pdf[account], pdf[cost], strict=True):
                key, spent = own, spent if own == key else 0
                ok = c <= call_cap and spent + c <= total_cap
                spent += c if ok else 0
                out.append((ok, spent))
            yield pdf.assign(accepted=[o for o, _ in out], spent=[s for _, s in out])

    schema = calls.withColumns({"accepted": F.lit(True), "spent": F.lit(0).cast("long")}).schema
    return in_order(calls, account, [at, row_id]).mapInPandas(decide, schema)


def reservations(calls: DataFrame, account: str, at: str, row_id: str, kind: str, ref: str, cents: str, call_cap: int, total_cap: int, max_calls: int | None = None) -> DataFrame:
    """The outcome of each entry of a ledger, with what its account has spent and reserved after it.

    A `reserve` sets cents aside, within the cap of a call, the number of calls and the account's cap
    over what is spent and set aside. A `settle` (of the same ref) replaces that by the cost, or by
    all of it if the cost is null; an `abandon` charges all of it. Entries without an open reservation
    change nothing. An account's entries stream through one task, in order."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), Account()
        for pdf in batches:
            out = []
            for own, what, which, c in zip(pdf[account], pdf[kind], pdf[ref], pdf[cents], strict=True):
                if own != key:
                    key, state = own, Account()
                outcome = state.decide(what, which, None if pd.isna(c) else int(c), call_cap, total_cap, max_calls)
                out.append((outcome, state.spent, sum(state.open.values()), state.unknown))
            yield pdf.assign(**{n: [o[i] for o in out] for i, n in enumerate(("outcome", "spent", "reserved", "unknown"))})

    zero = F.lit(0).cast("long")
    schema = calls.withColumns({"outcome": F.lit(""), "spent": zero, "reserved": zero, "unknown": zero}).schema
    return in_order(calls, account, [at, row_id]).mapInPandas(decide, schema)
