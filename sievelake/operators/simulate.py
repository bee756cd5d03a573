"""Replays of ordered events: caches and leases, one state for each key."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCENARIO = (
    "scenario string, vram_bytes long, ram_bytes long, policy string, pinned array<long>, "
    "ssd_bytes_s double, ssd_latency_s double, ram_bytes_s double, ram_latency_s double, prefetch_window_s double"
)
CACHE = (
    "scenario string, tokens long, accesses long, vram_hits long, ram_hits long, reads long, evictions long, bytes_ssd long, bytes_ram long, "
    "stall double, hidden double, issued_bytes long, useful_bytes long, wasted_bytes long"
)


class Tier:
    """Pages in a tier of limited bytes; the least recent (or least frequent) ones that aren't pinned leave."""

    def __init__(self, room: int, sizes: dict[int, int], policy: str, pinned: frozenset[int] = frozenset()):
        self.room, self.sizes, self.policy, self.pinned = room, sizes, policy, pinned
        self.held: OrderedDict[int, None] = OrderedDict()
        self.uses: dict[int, int] = {}
        self.used = self.evictions = 0

    def use(self, page: int) -> bool:
        """Whether the page was there; it is afterwards, if the tier has room for it."""
        self.uses[page] = self.uses.get(page, 0) + 1
        if page in self.held:
            self.held.move_to_end(page)
            return True
        size = self.sizes[page]
        if size > self.room:
            return False
        while self.used + size > self.room:
            free = [p for p in self.held if p not in self.pinned]
            if not free:
                return False
            gone = min(free, key=lambda p: self.uses[p]) if self.policy == "lfu" else free[0]
            del self.held[gone]
            self.used -= self.sizes[gone]
            self.evictions += 1
        self.held[page] = None
        self.used += size
        return False


class Replay:
    """One scenario over a trace, token by token.

    A page that misses the first tier comes over the second one's bandwidth and
    latency, and if that misses too, over the store's first. After each token its
    predictions start transfers within the prefetch window; a later demand waits
    only for the rest. What was started and is neither used by the next token nor
    predicted again is waste, and costs its whole transfer.
    """

    def __init__(self, scenario, sizes: dict[int, int]):
        self.s, self.sizes = scenario, sizes
        self.vram, self.ram = Tier(scenario.vram_bytes, sizes, scenario.policy, frozenset(scenario.pinned)), Tier(scenario.ram_bytes, sizes, scenario.policy)
        self.started: dict[int, tuple[float, bool]] = {}
        self.tokens = self.accesses = self.vram_hits = self.ram_hits = self.reads = self.bytes_ssd = self.bytes_ram = 0
        self.issued = self.useful = self.wasted = 0
        self.stall = self.hidden = 0.0

    def cost(self, page: int, from_store: bool) -> float:
        size = self.sizes[page]
        return size / self.s.ram_bytes_s + self.s.ram_latency_s + (size / self.s.ssd_bytes_s + self.s.ssd_latency_s if from_store else 0.0)

    def demand(self, page: int) -> None:
        self.accesses += 1
        if self.vram.use(page):
            self.vram_hits += 1
            return
        cached, size = self.ram.use(page), self.sizes[page]
        if cached:
            self.ram_hits += 1
        else:
            self.reads += 1
            self.bytes_ssd += size
        wait = self.cost(page, not cached)
        if page in self.started:
            saved = min(wait, self.started.pop(page)[0])
            wait, self.hidden, self.useful = wait - saved, self.hidden + saved, self.useful + size
        self.bytes_ram += size
        self.stall += wait

    def waste(self, pages: list[int]) -> None:
        for page in pages:
            from_store, size = self.started.pop(page)[1], self.sizes[page]
            self.wasted += size
            self.bytes_ram += size
            self.stall += size / self.s.ram_bytes_s
            if from_store:
                self.reads += 1
                self.bytes_ssd += size
                self.stall += size / self.s.ssd_bytes_s + self.s.ssd_latency_s

    def token(self, pages, predicted) -> None:
        for page in pages:
            self.demand(page)
        left = self.s.prefetch_window_s
        for page in dict.fromkeys(predicted):
            if page not in self.sizes or page in self.vram.held or page in self.started:
                continue
            from_store = page not in self.ram.held
            ahead = min(self.cost(page, from_store), left)
            if ahead > 0:
                left -= ahead
                self.started[page] = (ahead, from_store)
                self.issued += self.sizes[page]
        if self.tokens:
            self.waste([p for p in self.started if p not in set(pages) and p not in set(predicted)])
        self.tokens += 1

    def row(self) -> tuple:
        self.waste(list(self.started))
        return (
            self.s.scenario, self.tokens, self.accesses, self.vram_hits, self.ram_hits, self.reads, self.vram.evictions + self.ram.evictions,
            self.bytes_ssd, self.bytes_ram, self.stall, self.hidden, self.issued, self.useful, self.wasted,
        )


def cache_replay(trace: DataFrame, sizes: dict[int, int], scenarios: DataFrame) -> DataFrame:
    """Each scenario (SCENARIO) over the whole trace (order, pages, predicted) in order: the columns of CACHE.

    ``sizes``: bytes of each page, a model's own small table. Scenarios are few;
    each is one ordered fold over a stream of batches that holds the tiers alone.
    Null lists are empty; a trace without rows gives no rows.
    """
    listed = trace.select("order", *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("pages", "predicted")])
    dealt = listed.crossJoin(F.broadcast(scenarios)).repartition("scenario").sortWithinPartitions("scenario", "order")

    def run(frames):
        replay, out = None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if replay is None or row.scenario != replay.s.scenario:
                    if replay is not None:
                        out.append(replay.row())
                    replay = Replay(row, sizes)
                replay.token([int(p) for p in row.pages], [int(p) for p in row.predicted])
        if replay is not None:
            out.append(replay.row())
        yield pd.DataFrame(out, columns=[f.split()[0] for f in CACHE.split(", ")])

    return dealt.mapInPandas(run, CACHE)


def lease_states(events: DataFrame, lease_seconds: float) -> DataFrame:
    """``task``, ``status``, ``owner``, ``n_leases`` after all events (task, at, kind, owner) in order of time.

    A lease holds for ``lease_seconds``; then the task is pending again. Only the
    owner of a running lease completes a task. Events come sorted outside memory,
    task by task, and one small state goes along.
    """
    narrow = events.select(F.col("task").cast("string").alias("task"), F.col("at").cast("double").alias("at"), "event", "kind", "owner").filter("task IS NOT NULL")

    def run(frames):
        now, state, out = None, None, []
        for frame in frames:
            for task, at, kind, owner in zip(frame["task"], frame["at"], frame["kind"], frame["owner"]):
                if task != now:
                    if now is not None:
                        out.append((now, *state[:2], state[3]))
                    now, state = task, ("pending", None, 0.0, 0)
                status, holder, until, n = state
                if kind == "lease" and (status == "pending" or status == "leased" and until <= at):
                    state = ("leased", owner, at + lease_seconds, n + 1)
                elif kind == "complete" and status == "leased" and until > at and holder == owner:
                    state = ("done", holder, until, n)
            yield pd.DataFrame(out, columns=["task", "status", "owner", "n_leases"])
            out = []
        if now is not None:
            yield pd.DataFrame([(now, *state[:2], state[3])], columns=["task", "status", "owner", "n_leases"])

    kind = dict(events.dtypes)["task"]
    return narrow.repartition("task").sortWithinPartitions("task", "at", "event").mapInPandas(run, "task string, status string, owner string, n_leases int").withColumn("task", F.col("task").cast(kind))


def critic_cache(puts: DataFrame, key: str, order: str, result: str) -> DataFrame:
    """The last result put for each key."""
    return puts.groupBy(key).agg(F.max_by(result, order).alias(result), F.count("*").alias("n_puts"))


def compacted_fields(fields: DataFrame, key: str, order: str, boundaries: int, ratio: float) -> DataFrame:
    """Fields that survive repeated compaction: each boundary keeps the first max(n / ratio, 1) of them."""
    counted = fields.groupBy(key).agg(F.count(order).cast("int").alias("n"))
    kept = F.aggregate(F.sequence(F.lit(1), F.lit(boundaries)), F.col("n"), lambda n, _: F.greatest(F.floor(n / ratio).cast("int"), F.lit(1)))
    return counted.select(key, F.col("n").alias("n_before"), kept.alias("n_after"), (kept / F.col("n")).alias("retention"))


def field_retention(facts: DataFrame, recovered: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """``key``, ``n_fields``, ``n_exact``, ``retention``, ``lost``: which of each record's facts (key, field, value) came back with
    the same value. A missing field is lost, a null value comes back only as null; fields that were no facts don't count."""
    back = recovered.select(key, field, F.col(value).alias("_back"), F.lit(True).alias("_there")).dropDuplicates([key, field])
    same = F.coalesce("_there", F.lit(False)) & F.col(value).eqNullSafe(F.col("_back"))
    joined = facts.select(key, field, value).join(back, [key, field], "left").withColumn("_same", same)
    out = joined.groupBy(key).agg(F.count("*").alias("n_fields"), F.count_if("_same").alias("n_exact"), F.array_sort(F.collect_list(F.when(~F.col("_same"), F.col(field)))).alias("lost"))
    return out.select(key, "n_fields", "n_exact", (F.col("n_exact") / F.col("n_fields")).alias("retention"), "lost")
