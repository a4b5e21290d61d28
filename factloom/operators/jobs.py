"""Jobs, ledgers and retention over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.fold import folded

RESOURCES = ("calls", "input_tokens", "output_tokens", "tool_calls")


def submissions(events: DataFrame, keys: list[str], order: list[Column], fingerprint: str) -> DataFrame:
    """The first submission of each key is the job; later ones reuse it, or conflict if their fingerprint differs.

    The first is a map-side minimum, so a key may be of any size."""
    first = events.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(fingerprint).alias("fp"))).alias("f"))
    own = events.join(first, keys)
    mine = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    is_first = mine == F.struct(*[F.col(f"f.o{k}").alias(f"o{k}") for k in range(len(order))])
    return own.withColumn("outcome", F.when(is_first, "created").when(F.col(fingerprint).eqNullSafe(F.col("f.fp")), "reused").otherwise("conflict")).drop("f")


def latest(events: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def active(rows: DataFrame, now: Column, *, expires: str, created: str | None = None) -> DataFrame:
    """Rows that are neither expired nor from the future."""
    keep = F.col(expires) > now
    return rows.where(keep if created is None else keep & (F.col(created) <= now))


def owned(rows: DataFrame, owner: str) -> DataFrame:
    return rows.where(F.col("owner_hash") == owner)


def total(*parts: DataFrame, keys: list[str], excluding: Column | None = None) -> DataFrame:
    """Resources spent, in flight and protected, by component."""
    own = parts[0]
    for more in parts[1:]:
        own = own.unionByName(more)
    own = own if excluding is None else own.where(~excluding)
    return own.groupBy(*keys).agg(*[F.sum(r).alias(r) for r in RESOURCES])


def fits(a: str, b: str) -> Column:
    """Whether vector ``a.*`` is within ``b.*``."""
    out = F.lit(True)
    for r in RESOURCES:
        out = out & (F.col(f"{a}.{r}") <= F.col(f"{b}.{r}"))
    return out


def capacity(rows: DataFrame, keys: list[str], *, size: str, item: str, most_items: int, most_size: int) -> DataFrame:
    """Groups over their number or total size of distinct items."""
    own = rows.groupBy(*keys, item).agg(F.max(size).alias("s")).groupBy(*keys).agg(F.count("*").alias("items"), F.sum("s").alias("size"))
    return own.where((F.col("items") > most_items) | (F.col("size") > most_size))


def admissions(events: DataFrame, scope: list[str], order: str, amount: str, *, budget: int) -> DataFrame:
    """Reservations in order: admitted while they fit in what earlier admitted ones left; refused ones cost nothing.
    A null amount is refused."""

    def start():
        used = 0

        def step(n):
            nonlocal used
            ok = n is not None and used + n <= budget
            used += n if ok else 0
            return (ok,)

        return step

    return folded(events.select(*scope, order, F.col(amount).cast("long").alias("_n")), scope, [F.asc(order)], ["_n"], "admitted boolean", start).drop("_n")


class LedgerSteps:
    """One scope's ledger, event by event; ``state`` is all that it remembers, and can be stored as JSON."""

    def __init__(self, limits: dict[str, int], state: dict | None = None):
        self.limits = limits
        self.state = state or {"spent": dict.fromkeys(RESOURCES, 0), "held": dict.fromkeys(RESOURCES, 0), "flight": {}, "shut": False}

    def __call__(self, key: str | None, kind: str | None, *amounts: int | None) -> tuple[bool, int, int]:
        own, amount = self.state, dict(zip(RESOURCES, amounts, strict=True))
        spent, held, flight = own["spent"], own["held"], own["flight"]
        ok = False
        if kind == "reserve" and key is not None and None not in amounts:
            ok = not own["shut"] and key not in flight and all(spent[r] + held[r] + amount[r] <= self.limits[r] for r in RESOURCES)
            own["shut"] = own["shut"] or not ok
            if ok:
                flight[key] = amount
                held.update({r: held[r] + amount[r] for r in RESOURCES})
        elif kind == "settle" and key in flight:
            ok, freed = True, flight.pop(key)
            held.update({r: held[r] - freed[r] for r in RESOURCES})
            spent.update({r: spent[r] + (freed[r] if amount[r] is None else amount[r]) for r in RESOURCES})
        return ok, spent["input_tokens"], held["input_tokens"]


#: What ``LedgerSteps`` reads and gives.
LEDGER_INPUTS, LEDGER_OUTPUTS = ("key", "kind", *RESOURCES), "accepted boolean, spent_tokens long, in_flight_tokens long"


def ledger(events: DataFrame, scope: list[str], limits: dict[str, int]) -> DataFrame:
    """Reserve and settle events replayed in order (``ord, key, kind`` and the four resources): ``accepted`` for each,
    what is spent and in flight after it. A reservation must fit; settling frees it and spends the actual amount, of
    what is not known (null) the reserved one; after a refusal the ledger is exhausted and takes no more. A reservation
    with a null key or amount, and an event of no kind, is refused without more. The state is the reservations in flight."""
    return folded(events, scope, [F.asc("ord")], [*LEDGER_INPUTS], LEDGER_OUTPUTS, lambda: LedgerSteps(limits))


class PlaceSteps:
    """One scope's open jobs, event by event; ``state`` is the owner of each open job, in order."""

    def __init__(self, running: int, queued: int, per_owner: int, state: dict | None = None):
        self.running, self.places, self.per_owner = running, running + queued, per_owner
        self.state: dict[str, str | None] = {} if state is None else state

    def __call__(self, job: str | None, owner: str | None, kind: str | None) -> tuple[str]:
        jobs = self.state
        if kind == "finish":
            return ("finished" if jobs.pop(job, self) is not self else "ignored",)
        if job is None:
            return ("ignored",)
        if list(jobs.values()).count(owner) >= self.per_owner:
            return ("owner_busy",)
        if len(jobs) >= self.places:
            return ("full",)
        jobs[job] = owner
        return ("running" if len(jobs) <= self.running else "queued",)


PLACE_INPUTS, PLACE_OUTPUTS = ("job_id", "owner_hash", "kind"), "outcome string"


def admitted_jobs(submitted: DataFrame, *, running: int = 2, queued: int = 4, per_owner: int = 1) -> DataFrame:
    """Events ``(scope, ord, job_id, owner_hash, kind submit|finish)`` replayed: a submission enters if its owner has
    fewer than ``per_owner`` open jobs and there is room to run or wait; null owners are one owner, a job without an id is
    ignored. The state is the open jobs."""
    return folded(submitted, ["scope"], [F.asc("ord")], [*PLACE_INPUTS], PLACE_OUTPUTS, lambda: PlaceSteps(running, queued, per_owner))


def durations(events: DataFrame, keys: list[str], order: list[Column], micros: Column) -> DataFrame:
    """Microseconds from each event to the next of its key; null for the last."""
    gap = F.lead(micros).over(W.partitionBy(*keys).orderBy(*order)) - micros
    return events.withColumn("micros", F.when(gap.isNotNull(), F.greatest(gap, F.lit(0))))


def reusable(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Tasks with whether an artifact of the same input is there."""
    have = artifacts.select("task_key", "input_hash", F.lit(True).alias("_have")).distinct()
    return tasks.join(have, ["task_key", "input_hash"], "left").withColumn("reuse", F.coalesce("_have", F.lit(False))).drop("_have")


def invalidated(changed: DataFrame, edges: DataFrame, *, rounds: int = 32) -> DataFrame:
    """Everything downstream of what changed over ``edges(src, dst)``; the graph is the stage plan, of a few nodes.
    A chain of ``rounds`` hops or a cycle is an error."""
    found = changed.sparkSession.sql(
        """
        with recursive reach(node, depth) as (
          select node, 0 from {changed}
          union all
          select e.dst, r.depth + 1 from reach r join {edges} e on e.src = r.node where r.depth < {rounds})
        select node, min(depth) as depth, max(depth) as longest from reach group by node""",
        changed=changed.select("node").distinct(),
        edges=edges.select("src", "dst"),
        rounds=rounds,
    )
    return found.select("node", F.when(F.col("longest") < rounds, F.col("depth")).otherwise(F.raise_error(F.lit(f"more than {rounds} hops"))).alias("depth"))


def remaining(plan: DataFrame, done: DataFrame, allowance: DataFrame) -> DataFrame:
    """What the tasks still to come must be able to spend."""
    return plan.join(done.select("task_key"), "task_key", "left_anti").join(allowance, "task_id").groupBy("job_id").agg(*[F.sum(r).alias(r) for r in RESOURCES])


def promoted(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The last valid attempt of each task, else its last one."""
    return attempts.groupBy(*keys).agg(F.max_by(F.struct("attempt", "valid", "value"), F.struct(F.col("valid").cast("int"), "attempt")).alias("a")).select(*keys, "a.*")


def retryable(jobs: DataFrame, failures: DataFrame, spent: DataFrame, *, calls: int) -> DataFrame:
    """Failed jobs that only failed for passing reasons and have budget left."""
    lasting = failures.groupBy("job_id").agg(F.bool_and("transient").alias("ok"))
    return jobs.where("state = 'failed'").join(lasting.where("ok"), "job_id", "left_semi").join(spent.where(F.col("calls") >= calls).select("job_id"), "job_id", "left_anti")


def purged(reports: DataFrame, jobs: DataFrame, now: Column, retention: Column) -> tuple[DataFrame, DataFrame]:
    return reports.where(F.col("expires_at") > now), jobs.where(F.col("finished_at").isNull() | (F.col("finished_at") + retention > now))


def lifecycle(events: DataFrame) -> DataFrame:
    """The state of each job after all its events; deleted ones are gone, a retry clears error and report."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("kind", "error", "report_id"), F.struct("ts", "ord")).alias("e")).where("e.kind <> 'delete'")
    retry = F.col("e.kind") == "retry"
    return last.select("job_id", F.when(retry, "queued").otherwise(F.col("e.kind")).alias("state"), F.when(~retry, F.col("e.error")).alias("error"), F.when(~retry, F.col("e.report_id")).alias("report_id"))


def restored(cached: DataFrame, present: DataFrame, now: Column, retention: Column) -> DataFrame:
    """Cached reports that are not there yet, kept until the earlier of both ends."""
    return cached.join(present.select("report_id"), "report_id", "left_anti").withColumn("expires_at", F.least(now + retention, F.col("expires_at")))


def swept(store: DataFrame, namespace: str) -> DataFrame:
    """A store without the broken or expired records of one namespace; others are not touched."""
    return store.where(~((F.col("namespace") == namespace) & F.col("status").isin("invalid", "expired")))


def usage_by_task(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("task_id").agg(F.count("*").alias("attempts"), *[F.sum(r).alias(r) for r in RESOURCES[1:3]], F.count_if(F.col("status") == "ok").alias("succeeded"))


def planned(tasks: DataFrame, limits: DataFrame, estimate: str) -> DataFrame:
    """Tasks with their caps and ``code`` where the estimate is over."""
    return tasks.join(limits, "task_id").withColumn("code", F.when(F.col(estimate) > F.col("input_cap"), "input_too_large"))


def failure(status: Column) -> Column:
    """``(code, retryable)`` of a provider's status."""
    code = F.when(status.isin(401, 403), "auth").when(status == 429, "rate_limited").when(status == 408, "timeout").when(status >= 500, "unavailable").when(status >= 400, "rejected")
    return F.struct(code.alias("code"), F.coalesce(status.isin(408, 429) | (status >= 500), F.lit(False)).alias("retryable"))
