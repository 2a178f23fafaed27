"""Alert cases, anomaly candidates, agent and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Ours: the contract names the states, not which may follow which.
LEGAL = ["OPEN>ACKNOWLEDGED", "OPEN>INVESTIGATING", "OPEN>FALSE_POSITIVE", "ACKNOWLEDGED>INVESTIGATING", "ACKNOWLEDGED>CLOSED", "ACKNOWLEDGED>FALSE_POSITIVE", "INVESTIGATING>CLOSED", "INVESTIGATING>FALSE_POSITIVE"]
PRIORITY = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def case_latest(events: DataFrame) -> DataFrame:
    """The last state of each case, with its number of events: an aggregate."""
    last = F.max_by(F.struct("state", "event_ms"), F.struct("event_ms", "seq")).alias("_l")
    return events.groupBy("caseId").agg(last, F.count("*").alias("n_events")).select("caseId", F.col("_l.state").alias("state"), F.col("_l.event_ms").alias("event_ms"), "n_events")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events whose state may not follow the one before; a case must begin as OPEN."""
    before = F.lag("state").over(W.partitionBy("caseId").orderBy("event_ms", "seq"))
    d = events.withColumn("previous", before)
    step = F.concat_ws(">", "previous", "state")
    return d.filter(F.when(F.col("previous").isNull(), F.col("state") != "OPEN").otherwise(~step.isin(LEGAL)))


STATES = ["", "OPEN", "ACKNOWLEDGED", "INVESTIGATING", "CLOSED", "FALSE_POSITIVE"]
_STEP = "array<struct<state:int,illegal:bigint>>"


def _event(state: str) -> Column:
    """What an event makes of each state that the case may be in: its own state where that is legal, else none but a count."""
    to = F.array_position(F.array(*map(F.lit, STATES)), F.col(state)).cast("int") - 1
    legal = lambda k, s: (F.col(state) == "OPEN") if k == 0 else F.concat(F.lit(f"{s}>"), F.col(state)).isin(LEGAL)
    ways = [F.when(legal(k, s), F.struct(to.alias("state"), F.lit(0).cast("long").alias("illegal"))).otherwise(F.struct(F.lit(k).alias("state"), F.lit(1).cast("long").alias("illegal"))) for k, s in enumerate(STATES)]
    return F.array(*ways).cast(_STEP)


def _after(steps: Column) -> Column:
    """One step that does what the steps do one after the other. Steps can be put together in any grouping."""
    nothing = F.array(*[F.struct(F.lit(k).alias("state"), F.lit(0).cast("long").alias("illegal")) for k in range(len(STATES))]).cast(_STEP)

    def then(one: Column, two: Column) -> Column:
        go = lambda x: F.element_at(two, x["state"] + 1)
        return F.transform(one, lambda x: F.struct(go(x)["state"].alias("state"), (x["illegal"] + go(x)["illegal"]).alias("illegal"))).cast(_STEP)

    return F.aggregate(steps, nothing, then)


def case_states(events: DataFrame, span_ms: int = 86_400_000, rows: int = 1024) -> DataFrame:
    """caseId, state, n_events, n_illegal: the state a case is really in, where illegal events leave it as it is; '' if none opened it.

    An event is a function from state to state. A case's events are put together by ranges of time and, within these, in
    runs of at most `rows`, then the runs and the ranges; so a case with a third of all events is spread out, and no list is long.
    """
    order = W.partitionBy("caseId", "_range").orderBy("event_ms", "seq")
    d = events.select("caseId", "event_ms", "seq", F.floor(F.col("event_ms") / span_ms).alias("_range"), _event("state").alias("step"))
    d = d.withColumn("_run", F.floor((F.row_number().over(order) - 1) / rows))
    by = lambda d, key, *at: d.groupBy(*key).agg(_after(F.transform(F.array_sort(F.collect_list(F.struct(*at, "step"))), lambda x: x["step"])).alias("step"), F.sum("n").alias("n"))
    runs = by(d.withColumn("n", F.lit(1)), ["caseId", "_range", "_run"], "event_ms", "seq")
    ranges = by(runs, ["caseId", "_range"], "_run")
    first = F.element_at("step", 1)
    return by(ranges, ["caseId"], "_range").select("caseId", F.element_at(F.array(*map(F.lit, STATES)), first["state"] + 1).alias("state"), F.col("n").alias("n_events"), first["illegal"].alias("n_illegal"))


def safe_outcome(outcome: str = "outcome", tools: str = "toolStatus") -> Column:
    """NO_FLAG becomes ESCALATE where a tool failed or the budget ran out."""
    failed = F.exists(F.map_values(tools), lambda v: F.upper(v).isin("FAILED", "ERROR", "TIMEOUT", "BUDGET_EXHAUSTED"))
    return F.when((F.col(outcome) == "NO_FLAG") & F.coalesce(failed, F.lit(False)), "ESCALATE").otherwise(F.col(outcome))


def top_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates to promote: by priority, then age, then identifier."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("priority"))
    return candidates.orderBy(rank.desc(), "created_ms", "candidateId").limit(k)


def review_chain(candidates: DataFrame, decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with their decision and its review, where there are such."""
    return candidates.join(decisions, "candidateId", "left").join(reviews, "decisionId", "left")


def agent_costs(decisions: DataFrame) -> DataFrame:
    """Tokens and cost of each model."""
    return decisions.groupBy("modelId").agg(F.count("*").alias("decisions"), F.sum("inputTokens").alias("inputTokens"), F.sum("outputTokens").alias("outputTokens"), F.sum("estimatedCostUsd").alias("estimatedCostUsd"))
