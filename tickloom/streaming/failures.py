"""Attempts at single records, counted across restarts.

A batch is tried as a whole; the records that fail are tried again by themselves, after a pause that doubles, while the
others go on. What each attempt gave is written before the next begins, in a folder of the batch and the attempt. A
restarted batch takes up the attempts that stand there, so a record's count and the time of its first failure outlive
the process. A record that fails the last attempt, or for which another attempt is no use, is given up alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import Files


class Outage(Exception):
    """A dependency is down: the batch must fail, so that it is run again from the checkpoint. Nothing is quarantined."""


class Poison(Exception):
    """The record itself is at fault: another attempt is no use."""


def with_retry(write: Callable[[], None], attempts: int = 3, first_s: float = 0.1, factor: float = 2.0, most_s: float = 5.0, budget_s: float = 5.0, sleep=time.sleep) -> int:
    """Call write until it returns; the attempts it took. The last failure is raised, and an outage at once."""
    waited, pause = 0.0, first_s
    for n in range(1, attempts + 1):
        try:
            write()
            return n
        except Outage:
            raise
        except Exception:
            pause = min(pause, most_s)
            if n == attempts or waited + pause > budget_s:
                raise
            sleep(pause)
            waited += pause
            pause *= factor
    raise AssertionError("unreachable")


#: records, number of the attempt -> keys and what else is to be kept, `failure` (null: done), `again` (another attempt may help).
Attempt = Callable[[DataFrame, int], DataFrame]


def by_record(write: Callable[[dict, int], None], keys: list[str], columns: list[str]) -> Attempt:
    """An attempt that hands each record to write(record, attempt) in the executors. It must be idempotent by the keys.

    What write raises is the record's failure, with its class in front; an Outage fails the batch.
    """

    def attempt(records: DataFrame, number: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                failures, again = [], []
                for record in frame.to_dict("records"):
                    try:
                        write(record, number)
                        failures.append(None)
                        again.append(False)
                    except Outage:
                        raise
                    except Exception as e:  # noqa: BLE001
                        failures.append(f"{type(e).__name__}: {e}")
                        again.append(not isinstance(e, Poison))
                yield frame[keys].assign(failure=failures, again=again)

        rows = records.select(*columns)
        schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", failure string, again boolean"
        return rows.mapInPandas(run, schema)

    return attempt


def attempted(records: DataFrame, at: str, keys: list[str], attempt: Attempt, most: int = 3, first_s: float = 0.1, factor: float = 2.0, cap_s: float = 5.0, budget_s: float = 5.0, sleep=time.sleep) -> DataFrame:
    """All attempts at the records: what `attempt` gave, with `attempt` (its number) and `attempted_ms`.

    at: the batch's own folder. keys: one row a record. Pauses are bounded by cap_s each and budget_s in all.
    """
    spark = records.sparkSession
    files, rounds, pause, waited = Files(spark, at), [], first_s, 0.0
    for number in range(1, most + 1):
        folder = f"{at}/attempt={number}"
        if not files.exists(f"{folder}/_SUCCESS"):
            todo = records
            if rounds:
                if waited + pause > budget_s:
                    break
                sleep(pause)
                waited, pause = waited + pause, min(cap_s, pause * factor)
                todo = records.join(rounds[-1].filter("failure is not null and again").select(*keys), keys, "left_semi")
            tried = attempt(todo, number).withColumn("attempted_ms", F.unix_millis(F.current_timestamp()))
            tried.write.mode("overwrite").parquet(folder)
        rounds.append(spark.read.parquet(folder).withColumn("attempt", F.lit(number)))
        if not rounds[-1].filter("failure is not null and again").limit(1).count():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def given_up(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failure, retryCount, firstFailureMs, lastFailureMs of the records none of whose attempts came to an end."""
    last = F.max_by("failure", "attempt")
    failed = F.col("failure").isNotNull()
    times = lambda f: f(F.when(failed, F.col("attempted_ms")))
    d = rounds.groupBy(*keys).agg(last.alias("failure"), F.count_if(failed).alias("retryCount"), times(F.min).alias("firstFailureMs"), times(F.max).alias("lastFailureMs"), F.count_if(~failed).alias("_done"))
    return d.filter("_done = 0").drop("_done")


def chain(failure: str = "failure"):
    """The failure's class and message, as `dead_letters` wants them."""
    cls = F.substring_index(failure, ": ", 1)
    message = F.when(F.contains(F.col(failure), F.lit(": ")), F.expr(f"substring({failure}, instr({failure}, ': ') + 2)"))
    return F.array(F.struct(cls.alias("class"), message.alias("message")))
