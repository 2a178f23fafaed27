"""Sinks that the registered queries write single records to; apart from the queries, as executors import them."""

from __future__ import annotations

from ..streaming.failures import Poison


def flaky(record, attempt):
    """A sink that takes some records at the second or third attempt, some never, and says of some that they are at fault."""
    n = record["partition"] + record["offset"] * 12
    if n % 19 == 0:
        raise Poison("not for us")
    if n % 13 == 0 or attempt <= (2 if n % 11 == 0 else 1 if n % 7 == 0 else 0):
        raise OSError(f"connection {n % 3} reset")
