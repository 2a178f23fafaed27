"""op6: against brute force; ties, nulls, repeated rows, runs merged by hand."""

import hashlib
import re

import numpy as np
import pytest

from tickloom.llm import exact_dedup as E

DDL = "doc_id long, text string, _kept int"


def by_text(x):
    return sorted(x, key=str)


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups: dict = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    least = {n: min((x for x in v if x is not None), default=None) for n, v in groups.items()}
    return by_text(((i is None, i or 0), least[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm)), least, norm


ROWS = [(5, "a b"), (3, "a  b"), (9, "a\t\nb"), (1, "a b "), (2, None), (4, ""), (None, "a b"), (7, "x" * 50_000), (8, "x" * 50_000), (6, "a b"), (11, "dup"), (11, "dup"), (11, "dup"), (None, "nul"), (None, "nul")] + [(100 + i, "common") for i in range(200)]


@pytest.mark.parametrize("fan_in,parts", [(2, 7), (8, 3), (3, 1)])
def test_equals_brute_force(spark, fan_in, parts):
    d = spark.createDataFrame([(i, t, 0) for i, t in ROWS], DDL).repartition(parts)
    got = E.exact_groups(d, fan_in=fan_in).collect()
    want, least, _ = brute(ROWS)
    assert by_text(((r["caller_0"] is None, r["caller_0"] or 0), r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(least) and all(r["caller_0"] == r["keep_id"] for r in kept)
    assert E.exact_dedup(d).columns == d.columns and E.exact_dedup(d).count() == len(least)


def test_different_texts_of_one_digest_stop_the_job():
    run = np.zeros(2, E.RUN)
    run["digest"], run["check"] = b"d" * 32, [1, 2]
    with pytest.raises(ValueError):
        E.merge([run])


def test_empty(spark):
    assert E.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
