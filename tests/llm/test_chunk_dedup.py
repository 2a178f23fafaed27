"""op8: cuts shift with insertions, runs against a plain version, planted passages, odd rows."""

import random

import numpy as np

from tickloom.llm import chunk_dedup as C

DDL = "doc_id long, text string, spans int"


def plain_cuts(raw):
    h, at = 0, []
    for i, b in enumerate(raw):
        h = ((h << 2) + int(C.GEAR[b])) & 0xFFFFFFFF
        if h < 2**32 // C.MEAN:
            j = i + 1
            while j < len(raw) and raw[j] & 0xC0 == 0x80:
                j += 1
            if C.WINDOW < j < len(raw):
                at.append(j)
    at = sorted(set(at))
    kept = [x for k, x in enumerate(at) if k == 0 or x - at[k - 1] >= C.LEAST]
    return [0, *kept] if raw else []


def prose(r, n):
    return " ".join("".join(r.choice("aeiouéßntrs") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_cuts_equal_the_rolling_hash_and_resist_insertions():
    r = random.Random(0)
    texts = [prose(r, n).encode() for n in (3, 200, 1, 400)]
    starts = np.r_[0, np.cumsum([len(t) for t in texts])]
    at, text = C.cuts(np.frombuffer(b"".join(texts), np.uint8), starts)
    for k, t in enumerate(texts):
        assert (at[text == k] - starts[k]).tolist() == plain_cuts(t)
    t = texts[3]
    moved = b"inserted " + t
    a = {x for x in plain_cuts(t)}
    b = {x - 9 for x in plain_cuts(moved)}
    assert len(a - b) <= 3


def test_planted_passages_and_clean_texts(spark):
    r = random.Random(3)
    passages = [prose(r, 60) for _ in range(10)]
    rows = [(i, prose(r, 50) + " " + passages[i % 10] + " " + prose(r, 50), 0) for i in range(40)] + [(100 + i, prose(r, 150), 0) for i in range(40)]
    rows += [(200, None, 0), (201, "", 0), (None, rows[0][1], 0), (202, rows[0][1], 0), (202, rows[0][1], 0), (203, "z" * 5000, 0)]
    d = spark.createDataFrame(rows, DDL).repartition(3)
    found = {r_["id"]: r_ for r_ in C.repeats(d.drop("spans")).collect()}
    caught = [i for i in range(10, 40) if i in found and found[i]["n_removed"] >= C.LEAST_RUN]
    assert len(caught) >= 28 and not [i for i in range(10) if i in found and found[i]["n_removed"]] and not [i for i in range(100, 140) if i in found and found[i]["n_removed"]]
    assert len([i for i in range(40) if i in found and found[i]["n_shared"] >= C.LEAST_RUN]) >= 38 and not [i for i in range(100, 140) if i in found and found[i]["n_shared"]]
    for i in caught:
        text = rows[i][1].encode()
        assert all(text[s["start"] : s["end"]].decode() in rows[i % 10][1] for s in found[i]["spans"])
    whole = len(rows[0][1].encode())
    assert found[202]["n_removed"] == whole and found[C.LAST]["n_removed"] == whole and found[203]["n_removed"] >= 3000
    out = {x["doc_id"]: x["text"] for x in C.substring_dedup(d.filter("doc_id is not null and doc_id <> 202")).collect()}
    assert out[0] == rows[0][1] and out[200] is None and len(out[15]) < len(rows[15][1]) and d.columns == C.substring_dedup(d).columns


def test_empty(spark):
    assert C.repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tables_without_any_cut(spark):
    for text in ("short", "x" * 17, "z" * 450_000):
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = C.repeats(d).collect()
        assert (len(text) < 100 and not found) or found[0]["n_removed"] >= 440_000
        assert C.substring_dedup(d).count() == 1


def test_no_passage_of_51_words_is_missed(spark):
    r = random.Random(51)
    passages = [prose(r, 51) for _ in range(400)]
    rows = [(i + 1000 * k, f"{prose(r, 30)} {p} {prose(r, 30)}") for k in range(2) for i, p in enumerate(passages)]
    found = {x["id"]: x for x in C.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, p in enumerate(passages):
        least = len(p.encode()) - 32 - 2 * C.STRETCH
        assert least >= C.LEAST_RUN and found[i]["n_removed"] == 0
        assert found[i]["n_shared"] >= least and found[1000 + i]["n_removed"] >= least


def test_repeated_short_strings_are_cut_and_characters_stay_whole():
    for text in ("z" * 5000, "ab " * 300, "é" * 400, "abcdefgh" * 500):
        raw = text.encode()
        at, _ = C.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        size = np.diff(np.r_[at, len(raw)])
        assert at[0] == 0 and size.max() < 2 * C.STRETCH and len(at) <= len(raw) // C.LEAST + 2
        assert "".join(raw[x : x + n].decode() for x, n in zip(at, size, strict=True)) == text


def test_parts_change_no_cut(monkeypatch):
    r = random.Random(7)
    texts = [prose(r, n).encode() for n in (900, 2, 700)]
    starts, data = np.r_[0, np.cumsum([len(t) for t in texts])], np.frombuffer(b"".join(texts), np.uint8)
    whole = C.chunks(data, starts)[0].tolist()
    monkeypatch.setattr(C, "PART", 100)
    assert C.chunks(data, starts)[0].tolist() == whole


def plain_repeats(rows):
    """id -> (n_repeats, n_removed, n_shared) by dictionaries, from the chunks of each text."""
    chunked = {}
    for i, text in rows:
        raw = text.encode()
        at = C.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() if raw else []
        chunked[i] = [(a, z, raw[a:z]) for a, z in zip(at, [*at[1:], len(raw)])]
    owners = {}
    for i, own in chunked.items():
        for *_, x in own:
            owners.setdefault(x, set()).add(i)

    def long_runs(spans):
        total, run = 0, None
        for a, z in [*spans, (None, None)]:
            if run and run[1] == a:
                run = (run[0], z)
            else:
                total += run[1] - run[0] if run and run[1] - run[0] >= C.LEAST_RUN else 0
                run = (a, z)
        return total

    out = {}
    for i, own in chunked.items():
        seen, later, either = set(), [], []
        for a, z, x in own:
            if x in seen or min(owners[x]) < i:
                later.append((a, z))
            if x in seen or len(owners[x]) > 1:
                either.append((a, z))
            seen.add(x)
        if either:
            out[i] = (len(later), long_runs(later), long_runs(either))
    return out


def test_runs_equal_a_plain_version(spark):
    r = random.Random(12)
    shared = [prose(r, n) for n in (5, 20, 30, 60, 300)]
    rows = [(i, " ".join(r.choice([prose(r, r.randrange(1, 40)), r.choice(shared)]) for _ in range(r.randrange(1, 8)))) for i in range(120)]
    rows += [(200, "z" * 4000), (201, "ab " * 900), (202, "a" + "z" * 3000 + prose(r, 30))]  # long stretches without a valid cut
    got = C.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["id"]: (x["n_repeats"], x["n_removed"], x["n_shared"]) for x in got} == plain_repeats(rows)


def test_rows_without_a_doc_id_are_compared(spark):
    r = random.Random(21)
    shared = prose(r, 120)
    rows = [(None, prose(r, 30) + shared + prose(r, 30)) for _ in range(3)]
    got = C.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and {x["id"] for x in got} == {C.LAST} and sorted(x["n_removed"] > 300 for x in got) == [False, True, True]
    left = [x["text"] for x in C.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(shared in x for x in left) == 1
