"""MinHash near-deduplication by ProbMinHash.

A document's five-word shingles, weighted by how often they occur, are the elements. Each element throws a
Poisson process whose rate is its weight at the `M` components of the signature; a component keeps the
element that reaches it first. An element is dropped as soon as its next arrival is later than the latest
first arrival over all components (early termination), so long texts cost little more than one arrival for
each shingle. Two signatures agree in a component with the probability Jaccard similarity of the weighted
shingle sets, which is the plain Jaccard similarity when no shingle repeats.

Documents with the same weighted shingles become one node (they are copies); nodes are banded. Every node of a
bucket meets the bucket's lead, the node whose buckets are the largest in all, which stands near the middle of a
group of near copies, and the pair is verified exactly; this makes one pair for each node and joins large groups.
What is left are pairs of nodes that met one lead but are in different components. Before any such pair is made
it has to pass an exact bound. Of a node x that met lead c are known: its weight W, how many shingles of c it
lacks (a), and the weight of its shingles outside c that no other component that met c has (u). For x and y,

    P = 1 - (u(x) + max(0, a(y) - a(x))) / W(x),   Q = 1 - (u(y) + max(0, a(x) - a(y))) / W(y)

are at least the shares of their weights in common shingles, and the similarity is at most 1 / (1/P + 1/Q - 1).
Nodes that can pass with no other node of a bucket, by the bucket's extremes of u, a and W, leave it unpaired, so
groups of documents that share a template, or that lie just under the similarity, cost a pass over their nodes.
What passes is met in rounds: about `LEADERS` nodes outside the lead's component (eight times more in each
round) meet all that pass, pairs are screened by signatures and verified, components and u are brought up to
date, until no bucket holds two components. Nodes meet by the lead that they have met, so a pair is made once
however many buckets both are in, and only if it passes a second exact bound, which knows where the two differ
from the lead: a bit for each shingle of the lead that a node lacks, and hashed bits (`FRESH` for each shingle of
the lead) for those that it has and the lead lacks. If x has f(x) bits of the latter kind, and i bits of any kind
are set for both nodes,

    P = 1 - (f(x) + a(y) - i) / W(x),   Q = 1 - (f(y) + a(x) - i) / W(y),

as a bit that only one of them has stands for a shingle at least that only one of them has. So the pairs that are
made are near ones, almost all. No link that banding finds between components is lost, and no cap is set on
buckets.

Defined results: words are lower-case runs of letters, marks, numbers and connecting lines; a text of one to
four words is one shingle; a text without words (null and empty ones too) is in a class of its own doc_id; a
null doc_id is in no class (null) and is always kept; rows that share a doc_id are one document, whose texts
bring all that they are near to into one class, but a row is only dropped for a text that its own text is near
to; an empty table gives an empty result; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_batches, columns, table, unclashing
from .graph import components
from .words import PRIME, hashed_words, mixed, slices

WORDS, SIMILARITY = 5, 0.8
#: Bands and their rows at SIMILARITY; less similar pairs need more bands of fewer rows, see `banding`.
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Chance at most with which banding may miss a pair that is just as similar as asked.
MISS = 1e-4
#: Nodes of a bucket that meet others in the first round, at least; more if the bucket makes no more than PAIRS pairs.
LEADERS, PAIRS = 32, 65_536
SHINGLE_BITS = 44
#: Bits for shingles that a node has and its lead lacks, for each shingle of the lead.
FRESH = 4


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows) of signatures for pairs of that similarity: as many rows as MISS allows, ROWS at most."""
    for rows in range(ROWS, 0, -1):
        if 0 < similarity <= 1 and (1 - similarity**rows) ** (M // rows) <= MISS:
            return M // rows, rows
    raise ValueError(f"similarity {similarity}: signatures of {M} components find pairs from about 0.071 to 1 only")


def screen(similarity: float) -> float:
    """Signatures of pairs of that similarity agree in at least this share of components, but for 6 standard deviations."""
    return similarity - 6 * (similarity * (1 - similarity) / M) ** 0.5


def weighted_shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times): every shingle of every text once, in order; shingles are SHINGLE_BITS wide."""
    words, upto = hashed_words(texts)
    size = np.diff(upto)
    text = np.repeat(np.arange(len(texts)), size)
    shingle = np.full(len(words), PRIME)
    for k in range(n):  # hash of the words from here on, as far as the text goes
        ahead = np.arange(len(words)) + k
        inside = ahead < upto[text + 1]
        shingle = np.where(inside, mixed(shingle * PRIME + words[np.minimum(ahead, len(words) - 1)]), shingle) if len(words) else shingle
    within = np.arange(len(words)) - upto[text]
    some = within <= np.maximum(size[text] - n, 0)
    key = text[some].astype(np.uint64) << np.uint64(SHINGLE_BITS) | shingle[some] >> np.uint64(64 - SHINGLE_BITS)
    key, times = np.unique(key, return_counts=True)
    return (key >> np.uint64(SHINGLE_BITS)).astype(np.int64), key & np.uint64((1 << SHINGLE_BITS) - 1), times


def signatures(text: np.ndarray, shingle: np.ndarray, times: np.ndarray, n_texts: int, m: int = M) -> np.ndarray:
    """ProbMinHash signatures, one row for each text; rows of texts without shingles mean nothing."""
    first = np.full(n_texts * m, np.inf)
    who = np.zeros(n_texts * m, np.uint64)
    has = np.zeros(n_texts, bool)
    has[text] = True
    rate = times.astype(np.float64)
    arrival = np.zeros(len(text))
    throw, ahead = 0, 1
    while len(text):
        # The next `ahead` arrivals of each element that is still in the race.
        step = np.arange(throw, throw + ahead, dtype=np.uint64)
        draw = mixed((shingle[:, None] * np.uint64(0xD1342543DE82EF95)) + (step + np.uint64(1)) * PRIME)
        wait = -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate[:, None]
        when = arrival[:, None] + np.cumsum(wait, axis=1)
        where = text[:, None] * m + (mixed(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        early = when < first[where]
        at, t = where[early], when[early]
        name = np.broadcast_to(shingle[:, None], when.shape)[early]
        np.minimum.at(first, at, t)
        won = t == first[at]
        who[at[won]] = name[won]
        arrival = when[:, -1]
        latest = first.reshape(n_texts, m).max(axis=1)
        still = arrival < latest[text]
        text, shingle, rate, arrival = text[still], shingle[still], rate[still], arrival[still]
        throw += ahead
        ahead = min(16, ahead * 2) if throw >= 2 else 1
    return who.reshape(n_texts, m)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets; a and b are sorted."""
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = wa
    y[np.searchsorted(every, b)] = wb
    both = (x > 0) & (y > 0)
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    # For an element i, max(x_j / x_i, y_j / y_i) is the former where ratio_j >= ratio_i.
    upto = np.searchsorted(-ratio, -ratio[both], side="right")
    sums_x, sums_y = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(y)]
    return float((1 / (sums_x[upto] / x[both] + (sums_y[-1] - sums_y[upto]) / y[both])).sum())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, texts in slices(b):
            text, shingle, times = weighted_shingles(texts)
            who = signatures(text, shingle, times, len(texts)).astype("<u4")
            has = np.bincount(text, minlength=len(texts)) > 0
            own = np.zeros((len(texts), 2), np.uint64)
            for k, salt in enumerate((np.uint64(0x8BB84B93962EACC9), np.uint64(0x2D358DCCAA6C78A5))):
                np.add.at(own[:, k], text, mixed((shingle ^ salt) * PRIME + times.astype(np.uint64) * salt))
            keys = [own[k].tobytes() if has[k] else None for k in range(len(texts))]
            sigs = [who[k].tobytes() if has[k] else None for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["id", "th", "key", "sig"])


def _banded(bands: int, rows: int):
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64) * PRIME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, M)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            band = np.broadcast_to(salt, sig.shape[:2])
            for k in range(rows):
                band = mixed(band * PRIME + sig[:, :, k])
            nodes = np.repeat(b.column("node").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(band.view(np.int64).ravel()), pa.array(nodes)], ["band", "node"])

    return run


def _screened(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(-1, M) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted shingles of each node, and how often they occur (empty: each once)."""
    for b in batches:
        for part, texts in slices(b):
            text, shingle, times = weighted_shingles(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            often = [times[x:y].astype("<u4").tobytes() if (times[x:y] > 1).any() else b"" for x, y in pairs]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingle[x:y].tobytes() for x, y in pairs], pa.binary()), pa.array(often, pa.binary())], ["node", "shingles", "times"])


MET = "a long, b long, near boolean, missing long, weight long, fresh binary, often binary, mask array<long>, bits long"


def differences(fresh: np.ndarray, lacked: np.ndarray) -> tuple[np.ndarray, int]:
    """Bits of what a node has and its lead lacks, then of what it lacks of the lead, and how many of the former are set."""
    n = -(-len(lacked) // 64) * 64
    bits = np.zeros((FRESH + 1) * n, bool)
    bits[(fresh % np.uint64(FRESH * n)).astype(np.int64)] = True
    have = int(np.count_nonzero(bits))
    bits[FRESH * n : FRESH * n + len(lacked)] = lacked
    return np.packbits(bits).view(np.int64), have


def _met(least: float, batch: int = 64):
    """Pairs, whether they are as similar as asked, and what the bound needs to know of a, which met b, where `stats` is set."""

    def one(s1: bytes, t1: bytes, s2: bytes, t2: bytes, stats: bool) -> tuple:
        x, y = np.frombuffer(s1, "<u8"), np.frombuffer(s2, "<u8")
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = y[at] == x
        common = int(np.count_nonzero(both))
        wx = np.frombuffer(t1, "<u4") if t1 else np.ones(len(x), "<u4")
        if t1 or t2:
            similarity = probability_jaccard(x, wx, y, np.frombuffer(t2, "<u4") if t2 else np.ones(len(y), "<u4"))
        else:
            similarity = common / (len(x) + len(y) - common)
        rest = (None, None, None, None)
        if stats:
            lacked = np.ones(len(y), bool)
            lacked[at[both]] = False
            rest = (x[~both].tobytes(), wx[~both].tobytes(), *differences(x[~both], lacked))
        return similarity >= least - 1e-12, len(y) - common, int(wx.sum()), *rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):  # few pairs' shingles at once
                part = b.slice(at, batch)
                out = [one(*row) for row in zip(*(part.column(c).to_pylist() for c in ("s1", "t1", "s2", "t2", "stats")), strict=True)]
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *cols], ["a", "b", "near", "missing", "weight", "fresh", "often", "mask", "bits"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle that a node has and the lead lacks."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            fresh = [np.frombuffer(x, "<i8") for x in part.column("fresh").to_pylist()]
            size = [len(x) for x in fresh]
            own = [pa.array(np.repeat(part.column(c).to_numpy(), size)) for c in ("node", "lead", "c")]
            times = np.frombuffer(b"".join(part.column("often").to_pylist()), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(fresh)), pa.array(times)], ["node", "lead", "c", "shingle", "times"])


def similarity_bound(p: Column, q: Column) -> Column:
    """The most that two nodes with these shares of weight in common shingles can be similar."""
    return F.when((p > 0) & (q > 0), 1 / (1 / p + 1 / q - 1)).otherwise(0.0)


def _pairs(ends: DataFrame, similarity: float) -> DataFrame:
    """a, b of nodes of different components that met one lead, share a bucket which one of them leads, and may be similar."""
    first = ends.filter(F.size("heads") > 0)
    first = first.select("lead", *[F.col(c).alias(f"{c}_") for c in ends.columns if c != "lead"])
    p = 1 - (F.col("u") + F.greatest(F.lit(0), F.col("missing_") - F.col("missing"))) / F.col("weight")
    q = 1 - (F.col("u_") + F.greatest(F.lit(0), F.col("missing") - F.col("missing_"))) / F.col("weight_")
    both = F.aggregate(F.zip_with("mask", "mask_", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    p2 = 1 - (F.col("bits") + F.col("missing_") - both) / F.col("weight")
    q2 = 1 - (F.col("bits_") + F.col("missing") - both) / F.col("weight_")
    apart = (F.col("c") != F.col("c_")) & F.arrays_overlap("bands", "heads_") & (~F.arrays_overlap("heads", "bands_") | (F.col("node") < F.col("node_")))
    may = (similarity_bound(p, q) >= similarity - 1e-9) & apart & (similarity_bound(p2, q2) >= similarity - 1e-9)
    return ends.join(first, "lead").filter(may).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))


def _links(nodes: DataFrame, bands: DataFrame, shingles: DataFrame, similarity: float, keep: Scratch) -> DataFrame:
    """node, component of every node that banding links with another. bands: band, node, n, lead; shingles: node, shingles, times."""

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """pairs: a, b, stats."""
        s = lambda node, i: shingles.select(F.col("node").alias(node), F.col("shingles").alias(f"s{i}"), F.col("times").alias(f"t{i}"))
        full = pairs.join(s("a", 1), "a").join(s("b", 2), "b").select("a", "b", "s1", "t1", "s2", "t2", "stats")
        return keep(by_batches(full, _met(similarity), MET), name)

    met = verified(bands.filter("node <> lead").groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.max(F.col("n") > 2).alias("stats")), "met")
    comps = keep(components(met.filter("near")), "components-0")
    known = met.filter("fresh is not null").withColumnsRenamed({"a": "node", "b": "lead"}).drop("near")
    # A bucket's lead has met every node there; nodes of other components may still have to meet.
    left, turn = bands.filter("n > 2 and node <> lead").select("band", "node", "lead"), 0
    is_open = "others > 0 and c0 < c1"
    of_band = [F.count("*").alias("n"), F.count_if(F.col("c") != F.col("main")).alias("others"), F.min("c").alias("c0"), F.max("c").alias("c1")]
    while True:
        turn += 1
        of = lambda node, name: comps.select(F.col("node").alias(node), F.col("component").alias(f"_{name}"))  # noqa: B023, E731
        now = left.join(of("node", "c"), "node", "left").join(of("lead", "m"), "lead", "left")
        now = now.select("band", "node", "lead", F.coalesce("_c", "node").alias("c"), F.coalesce("_m", "lead").alias("main"))
        now = keep(now.join(now.groupBy("band").agg(*of_band).filter(is_open).select("band"), "band"), f"open-{turn}")
        if now.isEmpty():
            return comps
        here = known.join(now.select("node", "lead", "c").distinct(), ["node", "lead"])
        spread = keep(by_batches(here.select("node", "lead", "c", "fresh", "often"), _spread, "node long, lead long, c long, shingle long, times long"), f"spread-{turn}")
        alone = spread.groupBy("lead", "shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo = hi").select("lead", "shingle")
        own = spread.join(alone, ["lead", "shingle"]).groupBy("node", "lead").agg(F.sum("times").alias("u"))
        facts = here.select("node", "lead", "missing", "weight").join(own, ["node", "lead"], "left").na.fill(0, ["u"])
        facts = now.join(facts, ["node", "lead"])
        edge = facts.groupBy("band").agg(F.min(F.col("u") / F.col("weight")).alias("m1"), F.min(F.col("u") - F.col("missing")).alias("m2"), F.max("weight").alias("most"))
        far = F.greatest("m1", (F.col("missing") + F.col("m2")) / F.col("most"))
        may = facts.join(edge, "band").filter(similarity_bound(1 - F.col("u") / F.col("weight"), 1 - far) >= similarity - 1e-9).drop("m1", "m2", "most")
        may = keep(may, f"may-{turn}")
        many = F.greatest(F.lit(LEADERS * 8 ** (turn - 1)), F.floor(F.lit(PAIRS) / F.col("n")))
        chance = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 20)) * F.col("others") < many * F.lit(1 << 20)
        marks = may.join(may.groupBy("band").agg(*of_band).filter(is_open).select("band", "n", "others"), "band")
        marks = keep(marks.withColumn("leads", (F.col("c") != F.col("main")) & chance).drop("n", "others"), f"marks-{turn}")
        # A node's buckets with one lead, and those that it leads, are as many as bands at most.
        sets = [F.collect_list("band").alias("bands"), F.collect_list(F.when(F.col("leads"), F.col("band"))).alias("heads")]
        ends = marks.groupBy("node", "lead", "c", "missing", "weight", "u").agg(*sets)
        ends = keep(ends.join(known.select("node", "lead", "mask", "bits"), ["node", "lead"]), f"ends-{turn}")
        pairs = _pairs(ends, similarity).distinct()
        sig = lambda node, name: nodes.select(F.col("node").alias(node), F.col("sig").alias(name))
        pairs = pairs.join(sig("a", "sa"), "a").join(sig("b", "sb"), "b").select("a", "b", "sa", "sb")
        pairs = keep(by_batches(pairs, _screened(screen(similarity)), "a long, b long"), f"pairs-{turn}")
        found = verified(pairs.withColumn("stats", F.lit(False)), f"met-{turn}").filter("near").select("a", "b")
        if not found.isEmpty():
            comps = keep(components(found.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))), f"components-{turn}")
        left = marks.filter("not leads").select("band", "node", "lead")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th (hash of the text), class_id, rep_id, kept of every row. docs: doc_id, text.

    class_id is the smallest doc_id of the class, rep_id that of the rows with the same weighted shingles; kept
    are the rows of one document of each class, or of one for each of its texts if a document has several.
    """
    keep = Scratch(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = keep(by_batches(marked, _signed, "id long, th long, key binary, sig binary"), "signed")
    some = signed.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    # Stored, so that the numbers stay what they are.
    nodes = keep(some.groupBy("key").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = by_batches(nodes.select("node", "sig"), _banded(*banding(similarity)), "band long, node long")
    rows = keep(bands.join(bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "band"), "rows")
    score = rows.groupBy("node").agg((F.sum("n") * 1024 + F.pmod(F.xxhash64("node"), F.lit(1024))).alias("score"))
    leads = rows.join(score, "node").groupBy("band").agg(F.max_by("node", "score").alias("lead"))
    rows = keep(rows.join(leads, "band"), "led")
    wanted = rows.select("node").distinct().join(nodes.select("node", "key", "rep"), "node").join(some.select("id", "th", "key"), "key").filter("id = rep").select("id", "th", "node").dropDuplicates(["node"])
    texts = marked.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"])
    shingles = keep(by_batches(texts.select("node", "text"), _shingled, "node long, shingles binary, times binary"), "shingles")
    comps = _links(nodes, rows, shingles, similarity, keep)
    named = nodes.select("key", "node", "rep").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    # Of a component's nodes with its smallest doc_id one stays.
    heads = named.join(first, "component").filter("rep = class_id").groupBy("component").agg(F.min("node").alias("head"))
    classes = keep(named.join(first, "component").join(heads, "component").select("key", "node", "rep", "component", "class_id", (F.col("node") == F.col("head")).alias("head")), "classes")
    own = keep(signed.select("id", "th", "key").join(classes, "key", "left").drop("key"), "own")
    several = own.filter("id is not null").groupBy("id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("id", "lo")
    several = keep(several, "several")
    if not several.isEmpty():  # documents of several texts bring classes together
        joined = components(own.join(several, "id").select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct()).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        least = keep(classes.select("component", "class_id").distinct().join(joined, "component"), "joined")
        least = least.join(least.groupBy("whole").agg(F.min("class_id").alias("least")), "whole").select("component", "least")
        own = own.join(least, "component", "left").withColumn("class_id", F.coalesce("least", "class_id")).drop("least")
    keep.drop_but("own", "joined", "several")
    real = F.col("id").isNotNull()
    return own.select(F.col("id").alias("doc_id"), "th", F.when(real, F.coalesce("class_id", "id")).alias("class_id"), F.when(real, F.coalesce("rep", "id")).alias("rep_id"), F.coalesce(F.col("head") & (F.col("id") == F.col("rep")), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one document of each class, that whose doc_id is the smallest."""
    keep = Scratch(docs.sparkSession)
    i, t = unclashing(docs, "near_id", "near_text")
    drop = keep(near_classes(docs.select("doc_id", "text"), similarity).filter("not kept").select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct(), "dropped")
    here = (docs["doc_id"].cast("long") == F.col(i)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(t))
    return docs.join(drop, here, "left_anti").select(*columns(docs))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "rep_id", "kept")
