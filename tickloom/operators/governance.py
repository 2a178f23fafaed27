"""Access policies, schema compatibility, catalogues, masking."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import flag
from ..schemas import ENUMS, FIELDS, RESTRICTED, TOPICS, fields
from .enrichment import small

KEYS = ["principal", "resourceType", "name", "operation"]

# Principal, resource type, name, operations.
POLICIES = [
    ("trade-producer", "TOPIC", "trades.raw", ["WRITE"]),
    ("market-data-simulator", "TOPIC", "market-data.ticks", ["WRITE"]),
    ("corporate-action-producer", "TOPIC", "corporate-actions", ["WRITE"]),
    ("reference-data-service", "TOPIC", "reference-data.instruments", ["WRITE"]),
    ("audit-service", "TOPIC", "trades.raw", ["READ"]),
    ("audit-service", "TOPIC", "market-data.ticks", ["READ"]),
    ("audit-service", "TOPIC", "corporate-actions", ["READ"]),
    ("audit-service", "TOPIC", "reference-data.instruments", ["READ"]),
    ("audit-service", "TOPIC", "trades.raw.dlq", ["WRITE"]),
    ("audit-service", "TOPIC", "market-data.ticks.dlq", ["WRITE"]),
    ("audit-service", "TOPIC", "corporate-actions.dlq", ["WRITE"]),
    ("audit-service", "TOPIC", "reference-data.instruments.dlq", ["WRITE"]),
    ("audit-service", "GROUP", "audit-service", ["READ"]),
    ("market-data-cache-projector", "TOPIC", "market-data.ticks", ["READ"]),
    ("market-data-cache-projector", "TOPIC", "market-data.ticks.dlq", ["WRITE"]),
    ("market-data-cache-projector", "GROUP", "market-data-cache-projector", ["READ"]),
]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "principal string, resourceType string, name string, operations array<string>")


def grants(rules: DataFrame) -> DataFrame:
    """One row for each operation; READ and WRITE bring DESCRIBE."""
    each = rules.select("principal", "resourceType", "name", F.explode("operations").alias("operation"))
    implied = each.filter(F.col("operation").isin("READ", "WRITE")).withColumn("operation", F.lit("DESCRIBE"))
    return each.unionByName(implied).distinct()


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests with `decision`: ALLOW by an exact grant, else DENY."""
    g = small(grants(rules).withColumn("_granted", F.lit(True)))
    return requests.join(g, KEYS, "left").withColumn("decision", F.when(F.col("_granted"), "ALLOW").otherwise("DENY")).drop("_granted")


def grant_arguments(rules: DataFrame) -> DataFrame:
    """The argument line of each operation, in order."""
    each = rules.select("principal", "resourceType", "name", F.explode("operations").alias("operation"))
    line = F.format_string("--add --allow-principal User:%s --operation %s --%s %s", "principal", "operation", flag(F.col("resourceType")), "name")
    return each.select(*KEYS, line.alias("arguments")).orderBy(*KEYS)


def topic_catalogue(spark: SparkSession) -> DataFrame:
    """name, partitions, config of all topics."""
    rows = [(t, p, "cleanup.policy=compact" if days is None else f"retention.ms={days * 86_400_000}") for t, (p, days, _) in TOPICS.items()]
    return spark.createDataFrame(rows, "name string, partitions int, config string")


def topic_use(catalogue: DataFrame, records: DataFrame) -> DataFrame:
    """The catalogue with the records of each topic, and how many lie in a partition that it hasn't. records: name, p."""
    some = records.groupBy("name", "p").agg(F.count("*").alias("n"))
    d = catalogue.join(some, "name", "left")
    n = F.coalesce("n", F.lit(0))
    return d.groupBy("name", "partitions", "config").agg(F.sum(n).alias("records"), F.sum(F.when(F.col("p") >= F.col("partitions"), n).otherwise(0)).alias("misplaced"))


def grants_used(arguments: DataFrame, requests: DataFrame) -> DataFrame:
    """Grants with the number of requests of their principal for their name. requests: principal, name."""
    some = requests.groupBy("principal", "name").agg(F.count("*").alias("requests"))
    return arguments.join(some, ["principal", "name"], "left").select(*arguments.columns, F.coalesce("requests", F.lit(0)).alias("requests"))


def subject_catalogue(spark: SparkSession) -> DataFrame:
    """subject, schema, reference of the topics that carry one; an enriched trade refers to the raw trade's subject."""
    rows = [(f"{t}-value", s, "trades.raw-value" if s == "EnrichedTradeEvent" else "-") for t, (_, _, s) in TOPICS.items() if s]
    return spark.createDataFrame(rows, "subject string, schemaName string, reference string")


def masked(df: DataFrame, salt: str = "") -> DataFrame:
    """df with its RESTRICTED columns, by name or by metadata, replaced by a digest; null stays null."""
    hide = [f.name for f in df.schema.fields if f.name in RESTRICTED or f.metadata.get("classification") == "RESTRICTED"]
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in hide})


def avro_schema(name: str, namespace: str = "tickloom.events") -> str:
    """The event's Avro schema as JSON."""
    done: set[str] = set()

    def kind(t: str, must: bool, parent: str):
        if t in FIELDS:
            out = record(t) if t not in done else t
        elif t in ENUMS:
            out = t if t in done else {"type": "enum", "name": t, "symbols": ENUMS[t]}
            done.add(t)
        else:
            out = {"int": "int", "long": "long", "double": "double", "boolean": "boolean", "string": "string", "binary": "bytes", "map": {"type": "map", "values": "string"}, "array": {"type": "array", "items": "string"}, "timestamp": {"type": "long", "logicalType": "timestamp-millis"}}[t]
        return out if must else ["null", out]

    def record(n: str) -> dict:
        done.add(n)
        return {"type": "record", "name": n, "fields": [{"name": f, "type": kind(t, must, n)} | ({} if must else {"default": None}) for f, t, must in fields(n)]}

    return json.dumps({"namespace": namespace} | record(name))


def _union(t) -> list:
    return t if isinstance(t, list) else [t]


def _reads(reader, writer, path: str, named: tuple[dict, dict], seen: frozenset = frozenset()) -> list[str]:
    """Why data of writer can't be read as reader."""
    r = named[0].get(reader, reader) if isinstance(reader, str) else reader
    w = named[1].get(writer, writer) if isinstance(writer, str) else writer
    if isinstance(w, list) or isinstance(r, list):
        out = []
        for x in _union(w):
            tries = [_reads(y, x, path, named, seen) for y in _union(r)]
            if all(tries):
                out.append(f"{path}: {json.dumps(x)[:60]} has no match")
        return out
    wide = {("int", "long"), ("int", "double"), ("long", "double"), ("string", "bytes"), ("bytes", "string")}
    if isinstance(r, str) or isinstance(w, str):
        return [] if r == w or (isinstance(r, str) and isinstance(w, str) and (w, r) in wide) else [f"{path}: {w if isinstance(w, str) else w.get('type')} isn't {r if isinstance(r, str) else r.get('type')}"]
    if r["type"] != w["type"]:
        return [f"{path}: {w['type']} isn't {r['type']}"]
    if r["type"] == "record":
        if r["name"] != w["name"]:
            return [f"{path}: named {w['name']}, not {r['name']}"]
        if r["name"] in seen:
            return []
        have = {f["name"]: f["type"] for f in w["fields"]}
        out = []
        for f in r["fields"]:
            if f["name"] in have:
                out += _reads(f["type"], have[f["name"]], f"{path}.{f['name']}", named, seen | {r["name"]})
            elif "default" not in f:
                out.append(f"{path}.{f['name']}: mandatory, but older data lack it")
        return out
    if r["type"] == "enum":
        gone = sorted(set(w["symbols"]) - set(r["symbols"]))
        return [f"{path}: lost {', '.join(gone)}"] if gone and "default" not in r else []
    inner = {"array": "items", "map": "values"}.get(r["type"])
    return _reads(r[inner], w[inner], path, named, seen) if inner else []


def _named(t, into: dict) -> dict:
    if isinstance(t, list):
        for x in t:
            _named(x, into)
    elif isinstance(t, dict):
        if t.get("type") in ("record", "enum"):
            into[t["name"]] = t
        for x in [f["type"] for f in t.get("fields", [])] + [t[k] for k in ("items", "values") if k in t]:
            _named(x, into)
    return into


def incompatibilities(old: str, new: str) -> list[str]:
    """Faults of full compatibility: each schema must read what the other has written. Mandatory fields may not go either."""
    a, b = json.loads(old), json.loads(new)
    named = _named(a, {}), _named(b, {})
    out = [f"new reads old: {x}" for x in _reads(b, a, a["name"], named[::-1])]
    return out + [f"old reads new: {x}" for x in _reads(a, b, a["name"], named)]


def parse_order(documents: dict[str, str]) -> list[str]:
    """An order in which schema files can be parsed, each after those it refers to; tried until nothing changes."""
    builtin = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}

    def needs(t, own: set[str]) -> set[str]:
        if isinstance(t, str):
            return set() if t in builtin or t in own else {t}
        if isinstance(t, list):
            return set().union(*[needs(x, own) for x in t])
        out: set[str] = set()
        for x in [f["type"] for f in t.get("fields", [])] + [t[k] for k in ("items", "values") if k in t]:
            out |= needs(x, own)
        return out

    left, known, order = {k: json.loads(v) for k, v in documents.items()}, set(), []
    while left:
        ready = [k for k, v in left.items() if needs(v, set(_named(v, {}))) <= known]
        if not ready:
            raise ValueError(f"unresolved schemas: {', '.join(sorted(left))}")
        for k in sorted(ready):
            known |= set(_named(left.pop(k), {}))
            order.append(k)
    return order


def dropped_schemas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Schemas of the baseline that are gone. Both: name, namespace."""
    return baseline.select("name", "namespace").subtract(current.select("name", "namespace"))


def shared_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in both; two sets of settings must have none in common."""
    return a.select("name").intersect(b.select("name"))


def name_chain(modules: DataFrame, applications: DataFrame, principals: DataFrame) -> DataFrame:
    """Names that aren't module, application and principal alike."""
    tagged = modules.select("name", F.lit("module").alias("k")).unionByName(applications.select("name", F.lit("application").alias("k"))).unionByName(principals.select("name", F.lit("principal").alias("k")))
    return tagged.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("found")).filter("found <> 'application,module,principal'")


def crossing_edges(edges: DataFrame, planes: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Dependencies between planes that aren't allowed. edges: src, dst; planes: module, plane."""
    p = small(planes)
    d = edges.join(p.select(F.col("module").alias("src"), F.col("plane").alias("from_plane")), "src").join(p.select(F.col("module").alias("dst"), F.col("plane").alias("to_plane")), "dst")
    ok = F.concat_ws(">", "from_plane", "to_plane").isin([f"{a}>{b}" for a, b in allowed])
    return d.filter((F.col("from_plane") != F.col("to_plane")) & ~ok)
