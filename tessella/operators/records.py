"""Invocation records: listing, counting, retention, read and write of the index; entity, subject and limit documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from .relational import page

ACTIVATION = (
    "namespace string, name string, subject string, activationId string, start bigint, `end` bigint, cause string, "
    "response struct<statusCode: int, result: string, size: int>, logs array<string>, version string, publish boolean, "
    "annotations array<struct<key: string, value: string>>, duration bigint"
)
SUMMARY = ("namespace", "name", "version", "publish", "annotations", "activationId", "start", "end", "duration", "cause", "statusCode")
#: The largest page that a listing returns.
MOST = 200
ENTITY_FIELDS = {
    "action": ("namespace", "name", "version", "publish", "annotations", "limits", "exec", "updated"),
    "trigger": ("namespace", "name", "version", "publish", "annotations", "updated"),
    "rule": ("namespace", "name", "version", "publish", "annotations", "updated"),
    "package": ("namespace", "name", "version", "publish", "annotations", "binding", "updated"),
}


def summarize(acts: DataFrame) -> DataFrame:
    """Summary fields: no end, duration and status while running."""
    done = F.col("end") != 0
    out = acts.withColumns({"duration": S.duration("start", "end", "duration" if "duration" in acts.columns else None), "statusCode": F.when(done, F.col("response.statusCode")), "end": F.when(done, F.col("end"))})
    return out.select(*[c for c in SUMMARY if c in out.columns])


def _matching(acts: DataFrame, namespace: str | None, path: str | None, since: int | None, upto: int | None) -> DataFrame:
    out = acts.where(S.in_time_range("start", since, upto))
    if path is not None:
        # what namespace and name can be in this path; stored columns, so it reaches the scan and few paths are put together
        parts = path.split("/")
        for c, ends in (("namespace", [parts[:i] for i in range(1, len(parts) + 1)]), ("name", [parts[i:] for i in range(len(parts))])):
            out = out.where(F.col(c).isNull() | F.col(c).isin(["/".join(x) for x in ends]))
        return out.where(S.filter_path("namespace", "name", "annotations") == path)
    return out.where(F.col("namespace") == namespace) if namespace is not None else out


def list_activations(acts: DataFrame, namespace: str | None = None, since: int | None = None, upto: int | None = None, skip: int = 0, limit: int = 0, docs: bool = False, path: str | None = None, most: int | None = None) -> DataFrame:
    """Newest first, ties by id; bounds inclusive; by namespace, or by entity path ``ns/[pkg/]name``. docs gives whole records."""
    found = page(_matching(acts, namespace, path, since, upto), [F.desc("start"), F.asc("activationId")], skip, limit, most)
    return found if docs else summarize(found)


def count_activations(acts: DataFrame, namespace: str | None = None, since: int | None = None, upto: int | None = None, skip: int = 0, path: str | None = None) -> DataFrame:
    if skip < 0:
        raise ValueError("skip must not be negative")
    return _matching(acts, namespace, path, since, upto).agg(F.greatest(F.count("*") - skip, F.lit(0)).alias("activations"))


def get_activation(acts: DataFrame, activation_id: str, part: str = "all") -> DataFrame:
    """One record: all of it, its result or its logs; ``end`` and ``duration`` are null while running."""
    one = acts.where(F.col("activationId") == activation_id)
    if part == "result":
        return one.select("activationId", F.col("response.statusCode").alias("statusCode"), F.col("response.result").alias("result"), S.status_name(F.col("response.statusCode")).alias("status"))
    if part == "logs":
        return one.select("activationId", "logs")
    return one.withColumns({"duration": S.duration("start", "end", "duration"), "end": F.when(F.col("end") != 0, F.col("end"))})


def retain(acts: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Records that aren't older than so many days."""
    return acts.where(F.col("start") >= now_ms - days * 86_400_000)


def strip_logs(acts: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Older records lose their logs, but for those of kind sequence."""
    old = F.col("start") < now_ms - days * 86_400_000
    sequence = F.coalesce(S.annotation("annotations", "kind") == "sequence", F.lit(False))
    return acts.withColumn("logs", F.when(old & ~sequence, F.array().cast("array<string>")).otherwise(F.col("logs")))


def live_documents(docs: DataFrame, doc_id: str = "_id", deleted: str = "deleted") -> DataFrame:
    return docs.where(~F.coalesce(F.col(deleted), F.lit(False)) & ~F.col(doc_id).startswith("_design/"))


def foreign_changes(changes: DataFrame, cluster_id: str | None, col: str = "clusterId") -> DataFrame:
    """Changes that another cluster wrote, those without an origin included; all if the own id isn't known."""
    return changes if cluster_id is None else changes.where(~F.col(col).eqNullSafe(cluster_id))


def snapshot(docs: DataFrame, folder: str, snapshot_id: str) -> str:
    """Copies live documents to a folder of the snapshot's own."""
    path = f"{folder}/{snapshot_id}"
    live_documents(docs).write.mode("overwrite").parquet(path)
    return path


def expired_snapshots(names: DataFrame, now_s: int, keep_s: int, prefix: str = "backup_", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Names ``<prefix><seconds>_...`` whose time is longer ago than keep_s; excluded ones stay."""
    at = F.regexp_extract("name", rf"^{prefix}(\d+)_", 1).try_cast("bigint")
    out = names.where(at.isNotNull() & (at < now_s - keep_s))
    for x in exclude:
        out = out.where(~F.col("name").endswith(x))
    return out


def to_index(acts: DataFrame) -> DataFrame:
    """Index form: path (by binding, else path annotation, else ns/name), @timestamp, annotations as a map, result as text, index name."""
    binding, path = S.annotation("annotations", "binding"), S.annotation("annotations", "path")
    named = F.coalesce(F.when(binding.isNotNull(), F.concat_ws("/", binding, "name")), path, F.concat_ws("/", "namespace", "name"))
    return acts.withColumns({"path": named, "@timestamp": F.timestamp_millis("start"), "annotations": S.pairs_to_map("annotations"), "index": F.lower(S.root_namespace("namespace"))})


def from_index(df: DataFrame) -> DataFrame:
    """Inverse of to_index(); a result that is no JSON object becomes null."""
    result = F.col("response.result")
    good = F.when(F.from_json(result, "map<string, string>").isNotNull() & F.trim(result).startswith("{"), result)
    fixed = F.struct(F.col("response.statusCode").alias("statusCode"), good.alias("result"), F.col("response.size").alias("size"))
    return df.withColumns({"annotations": S.map_to_pairs("annotations"), "response": fixed}).drop("path", "@timestamp", "index")


def write_activations(acts: DataFrame, path: str) -> None:
    """One index a lower-cased namespace, as a column that files are dealt and sorted by: an index lies in few row groups side by side, which
    their statistics find, a large one in several files by time, small ones together. So there are as many files as the bytes ask for,
    however many namespaces there are."""
    to_index(acts).repartitionByRange("index", "start").sortWithinPartitions("index", "start").write.mode("overwrite").parquet(path)


def read_activations(spark: SparkSession, path: str) -> DataFrame:
    return from_index(spark.read.parquet(path))


def explode_namespaces(df: DataFrame, ns: str = "namespace", out: str = "listed_under") -> DataFrame:
    """Each document under its own namespace and under its root."""
    return df.withColumn(out, F.explode(F.array_distinct(F.array(F.col(ns), S.root_namespace(ns)))))


def list_entities(docs: DataFrame, view: str, namespace: str, since: int | None = None, upto: int | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
    """Entities of a view (actions, rules, triggers, packages, packages-public) in a namespace, newest update first, ties by namespace and name."""
    kind = {"actions": "action", "rules": "rule", "triggers": "trigger", "packages": "package", "packages-public": "package"}[view]
    found = docs.where((F.col("entityType") == kind) & S.in_time_range("updated", since, upto))
    if view == "packages-public":
        found = found.where(F.coalesce("publish", F.lit(False)) & (F.coalesce(F.size("binding"), F.lit(0)) < 1))
    found = found.where((F.col("namespace") == namespace) | (S.root_namespace("namespace") == namespace))
    if "exec" in docs.columns and kind == "action":
        found = found.withColumn("exec", F.struct(F.coalesce(F.col("exec.binary"), F.lit(False)).alias("binary")))
    return page(found, [F.desc(F.coalesce("updated", F.lit(0))), F.asc("namespace"), F.asc("name")], skip, limit).select(*[c for c in ENTITY_FIELDS[kind] if c in docs.columns])


def subject_identities(subjects: DataFrame, limits: DataFrame, by: str, key: tuple[str, ...]) -> DataFrame:
    """Identities (namespace, uuid, key) that match a namespace name, or a (uuid, key): the subject's own first, then its namespaces.

    Blocked subjects match nothing. A match by namespace carries its limits document (null fields if there is none).
    """
    open_ = subjects.where(~F.coalesce("blocked", F.lit(False)))
    own = open_.select("subject", F.lit(0).alias("pos"), F.col("subject").alias("namespace"), "uuid", "key")
    more = open_.select("subject", F.posexplode("namespaces").alias("pos", "n")).select("subject", (F.col("pos") + 1).alias("pos"), F.col("n.name").alias("namespace"), "n.uuid", "n.key")
    every = own.unionByName(more)
    if by == "namespace":
        found = every.where(F.col("namespace") == key[0])
        l = limits.select(F.col("_id").alias("__id"), "concurrentInvocations", "invocationsPerMinute")
        found = found.join(l, F.concat("namespace", F.lit("/limits")) == F.col("__id"), "left").drop("__id")
    elif by == "uuid":
        found = every.where((F.col("uuid") == key[0]) & (F.col("key") == key[1])).withColumns({c: F.lit(None).cast("int") for c in ("concurrentInvocations", "invocationsPerMinute")})
    else:
        raise ValueError("by must be 'namespace' or 'uuid'")
    return found.orderBy("subject", "pos").drop("pos")


def blocked_namespaces(subjects: DataFrame, limits: DataFrame) -> DataFrame:
    """Namespaces whose limits allow no invocation, and those of blocked subjects, with the number of reasons."""
    none = limits.where("_id like '%/limits' and (concurrentInvocations = 0 or invocationsPerMinute = 0)").select(F.regexp_replace("_id", "/limits$", "").alias("namespace"))
    blocked = subjects.where(F.coalesce("blocked", F.lit(False))).select(F.explode("namespaces.name").alias("namespace"))
    return none.unionByName(blocked).groupBy("namespace").agg(F.count("*").alias("reasons"))


def search(df: DataFrame, *conditions: Column, since: object = None, upto: object = None, time: str = "time", sort: str | None = None, desc: bool = False, start: int = 0, size: int = 0, agg: tuple[str, str] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Log search: all conditions (term, match, phrase, prefix below) and an inclusive range, then a page or a minimum / maximum."""
    for c in conditions:
        df = df.where(c)
    if since is not None:
        df = df.where(F.col(time) >= since)
    if upto is not None:
        df = df.where(F.col(time) <= upto)
    if agg:
        f, c = agg
        return df.agg({"min": F.min, "max": F.max}[f](c).alias(f"{f}_{c}"))
    return page(df, [F.col(sort or time).desc() if desc else F.col(sort or time).asc(), *ties], start, size)


def term(c: str, value: object) -> Column:
    return F.col(c) == value


def match(c: str, words: str) -> Column:
    """Any of the words occurs as a word, whatever its case."""
    return F.arrays_overlap(F.split(F.lower(F.col(c)), r"\W+"), F.array(*[F.lit(w) for w in words.lower().split()]))


def phrase(c: str, text: str) -> Column:
    return F.lower(F.col(c)).contains(text.lower())


def phrase_prefix(c: str, text: str) -> Column:
    return F.lower(F.col(c)).startswith(text.lower())


def activation_logs(logs: DataFrame, acts: DataFrame, activation_id: str, pad_ms: int = 5000) -> DataFrame:
    """Log lines of one activation within its bounds, padded on both sides, oldest first, as text. An activation that is running has no upper bound."""
    one = acts.where(F.col("activationId") == activation_id).select(F.col("activationId").alias("__a"), F.col("start").alias("__s"), F.when(F.col("end") != 0, F.col("end")).alias("__e"))
    t = F.unix_millis(F.col("time").cast("timestamp"))
    found = logs.where(F.col("activationId") == activation_id).join(one, F.col("activationId") == F.col("__a"))
    found = found.where((t >= F.col("__s") - pad_ms) & (F.col("__e").isNull() | (t <= F.col("__e") + pad_ms)))
    return found.orderBy("time").select("time", S.log_line("time", "stream", "log").alias("line"))


def enrich_logs(logs: DataFrame, acts: DataFrame) -> DataFrame:
    """Each line as JSON with activationId, action, namespace and subject of its record; the record itself follows as the last line (seq 1)."""
    who = acts.select("activationId", F.concat_ws("/", "namespace", "name").alias("action"), "namespace", F.col("subject").alias("namespaceId"))
    lines = logs.join(who, "activationId").select("activationId", F.lit(0).alias("seq"), "time", F.to_json(F.struct("activationId", "action", "namespace", "namespaceId", "time", "stream", "log")).alias("line"))
    own = acts.select("activationId", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("time"), F.to_json(F.struct(*acts.columns)).alias("line"))
    return lines.unionByName(own)
