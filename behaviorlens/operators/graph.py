"""Provenance graphs: relations from events, nodes, edges and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.functions.columns import hmac_sha256
from behaviorlens.operators.sessions import behind_running_max, first_wins


#: Node kinds and the actions that accept a connection.
ACCEPTS = ("EVENT_ACCEPT", "EVENT_RECVMSG", "EVENT_RECVFROM", "ACCEPT")
SPAWNS = ("EVENT_FORK", "EVENT_CLONE", "EVENT_CREATE_PROCESS")
CDM = "dataset.tc_cdm"


def graph_id(key: bytes, kind: Column, *parts: Column) -> Column:
    """kind:keyed hash of kind and parts."""
    return F.concat_ws(":", kind, F.substring(hmac_sha256(key, F.concat_ws("\x1f", kind, *parts)), 1, 32))


def relations(events: DataFrame) -> DataFrame:
    """Events with relation, source and target (kind, identity) and missing (names of identities that the event lacks);
    relation is null where the event is not supported.

    events has event_id, source, event_type, native_action, actor_id, actor_defined, object_id, object_kind, principal.  An identity that is
    missing is the event itself, a host's identity within its host is 'host'."""
    t, action, kind = F.col("event_type"), F.upper(F.coalesce("native_action", F.lit(""))), F.lower(F.coalesce("object_kind", F.lit("")))
    cdm, operation = F.col("source") == CDM, F.regexp_replace(action, "^EVENT_", "")
    actor, target, principal = (F.nullif(F.col(c), F.lit("")) for c in ("actor_id", "object_id", "principal"))
    own = F.col("event_id").cast("string")
    lacks = lambda **of: F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k.replace("_", "."))) for k, v in sorted(of.items())]))
    edge = lambda name, sk, s, tk, t, missing: F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("relation"), F.struct(F.lit(sk).alias("kind"), s.alias("identity")).alias("source_node"),
        F.struct(F.lit(tk).alias("kind"), t.alias("identity")).alias("target_node"), missing.alias("missing"),
    )
    both, none, host = lacks(actor_id=actor, object_id=target), F.array().cast("array<string>"), F.lit("host")
    process = kind.isin("process", "subject")
    file_relation = F.when(operation == "READ", "read").when(operation == "WRITE", "wrote").when(operation == "RENAME", "renamed")
    stopped = F.when(process, target).otherwise(actor)
    spawned = edge("spawned", "process", actor, "process", target, none)
    found = (
        F.when(cdm & (F.col("actor_defined") == False), None)  # noqa: E712
        .when((t == "process_started") & cdm & (action == "EVENT_EXECUTE") & (kind == "fileobject") & target.isNotNull(), edge("executed", "process", F.coalesce(actor, own), "executable", target, lacks(actor_id=actor)))
        .when((t == "process_started") & cdm & action.isin(*SPAWNS) & (kind == "subject") & actor.isNotNull() & target.isNotNull(), spawned)
        .when((t == "process_started") & cdm, None)
        .when((t == "process_started") & (actor != target) & process, spawned)
        .when(t == "process_started", edge("started", "host", host, "process", F.coalesce(actor, target, own), both))
        .when(t == "process_stopped", edge("stopped", "process", F.coalesce(stopped, own), "host", host, lacks(actor_id=stopped)))
        .when((t == "file_activity") & (~cdm | (kind == "fileobject")) & file_relation.isNotNull(), edge(file_relation, "process", F.coalesce(actor, own), "file", F.coalesce(target, own), both))
        .when((t == "network_activity") & (~cdm | (kind == "netflowobject")), edge(
            F.when(action.isin(*ACCEPTS), "accepted").otherwise("connected"), "process", F.coalesce(actor, own), "socket_endpoint", F.coalesce(target, own), both))
        .when(t == "authentication_activity", edge("authenticated", "user", F.coalesce(principal, own), "host", host, lacks(actor_principal=principal)))
    )
    return events.withColumn("edge", found).select("*", "edge.*").drop("edge")


def conflicting_events(events: DataFrame) -> DataFrame:
    """(event_id) of the ids that stand on events which differ in anything but row_no; a graph is refused while there are any."""
    body = F.sha2(F.to_json(F.struct(*[c for c in events.columns if c != "row_no"])), 256)
    return events.groupBy("event_id").agg(F.min(body).alias("low"), F.max(body).alias("high")).where("low != high").select("event_id")


def admission_faults(events: DataFrame, sources: tuple[str, ...] = ("dataset.optc", CDM)) -> DataFrame:
    """(event_id, fault) of events that a graph does not admit: an id that is no UUID, a host that is no pseudonym of 16 hex digits, a source that is not
    known, a missing time, or an envelope (class_uid, activity_id, type_uid) that contradicts itself or the event's type."""
    classes = F.create_map(*[F.lit(x) for kv in {"process_started": 1007, "process_stopped": 1007, "file_activity": 1001, "network_activity": 4001, "authentication_activity": 3002}.items() for x in kv])
    uid, expected = F.col("class_uid"), F.element_at(classes, F.col("event_type"))
    checks = {
        "event_id must be a UUID": ~F.coalesce(F.lower(F.col("event_id").cast("string")).rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), F.lit(False)),
        "host must be a pseudonymous token": ~F.coalesce(F.col("host").rlike("^[0-9a-f]{16}$"), F.lit(False)),
        "unsupported normalized source": ~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "event time is missing": F.col("epoch_us").isNull(),
        "class and activity identifiers are invalid": ~F.coalesce((uid >= 0) & (F.col("activity_id") >= 0) & (F.col("type_uid") == uid * 100 + F.col("activity_id")), F.lit(False)),
        "event type disagrees with its class": expected.isNotNull() & (uid != expected),
    }
    return events.select("event_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()]))).alias("fault"))


def admitted(events: DataFrame, most: int | None = None) -> DataFrame:
    """events, or a ValueError: for a fault of one of them, for one id on different events, or for more than ``most`` of them."""
    if most is not None and events.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} events")
    fault = admission_faults(events).first()
    if fault:
        raise ValueError(f"{fault['fault']}: {fault['event_id']}")
    clash = conflicting_events(events).first()
    if clash:
        raise ValueError(f"conflicting duplicate event_id: {clash['event_id']}")
    return events


def build_graph(events: DataFrame, key: bytes, dataset: str = "dataset") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats).  Repeated events count once, in order of row_no; unsupported events do not advance a host's clock;
    an edge with a missing identity or out of time order has confidence 0.5.  Identities hold within their host.

    events has what relations reads, host, epoch_us and row_no; conflicting_events should be empty."""
    once = first_wins(events, ["event_id"], ["row_no"])
    related = relations(once)
    kept = related.where("relation is not null")
    kept = kept.withColumn("reordered", behind_running_max(kept, ["host"], "epoch_us", ["row_no"]))
    of = F.lit(dataset)
    end = lambda c: graph_id(key, F.col(f"{c}.kind"), of, F.col("host"), F.col(f"{c}.identity"))
    kept = kept.withColumn("source", end("source_node")).withColumn("target", end("target_node")).withColumn("missing_identity", F.size("missing") > 0)
    own = F.col("event_id").cast("string")
    edges = kept.select(
        graph_id(key, F.lit("edge"), of, own, F.col("relation"), F.col("source"), F.col("target")).alias("edge_id"), "event_id", "host", "epoch_us", "relation", "source", "target",
        F.col("source_node.kind").alias("source_kind"), F.col("target_node.kind").alias("target_kind"), graph_id(key, F.lit("event"), of, own).alias("source_event_id"),
        "missing", "reordered", (F.col("copies") > 1).alias("duplicate"), "missing_identity", F.when(F.col("missing_identity") | F.col("reordered"), 0.5).otherwise(1.0).alias("confidence"),
    )
    refs = edges.select("epoch_us", F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.col("source_kind").alias("kind")), F.struct(F.col("target").alias("node"), F.col("target_kind").alias("kind")),
        F.struct(graph_id(key, F.lit("host"), of, F.col("host"), F.lit("host")).alias("node"), F.lit("host").alias("kind")),
    )).alias("r")).select("epoch_us", "r.*")
    nodes = refs.groupBy("node").agg(F.min("kind").alias("kind"), F.min("epoch_us").alias("first_seen"), F.max("epoch_us").alias("last_seen"))
    undefined = (F.col("source") == CDM) & ((F.col("actor_defined") == False) | (F.col("object_defined") == False))  # noqa: E712
    counted = related.agg(
        F.sum("copies").alias("input"), F.sum(F.col("copies") - 1).alias("duplicates"), F.count_if(F.col("relation").isNull()).alias("unsupported"),
        F.count("relation").alias("accepted"), F.count_if(undefined).alias("unresolved"),
    )
    marks = edges.agg(F.count_if("reordered").alias("reordered"), F.count_if("missing_identity").alias("missing_identity"))
    return nodes, edges, counted.crossJoin(F.broadcast(marks))


def in_order(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id, edges by time and id."""
    return nodes.orderBy("node"), edges.orderBy("epoch_us", "edge_id")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes; a valid graph has none."""
    ends = edges.select("event_id", F.explode(F.array("source", "target")).alias("node"))
    return ends.join(nodes.select("node"), "node", "left_anti")
