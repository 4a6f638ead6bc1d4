"""Text, identifier, adapter, envelope, graph and streaming queries, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.functions import ocsf
from behaviorlens.operators import graph, quality
from behaviorlens.plans.behaviour import DAY, EV, RECURSIVE, ev_norm, read
from behaviorlens.sources import adapters, files
from behaviorlens.sources.store import shared_dir
from behaviorlens.streaming import windows as streaming

KEY = b"behaviorlens-example-key"
SALT = "example"


def q_redact(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", fn.redact_text(F.coalesce("text", F.lit(""))).alias("text"))


def q_exposures(spark, sf_dir):
    return quality.secret_exposures(read(spark, sf_dir, "documents").withColumnRenamed("source", "token"), "doc_id", ["text", "token"])


def q_pseudonyms(spark, sf_dir):
    return ev_norm(spark, sf_dir).select("event_id", fn.pseudonym(SALT, F.col("host")).alias("pseudonym"), fn.host_id(SALT, F.col("host")).alias("host_id"))


def q_uuid5(spark, sf_dir):
    return ev_norm(spark, sf_dir).select("event_id", fn.uuid5(F.lit("lanl"), F.col("event_id").cast("string"), F.col("host")).alias("uuid"))


def q_hmac(spark, sf_dir):
    return ev_norm(spark, sf_dir).select("event_id", fn.hmac_sha256(KEY, F.concat_ws("\x1f", F.lit("host"), "host")).alias("hmac"))


def pick(names, at):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (at % len(names) + 1).cast("int"))


#: What the made rows of the adapters hold, by k or event_id.
LANL_IDS = (4624, 4625, 4634, 4647, 4672, 4688, 4689, 1)
OPTC_MADE = (("PROCESS", "FLOW", "FILE", "REGISTRY", "gadget"), ("CREATE", "TERMINATE", "READ", "open", "WRITE", "FLY"), ("C:\\a\\b.EXE", "/x/y.csv", "plain", "z.so", "/d/.bat", "q.com"))
UNSW_LABELS = ("", "0", "Normal", "1", "dos")
CDM_MADE = ("EVENT_EXECUTE", "EVENT_EXIT", "EVENT_SENDTO", "EVENT_WRITE", "EVENT_LOGIN", "EVENT_CREATE_THREAD", "EVENT_MODIFY_FILE_ATTRIBUTES")
COMMON = ["event_id", "epoch_us", "host", "event_type", "class_name", "activity_name", "status"]


def q_lanl(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    rows = ev.select(
        F.col("event_id").alias("row_no"), F.floor(F.col("epoch_us") / 1_000_000).alias("Time"), pick(LANL_IDS, F.col("k")).alias("EventID"), F.nullif("host", F.lit("u1")).alias("Computer"),
        F.col("process_name").alias("UserName"), F.nullif("process_name", F.lit("p3")).alias("ProcessName"),
    )
    return adapters.lanl(rows, SALT).select(*COMMON, "native_event_id", "user_name", "process_name")


def q_optc(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    rows = ev.select(
        F.col("event_id").alias("row_no"), F.floor(F.col("epoch_us") / 1000).alias("timestamp"), F.col("host").alias("hostname"), F.concat(F.lit("o"), F.col("k")).alias("objectID"), pick(OPTC_MADE[0], F.col("k")).alias("object"),
        pick(OPTC_MADE[1], F.col("k")).alias("action"), F.nullif("process_name", F.lit("unknown")).alias("actorID"), F.struct(pick(OPTC_MADE[2], F.col("k")).alias("image_path")).alias("properties"), F.lit("Benign").alias("label"),
    )
    return adapters.optc(rows, SALT).select(*COMMON, "native_object", "native_action", "semantic_action", "label", "actor_id", "object_id", "object_kind", "path_category")


def q_unsw(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    rows = ev.select(
        F.col("event_id").alias("row_no"), F.floor(F.col("epoch_us") / 1_000_000).alias("stime"), F.nullif("host", F.lit("u1")).alias("srcip"), F.col("remote").alias("dstip"), pick(UNSW_LABELS, F.col("k")).alias("label"),
        F.when(F.col("event_id") % 7 == 0, "Worms").when(F.col("event_id") % 7 == 1, "").alias("attack_cat"),
    )
    return adapters.unsw(rows, SALT).select(*COMMON, "remote", "label")


def q_loghub(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_no"), F.col("doc_id").alias("Time"), F.nullif("source", F.lit("src1")).alias("Node"), F.col("text").alias("Content"))
    return adapters.loghub(rows, SALT).select(*COMMON, "message")


def q_cdm(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    kind = F.when(F.col("k") % 3 == 0, "Subject").when(F.col("k") % 3 == 1, "FileObject").otherwise("MemoryObject")
    objects = ev.select(F.concat(F.lit("s"), F.col("k") % 50).alias("uuid"), kind.alias("kind"), F.nullif("host", F.lit("u2")).alias("host_id"), F.col("event_id").alias("row_no"))
    events = ev.select(
        F.col("event_id").alias("row_no"), F.concat(F.lit("s"), F.col("k") % 60).alias("subject"), F.when(F.col("k") % 4 > 0, F.concat(F.lit("s"), F.col("k") % 55)).alias("predicate_object"),
        F.when(F.col("event_id") % 3 == 0, F.col("host")).alias("host_id"), pick(CDM_MADE, F.col("k")).alias("type"), (F.col("epoch_us") * 1000).alias("nanos"),
    )
    return adapters.cdm(objects, events, SALT).select(*COMMON, "native_action", "actor_id", "actor_kind", "actor_defined", "object_id", "object_kind", "object_defined")


def enveloped(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    kind = F.col("event_type")
    name = F.when(kind.startswith("process"), "Process Activity").when(kind.startswith("auth"), "Authentication").when(kind == "privilege_elevation", "Security Finding").otherwise("Software Inventory Info")
    activity = F.when(kind == "process_started", "Launch").when(kind == "process_stopped", "Terminate").when(kind.startswith("auth"), "Logon").otherwise("Observe")
    status = F.when(kind == "authentication_failure", "failure").otherwise("success")
    level = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 50, "odd").otherwise("informational")
    uid = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("event_id").cast("string"))
    return ev.select("event_id", ocsf.envelope(name, activity, level, status, F.floor(F.col("epoch_us") / 1000), uid, "behaviorlens").alias("o"))


def q_ocsf_envelope(spark, sf_dir):
    return enveloped(spark, sf_dir).select("event_id", "o.activity_id", "o.activity_name", "o.category_uid", "o.category_name", "o.class_uid", "o.class_name", "o.severity_id", "o.severity", "o.status_id", "o.status", "o.time", "o.type_uid")


def q_ocsf_validate(spark, sf_dir):
    of = lambda n, name: F.when(F.col("event_id") % n == 0, name)
    objects = F.array_compact(F.array(of(2, "process"), of(3, "user"), of(4, "dst_endpoint"), of(5, "finding_info"), F.lit("device")))
    issues = enveloped(spark, sf_dir).select(F.explode(ocsf.core_issues(F.col("o"), objects)).alias("issue"))
    return issues.groupBy("issue").agg(F.count("*").alias("n"))


GRAPH_TYPES = ("process_started", "process_stopped", "file_activity", "network_activity", "authentication_activity", "package_installed")
GRAPH_ACTIONS = ("EVENT_EXECUTE", "EVENT_FORK", "READ", "EVENT_WRITE", "RENAME", "EVENT_RECVFROM", "RECVFROM")
GRAPH_KINDS = ("FileObject", "Subject", "NetFlowObject", "Process")


def graphed(spark, sf_dir):
    ev, i = ev_norm(spark, sf_dir), F.col("event_id")
    rows = ev.select(
        "event_id", F.when(i % 3 == 0, "dataset.tc_cdm").otherwise("dataset.optc").alias("source"), pick(GRAPH_TYPES, F.col("k")).alias("event_type"), pick(GRAPH_ACTIONS, i).alias("native_action"), "host", "epoch_us",
        F.nullif("process_name", F.lit("unknown")).alias("actor_id"), F.when(F.col("k") % 7 > 0, F.concat(F.lit("p"), F.col("k") % 7)).alias("object_id"), pick(GRAPH_KINDS, F.floor(i / 7)).alias("object_kind"),
        F.nullif("remote", F.lit("local")).alias("principal"), (i % 11 != 0).alias("actor_defined"), (i % 13 != 0).alias("object_defined"), F.pmod(i * 7919, F.lit(1_000_003)).alias("row_no"),
    )
    return graph.build_graph(rows.unionByName(rows.where("event_id % 10 = 0").withColumn("row_no", F.col("row_no") + 2_000_003)), KEY)


def q_graph_nodes(spark, sf_dir):
    return graphed(spark, sf_dir)[0].select("node", "kind", "first_seen", "last_seen")


def q_graph_edges(spark, sf_dir):
    return graphed(spark, sf_dir)[1].select(
        "edge_id", "event_id", "relation", "source", "target", F.array_join("missing", ",").alias("missing"), "reordered", "duplicate", "confidence"
    )


def q_graph_stats(spark, sf_dir):
    return graphed(spark, sf_dir)[2]


def q_auth_log(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    line = F.element_at(F.array(
        F.concat(F.lit("sshd[1]: Accepted password for "), "host", F.lit(" from 10.0.0."), F.col("k"), F.lit(" port 22")), F.concat(F.lit("sshd[1]: Failed password for invalid user "), "host", F.lit(" from 10.0.0.9 port 22")),
        F.concat(F.lit("sudo: "), "host", F.lit(" : TTY=x ; USER=root ; COMMAND=/bin/ls")), F.concat(F.lit("session opened for user "), "host"), F.concat(F.lit("session closed for user "), "host"), F.lit("nothing"),
    ), (F.col("k") % 6 + 1).cast("int"))
    return ev.select("event_id", files.auth_event(line).alias("e")).where("e is not null").select("event_id", "e.*")


def streamed(spark, run, sf_dir, columns):
    """The result of a streaming query over the events as they lie, read until they end."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events*.parquet")
    kinds = {"click": "process_started", "view": "process_stopped", "error": "authentication_failure", "signup": "authentication_success"}
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.when(F.col("value") >= 100, "privilege_elevation").otherwise("package_installed"))
    rows = source.select("event_id", F.concat(F.lit("u"), "user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), mapped.alias("event_type"), "value")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = run(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select(*columns)


def q_stream_windows(spark, sf_dir):
    return streamed(spark, lambda rows: streaming.stream_windows(rows, DAY), sf_dir, ["host", "window_start", "metric_sample_count", F.round("value", 6).alias("value"), "event_process_started_count"])


def q_stream_ewma(spark, sf_dir):
    return streamed(spark, lambda rows: streaming.stream_ewma(rows, "host", "value", 4.0), sf_dir, ["host", F.unix_micros("ts").alias("epoch_us"), F.round("score", 4).alias("score"), "is_anomaly"])


def q_stream_cooldown(spark, sf_dir):
    return streamed(spark, lambda rows: streaming.stream_cooldown(rows.where("event_type = 'privilege_elevation'"), "host", 2 * DAY), sf_dir, ["host", F.unix_micros("ts").alias("epoch_us")])


# The patterns of fn, for DuckDB's engine.
_REDACTIONS = [(p, r.replace("$1", r"\1").replace("$3", r"\3")) for p, r in (fn.URL_CREDENTIALS, fn.AUTHORIZATION, fn.KEY_VALUE)]


def _redacted(text: str) -> str:
    for pattern, by in _REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


_PSEUDONYM = lambda c: f"substr(sha256('{SALT}' || chr(31) || {c}), 1, 16)"
_INNER, _OUTER = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
_HMAC = lambda m: f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({m}))))"
_UUID = (
    "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3), substr(h, 21, 12))"
)
_ISO = lambda us: f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN 'Z' ELSE '.' || lpad(({us} % 1000000)::VARCHAR, 6, '0') || 'Z' END)"
_EVENT_HASH = lambda dataset, us: f"sha1(unhex('{fn.NAMESPACE_URL}') || encode(concat_ws(chr(31), '{dataset}', row_no, {_ISO(us)}, host, event_type)))"
_LIST = lambda names: "[" + ", ".join(f"'{n}'" if isinstance(n, str) else str(n) for n in names) + "]"
_ID = lambda kind, *parts: f"({kind} || ':' || substr({_HMAC('concat_ws(chr(31), ' + ', '.join((kind, *parts)) + ')')}, 1, 32))"
_GRAPH = EV + f"""
    , g0 AS (SELECT event_id, host, us, event_id % 3 = 0 AS cdm, {_LIST(GRAPH_TYPES)}[k % 6 + 1] AS t, {_LIST(GRAPH_ACTIONS)}[event_id % 7 + 1] AS a, lower({_LIST(GRAPH_KINDS)}[(event_id // 7) % 4 + 1]) AS kind,
        nullif(process_name, 'unknown') AS actor, CASE WHEN k % 7 > 0 THEN 'p' || (k % 7) END AS object, nullif(remote, 'local') AS principal, event_id % 11 <> 0 AS known, event_id % 13 <> 0 AS object_known,
        (event_id * 7919) % 1000003 AS row_no FROM ev),
    g1 AS (SELECT *, CASE
        WHEN cdm AND NOT known THEN NULL
        WHEN t = 'process_started' AND cdm THEN CASE WHEN a = 'EVENT_EXECUTE' AND kind = 'fileobject' AND object IS NOT NULL THEN 'executed'
            WHEN a = 'EVENT_FORK' AND kind = 'subject' AND actor IS NOT NULL AND object IS NOT NULL THEN 'spawned' END
        WHEN t = 'process_started' THEN CASE WHEN actor <> object AND kind IN ('process', 'subject') THEN 'spawned' ELSE 'started' END
        WHEN t = 'process_stopped' THEN 'stopped'
        WHEN t = 'file_activity' AND (NOT cdm OR kind = 'fileobject') THEN CASE a WHEN 'READ' THEN 'read' WHEN 'EVENT_WRITE' THEN 'wrote' WHEN 'RENAME' THEN 'renamed' END
        WHEN t = 'network_activity' AND (NOT cdm OR kind = 'netflowobject') THEN CASE WHEN a = 'EVENT_RECVFROM' THEN 'accepted' ELSE 'connected' END
        WHEN t = 'authentication_activity' THEN 'authenticated' END AS relation FROM g0),
    g2 AS (SELECT *, CASE relation WHEN 'started' THEN 'host' WHEN 'authenticated' THEN 'user' ELSE 'process' END AS sk,
        CASE WHEN relation = 'started' THEN 'host' WHEN relation = 'authenticated' THEN coalesce(principal, event_id::VARCHAR)
             WHEN relation = 'stopped' THEN coalesce(CASE WHEN kind IN ('process', 'subject') THEN object ELSE actor END, event_id::VARCHAR) ELSE coalesce(actor, event_id::VARCHAR) END AS sv,
        CASE WHEN relation IN ('stopped', 'authenticated') THEN 'host' WHEN relation IN ('read', 'wrote', 'renamed') THEN 'file' WHEN relation IN ('accepted', 'connected') THEN 'socket_endpoint'
             WHEN relation = 'executed' THEN 'executable' ELSE 'process' END AS tk,
        CASE WHEN relation IN ('stopped', 'authenticated') THEN 'host' WHEN relation = 'started' THEN coalesce(actor, object, event_id::VARCHAR) ELSE coalesce(object, event_id::VARCHAR) END AS tv,
        CASE WHEN relation IN ('started', 'read', 'wrote', 'renamed', 'accepted', 'connected') THEN concat_ws(',', CASE WHEN actor IS NULL THEN 'actor.id' END, CASE WHEN object IS NULL THEN 'object.id' END)
             WHEN relation = 'executed' AND actor IS NULL THEN 'actor.id' WHEN relation = 'authenticated' AND principal IS NULL THEN 'actor.principal'
             WHEN relation = 'stopped' AND CASE WHEN kind IN ('process', 'subject') THEN object ELSE actor END IS NULL THEN 'actor.id' ELSE '' END AS missing,
        coalesce(us < max(us) OVER (PARTITION BY host ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reordered
        FROM g1 WHERE relation IS NOT NULL),
    g AS (SELECT event_id, host, us, relation, sk, tk, {_ID('sk', "'dataset'", 'host', 'sv')} AS source, {_ID('tk', "'dataset'", 'host', 'tv')} AS target, reordered, missing FROM g2)
"""
_OCSF = EV + """
    , o AS (SELECT event_id, us // 1000 AS time, CASE WHEN event_type LIKE 'process%' THEN 1007 WHEN event_type LIKE 'auth%' THEN 3002 WHEN event_type = 'privilege_elevation' THEN 2004 ELSE 5020 END AS class_uid,
        CASE WHEN event_type = 'process_started' THEN 1 WHEN event_type = 'process_stopped' THEN 2 WHEN event_type LIKE 'auth%' THEN 1 WHEN event_type = 'privilege_elevation' THEN 1 ELSE 2 END AS activity_id,
        CASE WHEN event_type = 'process_started' THEN 'Launch' WHEN event_type = 'process_stopped' THEN 'Terminate' WHEN event_type LIKE 'auth%' THEN 'Logon' WHEN event_type = 'privilege_elevation' THEN 'Create' ELSE 'Collect' END AS activity_name,
        CASE WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 99 ELSE 1 END AS severity_id,
        CASE WHEN value >= 100 THEN 'High' WHEN value >= 50 THEN 'Odd' ELSE 'Informational' END AS severity,
        CASE WHEN event_type = 'privilege_elevation' THEN 'New' WHEN event_type = 'authentication_failure' THEN 'Failure' ELSE 'Success' END AS status FROM ev)
"""

CATALOGUE = {
    "redact_documents": (q_redact, f"SELECT doc_id, {_redacted(chr(34) + 'text' + chr(34))} AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"),
    "secret_exposures": (q_exposures, f"""
        SELECT doc_id, 'token' AS path, 'sensitive_key' AS reason FROM documents WHERE source IS NOT NULL AND source NOT IN ('', '[REDACTED]')
        UNION ALL SELECT doc_id, 'text', 'secret_text' FROM documents WHERE {_redacted('text')} <> text"""),
    "pseudonyms": (q_pseudonyms, EV + f"SELECT event_id, {_PSEUDONYM('host')} AS pseudonym, 'host-' || substr(sha256(encode('{SALT}') || unhex('00') || encode(host)), 1, 16) AS host_id FROM ev"),
    "uuid5_ids": (q_uuid5, EV + f", x AS (SELECT event_id, sha1(unhex('{fn.NAMESPACE_URL}') || encode(concat_ws(chr(31), 'lanl', event_id, host))) AS h FROM ev) SELECT event_id, {_UUID} AS uuid FROM x"),
    "hmac_ids": (q_hmac, EV + f"SELECT event_id, {_HMAC('concat_ws(chr(31), ' + chr(39) + 'host' + chr(39) + ', host)')} AS hmac FROM ev"),
    "lanl_adapt": (q_lanl, EV + f"""
        , x AS (SELECT event_id AS row_no, s * 1000000 AS epoch_us, {_PSEUDONYM("coalesce(nullif(host, 'u1'), 'unknown')")} AS host, {_LIST(LANL_IDS)}[k % 8 + 1] AS native_event_id,
            {_PSEUDONYM('process_name')} AS user_name, coalesce(nullif(process_name, 'p3'), 'unknown') AS process_name, k FROM ev),
        y AS (SELECT *, ['authentication_success', 'authentication_failure', 'session_ended', 'session_ended', 'privilege_elevation', 'process_started', 'process_stopped', 'windows_event'][k % 8 + 1] AS event_type FROM x),
        z AS (SELECT *, {_EVENT_HASH('lanl', 'epoch_us')} AS h FROM y)
        SELECT {_UUID} AS event_id, epoch_us, host, event_type, ['Authentication', 'Authentication', 'Logon Session', 'Logon Session', 'Authentication', 'Process Activity', 'Process Activity', 'Application Log'][k % 8 + 1] AS class_name,
            ['Logon', 'Logon', 'End', 'End', 'Assign Privileges', 'Launch', 'Terminate', 'Observe'][k % 8 + 1] AS activity_name, CASE k % 8 WHEN 1 THEN 'failure' WHEN 7 THEN 'unknown' ELSE 'success' END AS status,
            native_event_id, user_name, process_name FROM z"""),
    "optc_adapt": (q_optc, EV + f"""
        , x AS (SELECT event_id AS row_no, (us // 1000) * 1000 AS epoch_us, {_PSEUDONYM('host')} AS host, ['PROCESS', 'FLOW', 'FILE', 'REGISTRY', 'UNKNOWN'][k % 5 + 1] AS o,
            ['CREATE', 'TERMINATE', 'READ', 'OPEN', 'WRITE', 'UNKNOWN'][k % 6 + 1] AS a, k, CASE WHEN process_name <> 'unknown' THEN {_PSEUDONYM('process_name')} END AS actor_id FROM ev),
        y AS (SELECT *, CASE WHEN o = 'PROCESS' AND a IN ('CREATE', 'OPEN') THEN 'process_started' WHEN o = 'PROCESS' AND a = 'TERMINATE' THEN 'process_stopped' WHEN o = 'FLOW' THEN 'network_activity'
            WHEN o = 'FILE' THEN 'file_activity' ELSE 'endpoint_activity' END AS event_type FROM x),
        z AS (SELECT *, {_EVENT_HASH('optc', 'epoch_us')} AS h FROM y)
        SELECT {_UUID} AS event_id, epoch_us, host, event_type, CASE event_type WHEN 'network_activity' THEN 'Network Activity' WHEN 'file_activity' THEN 'File System Activity' WHEN 'endpoint_activity' THEN 'Application Log' ELSE 'Process Activity' END AS class_name,
            CASE event_type WHEN 'process_started' THEN 'Launch' WHEN 'process_stopped' THEN 'Terminate' WHEN 'network_activity' THEN 'Open' ELSE 'Observe' END AS activity_name, 'unknown' AS status,
            lower(o) AS native_object, lower(a) AS native_action, lower(o || '_' || a) AS semantic_action, 'benign' AS label, actor_id, {_PSEUDONYM("('o' || k)")} AS object_id,
            ['Process', 'Flow', 'File', 'Registry', 'Unknown'][k % 5 + 1] AS object_kind, ['executable', 'document', 'other', 'other', 'other', 'executable'][k % 6 + 1] AS path_category FROM z"""),
    "unsw_adapt": (q_unsw, EV + f"""
        , x AS (SELECT event_id AS row_no, s * 1000000 AS epoch_us, {_PSEUDONYM("coalesce(nullif(host, 'u1'), 'unknown')")} AS host, 'network_activity' AS event_type, {_PSEUDONYM('remote')} AS remote,
            CASE WHEN event_id % 7 = 0 THEN 'Worms' ELSE nullif({_LIST(UNSW_LABELS)}[k % 5 + 1], '') END AS label FROM ev),
        z AS (SELECT *, {_EVENT_HASH('unsw', 'epoch_us')} AS h FROM x)
        SELECT {_UUID} AS event_id, epoch_us, host, event_type, 'Network Activity' AS class_name, 'Traffic' AS activity_name, CASE WHEN lower(coalesce(label, 'none')) IN ('0', 'normal', 'none') THEN 'success' ELSE 'failure' END AS status, remote, label FROM z"""),
    "loghub_adapt": (q_loghub, f"""
        WITH x AS (SELECT doc_id AS row_no, doc_id * 1000000 AS epoch_us, {_PSEUDONYM("coalesce(nullif(source, 'src1'), 'log-source')")} AS host, 'application_log' AS event_type, {_redacted('coalesce(text, ' + chr(39) * 2 + ')')} AS message FROM documents),
        z AS (SELECT *, {_EVENT_HASH('loghub', 'epoch_us')} AS h FROM x)
        SELECT {_UUID} AS event_id, epoch_us, host, event_type, 'Application Log' AS class_name, 'Observe' AS activity_name, 'unknown' AS status, message FROM z"""),
    "cdm_deref": (q_cdm, EV + f"""
        , ob AS (SELECT 's' || (k % 50) AS uuid, CASE k % 3 WHEN 0 THEN 'Subject' ELSE 'FileObject' END AS kind, nullif(host, 'u2') AS host, event_id FROM ev WHERE k % 3 < 2
            QUALIFY row_number() OVER (PARTITION BY k % 50 ORDER BY event_id DESC) = 1),
        x AS (SELECT ev.event_id AS row_no, us AS epoch_us, {_PSEUDONYM("coalesce(CASE WHEN ev.event_id % 3 = 0 THEN ev.host END, a.host, 'dataset-host')")} AS host, k % 7 AS n,
            ['process_started', 'process_stopped', 'network_activity', 'file_activity', 'authentication_activity', 'endpoint_activity', 'file_activity'][k % 7 + 1] AS event_type,
            {_PSEUDONYM("('s' || (k % 60))")} AS actor_id, coalesce(a.kind, 'Subject') AS actor_kind, a.uuid IS NOT NULL AS actor_defined,
            {_PSEUDONYM("CASE WHEN k % 4 > 0 THEN 's' || (k % 55) ELSE 'unknown' END")} AS object_id, coalesce(b.kind, 'Unknown') AS object_kind, b.uuid IS NOT NULL AS object_defined
            FROM ev LEFT JOIN ob a ON a.uuid = 's' || (k % 60) LEFT JOIN ob b ON k % 4 > 0 AND b.uuid = 's' || (k % 55)),
        z AS (SELECT *, {_EVENT_HASH('tc_cdm', 'epoch_us')} AS h FROM x)
        SELECT {_UUID} AS event_id, epoch_us, host, event_type, ['Process Activity', 'Process Activity', 'Network Activity', 'File System Activity', 'Authentication', 'Application Log', 'File System Activity'][n + 1] AS class_name,
            ['Launch', 'Terminate', 'Sendto', 'Write', 'Login', 'Unknown', 'Modify File Attributes'][n + 1] AS activity_name, 'success' AS status,
            ['EVENT_EXECUTE', 'EVENT_EXIT', 'EVENT_SENDTO', 'EVENT_WRITE', 'EVENT_LOGIN', 'EVENT_UNKNOWN', 'EVENT_MODIFY_FILE_ATTRIBUTES'][n + 1] AS native_action,
            actor_id, actor_kind, actor_defined, object_id, object_kind, object_defined FROM z"""),
    "ocsf_envelope": (q_ocsf_envelope, _OCSF + """
        SELECT event_id, activity_id, activity_name, CASE class_uid WHEN 1007 THEN 1 WHEN 3002 THEN 3 WHEN 2004 THEN 2 ELSE 5 END AS category_uid, class_uid,
            CASE class_uid WHEN 1007 THEN 'Process Activity' WHEN 3002 THEN 'Authentication' WHEN 2004 THEN 'Detection Finding' ELSE 'Software Inventory Info' END AS class_name,
            CASE class_uid WHEN 1007 THEN 'System Activity' WHEN 3002 THEN 'Identity & Access Management' WHEN 2004 THEN 'Findings' ELSE 'Discovery' END AS category_name,
            severity_id, severity, CASE status WHEN 'Failure' THEN 2 ELSE 1 END AS status_id, status, time, class_uid * 100 + activity_id AS type_uid FROM o"""),
    "ocsf_validate": (q_ocsf_validate, _OCSF + """
        , i AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'metadata.uid is required' END AS issue FROM o
            UNION ALL SELECT CASE WHEN class_uid = 1007 AND event_id % 2 <> 0 THEN 'process is required for class_uid 1007' WHEN class_uid = 3002 AND event_id % 3 <> 0 THEN 'user is required for class_uid 3002'
                WHEN class_uid = 2004 AND event_id % 5 <> 0 THEN 'finding_info is required for class_uid 2004' END FROM o
            UNION ALL SELECT CASE WHEN class_uid = 3002 AND event_id % 4 <> 0 THEN 'Authentication requires service or dst_endpoint' END FROM o)
        SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue"""),
    "graph_edges": (q_graph_edges, _GRAPH + f"""
        SELECT {_ID("'edge'", "'dataset'", "event_id", "relation", "source", "target")} AS edge_id, event_id, relation, source, target, missing, reordered, event_id % 10 = 0 AS duplicate,
            CASE WHEN reordered OR missing <> '' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM g"""),
    "graph_nodes": (q_graph_nodes, _GRAPH + f"""
        , r AS (SELECT source AS node, sk AS kind, us FROM g UNION ALL SELECT target, tk, us FROM g UNION ALL SELECT {_ID("'host'", "'dataset'", "host", "'host'")}, 'host', us FROM g)
        SELECT node, min(kind) AS kind, min(us) AS first_seen, max(us) AS last_seen FROM r GROUP BY node"""),
    "graph_stats": (q_graph_stats, _GRAPH + """
        SELECT (SELECT count(*) + count(*) FILTER (event_id % 10 = 0) FROM g1)::BIGINT AS input, (SELECT count(*) FILTER (event_id % 10 = 0) FROM g1) AS duplicates,
            (SELECT count(*) FILTER (relation IS NULL) FROM g1) AS unsupported, (SELECT count(*) FILTER (cdm AND (NOT known OR NOT object_known)) FROM g1) AS unresolved, count(*) AS accepted,
            count(*) FILTER (reordered) AS reordered, count(*) FILTER (missing <> '') AS missing_identity FROM g"""),
    "auth_log_events": (q_auth_log, EV + """
        SELECT event_id, ['authentication_success', 'authentication_failure', 'privilege_elevation', 'session_started', 'session_ended'][k % 6 + 1] AS event_type, host AS user_name,
            CASE k % 6 WHEN 0 THEN '10.0.0.' || k WHEN 1 THEN '10.0.0.9' END AS remote FROM ev WHERE k % 6 < 5"""),
    # Windows that end after the watermark stay open when the source ends.
    "stream_windows": (q_stream_windows, EV + """
        SELECT host, window_start, n AS metric_sample_count, round(value, 6) AS value, ps AS event_process_started_count FROM w
        WHERE (window_start + 86400) * 1000 <= (SELECT max(us) // 1000 - 60000 FROM ev)"""),
    "stream_ewma": (q_stream_ewma, RECURSIVE + """
        , o AS (SELECT host, us, value AS x, row_number() OVER (PARTITION BY host ORDER BY us) AS n FROM ev),
        r AS (SELECT host, n, us, 0::DOUBLE AS score, x AS mean, 1e-6::DOUBLE AS var FROM o WHERE n = 1
            UNION ALL SELECT host, n, us, score, CASE WHEN score < 4 THEN mean + 0.05 * (x - mean) ELSE mean END, CASE WHEN score < 4 THEN greatest(0.95 * (var + 0.05 * (x - mean) * (x - mean)), 1e-6) ELSE var END
            FROM (SELECT o.host, o.n, o.us, o.x, mean, var, abs(o.x - mean) / greatest(sqrt(var), 0.01 * abs(mean), 1e-6) AS score FROM r JOIN o ON o.host = r.host AND o.n = r.n + 1))
        SELECT host, us AS epoch_us, round(score, 4) AS score, score >= 4 AS is_anomaly FROM r"""),
    "stream_cooldown": (q_stream_cooldown, RECURSIVE + f"""
        , o AS (SELECT host, us, row_number() OVER (PARTITION BY host ORDER BY us) AS n FROM ev WHERE event_type = 'privilege_elevation'),
        r AS (SELECT host, n, us, us AS last, true AS emit FROM o WHERE n = 1
            UNION ALL SELECT o.host, o.n, o.us, CASE WHEN o.us - last >= {2 * DAY * 1_000_000} THEN o.us ELSE last END, o.us - last >= {2 * DAY * 1_000_000} FROM r JOIN o ON o.host = r.host AND o.n = r.n + 1)
        SELECT host, us AS epoch_us FROM r WHERE emit"""),
}
