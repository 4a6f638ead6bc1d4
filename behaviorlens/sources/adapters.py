"""Public dataset adapters: raw rows to normalised events, as column expressions.

Every adapter takes rows with a column ``row_no``, the row's place in its file: a row whose time is missing
or cannot be read happens that many seconds after 1970.  A column that the rows lack counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.functions.columns import iso_z, pseudonym, redact_text, uuid5

# Meaning of Windows event ids as event type, class, activity and status.
LANL = {
    4624: ("authentication_success", "Authentication", "Logon", "success"),
    4625: ("authentication_failure", "Authentication", "Logon", "failure"),
    4634: ("session_ended", "Logon Session", "End", "success"),
    4647: ("session_ended", "Logon Session", "End", "success"),
    4672: ("privilege_elevation", "Authentication", "Assign Privileges", "success"),
    4688: ("process_started", "Process Activity", "Launch", "success"),
    4689: ("process_stopped", "Process Activity", "Terminate", "success"),
}
LANL_OTHER = ("windows_event", "Application Log", "Observe", "unknown")
# Objects, actions and labels that OpTC rows may name, and what file suffixes tell.
OPTC_OBJECTS = ("FILE", "FLOW", "MODULE", "NETWORK", "PROCESS", "REGISTRY", "SERVICE", "SHELL", "SOCKET", "TASK", "THREAD", "USER_SESSION")
OPTC_ACTIONS = (
    "ADD", "COMMAND", "CREATE", "DELETE", "EDIT", "EXIT", "GRANT", "LOAD", "LOGOUT", "MESSAGE", "MODIFY", "OPEN", "READ", "REMOTE",
    "REMOTE_CREATE", "REMOVE", "RENAME", "START", "STOP", "TERMINATE", "WRITE",
)
OPTC_LABELS = ("attack", "benign", "malicious", "normal")
EXECUTABLE = (".exe", ".dll", ".com", ".bat", ".ps1")
DOCUMENT = (".txt", ".doc", ".docx", ".pdf", ".csv")
# Event types of provenance records that are known, and the actions behind each kind.
CDM_TYPES = (
    "EVENT_ACCEPT", "EVENT_CLONE", "EVENT_CONNECT", "EVENT_CREATE_OBJECT", "EVENT_CREATE_PROCESS", "EVENT_END", "EVENT_EXECUTE", "EVENT_EXIT", "EVENT_FORK",
    "EVENT_LOGIN", "EVENT_MODIFY_FILE_ATTRIBUTES", "EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_RENAME", "EVENT_SENDMSG",
    "EVENT_SENDTO", "EVENT_TERMINATE", "EVENT_UNLINK", "EVENT_WRITE",
)
CDM_STARTS = ("EXECUTE", "FORK", "CLONE", "CREATE_PROCESS")
CDM_STOPS = ("EXIT", "TERMINATE", "END")
CDM_NETWORK = ("CONNECT", "ACCEPT", "SENDMSG", "RECVMSG", "SENDTO", "RECVFROM")
CDM_FILES = ("OPEN", "CREATE_OBJECT", "READ", "WRITE", "RENAME", "UNLINK", "MODIFY_FILE_ATTRIBUTES")
CDM_OBJECTS = ("Subject", "FileObject", "NetFlowObject", "SrcSinkObject")
# Where the datasets come from and on what terms.
CATALOGUE = {
    "lanl": {"source": "https://csr.lanl.gov/data/2017/", "license": "LANL dataset terms; review before redistribution", "track": "host_events"},
    "optc": {"source": "https://github.com/FiveDirections/OpTC-data", "license": "public domain; distribution unlimited", "track": "endpoint_graph"},
    "unsw": {"source": "https://research.unsw.edu.au/projects/unsw-nb15-dataset", "license": "academic use; commercial use requires author agreement", "track": "network"},
    "loghub": {"source": "https://github.com/logpai/loghub", "license": "research/academic use with citation", "track": "log_sequence"},
}

_NUMBER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _first(rows: DataFrame, *names: str) -> Column:
    """The first of the named columns that holds something, as a string: neither null, '' nor the number 0."""
    kinds = dict(rows.dtypes)
    found = []
    for name in names:
        if name in kinds:
            value = F.col(name)
            zero = value == 0 if kinds[name] in _NUMBER else F.lit(False)
            found.append(F.when(~zero & (value.cast("string") != ""), value.cast("string")))
    return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")


def event_micros(value: Column, row_no: Column) -> Column:
    """Microseconds of a number of seconds or an ISO time, in UTC where it names no zone; else row_no seconds."""
    number = F.when(value.rlike(r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.rint(value.cast("double") * 1e6).cast("long"))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(F.try_to_timestamp(value)))
    return F.coalesce(number, iso, row_no.cast("long") * 1_000_000)


def _events(rows: DataFrame, dataset: str, micros: Column, host: Column, kind: Column, class_name: Column, activity: Column, status: Column, **data: Column) -> DataFrame:
    """The common columns of an event and the dataset's own."""
    made = rows.select(
        "row_no", micros.alias("epoch_us"), host.alias("host"), kind.alias("event_type"), class_name.alias("class_name"),
        activity.alias("activity_name"), status.alias("status"), *[v.alias(k) for k, v in data.items()],
    )
    key = uuid5(F.lit(dataset), F.col("row_no").cast("string"), iso_z(F.col("epoch_us")), F.col("host"), F.col("event_type"))
    return made.select(key.alias("event_id"), F.lit(f"dataset.{dataset}").alias("source"), *made.columns)


def _choose(values: dict, key: Column, place: int, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v[place])])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def lanl(rows: DataFrame, salt: str) -> DataFrame:
    """Time, EventID, Computer or LogHost, UserName, ProcessName, ParentProcessName, Source, Label."""
    hidden = lambda *names: pseudonym(salt, F.coalesce(_first(rows, *names), F.lit("unknown")))
    number = F.coalesce(_first(rows, "EventID").try_cast("int"), F.lit(0))
    kind, class_name, activity, status = (_choose(LANL, number, i, LANL_OTHER[i]) for i in range(4))
    return _events(
        rows, "lanl", event_micros(_time(rows, "Time"), F.col("row_no")), hidden("Computer", "LogHost"), kind, class_name, activity, status,
        native_event_id=number, user_name=hidden("UserName"), process_name=redact_text(F.coalesce(_first(rows, "ProcessName"), F.lit("unknown"))),
        parent_name=redact_text(F.coalesce(_first(rows, "ParentProcessName"), F.lit("unknown"))), source_hostname=hidden("Source"), label=_first(rows, "Label"),
    )


def _time(rows: DataFrame, *names: str) -> Column:
    """A time column as a string, numbers without an exponent; where it is the only one, 0 is a time too."""
    kinds = dict(rows.dtypes)
    held = [n for n in names if n in kinds]
    if len(held) == 1 and kinds[held[0]] in _NUMBER:
        return F.col(held[0]).cast("decimal(38,6)").cast("string")
    return _first(rows, *names)


def path_category(path: Column) -> Column:
    """executable, document or other by the suffix of a file's name; a name's leading dot begins no suffix."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), r"[^/](\.[^./]+)$", 1))
    return F.when(suffix.isin(*EXECUTABLE), "executable").when(suffix.isin(*DOCUMENT), "document").otherwise("other")


def optc(rows: DataFrame, salt: str) -> DataFrame:
    """timestamp_ms, timestamp or time (milliseconds from 1e11 on), object, action, host or hostname or device, actorID, objectID or id,
    principal, pid, ppid, label and properties with file_path, image_path, path and user."""
    kind = rows.schema["properties"].dataType if "properties" in rows.columns else None
    held = lambda n: kind is not None and (kind.typeName() == "map" or n in getattr(kind, "names", ()))
    flat = rows.withColumns({f"__{n}": F.col("properties").getItem(n) if held(n) else F.lit(None).cast("string") for n in ("user", "file_path", "image_path", "path")})
    known = lambda value, allowed: F.when(F.upper(value).isin(*allowed), F.upper(value)).otherwise("UNKNOWN")
    hidden = lambda *names: F.when((v := _first(flat, *names)).isNotNull(), pseudonym(salt, v))
    o = known(_first(flat, "object", "object_type"), OPTC_OBJECTS)
    a = known(_first(flat, "action", "event_type", "type"), OPTC_ACTIONS)
    process, network = o == "PROCESS", o.isin("FLOW", "NETWORK", "SOCKET")
    started, stopped = process & a.isin("CREATE", "START", "OPEN"), process & a.isin("TERMINATE", "STOP", "EXIT")
    say = lambda *words: F.when(started, words[0]).when(stopped, words[1]).when(network, words[2]).when(o == "FILE", words[3]).otherwise(words[4])
    when = _first(flat, "timestamp_ms", "timestamp", "time")
    seconds = when.try_cast("double")
    when = F.when(seconds >= 1e11, (seconds / 1000).cast("decimal(38,6)").cast("string")).otherwise(when)
    label = F.lower(_first(flat, "label"))
    present = lambda name: (F.col(name).isNotNull() & (F.col(name).cast("string") != "-1")) if name in rows.columns else F.lit(False)
    return _events(
        flat, "optc", event_micros(when, F.col("row_no")), pseudonym(salt, F.coalesce(_first(flat, "host", "hostname", "device"), F.lit("unknown"))),
        say("process_started", "process_stopped", "network_activity", "file_activity", "endpoint_activity"),
        say("Process Activity", "Process Activity", "Network Activity", "File System Activity", "Application Log"), say("Launch", "Terminate", "Open", "Observe", "Observe"), F.lit("unknown"),
        native_object=F.lower(o), native_action=F.lower(a), semantic_action=F.lower(F.concat_ws("_", o, a)), label=F.when(label.isin(*OPTC_LABELS), label),
        actor_id=hidden("actorID", "actor_id"), principal=hidden("principal", "__user"), object_id=hidden("objectID", "object_id", "id"), object_kind=F.replace(F.initcap(F.replace(o, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_")),
        pid_present=present("pid"), parent_pid_present=present("ppid"), path_category=F.coalesce(path_category(_first(flat, "__file_path", "__image_path", "__path")), F.lit("other")),
    )


def unsw(rows: DataFrame, salt: str) -> DataFrame:
    """stime or timestamp, srcip, dstip, sport, dsport, proto, sbytes, dbytes; attack_cat, or else label, tells a failure unless
    it is '', 0, normal or none."""
    label = _first(rows, "attack_cat", "label")
    address = lambda *names: pseudonym(salt, F.coalesce(_first(rows, *names), F.lit("unknown")))
    bad = ~F.lower(F.coalesce(label, F.lit("none"))).isin("", "0", "normal", "none")
    plain = lambda name: F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
    return _events(
        rows, "unsw", event_micros(_time(rows, "stime", "timestamp"), F.col("row_no")), address("srcip", "src_ip"), F.lit("network_activity"), F.lit("Network Activity"), F.lit("Traffic"),
        F.when(bad, "failure").otherwise("success"), remote=address("dstip", "dst_ip"), source_port=plain("sport"), destination_port=plain("dsport"), protocol=plain("proto"),
        bytes_in=plain("dbytes"), bytes_out=plain("sbytes"), label=label,
    )


def loghub(rows: DataFrame, salt: str) -> DataFrame:
    """timestamp or Time, host or Node, Content or content or message, EventId, Component, Label; messages are redacted."""
    return _events(
        rows, "loghub", event_micros(_time(rows, "timestamp", "Time"), F.col("row_no")), pseudonym(salt, F.coalesce(_first(rows, "host", "Node"), F.lit("log-source"))),
        F.lit("application_log"), F.lit("Application Log"), F.lit("Observe"), F.lit("unknown"), template_id=_first(rows, "EventId", "event_id"),
        component=_first(rows, "Component", "component"), message=redact_text(F.coalesce(_first(rows, "Content", "content", "message"), F.lit(""))), label=_first(rows, "Label", "label"),
    )


def cdm(objects: DataFrame, events: DataFrame, salt: str) -> DataFrame:
    """Provenance events with the definitions of their subject and object, the last one of each uuid.

    objects has uuid, kind, host_id, row_no; events has subject, predicate_object, host_id, type, nanos, row_no.  A subject that is
    nowhere defined counts as a Subject, an object as Unknown."""
    known = objects.where(F.col("kind").isin(*CDM_OBJECTS) & (F.col("uuid") != ""))
    last = known.groupBy("uuid").agg(F.max_by(F.struct("kind", F.nullif("host_id", F.lit("")).alias("host_id")), "row_no").alias("d"))
    raw = F.upper("type")
    native = F.when(raw.isin(*CDM_TYPES), raw).otherwise("EVENT_UNKNOWN")
    action = F.regexp_replace(native, "^EVENT_", "")
    titled = F.initcap(F.replace(action, F.lit("_"), F.lit(" ")))
    groups = (
        (action.isin(*CDM_STARTS), "process_started", "Process Activity", F.lit("Launch")), (action.isin(*CDM_STOPS), "process_stopped", "Process Activity", F.lit("Terminate")),
        (action.isin(*CDM_NETWORK), "network_activity", "Network Activity", titled), (action.isin(*CDM_FILES), "file_activity", "File System Activity", titled),
        (action.contains("PRINCIPAL") | action.contains("LOGIN"), "authentication_activity", "Authentication", titled),
    )
    say = lambda i, other: F.coalesce(*[F.when(g[0], F.lit(g[i]) if i < 3 else g[i]) for g in groups], other)
    subject = last.select(F.col("uuid").alias("subject"), F.col("d").alias("s"))
    target = last.select(F.col("uuid").alias("predicate_object"), F.col("d").alias("o"))
    joined = events.withColumns({c: F.nullif(c, F.lit("")) for c in ("subject", "predicate_object", "host_id")}).join(subject, "subject", "left").join(target, "predicate_object", "left")
    hidden = lambda c: pseudonym(salt, F.coalesce(F.col(c), F.lit("unknown")))
    micros = F.coalesce(F.expr("nanos div 1000"), F.col("row_no") * 1_000_000)
    return _events(
        joined, "tc_cdm", micros, pseudonym(salt, F.coalesce("host_id", "s.host_id", F.lit("dataset-host"))), say(1, F.lit("endpoint_activity")), say(2, F.lit("Application Log")),
        say(3, titled), F.lit("success"), native_action=native, actor_id=hidden("subject"), actor_kind=F.coalesce("s.kind", F.lit("Subject")), actor_defined=F.col("s").isNotNull(),
        object_id=hidden("predicate_object"), object_kind=F.coalesce("o.kind", F.lit("Unknown")), object_defined=F.col("o").isNotNull(),
    )


def cdm_records(records: DataFrame, row_no: str = "row_no", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(objects, events) for cdm from JSON envelopes {datum: {"<namespace>.<Kind>": {...}}}, unions being objects of one key.
    Lines that are no such envelope give nothing."""
    text = F.coalesce(F.get_json_object(value, "$.datum"), F.col(value))
    entries = F.from_json(text, "map<string,string>")
    one = records.select(F.col(row_no).alias("row_no"), entries.alias("e")).where(F.size("e") == 1)
    pay = one.select("row_no", F.element_at(F.split(F.map_keys("e")[0], r"\."), -1).alias("kind"), F.from_json(F.map_values("e")[0], "map<string,string>").alias("p")).where("p is not null")

    def unwrapped(name: str) -> Column:
        found = F.col("p").getItem(name)
        for _ in range(3):
            inner = F.map_values(F.from_json(found, "map<string,string>"))
            found = F.when(found.startswith("{"), F.when(F.size(inner) == 1, inner[0])).otherwise(found)
        return found

    objects = pay.where(F.col("kind").isin(*CDM_OBJECTS)).select("row_no", "kind", unwrapped("uuid").alias("uuid"), unwrapped("hostId").alias("host_id"))
    events = pay.where("kind = 'Event'").select(
        "row_no", unwrapped("subject").alias("subject"), unwrapped("predicateObject").alias("predicate_object"), unwrapped("hostId").alias("host_id"),
        unwrapped("type").alias("type"), unwrapped("timestampNanos").try_cast("long").alias("nanos"),
    )
    return objects, events


ADAPTERS = {"lanl": lanl, "optc": optc, "unsw": unsw, "loghub": loghub}
