"""Event envelopes at the level of rows: class objects, the upgrade of rows without an envelope, and the audit of JSON lines.

Records are VARIANT columns, so that a record may hold anything: the type of each field is looked at before its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.functions import ocsf

#: Sources whose records name actor and object of an event, not its processes and files.
GRAPH_SOURCES = ("dataset.tc_cdm", "dataset.optc")
OBJECTS = ("process", "file", "user", "device", "package", "finding_info", "service", "src_endpoint", "dst_endpoint")


def _at(record: Column, *names: str) -> Column:
    return F.try_variant_get(record, "$." + ".".join(names), "variant")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY or the type's name; VOID for null in JSON, null for what is absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _object(value: Column) -> Column:
    return F.when(_kind(value) == "OBJECT", value)


def _text(value: Column) -> Column:
    """The value as text; null where it is absent, null, false, zero or empty."""
    text = value.cast("string")
    empty = F.when(_kind(value) == "STRING", text == "").otherwise(text.isin("false", "0", "{}", "[]"))
    return F.when(_kind(value).isin("VOID", "") | empty, F.lit(None)).otherwise(text)


def _whole(value: Column) -> Column:
    return F.when(_kind(value).isin("BIGINT", "BOOLEAN"), F.coalesce(value.try_cast("long"), value.try_cast("boolean").cast("long")))


def _variant(*fields: Column) -> Column:
    """A VARIANT object of those fields that are not null."""
    return F.parse_json(F.to_json(F.struct(*fields)))


def _name(value: Column, *names: str) -> Column:
    return F.coalesce(_text(_at(value, *names)), F.lit("unknown"))


def network_endpoint(end: Column) -> Column:
    """ip, hostname (or the hash of an ip) and a whole port of an endpoint, as VARIANT; a port that is no number is left out."""
    port = _at(end, "port")
    number = F.when(_kind(port) == "STRING", F.when(F.trim(port.cast("string")).rlike(r"^[+-]?\d+$"), F.trim(port.cast("string")).try_cast("long"))).otherwise(
        F.coalesce(port.try_cast("double").cast("long"), port.try_cast("boolean").cast("long")))
    found = _variant(_text(_at(end, "ip")).alias("ip"), F.coalesce(_text(_at(end, "hostname")), _text(_at(end, "ip_hash"))).alias("hostname"), number.alias("port"))
    return F.when(end.isNotNull(), found)


def _with_class_objects(rows: DataFrame, record: Column) -> DataFrame:
    """rows with the struct _objects: what an event's class carries beside its core, VARIANT objects (null where the class has none) and is_alert.

    Needs _uid, _host, _event, _source and _time; each stage is a projection of its own, so that no expression is copied into the next."""
    col = F.col
    rows = rows.withColumn("_data", _object(_at(record, "data")))
    parts = ("process", "file", "user", "actor", "subject", "object", "package", "destination_endpoint", "dst_endpoint", "source_endpoint", "src_endpoint")
    rows = rows.withColumns({f"_{n}": _at(col("_data"), n) for n in parts})
    # The first of two names that holds anything counts, even where it holds no object.
    first = lambda a, b: F.when(_text(col(a)).isNotNull(), col(a)).otherwise(col(b))
    rows = rows.withColumns({"_to": first("_destination_endpoint", "_dst_endpoint"), "_from": first("_source_endpoint", "_src_endpoint")})
    rows = rows.withColumns({f"_{n}": _object(col(f"_{n}")) for n in ("process", "file", "user", "actor", "subject", "object", "package", "to", "from")})
    graph = F.coalesce(col("_source").isin(*GRAPH_SOURCES) & col("_uid").isin(1001, 1007), F.lit(False))
    rows = rows.withColumns({
        "_graph": graph, "_who": F.when(col("_source") == "dataset.tc_cdm", col("_subject")).otherwise(col("_actor")), "_actor_user": _object(_at(col("_actor"), "user")),
        "_command": _at(col("_process"), "command_line"), "_pid": _at(col("_process"), "pid"), "_parent": _at(col("_process"), "parent_pid"),
        "_path": F.coalesce(_text(_at(col("_file"), "path")), _text(_at(col("_data"), "path")), F.lit("unknown")), "_software": F.coalesce("_package", "_data"),
    })
    target = F.when((col("_source") == "dataset.optc") | F.lower(_text(_at(col("_object"), "kind"))).isin("process", "subject"), _text(_at(col("_object"), "id")))
    words = F.array_join(F.transform(col("_command").try_cast("array<variant>"), lambda x: x.cast("string")), " ")
    rows = rows.withColumns({
        "_who": F.coalesce(_text(_at(col("_who"), "id")), col("_event")), "_target": target, "_version": _at(col("_software"), "version"),
        "_words": F.when(_kind(col("_command")) == "ARRAY", words).otherwise(_text(col("_command"))), "_executable": _text(_at(col("_process"), "executable")),
        "_category": _at(col("_data"), "path_category").cast("string"),
    })
    process = F.when(col("_graph"), _variant(F.coalesce("_target", "_who").alias("uid"), F.lit("unknown").alias("name"))).otherwise(_variant(
        _name(col("_process"), "name").alias("name"), F.when(_kind(col("_pid")) != "VOID", col("_pid")).alias("pid"),
        F.when(_kind(col("_parent")) != "VOID", F.struct(col("_parent").alias("pid"))).alias("parent_process"),
        F.when(col("_executable").isNotNull(), F.struct(col("_executable").alias("path"))).alias("file"), col("_words").alias("cmd_line"),
    ))
    kind = F.when(col("_category") == "executable", 8).when(col("_category") == "document", 1).otherwise(0)
    file = F.when(col("_graph"), _variant(F.lit("unknown").alias("name"), kind.alias("type_id"))).otherwise(_variant(col("_path").alias("path")))
    here, uid = _variant(col("_host").alias("hostname")), col("_uid")
    version = F.when(_kind(col("_version")) != "VOID", F.nullif(col("_version").cast("string"), F.lit("")))
    title = F.coalesce("_activity", "_type", F.lit("Finding"))
    return rows.withColumn("_objects", F.struct(
        F.when(uid == 1007, process).alias("process"), F.when(col("_graph"), _variant(F.struct(col("_who").alias("uid")).alias("process"))).when(uid == 1007, col("_actor")).alias("actor"),
        F.when(uid == 1001, file).alias("file"), F.when(uid == 3002, F.coalesce(col("_user"), col("_actor_user"), _variant(F.lit("unknown").alias("name")))).alias("user"),
        F.when(col("_graph"), _variant(col("_host").alias("hostname"), F.lit(0).alias("type_id"))).when(uid.isin(5001, 5020), here).alias("device"),
        F.when(uid == 5020, _variant(_name(col("_software"), "name").alias("name"), version.alias("version"))).alias("package"),
        F.when(uid == 4001, F.when(col("_from").isNull() & col("_to").isNull(), here).otherwise(network_endpoint(col("_from")))).alias("src_endpoint"),
        F.when(uid == 3002, F.coalesce(col("_to"), here)).when(uid == 4001, network_endpoint(col("_to"))).alias("dst_endpoint"),
        F.when(uid == 2004, _variant(col("_event").alias("uid"), title.alias("title"), col("_time").alias("created_time"))).alias("finding_info"),
        F.when(uid == 2004, F.lit(True)).alias("is_alert"),
    ))


def upgrade(rows: DataFrame, record: str, product: str, fallback_ms: Column | None = None) -> DataFrame:
    """rows with columns envelope and native: the record's own envelope where it is an object, else one built from the record: the core, what its class
    carries, and the record's own names under ``unmapped``.  The record stays as it is; a record that is no object has the envelope of an empty one.

    Names of rows that begin with an underscore are taken by the stages in between and may not occur."""
    if any(c.startswith("_") for c in rows.columns):
        raise ValueError("columns that begin with an underscore are not allowed")
    r, col = F.col(record), F.col
    found = rows.withColumns({
        "_own": _object(_at(r, "ocsf")), "_host": _name(r, "host"), "_event": _name(r, "event_id"), "_source": _at(r, "source").cast("string"), "_activity": _text(_at(r, "activity_name")),
        "_type": _text(_at(r, "event_type")), "_class": F.coalesce(_text(_at(r, "class_name")), F.lit("")), "_severity": F.coalesce(_text(_at(r, "severity")), F.lit("informational")),
        "_status": F.coalesce(_text(_at(r, "status")), F.lit("unknown")), "_time": ocsf.epoch_ms(_at(r, "timestamp").cast("string"), fallback_ms),
    }).withColumn("_uid", ocsf.class_uid(col("_class")))
    found = _with_class_objects(found, r)
    found = found.withColumn("_core", ocsf.envelope(col("_class"), F.coalesce("_activity", F.lit("Other")), col("_severity"), col("_status"), col("_time"), col("_event"), product))
    legacy = F.struct(*[_at(r, n).cast("string").alias(f"legacy_{n}") for n in ("category_name", "class_name", "event_type", "source")])
    built = F.parse_json(F.to_json(F.struct("_core.*", legacy.alias("unmapped"), "_objects.*")))
    found = found.withColumns({"native": col("_own").isNotNull(), "envelope": F.coalesce(col("_own"), built)})
    return found.select(*rows.columns, "native", "envelope")


def with_issues(rows: DataFrame, envelope: str) -> DataFrame:
    """rows with the array issues: what is wrong with their VARIANT envelopes, objects included.  Fields of the core that have another type count as absent."""
    e, col = F.col(envelope), F.col
    found = rows.withColumns({"_meta": _object(_at(e, "metadata")), "_time": _whole(_at(e, "time")), "_when": _at(e, "time").cast("string")}).withColumns({
        "_product": _object(_at(col("_meta"), "product")), "_logged": _at(col("_meta"), "logged_time").cast("string"),
    })
    # Equal values of any type agree, and values that differ must not look alike once they are typed.
    logged = F.when(col("_when").eqNullSafe(col("_logged")), col("_time")).when(col("_time").isNull(), F.lit(0))
    version = F.when(_kind(_at(col("_meta"), "version")) == "STRING", _at(col("_meta"), "version").cast("string"))
    metadata = F.when(col("_meta").isNotNull(), F.struct(
        version.alias("version"), _text(_at(col("_meta"), "uid")).alias("uid"), logged.alias("logged_time"), F.struct(_text(_at(col("_product"), "name")).alias("name")).alias("product"),
    ))
    whole = [_whole(_at(e, n)).alias(n) for n in ("activity_id", "category_uid", "class_uid", "severity_id", "status_id", "type_uid")]
    names = [_text(_at(e, n)).alias(n) for n in ("activity_name", "category_name", "class_name")]
    carried = F.array_compact(F.array(*[F.when(_kind(_at(e, n)) == "OBJECT", F.lit(n)) for n in OBJECTS]))
    found = found.withColumns({"_typed": F.struct(*whole, *names, col("_time").alias("time"), metadata.alias("metadata")), "_carried": carried})
    issues = F.when(_kind(e) == "OBJECT", ocsf.core_issues(col("_typed"), col("_carried"))).otherwise(F.array(F.lit("OCSF event must be an object")))
    return found.select(*rows.columns, issues.alias("issues"))


def judged_lines(lines: DataFrame, product: str, line: str = "value", fallback_ms: Column | None = None) -> DataFrame:
    """(native, class_name, issues) of each line that is not blank; native is null for lines that are no records."""
    text = F.col(line)
    parsed = lines.where(F.trim(F.regexp_replace(text, r"\s", " ")) != "").select(F.try_parse_json(text).alias("record"), text.alias("line"))
    sorted_out = parsed.withColumn("fault", F.when(F.col("record").isNull(), "malformed JSON").when(_kind(F.col("record")) != "OBJECT", "record is not an object"))
    found = with_issues(upgrade(sorted_out, "record", product, fallback_ms), "envelope")
    bad = F.col("fault").isNotNull()
    return found.select(
        F.when(~bad, F.col("native")).alias("native"), F.when(~bad, _name(F.col("envelope"), "class_name")).alias("class_name"),
        F.when(bad, F.array("fault")).otherwise(F.col("issues")).alias("issues"),
    )


def audit_lines(lines: DataFrame, product: str, line: str = "value", fallback_ms: Column | None = None) -> DataFrame:
    """(kind, name, n): the audit of JSON lines.  Kind total has records, native_envelopes, legacy_records_migrated, invalid_records and valid (1 or 0);
    kind class the records of each class; kind issue the records with each issue.  The lines are judged and counted in one pass; empty input has the totals only."""
    judged = judged_lines(lines, product, line, fallback_ms)
    one = lambda kind, name, sound=F.lit(None).cast("int"): F.struct(F.lit(kind).alias("kind"), name.alias("name"), sound.alias("sound"))
    record = F.col("native").isNotNull()
    marks = F.array_compact(F.concat(
        F.array(
            F.when(record, one("total", F.lit("records"))), F.when(F.col("native"), one("total", F.lit("native_envelopes"))), F.when(~F.col("native"), one("total", F.lit("legacy_records_migrated"))),
            F.when(F.size("issues") > 0, one("total", F.lit("invalid_records"))), F.when(record, one("class", F.col("class_name"))),
            one("total", F.lit("valid"), (F.size("issues") == 0).cast("int")),
        ),
        F.transform("issues", lambda i: one("issue", i)),
    ))
    counts = judged.select(F.inline(marks)).groupBy("kind", "name").agg(F.count("*").alias("n"), F.min("sound").alias("sound"))
    totals = ("records", "native_envelopes", "legacy_records_migrated", "invalid_records", "valid")
    zero = lines.sparkSession.createDataFrame([("total", name, 0, None) for name in totals], "kind string, name string, n long, sound int")
    full = counts.unionByName(zero).groupBy("kind", "name").agg(F.sum("n").alias("n"), F.min("sound").alias("sound"))
    verdict = (F.col("kind") == "total") & (F.col("name") == "valid")  # of lines that all are sound, and of one at least
    return full.select("kind", "name", F.when(verdict, F.coalesce(F.col("sound").cast("long"), F.lit(0))).otherwise(F.col("n")).alias("n"))
