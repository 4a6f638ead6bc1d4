"""OCSF 1.8 envelopes: lookups, construction and core validation as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "1.8.0"
# Fixed values of the schema.
CLASSES = {
    "Process Activity": (1, 1007), "File System Activity": (1, 1001), "Authentication": (3, 3002), "Logon Session": (3, 3002), "Network Activity": (4, 4001),
    "Software Inventory Info": (5, 5020), "Device Config State": (5, 5001), "Device Inventory Info": (5, 5001), "Security Finding": (2, 2004), "Detection Finding": (2, 2004),
}
CLASS_NAMES = {
    1007: "Process Activity", 1001: "File System Activity", 3002: "Authentication", 4001: "Network Activity", 5020: "Software Inventory Info",
    5001: "Device Inventory Info", 2004: "Detection Finding", 0: "Base Event",
}
ACTIVITIES = {
    1007: {"launch": 1, "terminate": 2, "open": 3, "inject": 4, "set user id": 5}, 3002: {"logon": 1, "logoff": 2, "end": 2},
    4001: {"open": 1, "close": 2, "reset": 3, "fail": 4, "refuse": 5, "traffic": 6, "listen": 7},
}
CATEGORY_NAMES = {1: "System Activity", 2: "Findings", 3: "Identity & Access Management", 4: "Network Activity", 5: "Discovery", 0: "Uncategorized"}
#: The object that a class requires.
REQUIRED = {1001: "file", 1007: "process", 3002: "user", 5001: "device", 5020: "device", 2004: "finding_info"}
CAPTIONS = {
    1007: {1: "Launch", 2: "Terminate", 3: "Open", 4: "Inject", 5: "Set User ID"}, 3002: {1: "Logon", 2: "Logoff"},
    4001: {1: "Open", 2: "Close", 3: "Reset", 4: "Fail", 5: "Refuse", 6: "Traffic", 7: "Listen"},
}
ALWAYS = {5001: (2, "Collect"), 5020: (2, "Collect"), 2004: (1, "Create")}
SEVERITIES = {"unknown": 0, "informational": 1, "low": 2, "medium": 3, "high": 4, "critical": 5, "fatal": 6}
STATUSES = {"unknown": 0, "success": 1, "failure": 2}


def _lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def class_uid(name: Column) -> Column:
    return _lookup({k: v[1] for k, v in CLASSES.items()}, name, 0)


def category_uid(name: Column) -> Column:
    return _lookup({k: v[0] for k, v in CLASSES.items()}, name, 0)


def activity_id(uid: Column, name: Column) -> Column:
    flat = {f"{c}:{n}": i for c, names in ACTIVITIES.items() for n, i in names.items()}
    fixed = _lookup({k: v[0] for k, v in ALWAYS.items()}, uid, -1)
    return F.when(fixed >= 0, fixed).otherwise(_lookup(flat, F.concat_ws(":", uid.cast("string"), F.lower(name)), 99))


def activity_caption(uid: Column, activity: Column, name: Column) -> Column:
    """The schema's name of an activity, or the given one (Other where it is empty)."""
    table = {k: v[1] for k, v in ALWAYS.items()}
    captions = {f"{c}:{i}": n for c, names in CAPTIONS.items() for i, n in names.items()}
    plain = F.coalesce(F.nullif(name, F.lit("")), F.lit("Other"))
    return F.coalesce(F.nullif(_lookup(table, uid, ""), F.lit("")), F.nullif(_lookup(captions, F.concat_ws(":", uid.cast("string"), activity.cast("string")), ""), F.lit("")), plain)


def epoch_ms(text: Column, fallback: Column | None = None) -> Column:
    """Milliseconds of an ISO 8601 time (UTC where it names no zone); the fallback, by default now, where the text is none."""
    micros = F.unix_micros(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)))
    fallback = F.unix_millis(F.current_timestamp()) if fallback is None else fallback
    return F.coalesce((micros.cast("double") / 1e6 * 1000).cast("long"), fallback)


def envelope(class_name: Column, activity_name: Column, severity: Column, status: Column, time_ms: Column, uid: Column, product: str) -> Column:
    """The core of an event as a struct; severity and status ids are 99 for names outside the schema."""
    cls = class_uid(class_name)
    act = activity_id(cls, activity_name)
    finding = cls == 2004
    return F.struct(
        act.alias("activity_id"), activity_caption(cls, act, activity_name).alias("activity_name"),
        category_uid(class_name).alias("category_uid"), _lookup(CATEGORY_NAMES, category_uid(class_name), "Uncategorized").alias("category_name"), cls.alias("class_uid"), _lookup(CLASS_NAMES, cls, "Base Event").alias("class_name"),
        _lookup(SEVERITIES, F.lower(severity), 99).alias("severity_id"), F.initcap(severity).alias("severity"), F.when(finding, 1).otherwise(_lookup(STATUSES, F.lower(status), 99)).alias("status_id"),
        F.when(finding, "New").otherwise(F.initcap(F.lower(status))).alias("status"), time_ms.alias("time"), (cls * 100 + act).alias("type_uid"),
        F.struct(F.lit(VERSION).alias("version"), uid.alias("uid"), time_ms.alias("logged_time"), F.struct(F.lit(product).alias("name")).alias("product")).alias("metadata"),
    )


def core_issues(e: Column, objects: Column | None = None) -> Column:
    """Array of what is wrong with an envelope, in a fixed order.  objects names the objects that the event carries beside it
    (process, user, src_endpoint, ...); without it these are not checked."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    whole = ("activity_id", "category_uid", "class_uid", "severity_id", "status_id", "time", "type_uid")
    checks = {f"{name} must be an integer": e[name].isNull() for name in whole}
    checks["time must be a positive UTC epoch millisecond value"] = e["time"] <= 0
    checks |= {f"{name} is required": text(e[name]) == "" for name in ("activity_name", "category_name", "class_name")}
    meta = e["metadata"]
    checks |= {
        "metadata must be an object": meta.isNull(),
        f"metadata.version must be {VERSION}": meta.isNotNull() & ~meta["version"].eqNullSafe(F.lit(VERSION)),
        "metadata.uid is required": meta.isNotNull() & (text(meta["uid"]) == ""),
        "metadata.logged_time must equal time": meta.isNotNull() & ~meta["logged_time"].eqNullSafe(e["time"]),
        "metadata.product.name is required": meta.isNotNull() & (text(meta["product"]["name"]) == ""),
    }
    issues = [F.when(bad, F.lit(message)) for message, bad in checks.items()]
    uid = e["class_uid"]
    expected = uid * 100 + e["activity_id"]
    issues.append(F.when(~e["type_uid"].eqNullSafe(expected) & expected.isNotNull(), F.concat(F.lit("type_uid must equal "), expected.cast("string"))))
    known = uid.isin(*[k for k in CLASS_NAMES if k])
    category, name, of = F.floor(uid / 1000), _lookup(CLASS_NAMES, uid, ""), F.concat(F.lit(" for class_uid "), uid.cast("string"))
    issues.append(F.when(known & ~e["category_uid"].eqNullSafe(category.cast("int")), F.concat(F.lit("category_uid must be "), category.cast("string"), of)))
    issues.append(F.when(known & ~e["class_name"].eqNullSafe(name), F.concat(F.lit("class_name must be "), name, of)))
    if objects is not None:
        need = _lookup(REQUIRED, uid, "")
        ends = lambda *names: F.arrays_overlap(objects, F.array(*[F.lit(n) for n in names]))
        issues.append(F.when((need != "") & ~F.array_contains(objects, need), F.concat(need, F.lit(" is required"), of)))
        issues.append(F.when((uid == 3002) & ~ends("service", "dst_endpoint"), F.lit("Authentication requires service or dst_endpoint")))
        issues.append(F.when((uid == 4001) & ~ends("src_endpoint", "dst_endpoint"), F.lit("Network Activity requires src_endpoint or dst_endpoint")))
    return F.array_compact(F.array(*issues))
