"""Scalar Column functions: timestamps, identifiers, redaction, vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Redaction patterns, in the order in which they apply, and the names that are sensitive.  KEY_VALUE has no alternatives for quoted
# values: what is not white space, a comma or a semicolon takes the quotes in already.
URL_CREDENTIALS = (r"(?i)(\b[a-z][a-z0-9+.-]*://[^\s/:@]+:)([^\s@]+)(@)", "$1[REDACTED]$3")
AUTHORIZATION = (r"(?i)(\bauthorization\s*:\s*(?:bearer|basic)\s+)[^\s,;]+", "$1[REDACTED]")
KEY_VALUE = (
    r"(?i)(\b(?:password|passwd|pwd|secret|token|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|authorization|cookie|session[_-]?id)"
    r"\b\s*[:=]\s*)([^\s,;]+)", "$1[REDACTED]",
)
SENSITIVE_KEY = r"(?i)^(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|authorization|cookie|session[_-]?id)$"
SENSITIVE_OPTION = r"(?i)^(?:--?|/)(?:password|passwd|pwd|secret|token|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|authorization|cookie)$"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def redact_text(text: Column) -> Column:
    """The text without credentials in URLs, authorization headers and key = value pairs."""
    for pattern, by in (URL_CREDENTIALS, AUTHORIZATION, KEY_VALUE):
        text = F.regexp_replace(text, pattern, by)
    return text


def is_sensitive_key(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_")).rlike(SENSITIVE_KEY)


def redact_map(data: Column) -> Column:
    """A string map: values of sensitive keys hidden, all other values redacted as text."""
    return F.transform_values(data, lambda k, v: F.when(is_sensitive_key(k), F.lit("[REDACTED]")).otherwise(redact_text(v)))


def redact_nested(value: Column, kind: DataType) -> Column:
    """A value of any type: what stands under a sensitive name of a struct or map is hidden (as text where it is text, else null), all other text is redacted, at any depth."""
    if isinstance(kind, StringType):
        return redact_text(value)
    if isinstance(kind, StructType):
        hidden = lambda f: F.lit("[REDACTED]").cast(f.dataType) if isinstance(f.dataType, StringType) else F.lit(None).cast(f.dataType)
        fields = [(hidden(f) if is_sensitive_name(f.name) else redact_nested(value.getField(f.name), f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, MapType):
        hidden = F.lit("[REDACTED]") if isinstance(kind.valueType, StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(value, lambda k, v: F.when(is_sensitive_key(k.cast("string")), hidden).otherwise(redact_nested(v, kind.valueType)))
    return value


def exposures_nested(value: Column, kind: DataType, path: Column | None = None) -> Column:
    """Array of struct(path, reason) of what redaction would still hide in a value of any type; paths as $.name[3].name."""
    path = F.lit("$") if path is None else path
    none = F.array().cast("array<struct<path:string,reason:string>>")
    one = lambda at, reason: F.array(F.struct(at.alias("path"), F.lit(reason).alias("reason")))
    bare = lambda v, t: v.isNull() | v.isin("", "[REDACTED]") if isinstance(t, StringType) else v.isNull()
    if isinstance(kind, StringType):
        return F.when(F.coalesce((value != "[REDACTED]") & (redact_text(value) != value), F.lit(False)), one(path, "secret-like text")).otherwise(none)
    if isinstance(kind, StructType):
        parts = []
        for f in kind.fields:
            item, at = value.getField(f.name), F.concat(path, F.lit(f".{f.name}"))
            inner = exposures_nested(item, f.dataType, at)
            parts.append(F.when(~bare(item, f.dataType), one(at, "unredacted sensitive field")).otherwise(inner) if is_sensitive_name(f.name) else inner)
        return F.coalesce(F.flatten(F.array(*parts)) if parts else none, none)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: exposures_nested(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))), none)
    if isinstance(kind, MapType):
        def entry(e):
            at = F.concat(path, F.lit("."), e["key"].cast("string"))
            loud = is_sensitive_key(e["key"].cast("string")) & ~bare(e["value"], kind.valueType)
            return F.when(loud, one(at, "unredacted sensitive field")).otherwise(exposures_nested(e["value"], kind.valueType, at))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), entry)), none)
    return none


def is_sensitive_name(name: str) -> bool:
    return re.match(SENSITIVE_KEY, name.replace("-", "_")) is not None


def redact_arguments(args: Column) -> Column:
    """A command line: the token after a bare sensitive option is hidden; a hidden token hides nothing itself."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))

    def step(acc, arg):
        hide = ~acc["hide"] & arg.rlike(SENSITIVE_OPTION)
        shown = F.when(acc["hide"], F.lit("[REDACTED]")).otherwise(redact_text(arg))
        return F.struct(F.concat(acc["out"], F.array(shown)).alias("out"), hide.alias("hide"))

    return F.aggregate(args, start, step, lambda acc: acc["out"])


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (naive is UTC under a UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_timestamp(text: Column) -> Column:
    """Epoch seconds (double) of a number of seconds or an ISO 8601 string; null where it is neither."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(text.try_cast("double"), F.unix_micros(iso) / 1e6)


def iso_z(micros: Column) -> Column:
    """ISO 8601 in UTC with Z; microseconds only where they are not zero."""
    ts = F.timestamp_micros(micros)
    return F.when(micros % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def iso_micros(text: Column) -> Column:
    """A time that names its zone as ISO 8601 in UTC with six digits and Z; null where the text is no time or names no zone."""
    aware = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(?:Z|[+-]\d{2}:?\d{2})$")
    return F.date_format(F.when(aware, F.try_to_timestamp(text)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def window_start(micros: Column, seconds: int) -> Column:
    """Epoch seconds of the tumbling window; fractions are cut towards zero first."""
    second = (micros / 1_000_000).cast("long")
    return second - F.pmod(second, F.lit(seconds))


def pseudonym(salt: str, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + "\x1f"), value.cast("string")), 256), 1, 16)


def host_id(salt: str, host: Column) -> Column:
    return F.concat(F.lit("host-"), F.substring(F.sha2(F.concat(F.lit(salt + "\0"), host), 256), 1, 16))


def uuid5(*parts: Column) -> Column:
    """Version 5 UUID in the URL namespace of the parts joined by the unit separator."""
    name = F.encode(F.concat_ws("\x1f", *parts), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), name))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 with a literal key of any length."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def severity(ratio: Column) -> Column:
    return F.when(ratio >= 5, "critical").when(ratio >= 2.5, "high").when(ratio >= 1, "medium").otherwise("normal")


# Severities and their ranks.
SEVERITIES = {"normal": 0, "informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def severity_name(name: Column) -> Column:
    """The severity in lower case; informational where it is missing or none of the known ones."""
    lower = F.lower(name)
    return F.when(lower.isin(*SEVERITIES), lower).otherwise("informational")


def severity_rank(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), severity_name(name))


def severity_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SEVERITIES if x != "normal"]), rank + 1)


def vectorise(columns: Sequence[str], strict: bool = False) -> Column:
    """The named columns as doubles; nulls, and unless strict bad values, are 0."""
    cast = (lambda c: F.col(c).cast("double")) if strict else (lambda c: F.col(c).try_cast("double"))
    return F.array(*[F.coalesce(cast(c), F.lit(0.0)) for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fingerprint(host: Column, rules: Column, features: Column, event_type: Column) -> Column:
    """host | rule ids in order, else the three first features in order, else the event type, else 'signal'; a | stands between any two."""
    names = F.when(F.size(rules) > 0, F.array_join(F.array_sort(rules), "|")).when(
        F.size(features) > 0, F.array_join(F.array_sort(F.slice(features, 1, 3)), "|")
    )
    return F.concat_ws("|", F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown")), F.coalesce(names, F.nullif(event_type, F.lit("")), F.lit("signal")))


def parse_duration(text: str) -> float:
    """Seconds of '5', '250ms', '30s', '5m' or '24h'."""
    import re

    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?\s*", text.lower())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * {"ms": 0.001, None: 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
