"""Scans and sinks: JSON lines with diagnostics, several formats, auth logs, packages and sockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Lines of authentication logs.
SSH_OK = r"(?i)sshd\[\d+\]: Accepted (\S+) for (\S+) from (\S+) port (\d+)"
SSH_BAD = r"(?i)sshd\[\d+\]: Failed (\S+) for (?:(?:invalid user) )?(\S+) from (\S+) port (\d+)"
PAM_BAD = r"(?i)authentication failure;.*?(?:rhost=(\S*))?.*?user=(\S+)"
SUDO = r"(?i)sudo(?:\[\d+\])?:\s+([^: ]+)\s*:\s+.*?USER=([^ ;]+)\s*;\s*COMMAND=(.*)$"
OPENED, CLOSED = r"(?i)session opened for user (\S+)", r"(?i)session closed for user (\S+)"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails on a bad line, else bad lines have null fields.  Gzip is read by its suffix."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)


def physical_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, order, line, kind) of every physical line: blank, malformed, non_object or valid.  Lines end at \\n, \\r or both, as in binary files; order is a
    struct that grows along a file, so that its last line can be told."""
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value"),
    )
    parts = rows.select("path", "block", "id", F.posexplode(F.split(F.regexp_replace("value", r"\r$", ""), "\r", -1)).alias("part", "line"), F.endswith("value", F.lit("\r")).alias("ended"))
    line = F.col("line")
    parsed = F.when(F.is_valid_utf8(line), F.try_parse_json(line))
    kind = F.when(F.trim(F.regexp_replace(line, r"[\t\x0b\f]", " ")) == "", "blank").when(parsed.isNull(), "malformed").when(F.schema_of_variant(parsed).startswith("OBJECT"), "valid").otherwise("non_object")
    return parts.select("path", F.struct("block", "id", "part").alias("order"), "line", "ended", kind.alias("kind"))


def scan_diagnostics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row on the physical lines of all segments: segments, bytes, total, blank, malformed, non_object, trailing_partial and valid lines.

    The last line of a segment is a partial one if it is no JSON and no line end follows it, as its bytes and the file's tell; compressed segments
    are rotated ones and count as ended.  Spark's readers pass over empty files, which are no segments here; a path without files is an error of theirs."""
    sizes = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))  # without the content column
    name = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    lines = physical_lines(spark, paths).groupBy(name("path").alias("path")).agg(
        F.count("*").alias("total"), count("blank"), count("malformed"), count("non_object"), count("valid"), F.sum(F.octet_length("line") + 1 + F.when(F.col("order.part") == 0, F.col("ended").cast("int")).otherwise(0)).alias("length"),
        F.max_by(F.struct("kind", "ended"), "order").alias("last"),
    )
    found = sizes.withColumn("path", name("path")).join(lines, "path", "left").fillna(0, ["total", "blank", "malformed", "non_object", "valid"])
    open_ = ~F.col("path").endswith(".gz") & (F.col("length") > F.col("bytes")) & ~F.col("last.ended") & (F.col("last.kind") == "malformed")
    found = found.withColumn("trailing_partial", F.coalesce(open_, F.lit(False)).cast("long"))
    return found.agg(
        F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.sum("total").alias("total"), F.sum("blank").alias("blank"), F.sum(F.col("malformed") - F.col("trailing_partial")).alias("malformed"),
        F.sum("non_object").alias("non_object"), F.sum("trailing_partial").alias("trailing_partial"), F.sum("valid").alias("valid"),
    )


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: csv with header (all strings), json, jsonl, else text lines as column message."""
    plain = path.lower().removesuffix(".gz")
    if plain.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if plain.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if plain.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    return spark.read.text(path).withColumnRenamed("value", "message")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with sorted columns and nulls kept."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header a part; quotes inside values are doubled, nulls are empty."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small report as JSON lines in one part, keys in order and nulls kept."""
    write_jsonl(df.coalesce(1), path, mode)


def dataset_manifest(path: str, source: DataFrame, events: DataFrame, dataset: str, facts: dict[str, str]) -> DataFrame:
    """A row a file of path: the dataset and its facts (licence and the like), rows read and rows made, and the file's bytes and SHA-256."""
    counts = source.agg(F.count("*").alias("source_rows")).crossJoin(events.agg(F.count("*").alias("normalized_rows")))  # one row each
    named = [F.lit(dataset).alias("dataset"), *[F.lit(v).alias(k) for k, v in facts.items()]]
    return file_hashes(source.sparkSession, path).crossJoin(F.broadcast(counts)).select(*named, F.col("path").alias("input"), "bytes", F.col("sha256").alias("input_sha256"), "source_rows", "normalized_rows")


def file_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def auth_event(line: Column) -> Column:
    """struct(event_type, user_name, remote) of an authentication log line; null for other lines."""
    def found(pattern: str, kind: str, user: int, remote: int | None) -> Column:
        address = F.nullif(F.regexp_extract(line, pattern, remote), F.lit("")) if remote else F.lit(None).cast("string")
        return F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("event_type"), F.regexp_extract(line, pattern, user).alias("user_name"), address.alias("remote")))

    return F.coalesce(
        found(SSH_OK, "authentication_success", 2, 3), found(SSH_BAD, "authentication_failure", 2, 3), found(PAM_BAD, "authentication_failure", 2, 1),
        found(SUDO, "privilege_elevation", 1, None), found(OPENED, "session_started", 1, None), found(CLOSED, "session_ended", 1, None),
    )


def packages(lines: DataFrame, manager: str) -> DataFrame:
    """(manager, name, version, architecture) from tab-separated package lists; lines with fewer than two fields go."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= 2).select(
        F.lit(manager).alias("manager"), parts[0].alias("name"), parts[1].alias("version"), F.coalesce(F.nullif(F.get(parts, 2), F.lit("")), F.lit("unknown")).alias("architecture")
    )


def socket_summary(lines: DataFrame) -> DataFrame:
    """States and distinct remote ports of lsof lines: every (endpoint, state) counts once."""
    state = F.regexp_extract("value", r"\(([A-Z_]+)\)\s*$", 1)
    ends = F.regexp_extract("value", r"(\S+)\s+\([A-Z_]+\)\s*$", 1)
    rows = lines.select(ends.alias("endpoint"), state.alias("state")).where("state != ''").distinct()
    port = F.regexp_extract("endpoint", r"->.*:(\d+)$", 1)
    return rows.agg(
        F.count_if(F.col("state") == "ESTABLISHED").alias("tcp_established"), F.count_if(F.col("state") == "LISTEN").alias("tcp_listen"),
        F.count_if(F.col("state") == "SYN_SENT").alias("tcp_syn_sent"), F.count_if(F.col("state") == "CLOSE_WAIT").alias("tcp_close_wait"),
        F.count_distinct(F.when(port != "", port)).alias("unique_remote_ports"),
    )


def netstat_summary(lines: DataFrame) -> DataFrame:
    """States and distinct remote ports of netstat lines; lines count as often as they stand, LISTENING is LISTEN, port 0 is none."""
    states = ("ESTABLISHED", "LISTEN", "LISTENING", "SYN_SENT", "CLOSE_WAIT")
    parts = F.split(F.trim("value"), r"\s+")
    upper = F.transform(parts, lambda p: F.replace(F.upper(p), F.lit("-"), F.lit("_")))
    at = F.array_min(F.array(*[F.nullif(F.array_position(upper, s), F.lit(0)) for s in states]))
    rows = lines.where(F.lower(parts[0]).startswith("tcp")).select(upper.alias("u"), parts.alias("p"), at.alias("at")).where("at is not null")
    state = F.element_at("u", F.col("at").cast("int"))
    port = F.nullif(F.regexp_extract(F.when(F.col("at") > 1, F.element_at("p", (F.col("at") - 1).cast("int"))), r"[.:](\d+)$", 1), F.lit("")).cast("int")
    return rows.agg(
        F.count_if(state == "ESTABLISHED").alias("tcp_established"), F.count_if(state.isin("LISTEN", "LISTENING")).alias("tcp_listen"), F.count_if(state == "SYN_SENT").alias("tcp_syn_sent"),
        F.count_if(state == "CLOSE_WAIT").alias("tcp_close_wait"), F.count_distinct(F.when(port != 0, port)).alias("unique_remote_ports"),
    )


def process_summary(lines: DataFrame, user: str | None = None) -> DataFrame:
    """Processes, those whose owner's name holds user, and threads of ps lines (value, line_no from 0); the first line is the header."""
    parts = F.split(F.trim("value"), r"\s+")
    threads = F.coalesce(F.element_at(parts, -1).try_cast("int"), F.lit(0))
    rows = lines.where((F.col("line_no") > 0) & (F.size(parts) >= 3))
    own = parts[0].contains(user) if user else F.lit(False)
    return rows.agg(F.count("*").alias("process_count"), F.count_if(own).alias("user_process_count"), F.coalesce(F.sum(F.greatest(threads, F.lit(0))), F.lit(0)).alias("thread_count"))


def listed_packages(lines: DataFrame, manager: str, architecture: str = "unknown") -> DataFrame:
    """(manager, name, version, architecture) of homebrew lists (name and versions, apart by spaces) or pkgutil lists (a name a line)."""
    parts = F.split(F.trim("value"), r"\s+")
    versions = F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ","), F.lit("")), F.lit("unknown"))
    name, version = (parts[0], versions) if manager == "homebrew" else (F.trim("value"), F.lit("unknown"))
    return lines.where(F.trim("value") != "").select(F.lit(manager).alias("manager"), name.alias("name"), version.alias("version"), F.lit(architecture).alias("architecture"))


def json_packages(documents: DataFrame) -> DataFrame:
    """The same of JSON texts (value): an object or a list of objects with Name, Version and ProviderName; objects without a Name go."""
    fields = "struct<Name: string, Version: string, ProviderName: string>"
    text = F.trim("value")
    listed = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{fields}>")
    rows = documents.where(text != "").select(F.inline(listed)).where("Name != ''")
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return rows.select(filled("ProviderName", "powershell").alias("manager"), F.col("Name").alias("name"), filled("Version", "unknown").alias("version"), F.lit("unknown").alias("architecture"))


def segment_order(paths: list[str], live: str) -> list[str]:
    """Rotated segments by name, then the live file."""
    return [*sorted(p for p in paths if p != live), *([live] if live in paths else [])]


def archive_lines(spark: SparkSession, path: str, most_bytes: int = 512 << 20, most_rows: int | None = None) -> DataFrame:
    """(member, line_no, value): the lines of every regular member of tar or tar.gz archives, only the first most_rows of each where that is given.

    Each archive is read by Spark and unpacked in one task; one above most_bytes fails, and unsafe member names are refused."""
    import io
    import itertools
    import tarfile

    import pandas as pd

    def unpack(batches):
        for batch in batches:
            for name, size, content in zip(batch["path"], batch["length"], batch["content"], strict=True):
                if size > most_bytes:
                    raise ValueError(f"{name} is larger than {most_bytes} bytes")
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for member in archive:
                        if member.name.startswith("/") or ".." in member.name.split("/"):
                            raise ValueError(f"unsafe member name in {name}")
                        if member.isfile():
                            lines = enumerate(itertools.islice(io.TextIOWrapper(archive.extractfile(member), encoding="utf-8"), most_rows))
                            while rows := [(member.name, no, line.rstrip("\n")) for no, line in itertools.islice(lines, 4096)]:
                                yield pd.DataFrame(rows, columns=["member", "line_no", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(unpack, "member string, line_no long, value string")


def verify_manifest(spark: SparkSession, paths: str | list[str], manifest: DataFrame) -> DataFrame:
    """Files whose size or hash is not what the manifest (path, bytes, sha256) says, or that are missing on either side."""
    found = file_hashes(spark, paths).select("path", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    joined = manifest.join(found, "path", "full_outer")
    return joined.where(~F.col("bytes").eqNullSafe(F.col("found_bytes")) | ~F.col("sha256").eqNullSafe(F.col("found_sha256")))
