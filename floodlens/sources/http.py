"""HTTP header lines, raw HTTP messages and the files they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD_END = "\r\n\r\n"


def _key_columns() -> list[Column]:
    return [
        F.get("p", F.lit(0)).try_cast("double").cast("long").alias("ts"),
        F.get("p", F.lit(1)).alias("src"),
        F.get("p", F.lit(2)).try_cast("int").alias("sport"),
        F.get("p", F.lit(3)).alias("dst"),
        F.get("p", F.lit(4)).try_cast("int").alias("dport"),
    ]


def _split_lines(lines: DataFrame) -> DataFrame:
    # Trailing empty fields do not count as fields.
    parts = F.split(F.regexp_replace("value", r"\t+$", ""), "\t", -1)
    return lines.select(parts.alias("p")).filter(F.size("p") >= 5)


def parse_http_field(lines: DataFrame, field: str) -> DataFrame:
    """Header lines (column `value`): five key fields, status, direction, header, value.

    Gives the rows of the requested header with its value; other lines are left out.
    """
    rest = F.slice("p", 6, F.size("p") - 5)
    place = F.array_position(rest, field).cast("int")
    value = F.get(rest, place)
    rows = _split_lines(lines).select(*_key_columns(), F.when(place > 0, value).alias("field"))
    return rows.filter(F.col("field").isNotNull())


def parse_http_all_fields(lines: DataFrame) -> DataFrame:
    """The same lines with the status as `request` and what follows the direction as `fields`."""
    return _split_lines(lines).select(
        *_key_columns(),
        F.get("p", F.lit(5)).alias("request"),
        F.slice("p", 8, F.greatest(F.size("p") - 7, F.lit(0))).alias("fields"),
    )


def http_field_scan(spark: SparkSession, path: str, field: str = "user-agent") -> DataFrame:
    """Header line files, rows of one header."""
    return parse_http_field(spark.read.text(path), field)


def http_all_fields_scan(spark: SparkSession, path: str) -> DataFrame:
    """Header line files, all fields."""
    return parse_http_all_fields(spark.read.text(path))


def http_message_split(df: DataFrame, column: str = "message", compat: bool = False) -> DataFrame:
    """Raw HTTP messages (text or bytes) as status, header map (lower-case names, last one wins),
    payload and payload_bytes.

    The payload is cut to Content-Length, counted in bytes; without that header it is empty.
    `payload_bytes` is exact; `payload` is the same as text, with replacement characters for bytes
    that are no UTF-8, such as those of a character that the cut goes through. Rows without a
    complete header are left out. `compat=True` ignores the last header line, as the original
    splitter did.
    """
    raw = F.col(column).cast("binary")
    # One character to a byte, so that places are places of bytes.
    head_length = F.instr(F.decode(raw, "ISO-8859-1"), _HEAD_END)
    head = F.substring(raw, F.lit(1), head_length - 1).cast("string")
    body = F.substring(raw, head_length + len(_HEAD_END), F.octet_length(raw))
    rows = (
        df.withColumn("_head", F.when(head_length > 0, F.make_valid_utf8(head)))
        .withColumn("_body", body)
        .filter(F.contains(F.col("_head"), F.lit("\r\n")))
        .withColumn("_lines", F.split("_head", "\r\n", -1))
    )
    fields = F.slice("_lines", 2, F.size("_lines") - (2 if compat else 1))
    pairs = F.transform(
        F.filter(fields, lambda line: F.instr(line, ": ") > 0),
        lambda line: F.struct(
            F.lower(F.substring_index(line, ": ", 1)).alias("key"),
            F.substring(line, F.instr(line, ": ") + 2, F.length(line)).alias("value")),
    )
    rows = rows.withColumn("_pairs", pairs)
    winners = F.filter("_pairs", lambda pair, i: ~F.exists(
        F.slice("_pairs", i + 2, F.size("_pairs")), lambda later: later["key"] == pair["key"]))
    headers = F.map_from_entries(winners)
    size = F.coalesce(F.try_element_at("headers", F.lit("content-length")).try_cast("int"),
                      F.lit(0))
    others = [c for c in df.columns if c != column]
    return (
        rows.withColumn("headers", headers)
        .select(*others, F.get("_lines", F.lit(0)).alias("status"), "headers",
                F.make_valid_utf8(F.substring("_body", F.lit(1), size).cast("string"))
                .alias("payload"),
                F.substring("_body", F.lit(1), size).alias("payload_bytes"))
    )


def http_file_hashes(df: DataFrame, mime: str = "") -> DataFrame:
    """Size, hashes and inferred name of each transferred file.

    Input: `payload`, `mimetype`, `ext`, `direction` (`c` for data the client received) and
    `request`, the request line it answers; other columns are kept. `mime` selects by MIME type
    (with `/`), extension (with `.`) or bare extension.
    """
    if "/" in mime:
        df = df.filter(F.col("mimetype") == mime)
    elif "." in mime:
        df = df.filter(F.col("ext") == mime)
    elif mime:
        df = df.filter(F.substring("ext", 2, 255) == mime)
    target = F.get(F.split("request", " ", -1), F.lit(1))
    # Fixed value: the characters a file name may have.
    clean = F.right(F.regexp_replace(target, r"[^-_.() a-zA-Z0-9]", "_"), F.lit(50))
    name = F.when((F.col("direction") == "c") & (F.length(clean) > 0), clean).otherwise("-")
    payload = F.col("payload").cast("binary")
    return df.select(
        *[c for c in df.columns if c not in ("payload", "request", "direction")],
        F.md5(payload).alias("md5"),
        F.sha1(payload).alias("sha1"),
        F.sha2(payload, 256).alias("sha256"),
        F.octet_length(payload).cast("long").alias("size"),
        name.alias("name"),
    )
