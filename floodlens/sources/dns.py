"""DNS messages, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens import schemas

# DNS record types whose data becomes the address column, by the part that holds it.
_TYPES_WITH_ADDRESS = {"A": 1, "AAAA": 28}
_TYPES_WITH_TARGET = {"PTR": 12, "MX": 15, "AFSDB": 18, "SRV": 33}
_TYPES_WITH_STRINGS = {"TXT": 16}


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """DNS JSON files as messages with question and answer lists."""
    return spark.read.schema(schemas.DNS_JSON).json(path)


def parse_messages(lines: DataFrame) -> DataFrame:
    """JSON lines (column `value`) as messages."""
    return lines.select(F.from_json("value", schemas.DNS_JSON).alias("m")).select("m.*")


def dns_rows(messages: DataFrame) -> DataFrame:
    """One row per question of a query and per answer of a response.

    A question has no address and TTL 0; an answer's address is the one of its A record.
    """
    questions = F.transform("questions", lambda q: F.struct(
        q["qname"].alias("name"), F.lit(None).cast("string").alias("addr"),
        F.lit(0).cast("long").alias("ttl")))
    answers = F.transform("answers", lambda a: F.struct(
        a["qname"].alias("name"), a["qrdata"]["IPAddress"].alias("addr"),
        a["qttl"].alias("ttl")))
    rows = (F.when(F.col("mode") == "query", questions)
            .when(F.col("mode") == "response", answers))
    return messages.select(
        F.col("ts").cast("long").alias("ts"), "id", "mode", F.inline(rows))


def _address(answer: Column) -> Column:
    kind, data = answer["qtype"], answer["qrdata"]
    return (
        F.when(kind.isin(*_TYPES_WITH_ADDRESS.values()), data["IPAddress"])
        .when(kind.isin(*_TYPES_WITH_TARGET.values()), data["Target"])
        .when(kind.isin(*_TYPES_WITH_STRINGS.values()),
              F.concat(F.lit("["), F.array_join(data["Strings"], ", "), F.lit("]")))
    )


def dns_all_rows(messages: DataFrame) -> DataFrame:
    """One row per question and per answer of every message, with addresses, class and type.

    The mode of a message that is no response reads `question`. A message without questions and
    answers gives no row.
    """
    def row(name: Column, addr: Column, ttl: Column, source: Column) -> Column:
        return F.struct(name.alias("name"), addr.alias("addr"), ttl.alias("ttl"),
                        source["qclass"].alias("class"), source["qtype"].alias("type"))

    none = F.lit(None).cast("string")
    questions = F.transform(F.coalesce("questions", F.array()), lambda q: row(
        q["qname"], none, F.lit(0).cast("long"), q))
    answers = F.transform(F.coalesce("answers", F.array()), lambda a: row(
        a["qname"], _address(a), a["qttl"], a))
    mode = F.when(F.col("mode") == "response", "response").otherwise("question")
    return (
        messages.select(F.col("ts").cast("long").alias("ts"), "id", mode.alias("mode"),
                        "srcIP", "dstIP", F.inline(F.concat(questions, answers)))
        .select("ts", "id", "mode", "name", "addr", "ttl",
                F.col("srcIP").alias("src_ip"), F.col("dstIP").alias("dst_ip"), "class", "type")
    )


def dns_packet_rows(messages: DataFrame) -> DataFrame:
    """The five-column form: questions and answers, address for A records only."""
    rows = dns_all_rows(messages)
    return rows.select("ts", "id", "mode", "name",
                       F.when(F.col("type") == _TYPES_WITH_ADDRESS["A"], F.col("addr"))
                       .alias("addr"), "ttl")
