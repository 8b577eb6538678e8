"""Small hand-made frames."""

from __future__ import annotations

from floodlens import schemas


def packets(spark, rows: list[dict]):
    """Packets with the given columns; the others are null."""
    names = schemas.PACKETS.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.PACKETS)


def udp(ts, src, dst="v", length=100, sport=10, dport=53, **more):
    return {"ts": ts, "ip_src": src, "ip_dst": dst, "ip_proto": 17, "ip_total_length": length,
            "udp_sport": sport, "udp_dport": dport, "ip_more_fragments": 0, "ip_ttl": 60, **more}


def tcp(ts, src, dst="v", length=100, sport=10, dport=80, **more):
    return {"ts": ts, "ip_src": src, "ip_dst": dst, "ip_proto": 6, "ip_total_length": length,
            "tcp_sport": sport, "tcp_dport": dport, "ip_more_fragments": 0, "ip_ttl": 60, **more}


def lines(spark, *values: str):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df, *columns: str) -> list[tuple]:
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df) -> str:
    """The physical plan before execution, subqueries included."""
    return df._jdf.queryExecution().executedPlan().toString()
