"""Syslog sources: lines over TCP by Spark's socket source, datagrams over UDP by a Python data source. Both give rows for the normalizer.

They are receivers on one host, for small installations and tests: what a receiver held when it died is lost. At scale a relay writes files to a landing zone (``files.landing``).
"""

from __future__ import annotations

import socket
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

MAX_BYTES = 65_536


def _rows(lines: DataFrame, peer) -> DataFrame:
    """Longer messages are cut, as their tails can't be told from the next message."""
    return lines.select(F.lit("/syslog").alias("path"), F.substring("value", 1, MAX_BYTES).alias("body"), peer.alias("peer"), F.lit(None).cast("string").alias("validation_id"), F.current_timestamp().alias("received_at"))


def syslog_tcp(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the lines that a relay at host and port sends."""
    return _rows(spark.readStream.format("socket").option("host", host).option("port", port).load(), F.lit(f"{host}:{port}"))


class _Datagrams(SimpleDataSourceStreamReader):
    """Reads what has come since the last batch; batches are kept until they are committed, so that a failed one can be read again."""

    def __init__(self, host: str, port: int, most: int):
        self.address, self.most, self.kept, self.socket = (host, port), most, {}, None

    def _opened(self) -> socket.socket:
        """Only the reader that reads listens; Spark makes others to plan with."""
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.socket.setblocking(False)
        return self.socket

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        rows, until = [], time.monotonic() + 0.2
        while len(rows) < self.most and time.monotonic() < until:
            try:
                data, (host, _) = self._opened().recvfrom(MAX_BYTES)
                rows.append((data.decode("utf-8", "replace").rstrip("\r\n\0"), host))
            except BlockingIOError:
                time.sleep(0.01)
        for i, r in enumerate(rows):
            self.kept[start["n"] + i] = r
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.kept[i] for i in range(start["n"], end["n"]) if i in self.kept])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["n"]]:
            del self.kept[i]


class SyslogUdp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "syslog_udp"

    def schema(self) -> str:
        return "value string, peer string"

    def simpleStreamReader(self, schema) -> _Datagrams:
        return _Datagrams(self.options.get("host", "127.0.0.1"), int(self.options["port"]), int(self.options.get("most", 10_000)))


def syslog_udp(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the datagrams that come to host and port."""
    spark.dataSource.register(SyslogUdp)
    return _rows(spark.readStream.format("syslog_udp").option("host", host).option("port", port).load(), F.col("peer"))
