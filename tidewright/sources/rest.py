"""Paged and range-split readers of REST services, as data sources whose partitions are ranges of time.

A transport is any callable (host, parameters) -> (status, payload), named by
`module:function`; the function gets the source's options and returns the
transport. So the same readers work over a network library and over recorded
answers.
"""

from __future__ import annotations

import importlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], tuple[int, object]]
# Answers that mean "try the next host", "wait", "range too large", "beyond the history that is allowed" and "beyond the quota".
BLOCKED, WAIT, TOO_LARGE, TOO_OLD, NO_QUOTA = 451, (418, 429), 422, 403, 402


class SourceError(RuntimeError):
    """No host answered."""


def ask(transport: Transport, hosts: list[str], parameters: dict, tries: int = 8, pause: float = 0.5) -> tuple[int, object]:
    """The first answer below 400, or of a kind that a caller handles; blocked hosts and failing ones pass on to the next."""
    said: list[str] = []
    for host in hosts:
        for k in range(tries):
            try:
                status, payload = transport(host, parameters)
            except OSError as e:
                said.append(f"{host}: {e}")
                time.sleep(pause * (1 + k))
                continue
            if status == BLOCKED:
                said.append(f"{host}: blocked")
                break
            if status in WAIT or status >= 500:
                said.append(f"{host}: {status}")
                time.sleep(pause * (1 + k) * (2 if status in WAIT else 1))
                continue
            return status, payload
    raise SourceError("; ".join(said[-5:]) or "no hosts")


def pages(transport: Transport, hosts: list[str], parameters: dict, start: int, end: int, limit: int, **how: float) -> Iterator[list]:
    """Rows [key in ms, ...] with start <= key < end, a page after the other: each begins a millisecond after the last key."""
    at = start
    while at < end:
        status, rows = ask(transport, hosts, {**parameters, "startTime": at, "endTime": end - 1, "limit": limit}, **how)
        if status >= 400 or not isinstance(rows, list):
            raise SourceError(f"{status}: {rows}")
        yield from (r for r in rows if start <= int(r[0]) < end)
        if len(rows) < limit or int(rows[-1][0]) < at:
            return
        at = int(rows[-1][0]) + 1


def ranged(transport: Transport, hosts: list[str], parameters: dict, start: int, end: int, step: int, depth: int = 0, most: int = 20, **how: float) -> list[dict]:
    """Records with start <= time < end. A range that is too large is halved, one that begins too early is cut to the
    days that are allowed, one beyond the quota is cut to its latest part; a refusal for another reason gives no records.
    """
    if end <= start or depth > most:
        return []
    again = lambda a, b: ranged(transport, hosts, parameters, a, b, step, depth + 1, most, **how)
    status, payload = ask(transport, hosts, {**parameters, "from": start, "to": end}, **how)
    said = payload if isinstance(payload, dict) else {}
    if status == TOO_LARGE:
        middle = start + (end - start) // 2
        return again(start, middle) + again(middle, end) if end - start > step else []
    if status == TOO_OLD and said.get("allowed_days") is not None:
        first = max(start, end - max(1, int(said["allowed_days"]) - 1) * 86_400_000)
        return again(first, end) if first > start else []
    if status == NO_QUOTA:
        left = said.get("quota_remaining")
        if left is not None and left <= 0:
            return []
        first = max(start, end - step * max(1, int(left) - 1)) if left is not None else start + (end - start) // 2
        return again(first, end) if first > start else []
    return payload if status < 400 and isinstance(payload, list) else []


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


class _Reader(DataSourceReader):
    """Partitions: the span of each name, cut at multiples of `split` ms."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Range]:
        o = self.options
        start, end = int(o["start"]), int(o["end"])
        split = int(o.get("split", 0))
        cuts = [start, *(range(start - start % split + split, end, split) if split else ()), end]
        return [Range(n, a, b) for n in o["names"].split(",") for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]

    def transport(self) -> Transport:
        module, _, name = self.options["transport"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    @property
    def hosts(self) -> list[str]:
        return self.options.get("hosts", "").split(",")

    @property
    def how(self) -> dict:
        return {"tries": int(self.options.get("tries", 8)), "pause": float(self.options.get("pause", 0.5))}


class _KlineReader(_Reader):
    def read(self, partition: Range) -> Iterator[tuple]:
        o = self.options
        parameters = {"symbol": partition.name, "interval": o.get("interval", "1d")}
        for r in pages(self.transport(), self.hosts, parameters, partition.start, partition.end, int(o.get("limit", 1000)), **self.how):
            yield partition.name, o.get("interval", "1d"), [None if v is None else str(v) for v in r]


class KlineSource(DataSource):
    """format `klines`: symbol, interval and the raw values of each bar, paged by time.

    Options: transport, names (symbols), interval, start and end (ms), split (ms a partition), limit, hosts, tries, pause.
    """

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, interval string, raw array<string>"

    def reader(self, schema: object) -> DataSourceReader:
        return _KlineReader(self.options)


class _MetricReader(_Reader):
    def read(self, partition: Range) -> Iterator[tuple]:
        o = self.options
        step = int(o.get("step", 86_400_000))
        for r in ranged(self.transport(), self.hosts, {"endpoint": partition.name}, partition.start, partition.end, step, **self.how):
            yield partition.name, int(r["time"]), json.dumps(r, sort_keys=True)


class MetricSource(DataSource):
    """format `metrics`: endpoint, time (ms) and each record as JSON, read by ranges that are split as the service asks.

    Options: as for klines, with names (endpoints) and step (ms between records) instead of interval and limit.
    """

    @classmethod
    def name(cls) -> str:
        return "metrics"

    def schema(self) -> str:
        return "endpoint string, time long, record string"

    def reader(self, schema: object) -> DataSourceReader:
        return _MetricReader(self.options)


def register(spark: SparkSession) -> None:
    for s in (KlineSource, MetricSource):
        spark.dataSource.register(s)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, one of this machine, in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tidewright-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def record(df: DataFrame, path: str) -> str:
    """Write answers to be replayed: df(name, time in ms, values array<string>), a folder a name."""
    df.repartition("name").sortWithinPartitions("name", "time").write.partitionBy("name").parquet(path)
    return path


class Recorded:
    """Replays answers that `record` wrote; refuses as services do: blocked hosts, a busy first call, limits of rows, days and quota."""

    def __init__(self, options: dict) -> None:
        self.options, self.calls = options, 0

    def rows(self, name: str, start: int, end: int, limit: int | None = None) -> list[tuple[int, list]]:
        """Answers with start <= time < end, at most `limit` of them; no more is read into memory."""
        from pyarrow import dataset

        path = f"{self.options['recording'].removeprefix('file://')}/name={name}"
        at = dataset.field("time")
        scan = dataset.dataset(path, format="parquet").scanner(columns=["time", "values"], filter=(at >= start) & (at < end))
        t = scan.head(limit) if limit is not None else scan.to_table()
        return sorted(zip(t["time"].to_pylist(), t["values"].to_pylist(), strict=True), key=lambda r: r[0])

    def __call__(self, host: str, parameters: dict) -> tuple[int, object]:
        o = self.options
        self.calls += 1
        if host in o.get("blocked", "").split(",") and host:
            return BLOCKED, None
        if self.calls == 1 and o.get("busy"):
            return WAIT[-1], None
        if "symbol" in parameters:
            return 200, [[t, *v] for t, v in self.rows(parameters["symbol"], parameters["startTime"], parameters["endTime"] + 1, parameters["limit"])]
        a, b = parameters["from"], parameters["to"]
        days = o.get("alloweddays")
        if days and a < b - int(days) * 86_400_000:
            return TOO_OLD, {"allowed_days": int(days)}
        most = max(int(o.get("quota") or 0), int(o.get("most", 0))) + 1
        found = self.rows(parameters["endpoint"], a, b, most if most > 1 else None)
        if o.get("quota") and len(found) > int(o["quota"]):
            return NO_QUOTA, {"quota_remaining": int(o["quota"])}
        if len(found) > int(o.get("most", 1 << 60)):
            return TOO_LARGE, {"message": "payload too large"}
        return 200, [{"time": t, "values": v} for t, v in found]
