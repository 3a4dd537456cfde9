"""Immutable versions of tables behind an index, and a log table with retention.

A version's data are written to a folder of their own first. The commit is its index entry, a file that is created only if it is not
there: of two writers that want the same number one gets it, the other takes the next. Readers go by the index, so data without an
entry do not exist for them; they are removed by clean(). Needs a file system with exclusive creation (HDFS, local, shared POSIX).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Corrupted(Exception):
    """Data that do not match what the index says of them."""


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of row digests that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.sum(number)).first()
    return n, str(total or 0)


class Versions:
    """Tables by kind and scope, each with versions 1, 2, 3 and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _index(self, kind: str, scope: str) -> str:
        return f"{self.folder}/index/{kind}/{scope or '-'}"

    def numbers(self, kind: str, scope: str = "") -> list[int]:
        return sorted(int(n[1:-5]) for n in _names(self.spark, self._index(kind, scope)) if n.endswith(".json"))

    def _enter(self, path: str, entry: dict) -> bool:
        """Whether the entry was not there and now is."""
        fs, at = _fs(self.spark, path)
        from py4j.protocol import Py4JJavaError

        try:
            out = fs.create(at(path), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(at(path)):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def write(self, df: DataFrame, kind: str, scope: str = "", created_by: str = "") -> int:
        """Writes the next version and returns its number. If the index cannot be written, no data stay."""
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        try:
            df.write.mode("errorifexists").parquet(data)
            rows, total = fingerprint(self.spark.read.schema(df.schema).parquet(data))
            entry = {"kind": kind, "scope": scope, "data": data, "rows": rows, "digest": total, "schema": df.schema.json(), "created_by": created_by}
            number = max(self.numbers(kind, scope), default=0) + 1
            while not self._enter(f"{self._index(kind, scope)}/v{number}.json", entry | {"version": number}):
                number += 1
        except BaseException:
            fs, at = _fs(self.spark, data)
            fs.delete(at(data), True)
            raise
        return number

    def read(self, kind: str, scope: str = "", version: int | None = None, check: bool = True) -> DataFrame:
        """A version, by default the latest; check: compare it with what the index says."""
        from pyspark.sql.types import StructType

        known = self.numbers(kind, scope)
        if not known or (version or known[-1]) not in known:
            raise LookupError(f"no version {version or ''} of {kind} {scope}")
        text = self.spark.read.text(f"{self._index(kind, scope)}/v{version or known[-1]}.json", wholetext=True).first()[0]
        entry = json.loads(text)
        df = self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["data"])
        if check and fingerprint(df) != (entry["rows"], entry["digest"]):
            raise Corrupted(entry["data"])
        return df

    def clean(self) -> list[str]:
        """Removes data that no index entry names; returns their names. Not while others write."""
        root = f"{self.folder}/index"
        named = set()
        for kind in _names(self.spark, root):
            for scope in _names(self.spark, f"{root}/{kind}"):
                for r in self.spark.read.text(f"{root}/{kind}/{scope}", wholetext=True).collect():  # an entry for each version
                    named.add(json.loads(r[0])["data"].rsplit("/", 1)[-1])
        lost = [n for n in _names(self.spark, f"{self.folder}/data") if n not in named]
        for n in lost:
            fs, at = _fs(self.spark, self.folder)
            fs.delete(at(f"{self.folder}/data/{n}"), True)
        return lost


def log_rows(events: DataFrame, extras: str, known: tuple[str, ...], ts: Column) -> DataFrame:
    """events with day, a column for each known extra, and extra: the others as VARIANT (null if there are none). extras: a JSON object; what is none counts as empty."""
    pairs = F.coalesce(F.from_json(extras, "map<string,string>"), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(pairs, lambda k, _: ~k.isin(*known))
    columns = {k: F.get_json_object(extras, f"$.{k}") for k in known}
    return events.withColumns(columns | {"day": ts.cast("date"), "extra": F.when(F.size(rest) > 0, F.try_parse_json(F.to_json(rest)))}).drop(extras)


def append_log(rows: DataFrame, folder: str) -> None:
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(folder)


def retain(spark: SparkSession, folder: str, today: str, days: int = 14) -> list[str]:
    """Deletes whole days before today less `days`; returns them. No row is read."""
    import datetime

    first = (datetime.date.fromisoformat(today) - datetime.timedelta(days=days)).isoformat()
    gone = [n for n in _names(spark, folder) if n.startswith("day=") and n[4:] < first]
    fs, at = _fs(spark, folder)
    for n in gone:
        fs.delete(at(f"{folder}/{n}"), True)
    return [n[4:] for n in gone]
