"""Named frames that stay resident between commands."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .dsl import run_json, run_text
from .errors import FrameNotFound
from .operators.frame import Frame
from .sources.csv import read_csv, to_csv

#: Bytes of CSV that show returns at most.
SHOWN = 1 << 20


@dataclass
class Entry:
    name: str
    frame: Frame
    created: float = field(default_factory=time.time)


class Catalog:
    """Frames by name, each persisted (memory, then disk) and registered as a temporary view, so SQL sees it as well.
    Commands may come from several threads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.started = spark, time.time()
        self._entries: dict[str, Entry] = {}
        self._lock = threading.Lock()

    def bind(self, name: str, frame: Frame) -> bool:
        """Keeps a frame; says whether the name was taken before."""
        frame.df.persist(StorageLevel.MEMORY_AND_DISK)
        frame.df.createOrReplaceTempView(name)
        with self._lock:
            old = self._entries.get(name)
            self._entries[name] = Entry(name, frame)
        if old is not None and old.frame.df is not frame.df:
            old.frame.df.unpersist()
        return old is not None

    def get(self, name: str) -> Frame:
        with self._lock:
            if name not in self._entries:
                raise FrameNotFound(f"no frame named {name!r}")
            return self._entries[name].frame

    def load(self, name: str, path: str, separator: str = ",", header: bool = True) -> dict:
        existed = self.bind(name, read_csv(self.spark, path, separator, header))
        return self._about(name) | {"overwritten": existed}

    def pipe(self, source: str, target: str, chain: str | None = None, json: str | None = None) -> dict:
        frame = self.get(source)
        existed = self.bind(target, run_json(frame, json) if json is not None else run_text(frame, chain or ""))
        return self._about(target) | {"overwritten": existed}

    def save(self, name: str, path: str, separator: str = ",") -> dict:
        frame = self.get(name)
        to_csv(frame, path, separator=separator)
        return {"name": name, "path": path, "rows": frame.df.count()}

    def _about(self, name: str) -> dict:
        e = self._entries[name]
        return {"name": name, "rows": e.frame.df.count(), "columns": len(e.frame.data_columns), "bytes": e.frame.estimated_bytes(), "created": e.created}

    def list(self) -> list[dict]:
        with self._lock:
            names = [e.name for e in sorted(self._entries.values(), key=lambda e: (e.created, e.name))]
        return [self._about(n) for n in names]

    def drop(self, name: str) -> dict:
        frame = self.get(name)
        freed = frame.estimated_bytes()
        with self._lock:
            del self._entries[name]
        self.spark.catalog.dropTempView(name)
        frame.df.unpersist()
        return {"name": name, "freed_bytes": freed}

    def show(self, name: str, n: int = 10) -> dict:
        text = to_csv(self.get(name).head(n)) or ""
        return {"name": name, "csv": text[:SHOWN], "truncated": len(text) > SHOWN}

    def info(self, name: str) -> dict:
        """Type, values that aren't missing and bytes of each column, in one pass."""
        frame = self.get(name)
        df = frame.df.select(*[f"`{c}`" for c in frame.data_columns])
        aggs = [a for k, (c, t) in enumerate(df.dtypes) for a in (F.count(f"`{c}`").alias(f"n{k}"), (F.sum(F.octet_length(f"`{c}`")) if t == "string" else F.count(f"`{c}`") * {"boolean": 1}.get(t, 8)).alias(f"b{k}"))]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
        return {"name": name, "rows": row["rows"], "columns": [{"name": c, "dtype": t, "non_null": row[f"n{k}"], "bytes": row[f"b{k}"] or 0} for k, (c, t) in enumerate(df.dtypes)]}

    def status(self) -> dict:
        import os

        found = self.list()
        return {"pid": os.getpid(), "uptime_s": time.time() - self.started, "frames": len(found), "bytes": sum(x["bytes"] for x in found)}

    def clear(self) -> None:
        for x in self.list():
            self.drop(x["name"])
