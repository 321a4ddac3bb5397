"""Arrivals as a stream: the version state machines, a key at a time. The batch windows are their specification.

Arrivals may come in any order: an arrival with an earlier number than ones already decided is put in its place, and what it
changes is decided again. Nothing is forgotten. Results are upserts by (scheme, seq); the sink keeps each trigger's in a folder of
its number, so that a trigger that runs again after a failure replaces what it wrote."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

TIMELINE = "scheme string, seq long, hash string, detected string, status string, change_type string, old_active long"
_ROW = "hash string, review boolean, detected string, status string, change_type string, old_active long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """New parquet files of a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class Timeline(StatefulProcessor):
    """The state of a scheme: each arrival by its number, the first arrival of each hash, and the last number with the active one.

    All are in the state store, entry by entry. An arrival in order looks at three entries; a late one walks the scheme's arrivals
    and holds those after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "seq long", _ROW)
        self.seen = handle.getMapState("seen", "hash string", "seq long")
        self.last = handle.getValueState("last", "seq long, active long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = {int(r.seq): (int(r.seq), r.hash if isinstance(r.hash, str) else None, True if r.review is None else bool(r.review)) for b in rows for r in b.itertuples()}
        last, active = self.last.get() if self.last.exists() else (None, None)
        earlier = None if last is None else self.rows.getValue((last,))
        out: dict[int, tuple] = {}
        came = [came[k] for k in sorted(came) if last is None or k > last or not self.rows.containsKey((k,))]  # others are given again
        if not came:
            return
        if last is not None and came[0][0] <= last:
            start, active, last_before, earlier = came[0][0], None, None, None
            for (seq,), row in self.rows.iterator():
                if seq > start:
                    came.append((seq, row[0], row[1]))
                    continue
                if last_before is None or seq > last_before:
                    last_before, earlier = seq, row
                if row[3] in ("ACTIVE", "ARCHIVED") and (active is None or seq > active):
                    active = seq
            came.sort(key=lambda r: r[0])
            for _, known, _ in came:
                if known and self.seen.containsKey((known,)) and self.seen.getValue((known,))[0] >= start:
                    self.seen.removeKey((known,))
        before = active
        for seq, known, review in came:
            fresh = not known or not self.seen.containsKey((known,))
            if fresh and known:
                self.seen.updateValue((known,), (seq,))
            status = "already_exists" if not fresh else "REVIEW" if review else "ARCHIVED"
            change = None if not fresh else "REVIEW_REQUIRED" if review else "INITIAL_ACTIVE" if active is None else "MODIFIED"
            detected = "NEW_SCHEME" if earlier is None else "UNCHANGED" if known is not None and known == earlier[0] else "NEW_VERSION"
            out[seq] = earlier = (known, review, detected, status, change, active)
            if fresh and not review:
                active = seq
        if active in out:
            out[active] = (*out[active][:3], "ACTIVE", *out[active][4:])
        if before is not None:  # it may have stopped being active, or is so again
            row, status = self.rows.getValue((before,)), "ACTIVE" if before == active else "ARCHIVED"
            if row[3] != status:
                out[before] = (*row[:3], status, *row[4:])
        for seq, row in out.items():
            self.rows.updateValue((seq,), row)
        self.last.update((max(came[-1][0], came[-1][0] if last is None else last), active))
        table = pd.DataFrame([(key[0], seq, r[0], *r[2:]) for seq, r in out.items()], columns=["scheme", "seq", "hash", "detected", "status", "change_type", "old_active"])
        yield table.astype({"old_active": "Int64"})


def timeline_stream(arrivals: DataFrame) -> DataFrame:
    """Upserts of the timeline (operators.versions.version_timeline) from a stream of arrivals (scheme, seq, hash, review): a row
    for each arrival, and again for those whose row a later or a late arrival changes. Null reviews count as needed, as there.
    ``detected`` is the change against the arrival before, as detect_versions has it."""
    return arrivals.select("scheme", "seq", "hash", "review").groupBy("scheme").transformWithStateInPandas(statefulProcessor=Timeline(), outputStructType=TIMELINE, outputMode="Update", timeMode="None")


def start(upserts: DataFrame, root: str, **trigger: Any) -> StreamingQuery:
    """Write a stream of upserts below ``root``: a folder for each trigger, by number; ``root`` has the checkpoint, too."""
    spark = upserts.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        sink = upserts.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/trigger={n}"))
        return sink.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(key, had)


def upserted(spark: SparkSession, root: str, keys: list[str], schema: str) -> DataFrame:
    """The last row of each key of what start() wrote."""
    rows = spark.read.schema(f"{schema}, trigger long").option("basePath", f"{root}/out").parquet(f"{root}/out")
    rest = [c for c in rows.columns if c not in (*keys, "trigger")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("r")).select(*keys, "r.*")


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """The first arrival of each (scheme, hash). What has been seen stays known, however long ago."""
    return arrivals.dropDuplicates(["scheme", "hash"])
