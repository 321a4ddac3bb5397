"""Token ids in raw shards, with a minimal perfect hash index from document keys to places in them.

Layout under one folder of the shared store:

    shard-<n>-<attempt>.ids   ids of a range of documents in key order, little-endian, 2 or 4 bytes each
    shard-<n>-<attempt>.len   the number of ids of each of its documents, little-endian unsigned 32-bit
    index-<bucket>-<attempt>.mph   an index bucket

A task writes its files under a name of its own attempt and reports them in its rows; the rows of the attempts that Spark
keeps are the manifest, so files of lost or repeated attempts are never read.

Index: keys fall into buckets by hash. A bucket holds a cascade of bit arrays: at each level a key's hash names a bit, a
bit named once belongs to its key, the keys of other bits go on to the next level. The rank of a key's bit is its slot,
from 0 without gaps; the slot holds a fingerprint, which tells foreign keys, and the key's entries.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path
from .tokenization import BLOCK_BYTES, encoder, mix64, spans_of_rows, utf8_buffers

KEYS_PER_BUCKET = 50_000
_LOOSE = 2.0
_LEVELS = 64


#: Bytes of text in a shard, about.
SHARD_BYTES = 256 << 20
#: Hadoop's names of stores that Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style URI, for workers without a JVM; a mounted ``dbfs:`` is a local path."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        path = rest if colon else uri
        return pafs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("//") else path
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    try:
        return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    except pa.ArrowInvalid as unknown:
        raise ValueError(f"Arrow has no file system for {scheme}: set the shared folder to one it has (file, hdfs, viewfs, s3a, gs, abfss)") from unknown


class PerfectHash:
    """A minimal perfect hash over distinct pairs of 64-bit hashes."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bit arrays, and first hashes of keys that no level took, in slot order
        self.ranks = [np.concatenate([[0], np.cumsum(level, dtype=np.int64)]) for level in levels]
        self.bases = np.concatenate([[0], np.cumsum([level.sum() for level in levels], dtype=np.int64)])

    @staticmethod
    def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(h1 + h2 * np.uint64(2 * level + 1)) % np.uint64(size)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        if len(np.unique(np.stack([h1, h2]), axis=1).T) != len(h1):
            raise ValueError("keys must be distinct")
        levels = []
        while len(h1) and len(levels) < _LEVELS:
            size = max(8, int(_LOOSE * len(h1)))
            bit = cls._bit(h1, h2, len(levels), size)
            counts = np.bincount(bit.astype(np.int64), minlength=size)
            levels.append(counts == 1)
            left = counts[bit.astype(np.int64)] > 1
            h1, h2 = h1[left], h2[left]
        return cls(levels, h1)

    def __len__(self) -> int:
        return int(self.bases[-1]) + len(self.rest)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a key is surely foreign. A foreign key may get a slot: compare the fingerprint."""
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            if not len(open_):
                break
            bit = self._bit(h1[open_], h2[open_], k, len(level)).astype(np.int64)
            hit = level[bit]
            out[open_[hit]] = self.bases[k] + self.ranks[k][bit[hit]]
            open_ = open_[~hit]
        if len(self.rest):
            for i in open_:
                where = np.flatnonzero(self.rest == h1[i])
                if len(where):
                    out[i] = self.bases[-1] + where[0]
        return out


_ENTRY = ("shard", "attempt", "first_row", "n_rows", "first_id", "n_ids")


def _save_bucket(h1: np.ndarray, h2: np.ndarray, entries: dict[str, np.ndarray]) -> bytes:
    order = np.lexsort((entries["shard"], h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    starts = np.flatnonzero(new)
    made = PerfectHash.build(h1[starts], h2[starts])
    slot = made.slots(h1[starts], h2[starts])
    by_slot = np.argsort(slot)
    counts = np.diff(np.append(starts, len(h1)))[by_slot]
    rows = order[np.concatenate([np.arange(s, s + n) for s, n in zip(starts[by_slot], counts)]) if len(starts) else np.empty(0, np.int64)]
    out = io.BytesIO()
    np.savez(
        out, sizes=np.array([len(x) for x in made.levels], np.int64), bits=np.packbits(np.concatenate(made.levels)) if made.levels else np.empty(0, np.uint8), rest=made.rest,
        fingerprints=(h2[starts][by_slot] >> np.uint64(32)).astype(np.uint32), ends=np.cumsum(counts), **{c: entries[c][rows] for c in _ENTRY},
    )
    return out.getvalue()


class IndexBucket:
    """A bucket of the index, as read from its file."""

    def __init__(self, raw: bytes):
        with np.load(io.BytesIO(raw)) as got:
            a = {k: got[k] for k in got.files}
        bits = np.unpackbits(a["bits"])[: a["sizes"].sum()].astype(bool)
        self.hash = PerfectHash(np.split(bits, np.cumsum(a["sizes"])[:-1]) if len(a["sizes"]) else [], a["rest"])
        self.fingerprints, self.entries = a["fingerprints"], {c: a[c] for c in _ENTRY}
        self.edges = np.concatenate([[0], a["ends"]])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the keys asked for, row of .entries) for all entries of all keys that are there."""
        slot = self.hash.slots(h1, h2)
        there = np.flatnonzero(slot >= 0)
        there = there[self.fingerprints[slot[there]] == (h2[there] >> np.uint64(32)).astype(np.uint32)]
        n = self.edges[slot[there] + 1] - self.edges[slot[there]]
        rows = np.repeat(self.edges[slot[there]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(there) else np.empty(0, np.int64)
        return np.repeat(there, n), rows.astype(np.int64)


def _key_hashes(id_col: str) -> list:
    key = F.coalesce(F.concat(F.lit("k"), F.col(id_col).cast("string")), F.lit("null"))
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class TokenStore:
    """What write_tokens() made: the folder, the manifest (entries) and the index's file list, both DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str, id_type: T.DataType, width: int, entries: DataFrame, index: DataFrame, n_buckets: int):
        self.spark, self.folder, self.id_col, self.id_type, self.width = spark, folder, id_col, id_type, width
        self.entries, self.index, self.n_buckets = entries, index, n_buckets

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Entries of the documents of ``keys``' id column, from the index files: id, shard, attempt, first_row, n_rows, first_id, n_ids.

        Keys without a document give no row; a key that occurs twice among ``keys`` is looked up once."""
        id_col, folder = self.id_col, self.folder
        schema = T.StructType([T.StructField(id_col, self.id_type)] + [T.StructField(c, T.LongType()) for c in _ENTRY])
        asked = keys.select(id_col).distinct().select(id_col, *_key_hashes(id_col)).withColumn("bucket", F.pmod("h1", F.lit(self.n_buckets)))
        asked = asked.join(self.index, "bucket").repartition(F.col("bucket")).sortWithinPartitions("bucket")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = open_store(folder)
            name, bucket = None, None
            for batch in batches:
                names = np.array(batch.column("file").to_pylist(), dtype=object)
                h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                cut = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist() + [len(names)]
                for a, b in zip(cut[:-1], cut[1:]):
                    if names[a] != name:
                        name = names[a]
                        with store.open_input_stream(f"{root}/{name}") as f:
                            bucket = IndexBucket(f.read())
                    of, rows = bucket.find(h1[a:b], h2[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(of + a)), *(pa.array(bucket.entries[c][rows], pa.int64()) for c in _ENTRY)], names=schema.names)

        return asked.select(id_col, "h1", "h2", "file").mapInArrow(run, schema)

    def read(self, keys: DataFrame, read_bytes: int = 1_000_000) -> DataFrame:
        """Documents by key, from the shard files: id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
        id_col, folder, width = self.id_col, self.folder, self.width
        totals = self.entries.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # a row per shard
        base = totals.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        found = self.lookup(keys).join(base, "shard").repartition(F.col("shard")).sortWithinPartitions("shard", "first_row")
        schema = T.StructType([T.StructField(id_col, self.id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = open_store(folder)
            name, payload, lengths = None, None, None
            for batch in batches:
                c = {k: batch.column(k).to_numpy() for k in ("shard", "attempt", "first_row", "n_rows", "first_id", "n_ids", "base")}
                i, n = 0, len(batch)
                while i < n:
                    this = (int(c["shard"][i]), int(c["attempt"][i]))
                    if this != name:
                        name = this
                        stem = f"{root}/shard-{this[0]:06d}-{this[1] & (1 << 64) - 1:016x}"
                        with store.open_input_stream(f"{stem}.len") as f:
                            lengths = np.frombuffer(f.read(), "<u4").astype(np.int64)
                        if payload is not None:
                            payload.close()
                        payload = store.open_input_file(f"{stem}.ids")
                    j = i + 1  # one read for entries that follow each other
                    while j < n and c["shard"][j] == this[0] and c["attempt"][j] == c["attempt"][i] and c["first_id"][j] == c["first_id"][j - 1] + c["n_ids"][j - 1] and (c["first_id"][j] + c["n_ids"][j] - c["first_id"][i]) * width <= read_bytes:
                        j += 1
                    first = int(c["first_id"][i])
                    raw = payload.read_at(int(c["first_id"][j - 1] + c["n_ids"][j - 1] - first) * width, first * width)
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                    keys_at, starts, sizes, values = [], [], [], []
                    for k in range(i, j):
                        at = int(c["first_id"][k])
                        for size in lengths[c["first_row"][k] : c["first_row"][k] + c["n_rows"][k]].tolist():
                            keys_at.append(k)
                            starts.append(int(c["base"][k]) + at)
                            sizes.append(size)
                            values.append(ids[4 * (at - first) : 4 * (at - first + size)])
                            at += size
                    yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(keys_at, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())], names=schema.names)
                    i = j
            if payload is not None:
                payload.close()

        return found.select(id_col, "shard", "attempt", "first_row", "n_rows", "first_id", "n_ids", "base").mapInArrow(run, schema)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, keys_per_bucket: int = KEYS_PER_BUCKET, block_bytes: int = BLOCK_BYTES) -> TokenStore:
    """Write the ids of all documents in ascending ``id_col`` order, each with ``end_id`` after it, and index them.

    Null text counts as empty; a null key is a key, before all others. Rows that share a key lie side by side, ordered by
    their texts' hash, and are all found under it. An empty table gives no file. Very long texts are encoded whole. Other
    columns are ignored. ``shards``: as many range partitions, else one for each SHARD_BYTES of text, the session's shuffle
    partitions at least.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // SHARD_BYTES))
    ordered = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_h"), F.monotonically_increasing_id().alias("_at"))
    order = [F.col(id_col).asc_nulls_first(), F.col("_h"), F.col("_at")]  # the last two deal out a key that very many rows share
    ordered = ordered.repartitionByRange(n, *order).sortWithinPartitions(*order).select(id_col, text_col)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(c, T.LongType()) for c in _ENTRY])
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    vocab = max(encoder(tokenizer_path).vocab_size, end_id + 1)
    width = 2 if vocab <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        store, root = open_store(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().int >> 65
        stem = f"{root}/shard-{shard:06d}-{attempt:016x}"
        payload = lengths = None
        rows = ids_before = 0
        for whole in batches:
            if payload is None:
                payload, lengths = store.open_output_stream(f"{stem}.ids"), store.open_output_stream(f"{stem}.len")
            for i, j in spans_of_rows(utf8_buffers(whole.column(1))[1], block_bytes):
                ids, counts = enc.encode(*utf8_buffers(whole.column(1).slice(i, j - i)))
                counts = counts + 1
                payload.write(np.insert(ids, np.cumsum(counts - 1), end_id).astype(f"<u{width}"))
                lengths.write(counts.astype("<u4"))
                k = j - i
                at = ids_before + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(i, k), *(pa.array(x, pa.int64()) for x in (np.full(k, shard), np.full(k, attempt), rows + np.arange(k), np.ones(k, np.int64), at, counts))], names=schema.names)
                rows, ids_before = rows + k, ids_before + int(counts.sum())
        if payload is not None:
            payload.close()
            lengths.close()

    entries = materialize(ordered.mapInArrow(run, schema), "token-entries")
    # Rows of one key in one shard lie side by side: one entry.
    merged = entries.groupBy(id_col, "shard", "attempt").agg(F.min("first_row").alias("first_row"), F.sum("n_rows").alias("n_rows"), F.min("first_id").alias("first_id"), F.sum("n_ids").alias("n_ids"))
    n_buckets = max(1, -(-entries.count() // keys_per_bucket))
    keyed = merged.select(*_key_hashes(id_col), *_ENTRY).withColumn("bucket", F.pmod("h1", F.lit(n_buckets)))

    def build(group: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        bucket = group.column("bucket")[0].as_py()
        name = f"index-{bucket:06d}-{uuid.uuid4().hex[:16]}.mph"
        raw = _save_bucket(*(group.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")), {c: group.column(c).to_numpy() for c in _ENTRY})
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(raw)
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "file": pa.array([name]), "n_entries": pa.array([group.num_rows], pa.int64())})

    index = materialize(keyed.groupBy("bucket").applyInArrow(build, "bucket long, file string, n_entries long"), "token-index")
    return TokenStore(spark, folder, id_col, id_type, width, entries, index.select("bucket", "file"), n_buckets)
