"""Training order on disk: token sequences in a keyed permutation, in shards of fixed stride.

Documents become token ids, an end mark after each, packed into sequences of a fixed length. With M
sequences in all, a keyed Feistel network over the next power of four permutes 0 .. M-1; a value that
falls outside is sent through again (cycle walking) until it is inside. The result is the sequence's
global slot. Shard s holds the slots from s * per_shard on, in order, each in a record of fixed stride:
slot i begins at byte (i % per_shard) * stride of shard i // per_shard, so a reader can resume anywhere.

The default tokens, also those of the registered query, are the UTF-8 bytes (one byte an id; the bytes FF and FE, which
UTF-8 never uses, are end mark and padding): no tokeniser runs then. `bpe` takes a vocabulary file of ranks instead (two
bytes an id), with `keep=True`.

Sequences are numbered task by task, so the order follows from the key and from how the files are split: another
`spark.sql.files.maxPartitionBytes` packs and numbers other sequences. Shards once written don't change.

The documents are read twice, to count and to write, unless `keep` stores the sequences in between.
The second reading must deal the rows as the first did, which stored tables do; a task that finds
another number of sequences than was counted stops the job.

Edge cases: null and empty texts give no tokens; very long texts span many sequences; repeated rows are
packed again; a null doc_id is listed as null; an empty table gives no shard and no row; other columns
are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import stored

LENGTH = 2_048
PER_SHARD = 16_384
ROUNDS = 6
# Fixed value: how the public byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Encoder:
    """Token ids of a text as little-endian bytes of `dtype`."""

    name: str
    encode: Callable[[str], bytes]
    dtype: str
    end: int
    pad: int

    def mark(self, token: int) -> bytes:
        return np.array([token], self.dtype).tobytes()


UTF8 = Encoder("utf-8", lambda text: text.encode("utf-8", "surrogatepass"), "<u1", 0xFF, 0xFE)


@lru_cache(maxsize=1)
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(path: str, end: int = 50_256) -> Encoder:
    """Byte-level BPE with the ranks in `path`, which every executor must be able to open."""
    return Encoder(path, lambda text: np.array(_ranks(path).encode_ordinary(text), "<u2").tobytes(), "<u2", end, end + 1)


def permute(values: np.ndarray, total: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Places of `values` in the keyed permutation of 0 .. total-1."""
    half = np.uint64(max(1, (max(1, total - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{r}")) for r in range(rounds)]

    def scramble(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    out, walking = values.astype(np.uint64), np.ones(len(values), bool)
    while walking.any():
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (scramble(right, k) & mask)
        out[walking] = left << half | right
        walking = out >= total
    return out.astype(np.int64)


def pack(rows: Iterator[tuple[int | None, str | None]], encoder: Encoder, length: int) -> Iterator[tuple[list, int, bytes]]:
    """(doc ids, number of tokens, tokens) of each sequence; only the last one is padded."""
    width = np.dtype(encoder.dtype).itemsize
    size, end, kept, ids = length * width, encoder.mark(encoder.end), b"", []
    for doc, text in rows:
        if not text:
            continue
        kept += encoder.encode(text) + end
        ids.append(doc)
        if len(kept) >= size:
            for at in range(0, len(kept) - size + 1, size):
                yield ids, length, kept[at:at + size]
                ids = [doc]
            kept = kept[len(kept) // size * size:]
            ids = [doc] if kept else []
    if kept:
        yield ids, len(kept) // width, kept + encoder.mark(encoder.pad) * (length - len(kept) // width)


def _sequences(docs: DataFrame, encoder: Encoder, length: int, wanted: str, plan: tuple | None = None) -> DataFrame:
    """Packed sequences: `part` and `row` say where a sequence comes from; with a plan also its slot."""
    columns = {"part": "int", "row": "long", "slot": "long", "doc_ids": "array<long>", "n_tokens": "int",
               "checksum": "long", "tokens": "binary"}
    names = wanted.split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row = TaskContext.get().partitionId(), 0
        rows = ((None if pd.isna(d) else int(d), t) for b in batches for d, t in zip(b["doc_id"], b["text"], strict=True))
        done, sequences = False, pack(rows, encoder, length)
        while not done:
            chunk = [x for _, x in zip(range(512), sequences)]  # noqa: B905 - the shorter one ends
            done = len(chunk) < 512
            if not chunk:
                break
            at = np.arange(row, row + len(chunk))
            row += len(chunk)
            out = {"part": np.full(len(chunk), part, np.int32), "row": at}
            if plan:
                counts, bases, total, key = plan
                if row > counts.get(part, 0):
                    raise RuntimeError("the documents were not dealt as they were counted")
                out["slot"] = permute(at + bases[part], total, key)
            if "tokens" in names:
                out["tokens"] = [x[2] for x in chunk]
            if "checksum" in names:
                out["checksum"] = np.array([xxhash.xxh64_intdigest(x[2], 42) for x in chunk], np.uint64).view(np.int64)
            if "doc_ids" in names:
                out["doc_ids"], out["n_tokens"] = [x[0] for x in chunk], np.array([x[1] for x in chunk], np.int32)
            yield pd.DataFrame({n: out[n] for n in names})
        if plan and row != plan[0].get(part, 0):
            raise RuntimeError("the documents were not dealt as they were counted")

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInPandas(run, ", ".join(f"{n} {columns[n]}" for n in names))


def materialise(docs: DataFrame, path: str, encoder: Encoder = UTF8, length: int = LENGTH,
                per_shard: int = PER_SHARD, key: int = 20_240_601, keep: bool = False) -> DataFrame:
    """Writes the shards below `path` and returns the index: slot, shard, offset, n_tokens, doc_ids, checksum.

    `keep` stores the packed sequences between counting and writing; right for slow encoders.
    """
    spark = docs.sparkSession
    if keep:
        packed = stored(_sequences(docs, encoder, length, "part row doc_ids n_tokens checksum tokens"), "sequences")
    else:
        packed = _sequences(docs, encoder, length, "part row")
    # One row a task of the first reading.
    counts = {r[0]: r[1] for r in packed.groupBy("part").agg(F.count("*")).toLocalIterator()}
    bases, total = {}, 0
    for part in sorted(counts):
        bases[part], total = total, total + counts[part]
    stride = length * np.dtype(encoder.dtype).itemsize + 1
    plan = (counts, bases, total, key)
    if keep:
        @F.pandas_udf("long")
        def place(part: pd.Series, row: pd.Series) -> pd.Series:
            return pd.Series(permute(row.to_numpy() + part.map(bases).to_numpy(), total, key))
        slotted = packed.withColumn("slot", place("part", "row"))
        wide, index = slotted.select("slot", "tokens"), slotted.select("slot", "doc_ids", "n_tokens", "checksum")
    else:
        wide = _sequences(docs, encoder, length, "slot tokens", plan)
        index = _sequences(docs, encoder, length, "slot doc_ids n_tokens checksum", plan)
    shard = F.floor(F.col("slot") / per_shard)
    if total:
        (wide.withColumn("shard", shard).repartitionByRange(-(-total // per_shard), "shard")
         .sortWithinPartitions("shard", "slot")
         .select("shard", F.col("tokens").cast("string").alias("value"))
         # The text writer puts out the bytes as they are, and one line feed after each record.
         .write.partitionBy("shard").option("compression", "none").text(f"{path}/shards"))
    about = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {
        "sequences": total, "length": length, "per_shard": per_shard, "stride": stride, "key": key,
        "encoder": encoder.name, "dtype": encoder.dtype, "end": encoder.end, "pad": encoder.pad}.items()])
    about.coalesce(1).write.json(f"{path}/about")
    return index.select("slot", shard.alias("shard"), ((F.col("slot") % per_shard) * stride).alias("offset"),
                        "n_tokens", "doc_ids", "checksum")


def read_slots(spark: SparkSession, path: str, first: int, count: int) -> Iterator[np.ndarray]:
    """Token ids of `count` slots from `first` on, reading one shard at a time."""
    about = spark.read.json(f"{path}/about").first()
    slot, last = first, min(first + count, about["sequences"])
    while slot < last:
        shard, begin = divmod(slot, about["per_shard"])
        files = spark.read.format("binaryFile").load(f"{path}/shards/shard={shard}")
        blob, stop = files.select("content").first()[0], min(about["per_shard"], begin + last - slot)
        for at in range(begin, stop):
            record = blob[at * about["stride"]:(at + 1) * about["stride"] - 1]
            yield np.frombuffer(record, about["dtype"])
        slot += stop - begin
