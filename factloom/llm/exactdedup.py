"""Exact deduplication by an extendible-hash index kept as files in the shared folder.

Texts are equal when they are identical after lower-casing A-Z only. Every text gets a 64-bit key. Key space is
cut into as many ranges as there are owners; one owner task processes one range. It inserts its entries in key
order into an extendible-hash index: a directory of 2^depth slots points at buckets of BUCKET keys at most; an
overfull bucket splits, and the directory doubles when the bucket already used all of its bits. Entries of one key
are chained and told apart by comparing their bytes. A bucket that lies wholly below the key just inserted can't
change any more, so it leaves memory at once: an owner holds a few buckets, not its range. The finished buckets
are a Parquet table in the shared folder, which the documents then look themselves up in by a join.

Copies are counted before anything moves: a task sends one entry per distinct text that it remembers, so a text
that makes up a third of all rows sends about one row a task. Look-ups of such a text meet one index row, and
Spark splits their skewed join partition.

Defined cases: a null text is an empty one, and all empty texts are one group. Of a group the largest doc_id stays;
rows that repeat this doc_id are the same document and all carry kept = true; a null doc_id stays only where all of
its group are null. An empty table gives no rows. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, slices, write_shared

#: Keys in a bucket before it splits.
BUCKET = 256
#: Bytes of texts that a task remembers in order to send copies once.
REMEMBERED = 32 << 20


class Bucket:
    """Keys with one prefix of `depth` bits; every key has a chain of entries."""

    __slots__ = ("chains", "depth", "prefix")

    def __init__(self, prefix: int, depth: int):
        self.prefix, self.depth, self.chains = prefix, depth, {}


class ExtendibleIndex:
    """An extendible-hash index over keys of `bits` bits that come in ascending order.

    `insert` adds an entry [body, digest, keep, size] or merges it with the chained entry of equal bytes, and
    yields the buckets that no later key can reach.
    """

    def __init__(self, capacity: int = BUCKET, bits: int = 64):
        self.capacity, self.bits, self.depth = capacity, bits, 0
        self.directory: list[Bucket | None] = [Bucket(0, 0)]
        self.low = 0  # slots below are final

    def _slot(self, key: int) -> int:
        return key >> (self.bits - self.depth) if self.depth else 0

    def _split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:  # double the directory: every slot becomes two
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth, self.low = self.depth + 1, self.low * 2
        halves = [Bucket(bucket.prefix << 1 | bit, bucket.depth + 1) for bit in (0, 1)]
        for key, chain in bucket.chains.items():
            halves[key >> (self.bits - bucket.depth - 1) & 1].chains[key] = chain
        width = 1 << (self.depth - bucket.depth - 1)
        at = bucket.prefix << (self.depth - bucket.depth)
        for n, half in enumerate(halves):
            self.directory[at + n * width : at + (n + 1) * width] = [half] * width

    def insert(self, key: int, entry: list) -> Iterator[Bucket]:
        yield from self._final(self._slot(key))
        while True:
            bucket = self.directory[self._slot(key)]
            chain = bucket.chains.get(key)
            if chain is None and len(bucket.chains) >= self.capacity and bucket.depth < self.bits:
                self._split(bucket)
                continue
            break
        for known in chain or ():
            if known[0] == entry[0]:  # bytes, not digests, decide
                known[2] = max(known[2], entry[2]) if None not in (known[2], entry[2]) else known[2] if entry[2] is None else entry[2]
                known[3] += entry[3]
                break
        else:
            bucket.chains.setdefault(key, []).append(entry)
        yield from self._final(self._slot(key))

    def _final(self, slot: int) -> Iterator[Bucket]:
        while self.low < slot:
            bucket = self.directory[self.low]
            end = (bucket.prefix + 1) << (self.depth - bucket.depth)
            if end > slot:
                return
            self.directory[self.low : end] = [None] * (end - self.low)
            self.low = end
            yield bucket

    def rest(self) -> Iterator[Bucket]:
        yield from self._final(len(self.directory))


def _normal(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z alone


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _entries(owners: int, id_col: int, text_col: int):
    """Map side: an entry for each distinct text that a task remembers, with its greatest id and count."""
    import xxhash
    import zstandard

    schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("keep", pa.int64()), ("size", pa.int64())])

    def rows(entries: list[tuple]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        cols = [[(k * owners) >> 64 for k, *_ in entries], [_signed(k) for k, *_ in entries], [hashlib.sha256(b).digest() for _, b, *_ in entries], [pack(b) for _, b, *_ in entries], [i for _, _, i, _ in entries], [n for *_, n in entries]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, list] = OrderedDict()
        held = 0
        for batch in batches:
            for part in slices(batch, batch.schema.names[text_col]):
                for doc, text in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist(), strict=True):
                    body = _normal(text)
                    if (old := known.get(body)) is not None:
                        known.move_to_end(body)
                        old[1] += 1
                        if doc is not None and (old[0] is None or doc > old[0]):
                            old[0] = doc
                    else:
                        known[body] = [doc, 1]
                        held += len(body) + 200
                gone = []
                while held > REMEMBERED:
                    body, (doc, n) = known.popitem(last=False)
                    held -= len(body) + 200
                    gone.append((xxhash.xxh64_intdigest(body), body, doc, n))
                if gone:
                    yield rows(gone)
        items = [(xxhash.xxh64_intdigest(b), b, d, n) for b, (d, n) in known.items()]
        for at in range(0, len(items), 1024):
            yield rows(items[at : at + 1024])

    return run


def _own(owners: int, capacity: int):
    """Owner side: the index of the key ranges of this task, a row for each entry."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("keep", pa.int64()), ("size", pa.int64()), ("bucket", pa.int64()), ("depth", pa.int32()), ("link", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        index, owner, out = ExtendibleIndex(capacity), None, []

        def take(buckets: Iterator[Bucket]) -> None:
            for b in buckets:
                for key, chain in b.chains.items():
                    for link, (_, digest, keep, size, whole) in enumerate(chain):
                        out.append((_signed(whole), digest, keep, size, _signed(b.prefix), b.depth, link))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for own, key, digest, body, keep, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != owner:  # the next key range of this task
                    take(index.rest())
                    index, owner = ExtendibleIndex(capacity), own
                whole = key % (1 << 64)
                within = (whole * owners) % (1 << 64)  # where in the owner's range the key lies, as a fraction of 2^64
                take(index.insert(within, [unpack(body), digest, keep, size, whole]))
            if len(out) >= 4096:
                yield flush()
        take(index.rest())
        yield flush()

    return run


def index(df: DataFrame, id_col: str = "doc_id", text: str = "text", owners: int | None = None, capacity: int = BUCKET) -> DataFrame:
    """The index of `df`'s distinct normalised texts: key, digest, keep, size, bucket, depth, link; in the shared folder."""
    spark = df.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    entries = given.mapInArrow(_entries(owners, 0, 1), "owner int, key long, digest binary, body binary, keep long, size long")
    # owners take ranges of ascending keys: `owner` rises with the unsigned key, and so does key ^ min(long)
    dealt = entries.repartitionById(owners, F.col("owner")).sortWithinPartitions("owner", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    built = dealt.mapInArrow(_own(owners, capacity), "key long, digest binary, keep long, size long, bucket long, depth int, link int")
    return write_shared(built, "exact-index")


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", owners: int | None = None, capacity: int = BUCKET) -> DataFrame:
    """One row per row of `df`: the id, keep_id, group_size, kept, text_sha256."""
    found = index(df, id_col, text, owners, capacity)
    given = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        bodies = [_normal(t) for t in batch.column(1).to_pylist()]
        keys = pa.array([_signed(xxhash.xxh64_intdigest(b)) for b in bodies], pa.int64())
        digests = pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), keys, digests], names=["doc", "key", "digest"])

    asked = map_arrow(given, each, "doc long, key long, digest binary")
    return asked.join(found.select("key", "digest", "keep", "size"), ["key", "digest"]).select(
        F.col("doc").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
