"""Media columns: payloads as 8-bit audio in content-defined chunks that are stored once.

A text's UTF-8 bytes, padded with 255 to a positive multiple of UNIT, are the samples of a mono 8-bit PCM file: a
header of 44 bytes and the samples. The file is cut where a rolling gear hash of its last bytes has CUT_BITS zero bits,
MIN_CHUNK to MAX_CHUNK bytes apart, so equal passages give equal chunks wherever they stand.

Chunks are named by their SHA-256. A grouped count of the names finds those that occur more than once; chunks of such
names go to a chunk table, once each, all others stay in the row of their document. A document's row holds its ordered
list of chunk names and its own chunks, compressed together. Reading back joins the names with the chunk table, puts
the chunks in order, and checks the file against its digest before features are computed.

Chunk bytes move only for shared names. Which names are shared is told to the writers by a broadcast of 64-bit
prefixes up to BROADCAST_NAMES; beyond, by a join on the document's file digest. A prefix that clashes only puts one
more chunk in the table.

Defined cases: a null text is an empty one (UNIT bytes of 255); equal texts give equal values; repeated rows and rows
without an id give a row each; an empty table gives no rows. Columns beside the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, slices, write_shared

UNIT = 576
#: Samples a second that the header states.
RATE = 8000
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 512, 11, 16384
#: Shared names up to which their prefixes are broadcast (8 bytes each).
BROADCAST_NAMES = 1_000_000
#: Names that a task remembers in order to send a shared chunk once.
REMEMBERED = 50_000
HEADER = 44


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def wav(samples: bytes) -> bytes:
    """A mono 8-bit PCM file."""
    n = len(samples)
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def samples_of(file: bytes) -> bytes:
    """The samples of such a file."""
    riff, size, kind, fmt, _, code, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", file[:HEADER])
    if (riff, kind, fmt, data, code, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or size != 36 + n or len(file) != HEADER + n:
        raise ValueError("not a mono 8-bit PCM file")
    return file[HEADER:]


_gear = None


def cuts(file: bytes) -> list[int]:
    """The ends of a file's chunks.

    The gear hash h = 2 h + G[byte] in 16 bits depends on the last 16 bytes, so it is summed for all positions at
    once by doubling the span; a cut needs the top CUT_BITS bits to be zero. MIN_CHUNK is more than 16, so no chunk's
    end depends on bytes before its begin.
    """
    import numpy as np

    global _gear
    if _gear is None:
        seeds = [hashlib.sha256(bytes([b])).digest() for b in range(256)]
        _gear = np.array([int.from_bytes(s[:2], "little") for s in seeds], np.uint16)
    if len(file) <= MIN_CHUNK:
        return [len(file)]
    h = _gear[np.frombuffer(file, np.uint8)]
    for span in (1, 2, 4, 8):
        wide = h.copy()
        wide[span:] += h[:-span] << np.uint16(span)
        h = wide
    marks = np.flatnonzero(h >> np.uint16(16 - CUT_BITS) == 0) + 1
    out, begin = [], 0
    while len(file) - begin > MIN_CHUNK:
        at = int(np.searchsorted(marks, begin + MIN_CHUNK))
        end = min(int(marks[at]) if at < len(marks) else len(file), begin + MAX_CHUNK, len(file))
        out.append(end)
        begin = end
    if begin < len(file):
        out.append(len(file))
    return out


def chunks(file: bytes) -> list[bytes]:
    begin, out = 0, []
    for end in cuts(file):
        out.append(file[begin:end])
        begin = end
    return out


def features(samples: bytes) -> str:
    """Length, sum, sum of squares, crossings of the middle and a histogram of 16 levels: exact integers."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8)
    wide, above = x.astype(np.int64), x >= 128
    levels = ",".join(map(str, np.bincount(x >> 4, minlength=16).tolist()))
    return f"n={len(x)};sum={int(wide.sum())};squares={int((wide * wide).sum())};crossings={int((above[1:] != above[:-1]).sum())};levels={levels}"


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each chunk name occurs in a slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            seen: dict[bytes, int] = {}
            for t in part.column(1).to_pylist():
                for c in chunks(wav(payload(t))):
                    name = hashlib.sha256(c).digest()
                    seen[name] = seen.get(name, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(seen.values(), pa.int64())], names=["name", "n"])


def _stored(shared: bytes | None):
    """The document rows: names in order, and the chunks that only this document has, compressed together."""
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media", pa.binary()), ("names", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("own", pa.list_(pa.bool_())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        known = frozenset(np.frombuffer(shared, "<i8").tolist()) if shared is not None else None
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                marked = part.column(2).to_pylist() if known is None else [None] * part.num_rows
                for d, t, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), marked, strict=True):
                    file = wav(payload(t))
                    cut = chunks(file)
                    names = [hashlib.sha256(c).digest() for c in cut]
                    among = known if known is not None else frozenset(marks or ())
                    own = [_short(n) not in among for n in names]
                    body = b"".join(c for c, o in zip(cut, own, strict=True) if o)
                    rows.append((d, len((t or "").encode()), len(file), hashlib.sha256(file).digest(), names, [len(c) for c in cut], own, pack(body)))
                cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _shared_chunks(shared: bytes | None):
    """The chunks of shared names, each once for as long as the task remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        known = frozenset(np.frombuffer(shared, "<i8").tolist()) if shared is not None else None
        sent: OrderedDict[bytes, None] = OrderedDict()
        for batch in batches:
            for part in slices(batch, "text"):
                out = {}
                marked = part.column(2).to_pylist() if known is None else [None] * part.num_rows
                for t, marks in zip(part.column(1).to_pylist(), marked, strict=True):
                    among = known if known is not None else frozenset(marks or ())
                    if not among:
                        continue
                    for c in chunks(wav(payload(t))):
                        name = hashlib.sha256(c).digest()
                        if _short(name) in among:
                            if name not in sent:
                                out[name] = pack(c)
                                if len(sent) >= REMEMBERED:
                                    sent.popitem(last=False)
                            sent[name] = None
                            sent.move_to_end(name)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(out.values(), pa.binary())], names=["name", "bytes"])

    return run


def store(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The document rows and the chunk table (name, bytes) of `df`'s media, both in the shared folder."""
    given = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    counts = given.mapInArrow(_counted, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    shared = write_shared(counts.where("n > 1").select("name"), "shared-names")
    prefixes = None
    if shared.count() <= BROADCAST_NAMES:
        import numpy as np

        got = shared.toArrow().column("name").to_pylist()
        prefixes = np.unique(np.array([_short(n) for n in got], np.int64)).tobytes()
    else:
        given = _marked(given, shared)
    documents = "doc long, n_bytes long, media_bytes long, media binary, names array<binary>, sizes array<int>, own array<boolean>, body binary"
    rows = write_shared(given.mapInArrow(_stored(prefixes), documents), "media")
    copies = given.mapInArrow(_shared_chunks(prefixes), "name binary, bytes binary")
    return rows, write_shared(copies.dropDuplicates(["name"]), "chunks")


def _marked(given: DataFrame, shared: DataFrame) -> DataFrame:
    """`given` with the prefixes of its shared names, by joins on the names and on the text's digest."""

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(hashlib.sha256((t or "").encode()).digest(), hashlib.sha256(c).digest()) for t in batch.column(1).to_pylist() for c in chunks(wav(payload(t)))]
        cols = list(zip(*rows, strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["digest", "name"])

    def short(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[_short(n) for n in x] for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["digest", "marks"])

    # equal texts have the same names, so one row a digest is enough
    held = map_arrow(given, named, "digest binary, name binary").distinct().join(shared, "name", "left_semi")
    marks = held.groupBy("digest").agg(F.collect_list("name").alias("names")).mapInArrow(lambda bs: (short(b) for b in bs), "digest binary, marks array<long>")
    keyed = given.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    return keyed.join(marks, "digest", "left").select("doc", "text", "marks")


def _opened(file: bytes, media: bytes) -> tuple:
    if hashlib.sha256(file).digest() != media:
        raise ValueError("a stored file doesn't match its digest")
    x = samples_of(file)
    return len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), features(x)


_OUT = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]
_OUT_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _read_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of rows that hold all of their chunks."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in slices(batch, "body", 1 << 20):
            found = [_opened(unpack(b), m) for b, m in zip(part.column("body").to_pylist(), part.column("media").to_pylist(), strict=True)]
            cols = list(zip(*found, strict=True)) or [[]] * 4
            kept = part.select(["doc", "n_bytes", "media_bytes", "media"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, (_, k) in zip(cols, _OUT, strict=True))], names=[*kept.schema.names, *(n for n, _ in _OUT)])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every chunk of the given files: its place, and its bytes or, if it is shared, its name."""
    import zstandard

    pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in slices(batch, "body", 1 << 20):
            rows = []
            for media, names, sizes, own, body in zip(*(part.column(c).to_pylist() for c in ("media", "names", "sizes", "own", "body")), strict=True):
                body, at = unpack(body), 0
                for n, (name, size, mine) in enumerate(zip(names, sizes, own, strict=True)):
                    rows.append((media, n, None if mine else name, pack(body[at : at + size]) if mine else None))
                    at += size * mine
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["media", "at", "name", "bytes"])


def _read_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of files whose chunks were put together in order."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        found = []
        for media, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = b"".join(unpack(p["bytes"]) for p in sorted(parts, key=lambda p: p["at"]))
            found.append((media, *_opened(file, media)))
        cols = list(zip(*found, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), *(k for _, k in _OUT)), strict=True)], names=["media", *(n for n, _ in _OUT)])


def read_back(rows: DataFrame, table: DataFrame) -> DataFrame:
    """doc, n_bytes, media_bytes, media and the features of every document row, from the stored bytes."""
    whole = rows.where(F.forall("own", lambda o: o)).mapInArrow(_read_own, f"doc long, n_bytes long, media_bytes long, media binary, {_OUT_DDL}")
    mixed = rows.where(~F.forall("own", lambda o: o))
    # a file that several documents have is all shared names, so its rows have no bytes and are read once
    parts = mixed.select("media", "names", "sizes", "own", "body").mapInArrow(_parts, "media binary, at int, name binary, bytes binary")
    asked = parts.where("name is not null").select("media", "at", "name").distinct().join(table, "name").select("media", "at", "bytes")
    joined = asked.unionByName(parts.where("name is null").select("media", "at", "bytes")).groupBy("media").agg(F.collect_list(F.struct("at", "bytes")).alias("parts"))
    read = write_shared(joined.mapInArrow(_read_joined, f"media binary, {_OUT_DDL}"), "read")
    return whole.unionByName(mixed.select("doc", "n_bytes", "media_bytes", "media").join(read, "media"))


def media_columns(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every row."""
    found = read_back(*store(df, id_col, text))
    return found.select(F.col("doc").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
