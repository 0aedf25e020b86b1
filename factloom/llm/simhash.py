"""SimHash near-duplicates: fingerprints linked through a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the vector of the bit counts of its SEGMENTS equal segments. The Manhattan
distance of two vectors is at most the Hamming distance of their fingerprints, so fingerprints that differ in at
most d bits lie within d in the embedding. The range join works on the unit grid: within distance d there is a grid
point at most ceil(d/2) from the one vector and floor(d/2) from the other, so every fingerprint registers at the
grid points within ceil(d/2) of its vector, and fingerprints that meet at a point are compared: first by the
Manhattan distance, then exactly by their differing bits.

What grows: distinct fingerprints take 1 + 2 SEGMENTS grid points each (d = 2), so the join's input is linear in the
distinct fingerprints. Copies share a fingerprint and take part once. A fingerprint can have no more than
64 + 64*63/2 others within two bits, which bounds its links whatever the size of a group.

Defined cases: a null or blank text has no words, its fingerprint is zero and links like any other; fewer words than
a shingle make one shingle of all of them; repeated shingles count each time; ties (exactly half of the hashes) give
bit 0; a row without an id is a row like any other, links through it count, and its component is named by the least id
that is there, null if no row of it has one; an empty table gives no rows. Columns beside the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, write_shared
from factloom.llm.components import components

#: Segments of a fingerprint. 16 segments of 4 bits leave about n * 5e-7 chance meetings a fingerprint among n, 32 of 2 bits fewer.
SEGMENTS = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's shingles of `size` words."""
    import numpy as np
    import xxhash

    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(s, seed) for s in shingles], dtype="<u8")
    set_bits, block = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), block):
        set_bits += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """doc (the id), fp (the fingerprint as a signed long) of every row."""
    given = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        made = np.array([fingerprint(t, size, seed) for t in batch.column(1).to_pylist()], "<u8").view("<i8")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc", "fp"])

    return map_arrow(given, each, "doc long, fp long")


def _vector(fp: Column, segments: int) -> list[Column]:
    width = 64 // segments
    return [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(segments)]


def weights(segments: int) -> list[int]:
    """What a step along each axis adds to a grid point's number.

    Where a digit for each count fits 62 bits, points are packed and numbers are exact. Beyond that the number is a
    linear hash with odd weights of 55 bits: it can't overflow, and points that clash only add comparisons.
    """
    bits = (64 // segments + 2).bit_length()
    if bits * segments <= 62:
        return [1 << bits * i for i in range(segments)]
    return [int.from_bytes(hashlib.sha256(f"axis {i}".encode()).digest()[:8], "little") >> 9 | 1 for i in range(segments)]


def _at_points(nodes: DataFrame, segments: int) -> DataFrame:
    """A row for each of `nodes` and each grid point within 1 of its vector; counts are raised by one, so a step never falls below 0."""
    axes = weights(segments)
    home = sum(((x.cast("long") + 1) * F.lit(a) for x, a in zip(_vector(F.col("fp"), segments), axes, strict=True)), F.lit(0).cast("long"))
    steps = F.array(*[F.lit(s).cast("long") for s in (0, *(s * a for a in axes for s in (1, -1)))])
    based = nodes.select("node", "fp", home.alias("home"))
    return based.select("node", "fp", F.explode(F.transform(steps, lambda s: F.col("home") + s)).alias("point"))


def links(nodes: DataFrame, most: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """Pairs a, b (a > b) of `node`s whose fingerprints `fp` differ in 1 to `most` bits (most: 0, 1 or 2); `fp` is distinct."""
    if most > 2:
        raise ValueError("the grid join is laid out for up to two differing bits")
    if not most:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    at = _at_points(nodes, segments)
    # Spark sizes exploded rows as if they were not exploded, so it would send millions of them through the driver: they are shuffled instead
    x, y = at.alias("x").hint("merge"), at.alias("y").hint("merge")
    manhattan = sum((F.abs(p - q) for p, q in zip(_vector(F.col("x.fp"), segments), _vector(F.col("y.fp"), segments), strict=True)), F.lit(0))
    differing = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    met = x.join(y, (F.col("x.point") == F.col("y.point")) & (F.col("x.node") > F.col("y.node")) & (manhattan <= most) & (differing <= most))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, most: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """The id, fingerprint (hexadecimal) and component_id of every row of `df`."""
    docs = write_shared(fingerprints(df, id_col, text, size, seed), "fingerprints")
    # a node is a distinct fingerprint, whether its rows have ids or not; a component is named when it is known
    nodes = write_shared(docs.groupBy("fp").agg(F.min("doc").alias("least")), "nodes")
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), most, segments)).withColumnRenamed("node", "fp")
    placed = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = placed.join(named, "component").select("fp", "component_id")
    return docs.join(labels, "fp").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, most: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """The rows of `df` less all documents of a component but that of the smallest id.

    Rows that repeat the id that stays are the same document and stay; rows without an id stay.
    """
    found = near_duplicates(df, id_col, text, size, seed, most, segments)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, df[id_col] == F.col("_gone"), "left_anti")
