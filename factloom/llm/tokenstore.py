"""Token ids of a corpus in files of grammar blocks, ordered by document, readable from any place.

`encode` turns texts into ids by the tokenizers library. `write` puts all ids into one sequence, ascending by document
id: rows are dealt to tasks by ranges of the id, sorted there, and every task packs its stretch into blocks of BLOCK
ids, each compressed by Re-Pair (:mod:`factloom.llm.repair`). Blocks are rows of a Parquet table in the shared folder:
part (the task's number), nth (the block's), first (ids of the part before it), the documents in it with the place
where each ends, and the block in its own binary layout. `read` gives every document with its place in the whole
sequence; `take` opens only the symbols that hold asked ranges. Only part totals, one row a task, meet in one place.

The library encodes distinct words, not texts, where the file's own steps allow that: if its normaliser and its
pattern are SPLITS, no step looks across a blank or a line end, so a text's ids are those of its words in order (tested
against the library on whole texts). Marks at a word's end are words of their own, so that a word is met less often
with other marks. A slice of texts is cut, its distinct words found, and their ids put together again by Arrow; Python
sees each distinct word of a slice once. For other files whole texts are encoded.

Defined cases: a null or empty text has the end id alone; rows without a document id come first; of rows with the same
id those with fewer ids come first, then by a hash of the ids, equal ones in any order; a document of more than
BLOCK ids lies in blocks of its own; an empty table gives an empty store. Columns beside id and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import repair
from factloom.llm.common import map_arrow, write_shared

#: Ids in a block.
BLOCK = 1 << 17
#: A pair has to occur so often in a block to become a rule.
LEAST = 32
#: Words that each of a worker's two generations remembers, and the longest one that it does.
REMEMBERED, LONGEST = 400_000, 64
#: The steps of a file under which words can be encoded one by one.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
SHARDS = "part int, nth int, first long, size long, whole boolean, head int, begin long, docs array<bigint>, ends array<bigint>, block binary"


class Encoder:
    """A worker's tokenizer and the words whose ids it remembers."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        given = json.loads(content)
        self.by_words = all(given.get(k) == v for k, v in SPLITS.items())
        self.added = [t["content"] for t in given.get("added_tokens", ())]
        self.by_words &= all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) and t["content"].split() == [t["content"]] for t in given.get("added_tokens", ()))
        self.first = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width, self.code = ("<u2", "H") if self.first <= 1 << 16 else ("<u4", "I")
        self.words, self.older = Words(self), {}
        self.by_words &= not any(map(LETTERS, self.added))
        self.marks = "".join(c for c in string.punctuation if c not in "".join(self.added))
        self.model, step = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.letters = {c: step.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]} if self.by_words else {}

    def plain(self, text: str) -> bytes:
        """The ids of a whole text, by the library alone."""
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a word: the library's steps one by one, without the offsets that `encode` notes."""
        if any(t in word for t in self.added):
            return self.plain(word)
        t = self.tokenizer
        return self.pack([x.id for piece, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word)) for x in t.model.tokenize(piece)])

    def lower(self, word: str) -> bytes:
        """The ids of a word of lower-case letters that LETTERS takes."""
        pieces = self.model.tokenize(word if word.isascii() else word.translate(self.letters))
        return array(self.code, [x.id for x in pieces]).tobytes()

    def ids(self, text: str | None) -> bytes:
        return self.every(pa.array([text], pa.string()))[0].as_py()

    def every(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, none for a null."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_words:
            return pa.array(map(self.plain, texts.to_pylist()), pa.binary())
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.values.dictionary_encode()
        return pc.binary_join(pa.ListArray.from_arrays(cut.offsets, self.distinct(words.dictionary).take(words.indices)), b"")

    def distinct(self, words: pa.StringArray) -> pa.Array:
        """The ids of each word, of which none is null: those of what precedes its last marks, then those of the marks."""
        import numpy as np

        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, Words(self)
        bare = pc.ascii_rtrim(words, self.marks)
        begins = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
        apart = pc.is_in(pc.utf8_slice_codeunits(bare, -1), pa.array(APART))
        places = np.empty(2 * len(words) + 1, np.int32)
        places[::2] = begins
        places[1::2] = np.where(apart, begins[:-1] + pc.binary_length(bare).to_numpy(), begins[1:])
        halves = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(places), words.buffers()[2]).dictionary_encode()
        ids = pa.array(map(self.words.__getitem__, halves.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        pairs = pa.array(np.arange(0, 2 * len(words) + 1, 2, dtype=np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(pairs, ids.take(halves.indices)), b"")


#: Letters that composition leaves alone and that have one lower-case letter each: a word of them needs no step of
#: SPLITS but lower-casing and its bytes' letters.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Characters after which every step of SPLITS sees a new piece where ASCII marks follow up to the word's end.
APART = [c for c in map(chr, range(0x100)) if LETTERS(c) or c in string.digits]


class Words(dict):
    """The ids of words, worked out when they are first asked for."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.older.get(word)
        if ids is None:
            if LETTERS(word) is None:
                ids = self.encoder.word(word)
            else:
                low = word.lower()
                ids = self.encoder.lower(word) if low == word else self[low]
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    """This worker's encoder for a file: built once and kept between tasks."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int | None = 1) -> DataFrame:
    """Per row the document (doc), the number of its ids (n) and these (ids), `end` last, as packed integers of the
    width that the vocabulary takes. No shuffle."""
    content = _content(path)
    given = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(content)
        last = b"" if end is None else own.pack([end])
        ids = pc.binary_join_element_wise(own.every(batch.column(1)), last, b"")
        n = pc.divide(pc.binary_length(ids), len(own.pack([0]))).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n, ids], names=["doc", "n", "ids"])

    return map_arrow(given, each, "doc long, n long, ids binary")


def _pack(first: int, width: str, block: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of a task's documents, which come in order."""
    schema = pa.schema([("nth", pa.int32()), ("first", pa.int64()), ("size", pa.int64()), ("whole", pa.bool_()), ("head", pa.int32()), ("begin", pa.int64()), ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        nth = before = held = 0
        docs: list[int | None] = []
        ends: list[int] = []
        parts: list[bytes] = []

        def out(ids: bytes, docs: list, ends: list[int], whole: bool, head: int, begin: int) -> pa.RecordBatch:
            nonlocal nth, before
            body = np.frombuffer(ids, width)
            row = [nth, before, len(body), whole, head, begin, docs, ends, repair.dumps(repair.compress(body, first, least))]
            nth, before = nth + 1, before + len(body)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if docs:
                yield out(b"".join(parts), [*docs], [*ends], True, nth, 0)
            held = 0
            for x in (docs, ends, parts):
                x.clear()

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held + n > block:
                    yield from flush()
                if n > block:
                    head, wide = nth, len(ids) // n
                    for at in range(0, n, block):
                        size = min(block, n - at)
                        yield out(ids[at * wide : (at + size) * wide], [doc], [size], False, head, at)
                else:
                    held += n
                    docs.append(doc)
                    ends.append(held)
                    parts.append(ids)
        yield from flush()

    return run


def write(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int | None = 1, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """The store of a corpus, a table in the shared folder with the columns SHARDS. Without an `end` id, texts without
    ids have no place in it."""
    own = encoder(_content(path))
    encoded = write_shared(encode(df, path, id_col, text, end).where("n > 0"), "ids")
    # the last key only tells repeated rows apart, so that they need not meet in one task
    order = [F.col("doc").asc_nulls_first(), F.col("n"), F.xxhash64("ids"), F.monotonically_increasing_id()]
    dealt = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [x.split()[0] for x in SHARDS.split(", ")]
    packed = dealt.mapInArrow(_pack(own.first, own.width, block, least), SHARDS.partition(", ")[2]).withColumn("part", F.spark_partition_id())
    return write_shared(packed.select(*names), "tokens")


def _bases(shards: DataFrame) -> DataFrame:
    """How many ids precede each part: one row a task that wrote, which bounds the window and the broadcast."""
    sums = shards.groupBy("part").agg(F.sum("size").alias("size"))
    return F.broadcast(sums.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base")))


def read(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of a store: its id, `start` (the ids before it), `n_tokens` and `ids`, unsigned 32-bit
    little-endian integers as one binary value."""
    schema = pa.schema([("part", pa.int32()), ("head", pa.int32()), ("begin", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    columns = "part int, head int, begin long, doc long, at long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                body = repair.loads(row["block"]).decode().astype("<u4").tobytes()
                begins = [0, *row["ends"][:-1]]
                n = len(begins)
                cols = [[row["part"]] * n, [row["head"]] * n, [row["begin"]] * n, row["docs"], [row["first"] + b for b in begins], [e - b for b, e in zip(begins, row["ends"], strict=True)], [body[4 * b : 4 * e] for b, e in zip(begins, row["ends"], strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def join(pieces):  # a document's pieces, as a table
        pieces = pieces.sort_by("begin")
        cols = [pieces.column(c)[0].as_py() for c in ("part", "head", "begin", "doc", "at")]
        cols += [sum(pieces.column("n").to_pylist()), b"".join(pieces.column("ids").to_pylist())]
        return pa.table([pa.array([v], f.type) for v, f in zip(cols, schema, strict=True)], schema=schema)

    used = shards.select("part", "head", "begin", "first", "docs", "ends", "block", "whole")
    whole = used.where("whole").drop("whole").mapInArrow(run, columns)
    pieces = used.where("not whole").drop("whole").mapInArrow(run, columns).groupBy("part", "head").applyInArrow(join, columns)
    return whole.unionByName(pieces).join(_bases(shards), "part").select(F.col("doc").alias(id_col), (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids")


def take(shards: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`spans` (id, begin, end; ids counted within the document) with `ids`, an array: the part of the range that exists.

    The blocks' directories find the blocks of a range; of a block only the symbols that hold the range are opened.
    A span of an unknown document, or with a null, has no row; a range without ids an empty array; a repeated document
    id gives a row for each of its rows.
    """
    entries = shards.select("part", "nth", "head", "begin", F.posexplode(F.arrays_zip("docs", "ends")).alias("k", "e"), "ends")
    before = F.when(F.col("k") > 0, F.element_at("ends", F.col("k"))).otherwise(F.lit(0))
    found = entries.select("part", "nth", F.col("begin").alias("skip"), F.col("e.docs").alias("doc"), before.alias("from"), F.col("e.ends").alias("to"), F.struct("part", "head", "k").alias("which"))
    asked = spans.select(F.col(id_col).cast("long").alias("doc"), F.col("begin").cast("long").alias("lo"), F.col("end").cast("long").alias("hi")).where("doc is not null and lo is not null and hi is not null")
    low = F.greatest(F.col("from"), F.col("from") + F.col("lo") - F.col("skip"))
    met = asked.join(found, "doc").select("doc", "lo", "hi", "which", "skip", "part", "nth", low.alias("low"), F.least(F.col("to"), F.col("from") + F.col("hi") - F.col("skip")).alias("high"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [repair.loads(b).decode(lo, hi).tolist() if lo < hi else [] for b, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("block", "low", "high")), strict=True)]
            kept = batch.select(["doc", "lo", "hi", "which", "skip"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bodies, pa.list_(pa.int64()))], names=[*kept.schema.names, "ids"])

    opened = met.join(shards.select("part", "nth", "block"), ["part", "nth"]).select("doc", "lo", "hi", "which", "skip", "low", "high", "block")
    got = opened.mapInArrow(each, "doc long, lo long, hi long, which struct<part: int, head: int, k: int>, skip long, ids array<bigint>")
    whole = got.groupBy("doc", "lo", "hi", "which").agg(F.array_sort(F.collect_list(F.struct("skip", "ids"))).alias("p"))
    return whole.select(F.col("doc").alias(id_col), F.col("lo").alias("begin"), F.col("hi").alias("end"), F.flatten(F.col("p.ids")).alias("ids"))
