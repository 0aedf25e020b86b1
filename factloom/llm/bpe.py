"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Every text is split by the tokenizer's pattern. The distinct words of a slice of texts become rows
(word, token position, token id); a recursive query joins neighbouring rows with the merge table and contracts
each word's leftmost pair of minimum rank until no word has a pair left. The ids are those of the tiktoken
library without special tokens. Decoding joins (document, position, id) with the vocabulary and gathers the
bytes by an ordered aggregation.

Defined cases: a null text is an empty one, has no tokens and decodes to no bytes; a word that is a token as a
whole is that token, as in the library; repeated rows give repeated results; an empty table gives no rows; input
columns named like an output column are replaced. Texts and words of any length are taken: a long text is encoded and
decoded in runs of words and of ids, so what DuckDB holds doesn't grow with it. Words over LONG bytes, rare in text, are
contracted outside DuckDB, by the same rule with a heap of pairs over a linked list, in n log n steps: the recursion
takes a round for each pair, which for a word of 1,000 bytes is seconds and for one of 1,000,000 is never.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import map_arrow, without

#: Bytes of a word beyond which pairs are contracted from a heap.
LONG = 128
#: Words that each of a worker's two generations remembers; its memory is bounded by this, whatever the input.
REMEMBERED = 150_000
#: Bytes of text that are encoded and decoded at a time.
SLICE = 1 << 20
#: Distinct words that one recursive query takes, and their bytes.
WORDS, WORD_BYTES = 20_000, 400_000
#: Words of a long text that are encoded at a time, and ids that one query decodes.
RUN_WORDS, RUN_IDS = 100_000, 250_000

#: A row holds its token, the token and position to its right, and the rank of the pair they make. A round takes each
#: word's least pair (rank, then position), drops its right row, and looks up only the two pairs that change.
RECURSIVE = """
WITH RECURSIVE step(word, pos, tok, right_tok, right_pos, rank, done) AS (
  SELECT s.word, s.pos, s.tok, s.right_tok, s.right_pos, m.merged, false
  FROM start s LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + s.right_tok
  UNION ALL
  (WITH least AS (
     SELECT word, min(rank::BIGINT * 1048576 + pos * 1024 + right_pos) AS packed
     FROM step WHERE NOT done AND rank IS NOT NULL GROUP BY word),
   pair AS (
     SELECT l.word, (packed >> 10) & 1023 AS here, packed & 1023 AS gone, (packed >> 20)::INTEGER AS merged,
            s.right_tok AS next_tok, s.right_pos AS next_pos
     FROM step s JOIN least l ON l.word = s.word AND s.pos = (packed & 1023)),
   moved AS (
     SELECT s.word, s.pos, CASE WHEN s.pos = here THEN merged ELSE s.tok END AS tok,
            CASE WHEN s.pos = here THEN next_tok WHEN s.right_pos = here THEN merged ELSE s.right_tok END AS right_tok,
            CASE WHEN s.pos = here THEN next_pos ELSE s.right_pos END AS right_pos,
            s.pos = here OR s.right_pos = here AS changed, s.rank, here IS NULL AS done
     FROM step s LEFT JOIN pair USING (word)
     WHERE NOT s.done AND (here IS NULL OR s.pos <> gone))
   SELECT v.word, v.pos, v.tok, v.right_tok, v.right_pos, CASE WHEN changed THEN m.merged ELSE v.rank END, v.done
   FROM moved v LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN v.tok::BIGINT * 4294967296 + v.right_tok END))
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE done GROUP BY word ORDER BY word"""

#: The bytes of a run of ids in order of document and position; documents are cut from it where their ids end.
DECODE = "SELECT list(bytes ORDER BY pos) AS parts FROM ids JOIN vocabulary USING (tok)"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The tokens and ranks of a rank file: a base64 token and a rank on every line."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}


class Codec:
    """Encoder and decoder of one Python worker; holds DuckDB's tables of merges and tokens."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import numpy as np
        import regex

        self.ranks, self.pattern = read_ranks(content), regex.compile(pattern)
        self.find = self.pattern.findall
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        # No temporary folder: runs are bounded whatever a text's length, so nothing has to leave memory.
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        given = pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())})
        tokens = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks, pa.binary())})
        self.con.register("given", given)
        self.con.register("tokens", tokens)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.rank_of: dict[int, int] = {}
        self.pairs = (np.array(pairs, np.int64), np.array(merged, np.int64))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _rows(self, words: list[bytes]) -> pa.Table:
        import numpy as np

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok, last = self.byte[flat], np.append(word[1:] != word[:-1], True)[: len(flat)]
        to_right = {"right_tok": pa.array(np.append(tok[1:], 0)[: len(flat)], pa.int32(), mask=last), "right_pos": pa.array(np.append(pos[1:], 0)[: len(flat)], pa.int32(), mask=last)}
        return pa.table({"word": word, "pos": pos, "tok": tok, **to_right})

    def _contract(self, words: list[bytes]) -> Iterator[bytes]:
        import numpy as np

        self.con.register("start", self._rows(words))
        ids = self.con.sql(RECURSIVE).to_arrow_table().column("ids").combine_chunks()
        flat, at = np.asarray(ids.values, dtype="<u4"), np.asarray(ids.offsets)
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield flat[begin:end].tobytes()

    def _contract_long(self, word: bytes) -> bytes:
        """The leftmost pair of least rank is taken from a heap; entries that no longer hold are passed over."""
        from array import array
        from heapq import heapify, heappop, heappush

        if not self.rank_of:
            self.rank_of = dict(zip(*(x.tolist() for x in self.pairs), strict=True))
        rank_of, n = self.rank_of.get, len(word)
        tok = array("q", self.byte[list(word)].tolist())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := rank_of(tok[i] << 32 | tok[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            rank, i = top >> 40, top & (1 << 40) - 1
            j = after[i]
            if tok[i] < 0 or j >= n or rank_of(tok[i] << 32 | tok[j]) != rank:
                continue
            tok[i], tok[j] = rank, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := rank_of(rank << 32 | tok[j])) is not None:
                    heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0 and (r := rank_of(tok[h] << 32 | rank)) is not None:
                heappush(heap, r << 40 | h)
        return array("I", (t for t in tok if t >= 0)).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet; words not met for a generation are forgotten."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new, raw = [], []
        for w in words - self.known.keys():
            if (old := self.older.get(w)) is not None:
                self.known[w] = old
                continue
            b = w.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                self.known[w] = whole.to_bytes(4, "little")
            elif len(b) > LONG:
                self.known[w] = self._contract_long(b)
            else:
                new.append(w)
                raw.append(b)
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and end - at < WORDS and (size := size + len(raw[end])) <= WORD_BYTES:
                end += 1
            self.known.update(zip(new[at:end], self._contract(raw[at:end]), strict=True))
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) if t and len(t) <= SLICE else [] for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) for w in split]
        for i, t in enumerate(texts):
            if t and len(t) > SLICE:
                out[i] = b"".join(self._runs(t))
        return out

    def _runs(self, text: str) -> Iterator[bytes]:
        """The ids of a long text, a run of words at a time; the pattern goes on where the run before ended."""
        matches = self.pattern.finditer(text)
        while words := [m.group() for m in islice(matches, RUN_WORDS)]:
            self.learn(set(words))
            yield b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        import numpy as np

        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if not len(flat):
            return [b""] * len(ids)
        data, ends, size = [], [np.zeros(1, np.int64)], 0
        for at in range(0, len(flat), RUN_IDS):
            run = flat[at : at + RUN_IDS]
            self.con.register("ids", pa.table({"pos": np.arange(len(run), dtype=np.int32), "tok": run}))
            joined = self.con.sql(DECODE).to_arrow_table().column("parts").combine_chunks().values
            if len(joined) != len(run):
                raise ValueError("an id isn't in the vocabulary")
            cut = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
            data.append(bytes(memoryview(joined.buffers()[2] or b"")[cut[0] : cut[-1]]))
            ends.append(cut[1:] - cut[0] + size)
            size += len(data[-1])
        whole, ends = memoryview(b"".join(data)), np.concatenate(ends)
        at = ends[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [bytes(whole[begin:end]) for begin, end in zip(at, at[1:], strict=False)]


_codecs: dict[str, Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """This worker's codec for a vocabulary: built once and kept between tasks."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content, pattern)
    return _codecs[key]


def vocabulary(path: str) -> bytes:
    """A rank file's content, read on the driver and sent with the task; its size is the vocabulary's (1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """`df` with `n_tokens`, `ids` (array of int, if `keep_ids`), `ids_sha256` and `decoded_sha256`.

    `decoded_sha256` is that of the bytes the ids decode to, so equality with the text's own digest is an exact
    round trip. One pass without a shuffle.
    """
    content, new = vocabulary(path), ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    df = without(df, *new)
    names = df.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        c = codec(content, pattern)
        ids = c.encode(batch.column(names.index(text)).to_pylist())
        back = c.decode(ids)
        made = [
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
        ]
        if keep_ids:
            offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            made.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4")))
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *new])

    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, each, f"{schema}, {kinds}", text, SLICE)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes that `ids` (array of int; null: none) decode to, as binary column `out`."""
    content = vocabulary(path)
    df = without(df, out)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                given = part.column(names.index(ids)).to_pylist()
                back = codec(content, pattern).decode([np.array(i or [], "<u4").tobytes() for i in given])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` binary")
