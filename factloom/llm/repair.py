"""Re-Pair: a grammar for a sequence of ids, whose rules and expansion lengths allow decoding from any place.

A pair of neighbouring symbols that occurs often is replaced by a new symbol, a nonterminal, again and again, until no
pair occurs `least` times. Pairs that can't overlap are replaced in one round: in a round a symbol is either a left
or a right half, the most frequent pair decides which. A round counts exactly the pairs that hold a slot of a hash
table; a pair that lost its slot to another is counted in a later round, under another hash.

Layout of a block, little-endian: the four bytes RPG1, then five unsigned 32-bit integers: the first nonterminal, the
number of rules, of symbols in the sequence, and of ids (low and high half); then as unsigned 32-bit integers the left
halves of the rules, their right halves, the number of ids that each expands to, and the sequence. Rule k makes symbol
first + k and holds only symbols made before it.

Defined cases: an empty sequence has no rules and no symbols; ids from `first` on and blocks that don't begin with the
four bytes are errors; places beyond the ends are cut off.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import numpy as np

MAGIC, HEADER = b"RPG1", struct.Struct("<4s5I")
#: A rule costs three integers and saves one each time it is used; rarer pairs aren't worth a round.
LEAST = 16


@dataclass
class Grammar:
    first: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """The number of ids that each symbol expands to."""
        import numpy as np

        made = symbols >= self.first
        out = np.ones(len(symbols), np.int64)
        out[made] = self.lengths[symbols[made] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols: a generation of rules is opened at a time."""
        import numpy as np

        while len(made := np.flatnonzero(symbols >= self.first)):
            rules = symbols[made] - self.first
            wide = np.ones(len(symbols), np.int8)
            wide[made] = 2
            symbols = np.repeat(symbols, wide)
            made += np.arange(len(made))
            symbols[made] = self.left[rules]
            made += 1
            symbols[made] = self.right[rules]
        return symbols.astype(np.uint32)

    def decode(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end: only the symbols that hold them are opened."""
        import numpy as np

        ends = np.cumsum(self.sizes(self.sequence))
        total = int(ends[-1]) if len(ends) else 0
        begin, end = max(0, begin), total if end is None else min(end, total)
        if begin >= end:
            return np.zeros(0, np.uint32)
        low, high = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end, "left"))
        skip = begin - (int(ends[low - 1]) if low else 0)
        return self.expand(self.sequence[low : high + 1])[skip : skip + end - begin]


def _round(code: np.ndarray, least: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place's pair (left << 32 | right) the rule or -1 (wait) or -2 (too rare for good), and the rules' pairs."""
    import numpy as np

    bits = max(10, len(code).bit_length())
    slot = ((code * (0x9E3779B97F4A7C15 + 2 * salt - (1 << 64))).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
    holder = np.zeros(1 << bits, np.int64)
    holder[slot] = code
    held = holder[slot] == code
    counts = np.bincount(slot[held], minlength=1 << bits)
    rule = np.where(counts >= least, np.int32(-1), np.int32(-2))
    slots = np.flatnonzero(counts >= least)
    slots = slots[np.lexsort((holder[slots], -counts[slots]))]
    pairs, taken = holder[slots], []
    role: dict[int, int] = {}
    for k, (x, y) in enumerate(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True)):
        if x == y:
            if x not in role:
                role[x] = 3
                taken.append(k)
        elif role.get(x, 1) == 1 and role.get(y, 2) == 2:
            role[x], role[y] = 1, 2
            taken.append(k)
    rule[slots[taken]] = np.arange(len(taken), dtype=np.int32)
    return np.where(held, rule[slot], np.int32(-1)), pairs[taken]


def _alternate(at: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which of the ascending places to keep, so that of a run of one symbol every other place is replaced."""
    import numpy as np

    begins = np.concatenate(([True], (np.diff(at) != 1) | ~(same[1:] & same[:-1])))
    order = np.arange(len(at))
    return ((order - np.maximum.accumulate(np.where(begins, order, 0))) & 1 == 0) | ~same


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> Grammar:
    """The grammar of `ids`, all of which are below `first`.

    A pair that is once too rare stays so, since only pairs of a round's new symbols come up: `live` marks the places
    whose pair is still worth counting.
    """
    import numpy as np

    seq = ids.astype(np.int32)
    if len(seq) and int(seq.max()) >= first:
        raise ValueError("an id is no terminal")
    live = np.ones(len(seq), bool)
    left, right, made, salt = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], first, 0
    while len(places := np.flatnonzero(live[:-1])):
        rule, pairs = _round(seq[places].astype(np.int64) << 32 | seq[places + 1], least, salt)
        salt += 1
        live[places[rule == -2]] = False
        if not len(pairs):
            continue
        at, rule = places[rule >= 0], rule[rule >= 0]
        same = seq[at] == seq[at + 1]
        if same.any():
            kept = _alternate(at, same)
            at, rule = at[kept], rule[kept]
        seq[at] = made + rule
        live[at] = True
        live[at[at > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, live = seq[keep], live[keep]
        left.append(pairs >> 32)
        right.append(pairs & 0xFFFFFFFF)
        made += len(pairs)
    out = Grammar(first, np.concatenate(left).astype(np.int32), np.concatenate(right).astype(np.int32), np.zeros(made - first, np.int32), seq)
    done = 0
    for part in left:  # rules of a round hold symbols of earlier rounds alone
        here = slice(done, done + len(part))
        out.lengths[here] = out.sizes(out.left[here]) + out.sizes(out.right[here])
        done += len(part)
    return out


def dumps(grammar: Grammar) -> bytes:
    """A block; it takes fewer than 2^32 rules and symbols."""
    n = int(grammar.sizes(grammar.sequence).sum())
    head = HEADER.pack(MAGIC, grammar.first, len(grammar.left), len(grammar.sequence), n & 0xFFFFFFFF, n >> 32)
    return head + b"".join(part.astype("<u4").tobytes() for part in (grammar.left, grammar.right, grammar.lengths, grammar.sequence))


def loads(block: bytes) -> Grammar:
    """The grammar of a block."""
    import numpy as np

    magic, first, rules, symbols, low, high = HEADER.unpack_from(block)
    parts = np.frombuffer(block, "<u4", offset=HEADER.size).astype(np.int32)
    if magic != MAGIC or len(parts) != 3 * rules + symbols:
        raise ValueError("not a block of ids")
    out = Grammar(first, parts[:rules], parts[rules : 2 * rules], parts[2 * rules : 3 * rules], parts[3 * rules :])
    if int(out.sizes(out.sequence).sum()) != low | high << 32:
        raise ValueError("a block's ids don't add up")
    return out
