"""Language identification by rank-order profiles of n-grams.

A profile is the PROFILE most frequent 1- to 3-grams of letters, words padded by a boundary, in order of frequency
(ties by n-gram id). A document's profile is compared to each language's by the out-of-place distance: the sum over
its n-grams of how far their ranks differ, PROFILE where the language's profile lacks the n-gram. The nearest language
wins, ties by name.

Profiles are learned from the texts of at most about SAMPLE documents a language, drawn by a hash of the id; the
documents of the held-out fold and those without a language take no part. Counting the n-grams of the sample is a
grouped sum; what reaches the driver is PROFILE n-grams a language. Prediction is one pass without a shuffle over
whole texts.

Defined cases: a null text or one without letters is `und` with score 0; without anything to learn from all are
`und`; a null id isn't held out and isn't learned from; repeated rows count each; an empty table gives no rows.
N-grams are numbered by a 32-bit hash, the same everywhere. Columns beside id, text and language aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, slices

#: N-grams in a profile.
PROFILE = 400
#: Documents of a language that its profile is learned from, about.
SAMPLE = 4000

_letters = None


def ngrams(text: str | None):
    """Ids and counts of a text's n-grams, by ascending id."""
    import numpy as np

    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(points) + 2, np.uint32)  # a boundary at either end; whatever isn't a letter is one
    c[1:-1] = np.where(_letters[points], points, 0)
    mixed = [c * np.uint32(k) for k in (2654435761, 2246822519, 3266489917)]
    one = c[c != 0] * np.uint32(668265263)
    two = (mixed[0][:-1] + (mixed[1][1:] ^ (mixed[1][1:] >> np.uint32(15))))[(c[:-1] != 0) | (c[1:] != 0)]
    three = (mixed[0][:-2] ^ (mixed[1][1:-1] << np.uint32(7)) ^ (mixed[1][1:-1] >> np.uint32(25))) + mixed[2][2:]
    return np.unique(np.concatenate([one, two, three[c[1:-1] != 0] * np.uint32(374761393)]), return_counts=True)


def profile(ids, counts, size: int = PROFILE):
    """The ids of the `size` most frequent n-grams, most frequent first, ties by id."""
    import numpy as np

    keys = (np.uint64(counts.max() if len(counts) else 0) - counts.astype(np.uint64)) << np.uint64(32) | ids.astype(np.uint64)
    if len(keys) > size:
        keys = np.partition(keys, size - 1)[:size]
    return (np.sort(keys) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Profiles:
    """The languages' profiles as one table of ranks."""

    def __init__(self, by_lang: dict[str, list[int]], size: int):
        import numpy as np

        self.langs, self.size = sorted(by_lang), size
        self.ids = np.unique(np.concatenate([np.array(by_lang[x], np.uint32) for x in self.langs])) if by_lang else np.array([], np.uint32)
        self.ranks = np.full((len(self.ids) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for k, lang in enumerate(self.langs):
            given = np.array(by_lang[lang], np.uint32)
            self.ranks[np.searchsorted(self.ids, given), k] = np.arange(len(given))

    def nearest(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        ids, counts = ngrams(text)
        if not len(ids) or not self.langs:
            return "und", 0.0
        own = profile(ids, counts, self.size)
        at = np.searchsorted(self.ids, own)
        at = np.where((at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == own), at, len(self.ids))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def learn(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """The profiles of the languages of `df`, every row of which may be learned from."""
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({}, size)
    part = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sizes.items()])
    drawn = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for piece in slices(batch, "text"):
                by: dict[str, list] = {}
                for name, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    by.setdefault(name, []).append(ngrams(t))
                for name, found in by.items():
                    ids, back = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids.astype(np.int64)), pa.array(n)], names=["lang", "ngram", "n"])

    counts = drawn.mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    by_lang: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        by_lang.setdefault(r["lang"], []).append(r["ngram"])
    return Profiles(by_lang, size)


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, lang_pred and score (0 to 1) of every row of `df`."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.nearest(t) for t in batch.column(1).to_pylist()]
        langs, scores = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return map_arrow(given, each, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(df: DataFrame, id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
