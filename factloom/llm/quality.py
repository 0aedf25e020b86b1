"""Quality classification by hierarchical empirical Bayes.

Three levels of evidence are combined. (1) A document classifier: logistic regression over counts and ratios of the
whole text, fitted on a bounded sample of labelled documents. (2) Paths of a site and (3) the site itself: grouped
sums over all documents of labels and, at weight SOFT, of the classifier's probabilities where there is no label.
A site's rate is the posterior mean under a beta prior around the global rate, a path's under one around its
site's rate; the strength of either prior is estimated from how much the rates vary beyond chance (method of
moments), so sparse sites shrink to their parents. The document's log likelihood ratio added to the log odds of its
path gives the posterior probability of good quality; below THRESHOLD the document is rejected.

No document is judged by its own label: documents fall into FOLDS folds by a hash of the id, and classifier and sums
for a fold come from the other ones. Where these have nothing to learn from, they say nothing, as below.

A document's site and path are columns: in `documents` the source is the site and the language its first path
segment, as in the URLs of `pages`.

Defined cases: a null text is an empty one; null sites and paths are groups of their own; documents without labels
count by their probability alone; a label of a doc_id that several rows share counts for each of them; several labels
of one doc_id count by their mean; labels without a quality are no labels; with labels of fewer than two kinds the
classifier says nothing (ratio 0) and the sites decide; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, without, write_shared

#: Labelled documents the classifier is fitted on, about.
SAMPLE = 20_000
#: Parts that documents fall into; each is judged by what the others tell.
FOLDS = 5
#: Weight of an unlabelled document's probability in its site's and path's sums.
SOFT = 0.1
#: Least posterior probability of good quality that a document is kept with.
THRESHOLD = 0.5
#: Paths up to which their posteriors are broadcast; beyond, they are joined by a shuffle.
BROADCAST_PATHS = 100_000

_CLASSES = None
_REPEAT = re.compile(rb"([^\s\w])\1{1,}")


def features(text: str | None) -> list[float]:
    """Counts and ratios of a text, each within a few units."""
    import numpy as np

    global _CLASSES
    if _CLASSES is None:
        kind = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 beyond ASCII
        for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\n", 4), (b".,;:'?-", 5), (b"!\"#$%&()*+/<=>@[\\]^_`{|}~", 6), (bytes(range(128, 256)), 7)):
            kind[np.frombuffer(chars, np.uint8)] = k
        _CLASSES = kind
    raw = (text or "").encode()
    n = max(len(raw), 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digit, space, mark, symbol, beyond = np.bincount(_CLASSES, byte, 8)[1:] / n
    words = raw.split()
    count = max(len(words), 1)
    distinct = len(set(words)) / count
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct_lines = len(set(lines)) / max(len(lines), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / count
    doubled = len(_REPEAT.findall(raw)) / count
    size = np.log10(count)
    shout = upper / max(lower + upper + beyond, 0.02)
    expected = min(1.0, 1.6 * count**-0.15)  # how varied a text of this many words usually is
    return [
        size - 2, (size - 2) ** 2, float(count < 20), 10 * upper, shout, float(shout > 0.5), 10 * digit, 10 * space - 1.5, 10 * mark, 10 * symbol,
        float(symbol > 0.02), 10 * byte[ord("|")] / count, 10 * byte[ord("!")] / count, distinct, distinct / expected - 1, float(distinct < 0.3), distinct_lines, float(distinct_lines < 0.7),
        10 * repeats, float(repeats > 0.05), doubled, (n / count - 5) / 5, float(not len(words)),
    ]


def fit(rows: list[list[float]], good: list[float], ridge: float = 1.0):
    """Weights (the intercept last), centre, scale and log odds of the labels; None if only one kind is there."""
    import numpy as np

    y = np.array(good, float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows, float)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    x = np.c_[(x - centre) / scale, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = p * (1 - p) + 1e-6
        move = np.linalg.solve((x * s[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += move
        if abs(move).max() < 1e-6:
            break
    return w, centre, scale, float(np.log(y.mean() / (1 - y.mean())))


def fold_of(name: Column) -> Column:
    """The fold of a document, by a hash of the id; documents without one are in fold 0."""
    return F.coalesce(F.pmod(F.xxhash64(name.cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int"), F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list:
    """For each fold the classifier that judges it: fitted on the other ones' share of about `sample` labelled documents, drawn by a hash of the id."""
    labels = labels.where("id is not null and good is not null").groupBy("id").agg(F.avg("good").alias("good"))
    part = min(1.0, sample / max(labels.count(), 1))
    drawn = labels.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < int(part * (1 << 30)))
    given = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "id")  # at most about `sample` rows

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))], names=["fold", "good", "x"])

    got = map_arrow(given.select(fold_of(F.col("id")).alias("fold"), "good", "text"), each, "fold int, good double, x array<double>").toArrow()
    order = sorted(zip(*(got.column(c).to_pylist() for c in ("fold", "x", "good")), strict=True))  # the same fit whatever the order of rows
    return [fit([x for f, x, _ in order if f != fold], [float(g >= 0.5) for f, _, g in order if f != fold]) for fold in range(FOLDS)]


def score(df: DataFrame, models: list, text: str = "text", out: str = "llr", id_col: str = "doc_id") -> DataFrame:
    """`df` with the document's log likelihood ratio of good to bad quality by its fold's classifier, in the column `out`."""
    df = without(df, out)
    names, given = df.columns, df.withColumn("_fold", fold_of(F.col(id_col)))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        x = np.array([features(t) for t in batch.column(names.index(text)).to_pylist()], float)
        fold, made = np.asarray(batch.column(len(names))), np.zeros(batch.num_rows)
        for f, model in enumerate(models):
            if model is not None and len(x):
                w, centre, scale, odds = model
                made = np.where(fold == f, np.clip(((x - centre) / scale) @ w[:-1] + w[-1] - odds, -30, 30), made)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(given, each, f"{schema}, `{out}` double", text)


def _strengths(groups: DataFrame, rate: Column) -> Column:
    """By fold, the strength of the beta prior around `rate` that explains how the groups' rates vary (method of moments)."""
    size, hits = F.col("n"), F.col("s")
    sums = groups.where("n > 0").groupBy("fold").agg(
        F.count("*").alias("g"), F.sum(size).alias("n"), F.sum(size * rate * (1 - rate)).alias("v"), F.sum(F.pow(hits - size * rate, 2) / size).alias("q"), F.avg(rate * (1 - rate)).alias("w")
    ).collect()
    found = dict.fromkeys(range(FOLDS), 1.0)
    for x in sums:
        if x["v"]:
            # q sums each group's n (rate_g - rate)^2: chance alone gives its share of w, variation between groups the rest
            chance, spread = x["g"] * x["w"], x["n"] * x["w"]
            found[x["fold"]] = 1 / min(max((x["q"] - chance) / max(spread - chance, 1e-9), 1e-4), 0.99) - 1
    return _by_fold(found)


def _by_fold(values: dict[int, float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(values[f])) for f in range(FOLDS)]), F.col("fold") + 1)


def posteriors(scored: DataFrame, labels: DataFrame, models: list, soft: float = SOFT) -> DataFrame:
    """fold, site, path, path_rate, site_rate: for each fold the rates that the other folds give to all paths; `scored` has id, site, path, llr.

    A path or site that the other folds have nothing of has its parent's rate.
    """
    odds = _by_fold({f: 0.0 if m is None else m[3] for f, m in enumerate(models)})
    labels = labels.where("id is not null and good is not null").groupBy("id").agg(F.avg("good").alias("good"))
    joined = scored.withColumn("fold", fold_of(F.col("id"))).join(labels, "id", "left")
    n, s = F.when(F.col("good").isNull(), soft).otherwise(1.0), F.coalesce(F.col("good").cast("double"), soft / (1 + F.exp(-(F.col("llr") + odds))))
    sums = [F.sum(F.when(F.col("fold") != f, x).otherwise(0.0)).alias(f"{name}{f}") for f in range(FOLDS) for name, x in (("n", n), ("s", s))]
    paths = write_shared(joined.groupBy("site", "path").agg(*sums), "paths")
    paths = paths.select("site", "path", F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"n{f}").alias("n"), F.col(f"s{f}").alias("s")) for f in range(FOLDS)])))
    sites = paths.groupBy("fold", "site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = {x["fold"]: x for x in sites.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    mean = _by_fold({f: (total[f]["s"] + 0.5) / (total[f]["n"] + 1) if f in total and total[f]["n"] else 0.5 for f in range(FOLDS)})
    of_site = _strengths(sites, mean)
    rated = sites.select(F.col("fold").alias("of"), F.col("site").alias("at"), ((F.col("s") + of_site * mean) / (F.col("n") + of_site)).alias("site_rate"))
    both = paths.join(rated, (F.col("fold") == F.col("of")) & F.col("site").eqNullSafe(F.col("at"))).select("fold", "site", "path", "n", "s", "site_rate")
    of_path = _strengths(both, F.col("site_rate"))
    return write_shared(both.select("fold", "site", "path", ((F.col("s") + of_path * F.col("site_rate")) / (F.col("n") + of_path)).alias("path_rate"), "site_rate"), "posteriors")


def decide(scored: DataFrame, rates: DataFrame, site: str, path: str, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """`scored` with site_rate, path_rate, posterior and keep."""
    rates = rates.select(F.col("fold").alias("_of"), F.col("site").alias("_site"), F.col("path").alias("_path"), "site_rate", "path_rate")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_PATHS else rates
    met = without(scored, "site_rate", "path_rate", "posterior", "keep").withColumn("_fold", fold_of(F.col(id_col)))
    met = met.join(rates, (F.col("_fold") == F.col("_of")) & F.col(site).eqNullSafe(F.col("_site")) & F.col(path).eqNullSafe(F.col("_path")), "left").drop("_site", "_path", "_of", "_fold")
    logit = F.col("llr") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    met = met.withColumn("posterior", 1 / (1 + F.exp(-logit)))
    return met.withColumn("keep", F.col("posterior") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `docs` with llr, site_rate, path_rate, posterior and keep; `labels` has id and good (0 or 1).

    The texts are read twice, once for the sums and once for the decisions, so that they never move.
    """
    models = learn(docs, labels, id_col, text, sample)
    slim = docs.select(F.col(id_col).alias("id"), F.col(site).alias("site"), F.col(path).alias("path"), F.col(text).alias("text"))
    rates = posteriors(score(slim, models, id_col="id").drop("text"), labels, models)
    return decide(score(docs, models, text, id_col=id_col), rates, site, path, threshold, id_col)
