"""Document quality: random Fourier features, ridge regression, isotonic calibration."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import materialize, small_batches

FEATURES = 128
RIDGE = 1e-3
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
MARKS = np.frombuffer(b".,;:!?'\"()-", np.uint8)
BINS = 3000


def document_stats(raw):
    """Statistics of a whole text (bytes) that tell prose from junk; zeros for an empty text."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = raw.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    kinds = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = count[65:91].sum(), count[97:123].sum()
    p = count[count > 0] / n
    inner = sum(1 for w in kinds if w[-1:] in b"!%&$#*|" and len(w)) / max(len(kinds), 1)
    top = max(kinds.values(), default=0)
    k = max(len(kinds), 1)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sizes.mean(), sizes.std(),
        math.log1p(sizes.max()), upper / max(upper + lower, 1), count[48:58].sum() / n,
        count[MARKS].sum() / n, count[SYMBOLS].sum() / n, math.sqrt(count[SYMBOLS].sum() / n),
        count[128:].sum() / n, len(kinds) / m, math.log(k) / math.log(m + 1), again / m,
        math.sqrt(again / m), top / m, math.log1p(m / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), count[33] / n, count[124] / m, inner,
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        count[46] / m, count[44] / m,
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _stats(text: pd.Series) -> pd.Series:
    return pd.Series([document_stats((t or "").encode("utf-8", "surrogatepass")) for t in text])


class KernelModel:
    """Ridge scores over random Fourier features of standardised statistics, calibrated.

    A Gaussian kernel of width ``sqrt(d)`` on the standardised statistics is approximated
    by ``cos(x w + b)`` at random frequencies.
    """

    def __init__(self, mean, scale, seed=5):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.w = rng.standard_normal((d, FEATURES)) / math.sqrt(d)
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def expand(self, stats):
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.w + self.b) * math.sqrt(2 / FEATURES)
        return np.concatenate((z, np.ones((len(z), 1))), 1)

    def raw(self, stats):
        return self.expand(stats) @ self.beta

    def score(self, stats):
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(x, good, total):
    """Rising step levels by pooling adjacent violators: (knots, levels)."""
    pools = []
    for at, g, t in zip(x, good, total):
        pools.append([g, t, at, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, t2, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + t2, pools[-1][2], hi]
    knots, levels = [], []
    for g, t, lo, hi in pools:
        value = (g + 0.5) / (t + 1)
        knots += [lo, hi] if hi > lo else [lo]
        levels += [value, value] if hi > lo else [value]
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def held_out(id_col):
    """Rows kept away from training: crc32 of the id as text, modulo 5, is 0; null ids too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(True))


def fit(stats, labels, id_col="doc_id", label_col="quality"):
    """Fit a :class:`KernelModel` on all labelled rows outside the held-out fold.

    ``stats`` has the id and ``stats``.  Normal equations are summed inside partitions, then
    over partitions; what reaches the driver is one matrix of fixed size and at most
    ``BINS`` calibration bins.  Several labels of one id are averaged, null labels ignored;
    with no usable label every score is 0.5.
    """
    y = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
         .groupBy(F.col(id_col).alias("label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")))
    known = stats.where(~held_out(id_col))
    train = materialize(known.join(y, known[id_col] == y["label_id"]).select("stats", "y"))
    width = len(document_stats(b""))
    moments = train.select(*[f(F.col("stats")[i]).alias(f"{n}{i}")
                             for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(width)]).first()
    if moments["m0"] is None:
        return KernelModel(np.zeros(width), np.ones(width))
    scale = np.array([moments[f"s{i}"] for i in range(width)])
    model = KernelModel(np.array([moments[f"m{i}"] for i in range(width)]),
                        np.where(scale > 1e-9, scale, 1.0))
    size = FEATURES + 1

    def sums(batches):
        total = np.zeros((size, size + 1))
        some = False
        for pdf in batches:
            if len(pdf):
                some = True
                z = model.expand(np.array(pdf["stats"].tolist()))
                total += z.T @ np.concatenate((z, pdf["y"].to_numpy()[:, None]), 1)
        if some:
            yield pd.DataFrame({"total": [total.ravel()]})

    cells = (train.mapInPandas(sums, "total array<double>")
             .select(F.posexplode("total").alias("cell", "x")).groupBy("cell").agg(F.sum("x").alias("x")))
    total = cells.toPandas().sort_values("cell")["x"].to_numpy().reshape(size, size + 1)
    n = total[-1, size - 1]
    penalty = np.eye(size) * RIDGE * n / size
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(total[:, :size] + penalty, total[:, size])

    @F.pandas_udf(DoubleType())
    def raw(s: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.array(s.tolist())))

    at = F.floor(F.least(F.greatest(raw("stats"), F.lit(-1.0)), F.lit(1.999)) * (BINS / 3)).cast("int")
    bins = (train.select(at.alias("bin"), "y").groupBy("bin")
            .agg(F.sum("y").alias("good"), F.count("*").alias("n")).toPandas().sort_values("bin"))
    model.knots, model.levels = isotonic((bins["bin"].to_numpy() + 0.5) * 3 / BINS,
                                         bins["good"].to_numpy(), bins["n"].to_numpy())
    return model


def _scorer(model, of_text):
    if of_text:
        @F.pandas_udf(DoubleType())
        def score(text: pd.Series) -> pd.Series:
            rows = [document_stats((t or "").encode("utf-8", "surrogatepass")) for t in text]
            return pd.Series(model.score(np.array(rows)) if rows else [], dtype=float)
    else:
        @F.pandas_udf(DoubleType())
        def score(stats: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.array(stats.tolist())) if len(stats) else [], dtype=float)
    return score


def score_quality(docs, labels, threshold=0.3, id_col="doc_id", text_col="text"):
    """Quality of every document: id, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Null texts count as empty; empty texts are scored like any other; repeated rows stay;
    other columns are never inputs; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    stats = materialize(docs.select(F.col(id_col), _stats(F.col(text_col)).alias("stats")))
    model = fit(stats, labels, id_col)
    return stats.select(id_col, held_out(id_col).alias("held_out"),
                        _scorer(model, False)("stats").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs, labels, threshold=0.3, id_col="doc_id", text_col="text"):
    """Documents scored ``threshold`` or more, all columns as they were; one pass after fitting."""
    small_batches(docs.sparkSession)
    ids = labels.select(F.col(id_col)).distinct()
    some = docs.select(F.col(id_col), _stats(F.col(text_col)).alias("stats"))
    model = fit(some.join(ids, id_col, "left_semi"), labels, id_col)
    score = _scorer(model, True)
    return docs.where(score(F.col(text_col)) >= threshold)
