"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the presence of hashed words and word beginnings (compounds and inflected forms share
theirs).  Besides the likelihood and an L2 term the loss has, for every labelled text that names a group, the squared change of its logit when the
group's name is swapped for another of the same kind.  So weight that a name has only by the company
it keeps costs loss, and a neutral mention does not raise a score.

Fitting: a bounded sample of labelled rows outside the held-out fold (``SAMPLE`` rows, those with the least
id hashes) brings its hashed features to the driver; words that tell the classes apart in that
sample are kept.  Scoring: every whole text, on the executors, with the weights broadcast (a table of
at most ``KEPT`` words).

Defined cases: null or empty text gets the score of the bias alone, and ``without_toxic`` keeps it if that is below 0.5; an empty table stays empty; a null id is not held out and
finds no label; labels other than 0 and 1 are ignored, an id with several labels takes the highest;
without labels of both kinds the score is the share of toxic labels; repeated rows score alike, and of several texts with one id the fit
takes the one with the least hash; other columns, whatever their names, are kept and stay out of the score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lanewise.llm.common import IS_PUNCTUATION, LOWER_BYTE, Hashes, mix, released, spans_of, text_buffers, unused, word_spans

SAMPLE = 6_000
#: Features of one text in the fit at most: those with the least hashes, of the whole text.
TEXT_FEATURES = 20_000
KEPT = 20_000
BEGINNINGS = (4, 5, 6)
CHUNK = 512 << 10
FOLDS = 5

#: Names of groups by kind; a name is swapped for the next one of its kind.
IDENTITY = {
    "religion": "christian muslim jewish hindu buddhist atheist catholic sikh".split(),
    "gender": "woman man girl boy female male transgender nonbinary".split(),
    "genders": "women men girls boys females males".split(),
    "orientation": "gay straight lesbian bisexual heterosexual homosexual queer".split(),
    "ethnicity": "black white asian latino african european arab indigenous hispanic".split(),
    "origin": "american mexican chinese german french spanish indian turkish nigerian".split(),
    "origins": "immigrants refugees foreigners migrants locals natives".split(),
    "ability": "disabled blind deaf autistic able-bodied".replace("able-bodied", "sighted").split(),
    "age": "old young elderly teenage".split(),
}


@np.errstate(over="ignore")
def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of each row and of their first bytes, and the row of each."""
    starts, ends, row = word_spans(raw, off, IS_PUNCTUATION)
    hashes = Hashes(raw, LOWER_BYTE)
    feats, rows = [hashes.of(starts, ends)], [row]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= k)
        feats.append(hashes.of(starts[long], starts[long] + k) + np.uint64(k))
        rows.append(row[long])
    return (mix(np.concatenate(feats)) >> np.uint64(32)).astype(np.uint32), np.concatenate(rows)


def features_of(word: str) -> list[int]:
    """Features of one word: itself first, then its beginnings."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return _features(raw, np.array([0, len(raw)]))[0].tolist()


def swaps() -> dict[int, tuple[list[int], list[int]]]:
    """Feature of each group name -> features that leave and features that come when it is swapped."""
    out = {}
    for names in IDENTITY.values():
        for a, b in zip(names, names[1:] + names[:1], strict=True):
            out[features_of(a)[0]] = (features_of(a), features_of(b))
    return out


def fold(doc_id):
    """Remainder that says whether a row is held out (0)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _sample_features(batches):
    import pyarrow as pa

    for batch in batches:
        raw, off = text_buffers(batch.column("text"))
        out = []
        for i, j in spans_of(off, CHUNK):
            feats, row = _features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(j - i + 1))
            feats = feats[order]
            out += [np.unique(feats[a:b])[:TEXT_FEATURES].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.binary())], ["toxic", "features"])


class Model:
    """Sparse weights over hashed words."""

    def __init__(self, bias: float, features: np.ndarray, weights: np.ndarray):
        order = np.argsort(features)
        self.bias, self.features, self.weights = float(bias), features[order], weights[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.features & 0xFFFFF] = True

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        feats, row = _features(raw, off)
        z = np.full(n, self.bias)
        near = np.flatnonzero(self.maybe[feats & np.uint32(0xFFFFF)])
        if len(near):
            feats, row = feats[near], row[near]
            at = np.minimum(np.searchsorted(self.features, feats), len(self.features) - 1)
            hit = self.features[at] == feats
            pairs = np.unique(row[hit] * len(self.features) + at[hit])
            z += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], minlength=n)
        return 0.5 * (1 + np.tanh(z / 2))


def fit(rows: list[np.ndarray], labels: np.ndarray, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 400) -> Model:
    """Fit on feature sets of texts and their 0/1 labels."""
    n, toxic = len(rows), int(labels.sum())
    share = (toxic + 0.5) / (n + 1)
    if not 0 < toxic < n:
        return Model(np.log(share / (1 - share)), np.empty(0, np.uint32), np.empty(0))
    size = np.array([len(r) for r in rows])
    row, feat = np.repeat(np.arange(n), size), np.concatenate(rows)
    names, col = np.unique(feat, return_inverse=True)
    seen = np.bincount(col).astype(float)
    seen_toxic = np.bincount(col, labels[row])
    # chi-squared of presence against the label
    a, b, c, d = seen_toxic, seen - seen_toxic, toxic - seen_toxic, n - toxic - seen + seen_toxic
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    swap = swaps()
    is_name = np.isin(names, np.array([f for pair in swap.values() for side in pair for f in side], np.uint32))
    # of so many candidates the largest chance value is about twice the logarithm of their number
    chosen = np.flatnonzero(((chi2 >= 2 * np.log(len(names) + 1)) & (seen >= 3)) | is_name)
    chosen = chosen[np.argsort(-chi2[chosen], kind="stable")[:KEPT]]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    index = {int(f): i for i, f in enumerate(names[chosen])}
    # swapped copies: the logit changes by the weights that come less those that leave; unseen features weigh 0
    grouped = np.array(list(swap), np.uint32)
    named = [swap[f] for r in rows for f in r[np.isin(r, grouped)].tolist()]
    moves = [(i, index[f], sign) for i, (old, new) in enumerate(named) for sign, side in ((-1.0, old), (1.0, new)) for f in side if f in index]
    pair, moved = np.array([m[0] for m in moves], np.int64), np.array([m[1] for m in moves], np.int64)
    sign = np.array([m[2] for m in moves])

    k = len(chosen)
    w, bias = np.zeros(k), np.log(share / (1 - share))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    weight = np.where(labels == 1, np.sqrt((n - toxic) / toxic), 1.0)
    weight /= weight.sum()
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], minlength=n)
        p = 0.5 * (1 + np.tanh(z / 2))
        g = weight * (p - labels)
        grad = np.bincount(col, g[row], minlength=k) + l2 * w
        if len(moves):
            change = np.bincount(pair, sign * w[moved], minlength=len(named))
            grad += np.bincount(moved, 2 * counterfactual / len(named) * sign * change[pair], minlength=k)
        full = np.concatenate([grad, [g.sum()]])
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(bias, names[chosen], w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **settings) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``sample`` rows of two numbers: bounded by the parameter
    joined = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.max("toxic").cast("int").alias("toxic"))
    got = joined.mapInArrow(released(_sample_features), "toxic int, features binary").toArrow()
    rows = [np.frombuffer(b, np.uint32) for b in got.column("features").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())  # the model does not hang on the order of arrival
    target = got.column("toxic").to_numpy().astype(float)
    return fit([rows[i] for i in order], target[order] if len(order) else target, **settings)


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``, which they must not have, between 0 and 1."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for i, j in spans_of(off, CHUNK):
                out[i:j] = shared.value.scores(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, name])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    model = train(docs, labels, **settings)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    name = unused("toxicity", docs.columns)
    return scored(docs, train(docs, labels, **settings), name).where(F.col(name) < 0.5).drop(name)
