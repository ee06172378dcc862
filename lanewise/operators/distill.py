"""From logs to training rows, vectors, students and calibrations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import decision, text

# Fixed values of the vectorizer and the trainer.
MAX_VOCAB, MIN_DF, HOLDOUT = 4096, 2, 0.2
#: Rows that the lexicon's training takes to the driver at most.
LEXICON_SAMPLE = 50_000


def skip_reason(df: DataFrame, need_text: bool = True) -> Column:
    """Why a log row is not exported; null if it is."""
    out = F.when(F.col("schema_version") != schema.SCHEMA_VERSION, "unsupported_schema_version").when(F.col("degraded"), "degraded")
    if need_text:
        out = out.when(F.coalesce("excerpt", F.lit("")) == "", "no_text")
    return out.when(F.col("complexity_confidence").isNull() & ~F.col("gate.fired"), "no_signal")


def row_tags(df: DataFrame) -> Column:
    tags = {
        "gate-fired": F.col("gate.fired"), "gate-blocked": F.col("gate.blocks_backend"), "gate-only": ~F.col("classified"),
        "force-local": F.col("gate.force_local"), "escalated": F.size("escalations") > 0, "cached": F.col("cached"),
    }
    return F.array_compact(F.array(*[F.when(c, name) for name, c in tags.items()]))


def training_rows(records: DataFrame, holdout: float = HOLDOUT, need_text: bool = True) -> DataFrame:
    """One row per request id (the first by time): targets, tags and the split its id hashes to."""
    order = Window.partitionBy("request_id").orderBy(F.col("timestamp").asc_nulls_first(), "excerpt_hash")
    rows = records.where(skip_reason(records, need_text).isNull()).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    bucket = text.split_bucket(F.col("request_id"))
    return rows.select(
        "request_id", "excerpt", "excerpt_hash", "complexity", "sensitivity", "domain", (F.col("pii") >= 0.5).alias("pii"),
        F.when(F.col("classified"), "backend").otherwise("gate").alias("source"), row_tags(rows).alias("tags"),
        F.when(bucket < holdout, "holdout").otherwise("train").alias("split"),
    )


def choice_target(p: Column, ladder: Sequence[str]) -> Column:
    """struct<probabilities, label, usable, confidence> of a distribution over a ladder."""

    def of(q: Column) -> Column:
        uniform = F.forall(q, lambda x: F.abs(x - 1.0 / len(ladder)) <= 1e-6)
        return F.struct(q.alias("probabilities"), decision.argmax(q, ladder).alias("label"), (~uniform).alias("usable"), decision.certainty(q).alias("confidence"))

    return decision.once(decision.renormalized(p), of)


# ------------------------------------------------------------ vectors


def document_frequency(docs: DataFrame, tokens: Column, most: int = MAX_VOCAB, least: int = MIN_DF) -> DataFrame:
    """(token, df, col): tokens in at least ``least`` documents, most frequent first, ties by token."""
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    kept = df.orderBy(F.desc("df"), F.asc("token")).limit(most)
    return kept.withColumn("col", F.row_number().over(Window.orderBy(F.desc("df"), F.asc("token"))) - 1)


def idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    return vocab.withColumn("idf", F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def tfidf(docs: DataFrame, vocab: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """(id, col, value): sublinear counts times idf, rows of length one.  The vocabulary has a bounded size."""
    # tokens outside the vocabulary leave before the shuffle
    known = docs.select(id_col, F.explode(tokens).alias("token")).join(F.broadcast(vocab.select("token", "col", "idf")), "token")
    weighed = known.groupBy(id_col, "col").agg(F.count("*").alias("tf"), F.any_value("idf").alias("idf")).withColumn("w", (1.0 + F.ln("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighed.select(id_col, "col", (F.col("w") / norm).alias("value"))


def standardized(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation (0 counts as 1)."""
    stats = rows.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names])
    scaled = rows.crossJoin(F.broadcast(stats.select(*[F.col(c).alias(f"_{c}") for c in names])))
    out = {c: (F.col(c) - F.col(f"_{c}.m")) / F.when(F.col(f"_{c}.s") == 0, 1.0).otherwise(F.col(f"_{c}.s")) for c in names}
    return scaled.withColumns(out).drop(*[f"_{c}" for c in names])


def lexicon_score(rows: DataFrame, weights: DataFrame, tokens: Column, bias: float, id_col: str = "id") -> DataFrame:
    """(id, score): sigmoid of the bias and the weights of a row's distinct tokens.  The lexicon is bounded."""
    found = rows.select(id_col, F.explode_outer(F.array_distinct(tokens)).alias("token")).join(F.broadcast(weights), "token", "left")
    return found.groupBy(id_col).agg(decision.sigmoid(F.coalesce(F.sum("weight"), F.lit(0.0)) + bias).alias("score"))


# ------------------------------------------------------------ training (bounded samples on the driver)


class Student:
    """Linear or one-hidden-layer model with one softmax per head."""

    def __init__(self, heads: dict[str, Sequence[str]], inputs: int, hidden: int = 0, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.heads, self.hidden = heads, hidden
        width = sum(len(v) for v in heads.values())
        xavier = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        self.params = {"w1": xavier(inputs, hidden), "b1": np.zeros(hidden), "w2": xavier(hidden, width)} if hidden else {"w2": np.zeros((inputs, width))}
        self.params["b2"] = np.zeros(width)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.params["w1"] + self.params["b1"]) if self.hidden else x
        return h, h @ self.params["w2"] + self.params["b2"]

    def slices(self):
        at = 0
        for name, labels in self.heads.items():
            yield name, slice(at, at + len(labels))
            at += len(labels)

    def predict(self, x: np.ndarray) -> dict[str, np.ndarray]:
        z = self.forward(x)[1]
        return {name: _softmax(z[:, s]) for name, s in self.slices()}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_student(
    x: np.ndarray, targets: dict[str, np.ndarray], mask: dict[str, np.ndarray], heads: dict[str, Sequence[str]], hidden: int = 0, epochs: int = 120,
    rate: float = 0.03, l2: float = 1e-4, temperature: float = 2.0, patience: int = 15, validation: float = 0.1, seed: int = 0,
) -> Student:
    """Soft-target distillation: masked KL with the temperature's square, Adam, early stopping, best weights."""
    if not len(x) or not any(m.any() for m in mask.values()):
        raise ValueError("no usable training rows")
    model = Student(heads, x.shape[1], hidden, seed)
    for name, s in model.slices():  # start from the class shares
        prior = np.clip(targets[name][mask[name]].mean(0) if mask[name].any() else np.ones(len(heads[name])) / len(heads[name]), 1e-6, None)
        model.params["b2"][s] = np.log(prior)
    soft = {k: _softmax(np.log(np.clip(t, 1e-9, None)) / temperature) for k, t in targets.items()}
    order = np.random.default_rng(seed).permutation(len(x))
    n_val = int(len(x) * validation)
    val, fit = order[:n_val], order[n_val:]
    m = {k: np.zeros_like(p) for k, p in model.params.items()}
    v = {k: np.zeros_like(p) for k, p in model.params.items()}
    best, best_loss, waited, t = None, np.inf, 0, 0

    def loss_of(rows):
        z, out = model.forward(x[rows])[1], 0.0
        for name, s in model.slices():
            keep = mask[name][rows]
            if keep.any():
                p = _softmax(z[:, s] / temperature)[keep]
                q = soft[name][rows][keep]
                out += temperature**2 * (q * (np.log(np.clip(q, 1e-12, None)) - np.log(np.clip(p, 1e-12, None)))).sum(1).mean()
        return out

    for _ in range(epochs):
        for rows in np.array_split(fit, max(1, len(fit) // 1024)):
            h, z = model.forward(x[rows])
            g = np.zeros_like(z)
            for name, s in model.slices():
                keep = mask[name][rows]
                if keep.any():
                    g[:, s] = temperature * (_softmax(z[:, s] / temperature) - soft[name][rows]) * keep[:, None] / keep.sum()
            grads = {"w2": h.T @ g + l2 * model.params["w2"], "b2": g.sum(0)}
            if hidden:
                back = (g @ model.params["w2"].T) * (1 - h**2)
                grads |= {"w1": x[rows].T @ back + l2 * model.params["w1"], "b1": back.sum(0)}
            t += 1
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                model.params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        now = loss_of(val if len(val) else fit)
        if now < best_loss - 1e-6:
            best, best_loss, waited = {k: p.copy() for k, p in model.params.items()}, now, 0
        elif (waited := waited + 1) >= patience:
            break
    model.params = best or model.params
    return model


def predictions(rows: DataFrame, model: Student, columns: Sequence[str], id_col: str = "request_id") -> DataFrame:
    """(id, <head>_p ...): the student's distributions, scored in Arrow batches."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    heads = list(model.heads)

    def run(batches):
        import pandas as pd

        for frame in batches:
            found = shared.value.predict(frame[list(columns)].to_numpy(float))
            yield pd.DataFrame({id_col: frame[id_col], **{f"{h}_p": list(found[h]) for h in heads}})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, *columns).mapInPandas(run, f"{id_col} {kind}, " + ", ".join(f"{h}_p array<double>" for h in heads))


# ------------------------------------------------------------ calibration


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[list[float], list[float]]:
    """Isotonic fit of values ``y``, that stand for ``n`` rows each: (break, value) of each block, breaks at a block's largest x."""
    n = np.ones(len(x)) if n is None else n
    order = np.argsort(x, kind="stable")
    if len(x) == 0 or len(np.unique(x)) == 1:
        return [], []
    blocks: list[list[float]] = []  # [sum, count, largest x]
    for a, b, w in zip(x[order], y[order], n[order], strict=True):
        blocks.append([float(b * w), float(w), float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, weight, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + weight, top]
    return [b[2] for b in blocks], [b[0] / b[1] for b in blocks]


def fit_isotonic(samples: DataFrame, by: str = "head", x: str = "x", y: str = "y") -> DataFrame:
    """(head, breaks, values): fits on sums per distinct x, which Spark combines first."""
    import pandas as pd

    sums = samples.groupBy(by, x).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").alias("n"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        breaks, values = pool_adjacent(rows[x].to_numpy(), (rows["s"] / rows["n"]).to_numpy(), rows["n"].to_numpy(float))
        return pd.DataFrame({by: [key[0]], "breaks": [breaks], "values": [values]})

    return sums.groupBy(by).applyInPandas(run, f"{by} string, breaks array<double>, values array<double>")


def fit_temperature(samples: DataFrame, p: str, target: str, low: float = 0.05, high: float = 12.0, rounds: int = 5, grid: int = 16) -> float:
    """Temperature of the least mean negative log likelihood: each round is one aggregation over a finer grid."""
    for _ in range(rounds):
        ts = np.geomspace(low, high, grid)
        losses = [F.avg(-decision.total(F.zip_with(F.col(target), decision.with_temperature(F.col(p), float(t)), lambda a, b: a * F.ln(F.greatest(b, F.lit(1e-12)))))).alias(f"t{i}") for i, t in enumerate(ts)]
        row = samples.agg(*losses).first()
        i = int(np.argmin([np.inf if v is None else v for v in row]))
        low, high = float(ts[max(i - 1, 0)]), float(ts[min(i + 1, grid - 1)])
    return float(np.sqrt(low * high))


def train_lexicon(rows: DataFrame, tokens: Column, label: str, vocab: DataFrame, epochs: int = 120, rate: float = 1.0, l2: float = 1e-3, sample: int = LEXICON_SAMPLE) -> tuple[dict[str, float], float]:
    """Presence-feature logistic weights by batch gradient descent on at most ``sample`` rows, those with the least hashes."""
    names = [r["token"] for r in vocab.orderBy("col").collect()]  # at most the vocabulary's bound
    index = {t: i for i, t in enumerate(names)}
    if sample:
        rows = rows.orderBy(F.xxhash64(tokens, label)).limit(sample)
    got = rows.select(F.array_intersect(F.array_distinct(tokens), F.array(*[F.lit(t) for t in names])).alias("t"), F.col(label).cast("double").alias("y")).toArrow()
    ids = [[index[t] for t in ts] for ts in got.column("t").to_pylist()]
    y = np.array(got.column("y").to_pylist())
    row, col = np.repeat(np.arange(len(ids)), [len(i) for i in ids]), np.array([c for i in ids for c in i], np.int64)
    w, b = np.zeros(len(names)), 0.0
    for _ in range(epochs):
        error = 0.5 * (1 + np.tanh((b + np.bincount(row, w[col], minlength=len(y))) / 2)) - y
        w -= rate * (np.bincount(col, error[row], minlength=len(w)) / len(y) + l2 * w)
        b -= rate * error.mean()
    return {t: float(w[i]) for t, i in index.items() if abs(w[i]) > 1e-6}, float(b)
