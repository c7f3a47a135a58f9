"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its characters between < and >, hashed as character n-grams of 3 to 6 and as a whole into BUCKETS rows of an
embedding table; its vector is the mean of them, so a misspelling that training never saw shares most of a known word's
vectors. A window of WINDOW words is the mean of its words, and a linear softmax over that mean gives the window's logit.
A few toxic words make a text toxic however long it is, so a text takes the logit of its highest window; training follows
the same rule: after a start in which each window takes its text's label, each text trains through its highest window.
Embeddings and softmax are trained jointly, by Adam, on at most SAMPLE labelled rows: of either label the SAMPLE / 2 with the
smallest hashes of their ids, and of those, in that order, the ones that fit SAMPLE_BYTES of text. They are gathered in one
task on an executor, which returns the model's numbers alone; no text reaches the driver. The logit is scaled by a line fitted on the training rows, and the decision is score >= THRESHOLD.

Since the softmax is linear, a word's part of the logit is one number: scoring looks up that number for each word.

Defined results: null and empty texts have no words and score the bias alone. Labels that are null or for unknown ids are
not used; repeated labels of one id count once each. Rows that repeat an id are scored one by one; null ids are never held
out. Without labels of both kinds every score is the share of toxic labels, or 0. Other columns are not read.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdelta.llm.common import lean, whole_row
from webdelta.llm.words import mix

#: WINDOW and DECAY have the least log loss over three folds and two seeds inside the training rows (crc32 modulo 3 not 1);
#: held-out rows had no part in the choice.
BUCKETS, DIMS, WINDOW = 1 << 16, 8, 2
#: Labelled rows, and bytes of their texts, that training reads at most.
SAMPLE, SAMPLE_BYTES = 5000, 24 << 20
THRESHOLD = 0.7
GRAMS = (3, 4, 5, 6)
_BASE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KEPT_WORDS = 200_000
#: Texts that must touch a bucket before it is trained; windows in a step of the start; Adam's rate; weight decay.
MIN_TEXTS, BATCH, RATE, DECAY = 6, 8192, 0.05, 3.0


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORDS.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of all words and of the words themselves, word by word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    char = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    word, end = np.repeat(np.arange(len(words)), size), np.repeat(first + size, size)
    at = np.arange(len(char))
    spread = mix(char + _SALT * (at - first[word] + 1).astype(np.uint64))
    hashes, owner = [mix(np.add.reduceat(spread, first))], [np.arange(len(words))]
    for n in GRAMS:
        i = np.flatnonzero(at + n <= end)
        h = np.full(len(i), n, np.uint64)
        for j in range(n):
            h = h * _BASE + char[i + j]
        hashes.append(mix(h))
        owner.append(word[i])
    owner, bucket = np.concatenate(owner), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words)).astype(np.int64)


WORDS = re.compile(r"\w+")


@dataclass
class Model:
    parts: np.ndarray  # the logit's part of each bucket
    bias: float
    scale: float
    shift: float
    constant: float | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's part of the logit."""
        bucket, n = grams_of(words)
        return np.bincount(np.repeat(np.arange(len(words)), n), self.parts[bucket], len(words)) / np.maximum(n, 1)


class Parts:
    """The parts of words seen lately, in a table of bounded size; a batch's new words are hashed together."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        new = set().union(*texts)
        new.difference_update(self.known)
        new = list(new)
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            self.known.update(zip(some, self.model.words(some).tolist()))
        return [np.fromiter(map(self.known.__getitem__, w), np.float64, len(w)) for w in texts]


def fresh(words: np.ndarray) -> np.ndarray:
    """Where a word is not one of the WINDOW - 1 words before it. Others count for nothing, so a word said over and over is no more toxic."""
    order = np.argsort(words, kind="stable")
    out = np.ones(len(words), bool)
    near = (words[order[1:]] == words[order[:-1]]) & (order[1:] - order[:-1] < WINDOW)
    out[order[1:][near]] = False
    return out


def window_means(parts: np.ndarray) -> np.ndarray:
    """Means over the windows of WINDOW words at every start. A short text is filled up with zeros."""
    n, parts = len(parts), parts * fresh(parts)
    if n <= WINDOW:
        return np.array([parts.sum() / WINDOW])
    total = np.concatenate([[0.0], np.cumsum(parts)])
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str | None], labels: np.ndarray, share: float | None = None, rounds: int = 80, start: int = 30, seed: int = 3) -> Model:
    """share: of toxic texts where the sample comes from, if the sample's own differs."""
    labels = np.asarray(labels, np.float64)
    own = float(labels.mean()) if len(labels) else 0.0
    share = own if share is None else share
    if not 0 < own < 1:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0, share)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int64) for t in texts]
    sizes = np.array([len(d) for d in docs])
    flat = np.concatenate(docs) if sizes.sum() else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    new = np.concatenate([fresh(d) for d in docs]) if len(flat) else np.zeros(0, bool)
    g_flat, g_len = grams_of(list(vocab))
    # Buckets that few texts touch could only be learnt by heart: their vectors stay 0.
    touched = np.zeros(BUCKETS, np.int64)
    g_first = np.cumsum(g_len) - g_len
    for d in docs:
        w = np.unique(d)
        if len(w):
            at = np.repeat(g_first[w] - (np.cumsum(g_len[w]) - g_len[w]), g_len[w]) + np.arange(int(g_len[w].sum()))
            touched[np.unique(g_flat[at])] += 1
    known = touched >= MIN_TEXTS
    row = (np.cumsum(known) - 1).astype(np.int32)
    kept = known[g_flat]
    g_word, g_row = np.repeat(np.arange(len(vocab), dtype=np.int32), g_len)[kept], row[g_flat[kept]]
    n_rows = int(known.sum())
    # Windows at every start: start, length and text of each.
    starts, lengths, of_doc = [], [], []
    for d, (n, f) in enumerate(zip(sizes.tolist(), first.tolist())):
        if n:
            at = np.arange(max(1, n - WINDOW + 1), dtype=np.int32)
            starts.append(at + np.int32(f))
            lengths.append(np.full(len(at), min(n, WINDOW), np.int32))
            of_doc.append(np.full(len(at), d, np.int32))
    if not starts or not n_rows:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0, share)
    starts, lengths, of_doc = map(np.concatenate, (starts, lengths, of_doc))
    per_doc = np.bincount(of_doc, minlength=len(texts))
    rng = np.random.default_rng(seed)
    table, soft, bias = rng.normal(0, 0.02, (n_rows, DIMS)), rng.normal(0, 0.3, (2, DIMS)), np.zeros(2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, soft, bias)]
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))

    def logits() -> np.ndarray:
        u = soft[1] - soft[0]
        parts = np.bincount(g_word, (table @ u)[g_row], len(vocab)) / g_len
        total = np.concatenate([[0.0], np.cumsum(parts[flat] * new)])
        return (total[starts + lengths] - total[starts]) / WINDOW + bias[1] - bias[0]

    rows = None
    for step in range(rounds):
        if step < start:
            rows = rng.choice(len(starts), min(len(starts), BATCH), replace=False)
            each = (weight / np.maximum(per_doc, 1))[of_doc[rows]] * (len(starts) / len(rows))
        elif rows is None or step % 4 == 0:
            # The highest window of each text, the last of equal ones.
            z, ends = logits(), np.cumsum(per_doc[per_doc > 0])
            top = np.flatnonzero(z == np.repeat(np.maximum.reduceat(z, np.append(0, ends[:-1])), per_doc[per_doc > 0]))
            rows = top[np.append(np.flatnonzero(np.diff(of_doc[top])), len(top) - 1)]
            each = weight[of_doc[rows]]
        w_len, doc = lengths[rows], of_doc[rows]
        w_first = np.cumsum(w_len) - w_len
        at = np.repeat(starts[rows] - w_first, w_len) + np.arange(int(w_len.sum()))
        use, counts = flat[at], new[at]
        # Only the words in use are embedded.
        words, use = np.unique(use, return_inverse=True)
        place = np.full(len(vocab), -1, np.int32)
        place[words] = np.arange(len(words))
        mine = place[g_word] >= 0
        gw, gr, count = place[g_word[mine]], g_row[mine], g_len[words]
        vec = np.stack([np.bincount(gw, table[gr, k], len(words)) for k in range(DIMS)], 1) / count[:, None]
        mean = np.add.reduceat(vec[use] * counts[:, None], w_first, axis=0) / WINDOW
        z = mean @ soft.T + bias
        p = _sigmoid(z[:, 1] - z[:, 0])
        d = each * (p - labels[doc])
        dz = np.stack([-d, d], 1)
        g_soft, g_bias = dz.T @ mean, dz.sum(0)
        d_rep = np.repeat((dz @ soft) / WINDOW, w_len, axis=0) * counts[:, None]
        d_vec = np.stack([np.bincount(use, d_rep[:, k], len(words)) for k in range(DIMS)], 1) / count[:, None]
        g_table = np.stack([np.bincount(gr, d_vec[gw, k], n_rows) for k in range(DIMS)], 1) + DECAY * table / n_rows
        for x, g, (m, v) in zip((table, soft, bias), (g_table, g_soft, g_bias), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    final = logits()
    parts = np.zeros(BUCKETS)
    parts[known] = table @ (soft[1] - soft[0])
    model = Model(parts, float(bias[1] - bias[0]), 1.0, 0.0)
    top = np.full(len(texts), model.bias)
    top[np.unique(of_doc)] = -np.inf
    np.maximum.at(top, of_doc, final)
    # The line from logit to log odds, weighted to the true share of labels, by Newton steps.
    a, b = 1.0, 0.0
    by = np.where(labels == 1, share / own, (1 - share) / (1 - own))
    for _ in range(50):
        p = _sigmoid(a * top + b)
        r = by * p * (1 - p) + 1e-9
        grad = np.array([(by * (p - labels) * top).sum() + 1e-2 * a, (by * (p - labels)).sum()])
        hess = np.array([[(r * top * top).sum() + 1e-2, (r * top).sum()], [(r * top).sum(), r.sum()]])
        step_ = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step_[0], -1, 1), b - np.clip(step_[1], -2, 2)
    model.scale, model.shift = float(a), float(b)
    return model


def score_texts(model: Model, texts: list[str | None], parts: Parts | None = None) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    parts = parts or Parts(model)
    out = np.empty(len(texts))
    for a in range(0, len(texts), 500):
        for i, p in enumerate(parts.of([words_of(t) for t in texts[a : a + 500]]), a):
            out[i] = window_means(p).max() + model.bias
    return _sigmoid(model.scale * out + model.shift)


def held_out(id_: Column) -> Column:
    """Whether labels of this id are never learnt: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    rows = rows.filter(~held_out(F.col("id"))).dropDuplicates()
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    some = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE // 2) for k in (0, 1)]
    # SAMPLE rows of two numbers at most.
    few = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(few, "id")
    key = [F.xxhash64("id"), F.col("id"), F.col("label"), F.xxhash64("text")]
    sized = texts.select(*[k.alias(f"k{i}") for i, k in enumerate(key)], F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    # A window over SAMPLE rows of numbers.
    keys = ["k0", "k1", "k2", "k3"]
    fits = sized.dropDuplicates(keys).orderBy(*keys).limit(SAMPLE).withColumn("held", F.sum("size").over(Window.orderBy(*keys))).filter(F.col("held") <= SAMPLE_BYTES).select("k1", "k2", "k3")
    texts = texts.withColumn("k", F.xxhash64("text")).join(F.broadcast(fits), (F.col("id") == F.col("k1")) & (F.col("label") == F.col("k2")) & F.col("k").eqNullSafe(F.col("k3")))
    sample = texts.select(F.col("id").cast("string").alias("id"), "label", "text", "k").dropDuplicates(["id", "label", "k"])

    @lean
    def learn(batches):
        held = pd.concat([pd.DataFrame({"id": [], "label": [], "text": [], "k": []}), *batches]).sort_values(["id", "label", "k"])
        m = fit(held["text"].tolist(), held["label"].to_numpy(np.float64), share)
        yield pd.DataFrame({"parts": [np.asarray(m.parts, "<f8").tobytes()], "bias": [m.bias], "scale": [m.scale], "shift": [m.shift], "constant": [m.constant]})

    got = sample.repartition(1).mapInPandas(learn, "parts binary, bias double, scale double, shift double, constant double").first()
    if got is None:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0, share)
    return Model(np.frombuffer(got["parts"], "<f8"), got["bias"], got["scale"], got["shift"], got["constant"])


def score_udf(model: Model, spark):
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts = Parts(sent.value)
        for texts in batches:
            yield pd.Series(score_texts(sent.value, texts.tolist(), parts))

    return score


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    rows = docs.select(docs[id_col], score_udf(model, docs.sparkSession)(docs[text_col].cast("string")).alias("score"))
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows that are not predicted toxic, with docs' columns."""
    rows = docs.select(whole_row(docs).alias("row"), score_udf(model, docs.sparkSession)(docs[text_col].cast("string")).alias("score"))
    return rows.filter(F.col("score") < threshold).select("row.*")
