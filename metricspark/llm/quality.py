"""Quality classifier: a convolutional network over bytes, trained and run in numpy.

Every byte position of a document meets every filter, which looks at six bytes. A filter's answers are
max-pooled over chunks of 256 bytes that overlap by half and cover the whole document; a small hidden
layer reads each chunk, and its answers, max-pooled and averaged over all chunks, give one probability.
The hidden layer can tell chunks with few different filters active, such as repeated words.

Fitting takes at most `rows` labelled documents (chosen by a hash of the id) of at most `most_bytes`
each; every document is scored whole, whatever its length.

Defined results: null is an empty text; an empty text is one chunk of padding and has a score; rows
are scored one by one, so repeated rows and ids do not matter; labels that are null are not learned
from; with no usable label every score is 0.5; without one of the two classes the scores lean to the
other. Other columns pass through unless they are named score or predicted, which replace them.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 6
FILTERS = 16
HIDDEN = 16
BLOCK = 128  # a chunk is two blocks, and chunks begin at every block
AT_ONCE = 1 << 17  # bytes whose filter answers are held at once

ROWS = 4000
MOST_BYTES = 1 << 16
EPOCHS = 14
BATCH = 32
RATE = 0.01

THRESHOLD = 0.3

Model = dict[str, np.ndarray]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, each from a block's start on and followed by zeros; and their first blocks."""
    blocks = np.array([(len(t) + WIDTH - 1) // BLOCK + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    data = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    for t, b in zip(texts, first):
        data[b * BLOCK : b * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return data, first


def chunk_pairs(first: np.ndarray) -> np.ndarray:
    """For each block the next block of the same text, or itself for the last."""
    after = np.arange(1, first[-1] + 1)
    after[first[1:] - 1] -= 1
    return after


def new_model(seed: int = 1) -> Model:
    r = np.random.default_rng(seed)
    return {
        "filters": r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "hidden": r.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def head(model: Model, chunks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """From pooled filter answers of chunks to one probability per text, with what lies between."""
    hidden = np.maximum(chunks @ model["hidden"] + model["hidden_bias"], 0)
    top = np.maximum.reduceat(hidden, first[:-1], axis=0)
    mean = np.add.reduceat(hidden, first[:-1], axis=0) / np.diff(first)[:, None]
    both = np.concatenate([top, mean], axis=1)
    return _sigmoid(both @ model["out"] + model["out_bias"][0]), both, hidden


def _gradients(model: Model, data: np.ndarray, first: np.ndarray, target: np.ndarray) -> Model:
    n = int(first[-1]) * BLOCK
    answers = np.zeros((n, FILTERS), np.float32)
    for j in range(WIDTH):
        answers += model["filters"][j][data[j : n + j]]
    answers = answers.reshape(-1, BLOCK, FILTERS)
    where = answers.argmax(axis=1)
    best = np.take_along_axis(answers, where[:, None], axis=1)[:, 0]
    where = where + np.arange(len(best))[:, None] * BLOCK
    after = chunk_pairs(first)
    second = best[after] > best
    chunks, where = np.where(second, best[after], best), np.where(second, where[after], where)
    p, both, hidden = head(model, chunks, first)
    d = ((p - target) / len(target)).astype(np.float32)
    sizes = np.diff(first)
    d_both = d[:, None] * model["out"][None]
    text = np.repeat(np.arange(len(sizes)), sizes)
    # the maximum's gradient goes to the first chunk that has it
    d_hidden = d_both[text, HIDDEN:] / sizes[text][:, None]
    is_top = hidden == both[text, :HIDDEN]
    rank = np.cumsum(is_top, axis=0)
    before = np.concatenate([np.zeros((1, HIDDEN), rank.dtype), rank])[first[:-1]]
    d_hidden += np.where(is_top & (rank - before[text] == 1), d_both[text, :HIDDEN], 0)
    d_hidden *= hidden > 0
    d_chunks = d_hidden @ model["hidden"].T
    filters = np.zeros_like(model["filters"])
    columns = np.broadcast_to(np.arange(FILTERS), where.shape).ravel()
    for j in range(WIDTH):
        cell = data[where.ravel() + j].astype(np.int64) * FILTERS + columns
        filters[j] = np.bincount(cell, d_chunks.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {
        "filters": filters,
        "hidden": chunks.T @ d_hidden,
        "hidden_bias": d_hidden.sum(axis=0),
        "out": both.T @ d,
        "out_bias": d.sum(keepdims=True),
    }


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Fit the network; steps are those of Adam with a falling rate."""
    model, random = new_model(seed), np.random.default_rng(seed)
    if not texts:
        return model | {"out": np.zeros_like(model["out"])}
    share = (sum(labels) + 1) / (len(labels) + 2)
    model["out_bias"][0] = np.log(share / (1 - share))
    target = np.array(labels, np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    # small sets take more rounds, so that every fit has a number of steps to learn in
    epochs = max(epochs, min(60, 800 * BATCH // len(texts)))
    steps, step = epochs * -(-len(texts) // BATCH), 0
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            grads = _gradients(model, *layout([texts[i] for i in some]), target[some])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


@functools.lru_cache(maxsize=2)
def _scorer(packed: bytes):
    model = pickle.loads(packed)
    f = model["filters"]
    # answers of neighbouring bytes added beforehand: half as many look-ups
    pairs = [(f[j][:, None] + f[j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def score(texts: list[bytes]) -> np.ndarray:
        data, first = layout(texts)
        blocks = int(first[-1])
        two = data[:-1].astype(np.uint16) << 8 | data[1:]
        best = np.empty((blocks, FILTERS), np.float32)
        step = AT_ONCE // BLOCK
        for b in range(0, blocks, step):
            i, j = b * BLOCK, min(blocks, b + step) * BLOCK
            answers = pairs[0][two[i:j]]
            for k in range(1, len(pairs)):
                answers += pairs[k][two[i + 2 * k : j + 2 * k]]
            best[b : b + step] = answers.reshape(-1, BLOCK, FILTERS).max(axis=1)
        return head(model, np.maximum(best, best[chunk_pairs(first)]), first)[0]

    return score


def _scores(packed: bytes):
    def run(texts: pa.Array) -> pa.Array:
        score, out, group, size = _scorer(packed), [], [], 0
        for t in texts:
            group.append((t.as_py() or b"") if t.is_valid else b"")
            size += len(group[-1])
            if size >= 1 << 21:
                out.append(score(group))
                group, size = [], 0
        if group:
            out.append(score(group))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = ROWS,
    most_bytes: int = MOST_BYTES,
) -> Model:
    """Learn from at most `rows` labelled documents, which is what the driver holds."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__label")
        .limit(rows)
    )
    text = F.col(text_col).cast("string").cast("binary")
    found = (
        docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
        .where(F.octet_length("__text") <= most_bytes)
        .join(F.broadcast(chosen), "__id")
        .orderBy(F.xxhash64("__id"), "__label", F.md5("__text"))
        .limit(rows)
        .collect()
    )
    return train([bytes(r["__text"]) for r in found], [int(r["__label"]) for r in found])


def score_column(model: Model, text: Column) -> Column:
    """The probability that a text is of good quality."""
    packed = pickle.dumps(model)
    return F.arrow_udf(_scores(packed), "double").asNondeterministic()(text.cast("string").cast("binary"))


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score and predicted, which is 1 from `threshold` on."""
    scored = docs.drop("score", "predicted").withColumn("score", score_column(model, F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
