"""Quality classifier: a byte-level convolutional network in numpy.

A filter of width WIDTH is a sum of one learned table row for each byte under it, so no input is ever expanded
to one-hot form. Filter outputs are max-pooled over overlapping chunks (CHUNK bytes, half of them shared with
the next) that cover the whole document; the largest and the mean of a document's chunk maxima go through one
hidden layer to a single probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_arrow

WIDTH, FILTERS, HIDDEN = 5, 16, 16
HALF = 256
CHUNK = 2 * HALF
PAD = 256
THRESHOLD = 0.3
#: The fit takes at most so many labelled documents of each class; of a text longer than PASSAGES * PASSAGE characters
#: it takes PASSAGES passages of PASSAGE characters, spread evenly from its begin to its end.
SAMPLE_PER_CLASS, PASSAGES, PASSAGE = 1500, 32, 512
EPOCHS, BATCH, RATE = 10, 32, 0.01
#: Bytes that go through the filters at once when scoring.
SCORE_BYTES = 1 << 16


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    return {
        "table": normal(WIDTH, 257, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32),
        "w1": normal(2 * FILTERS, HIDDEN, scale=0.2), "b1": np.zeros(HIDDEN, np.float32),
        "w2": normal(HIDDEN, scale=0.2), "b2": np.zeros(1, np.float32),
    }


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each with WIDTH - 1 pads behind it; where its halves start, then its pads; halves of each."""
    pad = np.full(WIDTH - 1, PAD, np.intp)
    parts, starts, halves, at = [], [], [], 0
    for t in texts:
        x = np.frombuffer(t, np.uint8).astype(np.intp) if t else np.array([PAD], np.intp)
        parts += [x, pad]
        starts.append(np.append(np.arange(at, at + len(x), HALF), at + len(x)))
        halves.append(len(starts[-1]) - 1)
        at += len(x) + len(pad)
    return np.concatenate(parts), np.concatenate(starts), np.array(halves)


def _convolve(model: dict, symbols: np.ndarray) -> np.ndarray:
    """Filter outputs at every position but the last WIDTH - 1."""
    n = len(symbols) - WIDTH + 1
    out = model["table"][0].take(symbols[:n], axis=0)
    for j in range(1, WIDTH):
        out += model["table"][j].take(symbols[j : j + n], axis=0)
    return out


def _half_maxima(model: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    symbols, starts, halves = _layout(texts)
    out = _convolve(model, symbols)
    pads = np.cumsum(halves + 1) - 1
    inside = starts < len(out)
    pooled = np.maximum.reduceat(out, starts[inside], axis=0)
    keep = np.ones(len(starts), bool)
    keep[pads] = False
    return pooled[keep[inside]], halves


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk its first and second half (the same for a document of one half); chunks of each document."""
    count = np.maximum(halves - 1, 1)
    base = np.repeat(np.cumsum(halves) - halves, count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = base + nth
    second = np.minimum(first + 1, base + np.repeat(halves, count) - 1)
    return first, second, count


def _head(model: dict, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(vectors @ model["w1"] + model["b1"], 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ model["w2"] + model["b2"], -30, 30)))


def _document_vectors(model: dict, pooled: np.ndarray, halves: np.ndarray):
    first, second, count = _chunks(halves)
    act = np.maximum(pooled + model["bias"], 0)
    chunk = np.maximum(act[first], act[second])
    starts = np.cumsum(count) - count
    top = np.maximum.reduceat(chunk, starts, axis=0)
    mean = np.add.reduceat(chunk, starts, axis=0) / count[:, None].astype(np.float32)
    return np.concatenate([top, mean], axis=1), (act, chunk, first, second, count)


def predict(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each whole text; the halves of a long text are pooled piece by piece."""
    pooled, halves, group, size = [], [], [], 0

    def flush():
        nonlocal group, size
        if group:
            p, h = _half_maxima(model, group)
            pooled.append(p)
            halves.extend(h)
        group, size = [], 0

    for t in texts:
        if len(t) > SCORE_BYTES:
            flush()
            parts = []
            for at in range(0, len(t), SCORE_BYTES):
                piece = t[at : at + SCORE_BYTES + WIDTH - 1]
                p, _ = _half_maxima(model, [piece])
                parts.append(p[: -(-min(SCORE_BYTES, len(t) - at) // HALF)])
            pooled += parts
            halves.append(sum(map(len, parts)))
            continue
        group.append(t)
        size += len(t)
        if size >= SCORE_BYTES:
            flush()
    flush()
    if not halves:
        return np.empty(0)
    vectors, _ = _document_vectors(model, np.concatenate(pooled), np.array(halves))
    return _head(model, vectors)[1].astype(np.float64)


def _gradients(model: dict, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    symbols, starts, halves = _layout(texts)
    out = _convolve(model, symbols)
    ends = np.append(starts[1:], len(symbols))
    pads = np.cumsum(halves + 1) - 1
    keep = np.ones(len(starts), bool)
    keep[pads] = False
    begin, end = starts[keep], ends[keep]
    best = np.stack([b + np.argmax(out[b:e], axis=0) for b, e in zip(begin, end, strict=True)])
    pooled = out[best, np.arange(FILTERS)]
    vectors, (act, chunk, first, second, count) = _document_vectors(model, pooled, halves)
    hidden, score = _head(model, vectors)
    d_logit = ((score - labels) * weights / len(texts)).astype(np.float32)
    grad = {"w2": hidden.T @ d_logit, "b2": d_logit.sum(keepdims=True)}
    d_hidden = np.outer(d_logit, model["w2"]) * (hidden > 0)
    grad |= {"w1": vectors.T @ d_hidden, "b1": d_hidden.sum(0)}
    d_vec = d_hidden @ model["w1"].T
    d_top, d_mean = d_vec[:, :FILTERS], d_vec[:, FILTERS:]
    doc = np.repeat(np.arange(len(texts)), count)
    d_chunk = (d_mean / count[:, None].astype(np.float32))[doc]
    is_top = chunk == vectors[:, :FILTERS][doc]
    shares = np.add.reduceat(is_top.astype(np.float32), np.cumsum(count) - count, axis=0)
    d_chunk = d_chunk + is_top * (d_top / shares)[doc]
    d_act = np.zeros_like(act)
    from_first = act[first] >= act[second]
    np.add.at(d_act, first, d_chunk * from_first)
    np.add.at(d_act, second, d_chunk * ~from_first)
    d_act *= act > 0
    grad["bias"] = d_act.sum(0)
    grad["table"] = np.zeros_like(model["table"])
    column = np.broadcast_to(np.arange(FILTERS), best.shape)
    for j in range(WIDTH):
        np.add.at(grad["table"][j], (symbols[best + j], column), d_act)
    return grad


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on weighted log loss. Without documents, or with one class only, the untrained parts give that class's share."""
    model = new_model(seed)
    if len(texts) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.5
        model["w2"][:] = 0
        model["b2"][:] = np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)))
        return model
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(x) for k, x in model.items()}
    rng, step = np.random.default_rng(seed), 0
    batches = -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(batches):
            at = order[b::batches]
            step += 1
            rate = RATE * max(0.05, 1 - step / (epochs * batches))
            for k, g in _gradients(model, [texts[i] for i in at], labels[at], weights[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def passages(text: F.Column) -> F.Column:
    """The text itself, or of a long one its passages, a line each."""
    length = F.char_length(text)
    spread = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substr(text, (F.lit(1) + F.floor(i * (length - PASSAGE) / (PASSAGES - 1))).cast("int"), F.lit(PASSAGE)))
    return F.when(length <= PASSAGES * PASSAGE, text).otherwise(F.array_join(spread, "\n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """Fit on a bounded sample: the SAMPLE_PER_CLASS labelled documents of each class that a hash puts first.

    Rows whose crc32(id) mod 5 is 0 are never read. Each class weighs as it does among all usable labels.
    Null labels and ids are left out; of labels that repeat an id the smallest counts. No document is left out for
    its length: long ones give passages, so the sample's bytes are bounded too.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for k in sorted(share):
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return train([], np.empty(0), np.empty(0))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").withColumn("text", passages(F.col("text")))
    rows = sample.groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id").collect()
    label = np.array([r["label"] for r in rows], np.float32)
    counts = {k: max(1, int((label == k).sum())) for k in share}
    total = sum(share.values())
    weights = np.array([share[int(k)] / total * len(rows) / counts[int(k)] for k in label], np.float32)
    return train([r["text"].encode() for r in rows], label, weights)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """<id_col>, held_out, score, predicted for every row of docs, from its whole text alone (null: empty).

    Ids may repeat or be null (a null id is not held out); other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = batch.column(0)[at : at + 500], batch.column(1)[at : at + 500].to_pylist()
                p = predict(model, [t or b"" for t in texts])
                yield pa.RecordBatch.from_arrays([ids, pa.array(p, pa.float64())], names=["id", "score"])

    scored = map_arrow(docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string").cast("binary")), run, "id bigint, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score gives threshold or more, with all their columns, in one pass without a shuffle."""
    model = fit(docs, labels, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                p = predict(model, [(t or "").encode() for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(p >= threshold))

    return map_arrow(docs, run, docs.schema)
