"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks that overlap by a filter's width and cover the whole document.  Each
filter is laid over every other byte of a chunk and max-pooled; a document is described by the mean and the maximum of
its chunks' pooled outputs, which a small dense layer combines into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

#: Bytes whose windows form a chunk, width of a filter, distance of two windows.
CHUNK, WIDTH, STRIDE = 256, 8, 2
#: Chunks convolved at once.
GROUP = 256


def chunk_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of bytes, valid windows of each row, first row of each text); an empty text is one window of zeros."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = bytes(WIDTH)
    buffer = np.frombuffer(pad.join(texts) + bytes(CHUNK + WIDTH), np.uint8)
    begin = np.cumsum(sizes + WIDTH) - sizes - WIDTH
    rows = np.maximum(1, -(-sizes // CHUNK))
    first = np.cumsum(rows) - rows
    inside = (np.arange(int(rows.sum())) - np.repeat(first, rows)) * CHUNK
    views = np.lib.stride_tricks.sliding_window_view(buffer, CHUNK + WIDTH - 1)
    valid = np.clip(-(-(np.repeat(sizes, rows) - inside) // STRIDE), 1, CHUNK // STRIDE)
    return views[np.repeat(begin, rows) + inside], valid, first


@dataclass
class ByteConvNet:
    """Weights: byte embeddings, filters over them, a hidden layer and an output."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    _moments: dict = field(default_factory=dict, repr=False)

    NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    @staticmethod
    def new(rng: np.random.Generator, dims: int, filters: int, hidden: int) -> ByteConvNet:
        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        return ByteConvNet(
            normal(256, dims, scale=0.5), normal(WIDTH, dims, filters, scale=(WIDTH * dims) ** -0.5), np.zeros(filters, np.float32),
            normal(2 * filters, hidden, scale=(2 * filters) ** -0.5), np.zeros(hidden, np.float32), normal(hidden, scale=hidden ** -0.5),
            np.zeros(1, np.float32),
        )

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each place of a window."""
        return np.einsum("bd,wdf->wbf", self.embed, self.filters).astype(np.float32)

    def pooled(self, tables: np.ndarray, rows: np.ndarray, valid: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter over each chunk, and with `places` at which window."""
        windows = CHUNK // STRIDE
        out, at = np.empty((len(rows), tables.shape[2]), np.float32), []
        for i in range(0, len(rows), GROUP):
            part = rows[i:i + GROUP]
            total = tables[0][part[:, 0:CHUNK:STRIDE]]
            for j in range(1, WIDTH):
                total += tables[j][part[:, j:j + CHUNK:STRIDE]]
            cut = valid[i:i + GROUP] < windows
            if cut.any():
                total[np.flatnonzero(cut)] = np.where(
                    (np.arange(windows) < valid[i:i + GROUP][cut][:, None])[:, :, None], total[cut], np.float32(-np.inf))
            out[i:i + GROUP] = total.max(axis=1)
            if places:
                at.append(total.argmax(axis=1))
        return out, np.concatenate(at) if places else None

    def head(self, mean: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(np.concatenate([mean, most], axis=1) @ self.hidden + self.hidden_bias)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30).astype(np.float64)))

    def score(self, texts: list[bytes], tables: np.ndarray) -> np.ndarray:
        """Probability of each whole text."""
        rows, valid, first = chunk_rows(texts)
        active = np.maximum(self.pooled(tables, rows, valid)[0] + self.bias, 0)
        counts = np.diff(np.append(first, len(rows)))[:, None]
        mean, most = np.add.reduceat(active, first, axis=0) / counts, np.maximum.reduceat(active, first, axis=0)
        # One row at a time: a text's score must not depend on the texts beside it.
        return np.array([self.head(mean[i:i + 1], most[i:i + 1])[1][0] for i in range(len(texts))])

    def step(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, rate: float, number: int) -> float:
        """One step of Adam on the weighted log loss; returns the loss."""
        rows, valid, first = chunk_rows(texts)
        tables = self.tables()
        raw, at = self.pooled(tables, rows, valid, places=True)
        active = np.maximum(raw + self.bias, 0)
        counts = np.diff(np.append(first, len(rows)))
        mean, most = np.add.reduceat(active, first, axis=0) / counts[:, None], np.maximum.reduceat(active, first, axis=0)
        hidden, p = self.head(mean, most)
        loss = -float(np.mean(weights * np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
        d_logit = (weights * (p - labels) / len(texts)).astype(np.float32)
        grads = {"out": hidden.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_hidden = np.outer(d_logit, self.out) * (1 - hidden ** 2)
        both = np.concatenate([mean, most], axis=1)
        grads |= {"hidden": both.T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0)}
        d_both = d_hidden @ self.hidden.T
        n = self.bias.size
        text = np.repeat(np.arange(len(texts)), counts)
        hit = active == most[text]
        share = hit / np.maximum(np.add.reduceat(hit, first, axis=0, dtype=np.float32), 1)[text]
        d_active = (d_both[:, :n] / counts[:, None])[text] + d_both[:, n:][text] * share
        d_raw = np.where(active > 0, d_active, 0).astype(np.float32)
        grads["bias"] = d_raw.sum(axis=0)
        d_tables = np.zeros_like(tables)
        chunk, which = np.nonzero(d_raw)
        begin = at[chunk, which] * STRIDE
        for j in range(WIDTH):
            np.add.at(d_tables[j], (rows[chunk, begin + j], which), d_raw[chunk, which])
        grads["embed"] = np.einsum("wbf,wdf->bd", d_tables, self.filters)
        grads["filters"] = np.einsum("wbf,bd->wdf", d_tables, self.embed)
        for name, grad in grads.items():
            m, v = self._moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
            self._moments[name] = m, v
            move = rate * (m / (1 - 0.9 ** number)) / (np.sqrt(v / (1 - 0.999 ** number)) + 1e-7)
            setattr(self, name, (getattr(self, name) - move).astype(np.float32))
        return loss


def fit(
    texts: list[bytes], labels: np.ndarray, steps: int = 1200, batch: int = 24, dims: int = 8, filters: int = 24, hidden: int = 16,
    rate: float = 0.01, seed: int = 7,
) -> ByteConvNet:
    """Fit by Adam; the rarer class weighs up to three times as much.  The same rows in the same order give the same net."""
    rng = np.random.default_rng(seed)
    net = ByteConvNet.new(rng, dims, filters, hidden)
    if len(texts) == 0:
        return net
    labels = np.asarray(labels, np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    weights = np.where(labels > 0, 1.0, min(3.0, max(1.0, share / (1 - share))))
    order: list[int] = []
    for number in range(1, steps + 1):
        while len(order) < batch:
            order += rng.permutation(len(texts)).tolist()
        chosen, order = order[:batch], order[batch:]
        net.step([texts[i] for i in chosen], labels[chosen], weights[chosen], rate * 0.5 * (1 + np.cos(np.pi * number / steps)) + 1e-4, number)
    net._moments = {}
    return net


def fold(id_col: str) -> Column:
    """Fold 0, 1 or 2 of a row by the CRC-32 of its id as text."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 1,
    max_rows: int = 8000, max_row_bytes: int = 1 << 15, **settings,
) -> ByteConvNet:
    """A net learned from labelled rows outside the fold `held_out`.

    At most `max_rows` ids, the first of `labels` by a hash of the id, are taken, and their texts of at most
    `max_row_bytes` bytes reach the driver; each is used whole.  The ids are the only broadcast.  A repeated id counts
    once, with its largest label and smallest text.  Rows with a null id, text or label teach nothing; without any row
    the net is untrained.
    """
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col) != held_out))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = (
        texts.where(F.octet_length("text") <= max_row_bytes).join(F.broadcast(chosen), "id")
        .groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .toArrow().sort_by("id")
    )
    return fit(rows.column("text").to_pylist(), np.array(rows.column("label").to_pylist(), np.float32), **settings)


def score_quality(docs: DataFrame, net: ByteConvNet, text_col: str = "text") -> DataFrame:
    """`docs` with score (probability of label 1, of the whole text) and predicted (1 from 0.5 on) added.

    They replace columns of those names.  A null text scores as an empty one.  Nothing is shuffled.
    """
    rows = docs.drop("score", "predicted")
    tables = net.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, texts, size = [], [], 0
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py() or b""
                if texts and size + len(text) > 1 << 20:
                    scores.append(net.score(texts, tables))
                    texts, size = [], 0
                texts.append(text)
                size += len(text)
            if texts:
                scores.append(net.score(texts, tables))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([*scores, []]))], [*names, "score"])

    names = [f"c{i}" for i in range(len(rows.columns))]
    given = rows.toDF(*names).withColumn("bytes", F.col(names[rows.columns.index(text_col)]).cast("string").cast("binary"))
    schema = StructType([*given.schema[:-1], *StructType.fromDDL("score double")])
    out = given.mapInArrow(run, schema).toDF(*rows.columns, "score")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
