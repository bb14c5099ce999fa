"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Lines are described by their own and their neighbours' features. Length-weighted
forward-backward marginals of a document's lines aggregate into its quality, which a one-variable
logistic fit turns into a probability. Training sees document labels only: lines of bad documents
start as bad and are relabelled by the model between rounds, a document's worst line staying bad.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import small_arrow_batches

#: At most so many labelled documents of each class are fitted to, in chains of at most so many
#: lines: longer documents of the sample make several chains.
SAMPLE, CHAIN = 1000, 64
#: Most bytes of a class's texts in a sample: those that fit come first in the sample's order.
SAMPLE_BYTES = 32 << 20
#: Documents of a step, and lines that run together.
STEP, PADDED = 256, 4096
_LETTERS = re.compile(r"[^\W\d_]+")
OWN = 12


def steps(batches: Iterator[pa.RecordBatch], rows: int = STEP) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts as Python strings."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def line_features(line: str) -> list[float]:
    """What one line looks like, without its neighbours. A very long line is seen whole."""
    n = len(line)
    if not line.strip():
        return [0.0] * OWN
    words = line.split()
    letters = sum(map(len, _LETTERS.findall(line)))
    count = len(words)
    low = line.lower()
    repeats = sum(a == b for a, b in zip(words, words[1:])) / max(1, count - 1)
    upper = sum(w.isupper() and len(w) > 1 for w in words) / count
    return [
        1.0,
        min(1.0, count / 40),
        letters / n,
        sum(map(line.count, "#$%&*|!<>{}[]=~^@")) / n * 4,
        line.count("|") / count,
        upper,
        repeats,
        1 - len(set(words)) / count,
        min(1.0, (letters / count) / 12),
        sum(map(low.count, "0123456789")) / n,
        1.0 if line.rstrip()[-1:] in ".!?:;\"'" else 0.0,
        min(1.0, len(zlib.compress(low.encode(), 1)) / max(40, len(low.encode()))),
    ]


WIDTH = 3 * OWN + 2


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, line lengths). Each line also has those of its neighbours, and
    whether it is the first or the last. A null or empty text is one empty line."""
    lines = (text or "").split("\n")
    own = np.array([line_features(x) for x in lines])
    wide = np.zeros((len(lines), WIDTH))
    wide[:, :OWN] = own
    wide[1:, OWN : 2 * OWN] = own[:-1]
    wide[:-1, 2 * OWN : 3 * OWN] = own[1:]
    wide[0, 3 * OWN] = wide[-1, 3 * OWN + 1] = 1
    return wide, np.array([max(1, len(x)) for x in lines], float)


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(emit: np.ndarray, move: np.ndarray, length: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once. emit: (d, t, 2) padded; length: lines each.
    Returns P(bad) of each line, the expected moves weighted by share (if given), and the log
    partition functions."""
    d, t, _ = emit.shape
    alpha, beta = np.zeros((d, t, 2)), np.zeros((d, t, 2))
    alpha[:, 0] = emit[:, 0]
    for k in range(1, t):
        step = alpha[:, k - 1, :, None] + move[None]
        alpha[:, k] = _log_add(step[:, 0], step[:, 1]) + emit[:, k]
    for k in range(t - 2, -1, -1):
        step = move[None] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :]
        inner = _log_add(step[:, :, 0], step[:, :, 1])
        beta[:, k] = np.where((k + 1 < length)[:, None], inner, 0.0)
    last = alpha[np.arange(d), length - 1]
    z = _log_add(last[:, 0], last[:, 1])
    both = alpha + beta - z[:, None, None]
    p = np.exp(np.minimum(0.0, both[:, :, 1]))
    moves = np.zeros((2, 2))
    for k in range(1, t if share is not None else 1):
        on = k < length
        joint = np.exp(alpha[on, k - 1][:, :, None] + move[None] + (emit[on, k] + beta[on, k])[:, None, :] - z[on][:, None, None])
        moves += (joint * share[on, None, None]).sum(0)
    return p, moves, z


def weighted(p: np.ndarray, weight: np.ndarray) -> float:
    """Length-weighted mean of the lines' P(bad): the badness of a document."""
    return float((p * weight).sum() / weight.sum())


def _pad(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for _, x in docs])
    out = np.zeros((len(docs), int(length.max()), WIDTH))
    for i, (x, _) in enumerate(docs):
        out[i, : len(x)] = x
    return out, length


class LineCrf:
    """Weights of the two-state chain, and the calibration of a document's marginals."""

    def __init__(self):
        self.w, self.move, self.fit2 = np.zeros(WIDTH), np.zeros((2, 2)), np.array([0.0, 1.0])

    def emit(self, x: np.ndarray) -> np.ndarray:
        bad = x @ self.w
        return np.stack([np.zeros_like(bad), bad], -1)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray | None = None, rounds: int = 3, steps: int = 120) -> LineCrf:
        whole, whole_labels = docs, labels
        cut = [(a[k : k + CHAIN], b[k : k + CHAIN], y) for (a, b), y in zip(docs, labels) for k in range(0, len(a), CHAIN)]
        docs, labels = [(a, b) for a, b, _ in cut], np.array([y for _, _, y in cut])
        x, length = _pad(docs)
        d, t, _ = x.shape
        mask = np.arange(t)[None] < length[:, None]
        y = np.where(labels[:, None] == 1, 0, 1) * mask
        share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * d
        for _ in range(rounds):
            self._descend(x, y, mask, length, share, steps)
            p, _, _ = marginals(self.emit(x), self.move, length)
            worst = p * mask
            y = ((worst > 0.5) | (worst >= worst.max(1, keepdims=True))) & mask & (labels == 0)[:, None]
            y = y.astype(int)
        scores = np.array([weighted(p, w) for p, (_, w) in zip(self.line_marginals([a for a, _ in whole]), whole)])
        self.fit2 = _logistic(scores, whole_labels, weight)
        return self

    def _descend(self, x, y, mask, length, share, steps) -> None:
        """Adam on the weighted negative log likelihood with a small ridge."""
        n = share @ length
        flat = np.concatenate([self.w, self.move.ravel()])
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        wmask = mask * share[:, None]
        seen = np.zeros((2, 2))
        both = mask[:, 1:] * share[:, None]
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] = (both * (y[:, :-1] == a) * (y[:, 1:] == b)).sum()
        for step in range(1, steps + 1):
            p, pairs, _ = marginals(self.emit(x), self.move, length, share)
            gradient = np.einsum("dt,dtf->f", (p - y) * wmask, x) / n + 1e-4 * self.w
            moves = (pairs - seen) / n + 1e-3 * self.move
            g = np.concatenate([gradient, moves.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            flat = flat - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w, self.move = flat[:WIDTH], flat[WIDTH:].reshape(2, 2)

    def line_marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """P(bad) of each line of each document; documents of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(docs)
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        k = 0
        while k < len(order):
            stop = k + 1
            while stop < len(order) and len(docs[order[stop]]) <= 2 * len(docs[order[k]]) and (stop - k) * len(docs[order[stop]]) < PADDED:
                stop += 1
            x, length = _pad([(docs[i], docs[i][:, 0]) for i in order[k:stop]])
            p, _, _ = marginals(self.emit(x), self.move, length)
            for row, i in enumerate(order[k:stop]):
                out[i] = p[row, : length[row]]
            k = stop
        return out

    def score(self, badness: np.ndarray) -> np.ndarray:
        a, b = self.fit2
        return 1 / (1 + np.exp(-np.clip(a + b * badness, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """Newton's method for P(y=1) = 1 / (1 + exp(-(a + b x))) of weighted rows, with a small ridge."""
    a = np.zeros(2)
    weight = np.ones_like(x) if weight is None else weight
    z = np.stack([np.ones_like(x), x], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-2 * a)
        a = a + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    return a


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, size: int) -> tuple[list, np.ndarray]:
    """Rows (id, text, label), at most size and SAMPLE_BYTES of each class, from labelled training rows
    in the order of a hash of their ids, and a weight of each that restores the classes' shares of
    all training labels. Ids are drawn before texts are read; the ids joined are at most 2 * size.
    Of an id with several texts all may come."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("sample_id"), F.col(label).cast("int").alias("y"))
    drawn = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("sample_id"), "sample_id").limit(size)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("sample_text"))
    met = texts.join(F.broadcast(drawn), "sample_id").filter(F.col("sample_text").isNotNull())
    before = Window.partitionBy("y").orderBy(F.xxhash64("sample_id"), "sample_id", "sample_text").rowsBetween(Window.unboundedPreceding, -1)
    fits = met.withColumn("before", F.coalesce(F.sum(F.octet_length("sample_text")).over(before), F.lit(0))).filter(F.col("before") + F.octet_length("sample_text") <= SAMPLE_BYTES)
    rows = sorted((r["sample_id"], r["sample_text"], r["y"]) for r in fits.select("sample_id", "sample_text", "y").collect())
    share = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    weight = {y: n / max(1, sum(r[2] == y for r in rows)) for y, n in share.items()}
    scale = len(rows) / max(1e-9, sum(weight[r[2]] for r in rows))
    return rows, np.array([weight[r[2]] * scale for r in rows])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> LineCrf | None:
    """A model fitted on the driver to a bounded sample; None if a class has no rows."""
    rows, weight = labelled_sample(docs, labels, label, id_col, text_col, sample)
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return LineCrf().fit([document_features(r[1]) for r in rows], y, weight)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted, n_lines, bad_lines.

    bad_lines are the numbers of lines with P(bad) over one half. Only text enters a score.
    Null and empty texts are one empty line and get its score. Repeated rows and null ids stay;
    a null id is not held out. An empty table gives none. Without labels of both kinds every
    score is 0.5. Very long texts are read whole. Other columns are not read, whatever their names.
    """
    small_arrow_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, label, sample)
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            seen = [document_features(t) for t in batch.column(2).to_pylist()]
            lines = model.line_marginals([x for x, _ in seen]) if model else [np.zeros(len(x)) for x, _ in seen]
            bad, n = [np.flatnonzero(p > 0.5).tolist() for p in lines], [len(p) for p in lines]
            score = model.score(np.array([weighted(p, w) for p, (_, w) in zip(lines, seen)])) if model else np.full(len(seen), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32()), pa.array(n, pa.int64()), pa.array(bad, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "score", "predicted", "n_lines", "bad_lines"],
            )

    return read.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_lines bigint, bad_lines array<int>")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject. Without a usable model
    every row stays."""
    small_arrow_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, label, sample)
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            seen = [document_features(t) for t in batch.column(at).to_pylist()]
            lines = model.line_marginals([x for x, _ in seen])
            scores = np.array([weighted(p, w) for p, (_, w) in zip(lines, seen)])
            yield batch.filter(pa.array(model.score(scores) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
