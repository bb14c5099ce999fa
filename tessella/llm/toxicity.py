"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled training rows, with all their terms: words, their
first letters, which stand for stems, and marks of stems that several different words have. A
term's weight is (1 + log tf) * idf, idf being that of the whole corpus, times its reliability: its
chi-square against the label in the sample, over itself plus a constant. No term is left out, so
any two texts that share a term meet, but chance words count little beside telling ones.

Examples lie in blocks of like ones; a block holds for each term its postings and their largest
weight. A text bounds each block's best cosine by those maxima and scores blocks in falling
order of the bound, until no block can hold one of its nearest. Cosines of the nearest are exact.
They vote with weights that fall with distance; a logistic fit on the examples' own leave-one-out
votes turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.llm.quality import _logistic, held_out, labelled_sample
from tessella.session import small_arrow_batches

#: At most so many labelled documents of each class are examples; so many nearest ones vote.
SAMPLE, NEAREST, BLOCK = 1500, 15, 64
#: Letters of a stem, marks of 2 to 4 different words of a stem, and the constant of reliability.
STEMS, KINDS, DOUBT = (4, 6), 4, 100.0
#: A term of one in so many examples is frequent; texts and postings of a search at most.
FREQUENT, STEP, POSTINGS = 20, 64, 500_000
#: What rounding may hide of a cosine.
SLACK = 1e-5
U64 = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, number of texts, text, term, count) of chunks of whole texts, sorted by text and
    term. Words are runs of two or more letters, lower-cased; whatever is outside ASCII is a
    letter. Terms are 48-bit hashes. Null and empty texts have none."""
    for k in range(0, len(texts), 1 << 16):
        for first, data, offsets in tokens.chunks(pc.utf8_lower(texts.slice(k, 1 << 16).cast(pa.large_string()))):
            key, count = _keys(data, offsets)
            yield k + first, len(offsets) - 1, (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1), count


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the keys, where each group of equal ones begins in it, sizes)."""
    order = np.argsort(key)
    own = key[order]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, begin, np.diff(np.append(begin, len(key)))


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text in 16 bits and term in 48, count), sorted."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:-1]
    tail[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    heads = np.flatnonzero(_HEAD[data])  # bytes that begin a code point
    place = np.cumsum(_HEAD[data]) - 1
    at, to = place[start], place[end - 1] + 1
    long_ = to - at >= 2
    start, end, at, to = start[long_], end[long_], at[long_], to[long_]
    doc = (np.cumsum(np.bincount(offsets[1:-1], minlength=n + 1))[start]).astype(np.uint64) << U64(48)
    hashed = tokens.ranges(data)
    key = doc | (tokens.mix(hashed(start, end)) >> U64(16))
    order, begin, count = _groups(key)
    one = order[begin]
    out = [(key[one], count)]
    doc, start, at, to = doc[one], start[one], at[one], to[one]
    for k in STEMS:
        more = np.flatnonzero(to - at > k)
        stem = tokens.mix(hashed(start[more], heads[at[more] + k]) ^ U64(k)) >> U64(16)
        own, times = doc[more] | stem, count[more]
        order, begin, kinds = _groups(own)
        own = own[order][begin]
        out.append((own, np.add.reduceat(times[order], begin) if len(begin) else times))
        for least in range(2, KINDS + 1):
            many = own[kinds >= least]
            out.append(((many & U64(0xFFFF << 48)) | (tokens.mix(many << U64(16) | U64(least)) >> U64(16)), np.ones(len(many), np.int64)))
    key, count = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(key)
    return key[order], count[order]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin..begin+size of each, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Examples:
    """The index: terms with their weights, and blocks of postings. rows: (term, count) of each
    example, sorted by term.

    Postings of terms that at least one in FREQUENT examples has are kept as a row of weights for
    each block, zeros included, so that a block is scored for many texts by one product of
    matrices; others are lists. Weights are in single precision.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, weight: np.ndarray | None = None, nearest: int = NEAREST, block: int = BLOCK, doubt: float = DOUBT):
        self.nearest, self.block, self.rows, self.labels, self.ids, self.weight = nearest, block, rows, labels, ids, weight
        self.terms, df = np.unique(np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.uint64), return_counts=True)
        n, pos = len(rows), int((labels == 1).sum())
        both = np.zeros(len(df), np.int64)
        for (t, _), label in zip(rows, labels.tolist()):
            if label == 1:
                both[np.searchsorted(self.terms, t)] += 1
        spread = df * (n - df) * float(pos * (n - pos))
        chi = np.where(spread > 0, (both * n - df * pos) ** 2.0 * n / np.maximum(spread, 1), 0.0)
        self.reliability = (chi + 1.0) / (chi + 1.0 + doubt)
        self.sample_df = df

    def weigh(self, df: np.ndarray | None = None, documents: int | None = None) -> Examples:
        """Weighs terms by their document frequencies (those of the sample, if none are given) and
        builds the index and the calibration."""
        df, documents = (self.sample_df, len(self.rows)) if df is None else (df, documents)
        self.by_term = (1.0 + np.log((1 + documents) / (1.0 + df))) * self.reliability
        vectors = [self.vector(*row) for row in self.rows]
        order = self._alike(vectors)
        vectors, labels, self.ids = [vectors[i] for i in order], self.labels[order], [self.ids[i] for i in order]
        self.labels, self.rows, self.scored, self.met = labels, None, 0, 0
        self._post(vectors)
        votes = np.array([vote for vote, _ in self.votes(vectors, np.arange(len(vectors)))])
        own = None if self.weight is None else self.weight[order]
        self.fit2 = _logistic(votes, labels, own) if len(set(labels.tolist())) == 2 else np.zeros(2)
        self.scored = self.met = 0
        return self

    def _alike(self, vectors: list) -> list[int]:
        """Examples in the order of their weightiest terms, ties by all their terms."""
        packed = lambda x: x.astype(">u4").tobytes()  # noqa: E731  in the order of the numbers
        key = lambda i: (packed(vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:8]]), packed(vectors[i][0]))
        return sorted(range(len(vectors)), key=key)

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the terms that the examples have, weights); the whole is of length 1."""
        if not len(self.terms):
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        have = self.terms[at] == term
        at = at[have].astype(np.int32)
        w = (1 + np.log(count[have])) * self.by_term[at]
        return at, (w / np.sqrt((w * w).sum()) if len(w) else w).astype(np.float32)

    def _post(self, vectors: list) -> None:
        size = [len(t) for t, _ in vectors]
        term, weight = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
        example = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.blocks = -(-len(size) // self.block)
        self.room = self.blocks * self.block
        frequent = np.flatnonzero(self.sample_df * FREQUENT >= len(size))
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        on = self.row[term] >= 0
        self.dense = np.zeros((len(frequent), self.room), np.float32)
        self.dense[self.row[term[on]], example[on]] = weight[on]
        self.most = self.dense.reshape(len(frequent), self.blocks, self.block).max(2)
        term, weight, example = term[~on], weight[~on], example[~on]
        order = np.lexsort((example, term))
        term, self.post_weight, self.post_example = term[order], weight[order], example[order]
        self.begin = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def search(self, texts: list[tuple[np.ndarray, np.ndarray]], leave: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the nearest examples of cosine over 0 of each text, nearest first;
        ties go by the examples' own order, which their terms decide."""
        n = len(texts)
        size = [len(t) for t, _ in texts]
        at, w, doc = np.concatenate([t for t, _ in texts]), np.concatenate([w for _, w in texts]), np.repeat(np.arange(n), size)
        on = self.row[at] >= 0
        query = np.zeros((n, len(self.dense)), np.float32)
        query[doc[on], self.row[at[on]]] = w[on]
        at, w, doc = at[~on], w[~on], doc[~on]
        long_ = self.begin[at + 1] - self.begin[at]
        post = _spread(self.begin[at], long_)
        listed = np.bincount(np.repeat(doc * self.room, long_) + self.post_example[post], np.repeat(w, long_) * self.post_weight[post], n * self.room)
        listed = listed.astype(np.float32).reshape(n, self.room)
        bound = listed.reshape(n, self.blocks, self.block).max(2) + query @ self.most
        score, done = np.zeros((n, self.room), np.float32), np.zeros((n, self.blocks), bool)
        ranked = np.argsort(-bound, axis=1, kind="stable")
        least = np.zeros(n, np.float32)
        for begin, end in ((0, 2), (2, 6), (6, self.blocks)):
            wanted = np.zeros_like(done)
            np.put_along_axis(wanted, ranked[:, begin:end], True, 1)
            wanted &= (bound > 0) & (bound >= least[:, None] - SLACK)
            for b in np.flatnonzero(wanted.any(0)).tolist():
                some, part = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                score[some, part] = listed[some, part] + query[some] @ self.dense[:, part]
            done |= wanted
            if leave is not None:
                score[np.arange(n), leave] = 0.0
            if self.room > self.nearest:
                least = np.maximum(0.0, -np.partition(-score, self.nearest - 1, axis=1)[:, self.nearest - 1])
        self.met, self.scored = self.met + int((bound > 0).sum()), self.scored + int(done.sum())
        out = []
        for own, lowest in zip(score, least.tolist()):
            found = np.flatnonzero((own > 0) & (own >= lowest - SLACK))
            top = found[np.lexsort((found, -np.round(own[found], 5)))[: self.nearest]]
            out.append((top, own[top].astype(float)))
        return out

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], leave: np.ndarray | None = None) -> list[tuple[float, tuple[np.ndarray, np.ndarray]]]:
        """Of each text, the share of label 1 among its nearest, weighted by 1 / (distance + 0.05), and
        the nearest. Places of the nearest that no example of cosine over 0 takes go to examples
        without any term. Texts are searched a few at a time, so that their postings stay few."""
        out, k = [], 0
        postings = np.array([int((self.begin[t + 1] - self.begin[t]).sum()) for t, _ in texts], np.int64)
        while k < len(texts):
            stop = k + max(1, min(STEP, int(np.searchsorted(np.cumsum(postings[k : k + STEP]), POSTINGS))))
            for near, cosine in self.search(texts[k:stop], None if leave is None else leave[k:stop]):
                weight = 1 / (1.05 - np.minimum(cosine, 1.0))
                total = weight.sum() + (self.nearest - len(near)) / 1.05
                out.append((float((weight * self.labels[near]).sum() / total), (near, cosine)))
            k = stop
        return out

    def score(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.fit2
        return 1 / (1 + np.exp(-np.clip(a + b * votes, -30, 30)))


def _split(first: int, n: int, doc: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for d in range(n):
        yield first + d, *[v[bounds[d] : bounds[d + 1]] for v in values]


def frequencies(docs: DataFrame, text_col: str, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of docs each of the wanted terms (sorted) stands, and how many rows there
    are. Counted within a task first: a task gives a row per wanted term at most, and the driver
    gets no more than that."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value, 0
        count = np.zeros(len(own) + 1, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for _, _, _, term, _ in terms(batch.column(0)):
                at = np.minimum(np.searchsorted(own, term), max(0, len(own) - 1))
                if len(own):
                    count += np.bincount(at[own[at] == term], minlength=len(count))
        count[-1] = rows
        some = np.flatnonzero(count)
        for k in range(0, len(some), 1 << 16):
            part = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(count[part])], names=["term", "n"])

    found = docs.select(text_col).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted) + 1, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    shared.unpersist()
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Examples | None:
    """The index of a bounded sample, weighed by the frequencies of all documents; None if a class has
    no rows."""
    rows, weight = labelled_sample(docs, labels, label, id_col, text_col, sample)
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    ids, texts = [r[0] for r in rows], pa.array([r[1] for r in rows], pa.large_string())
    del rows
    found = [(t.copy(), c.astype(np.int32)) for chunk in terms(texts) for _, t, c in _split(*chunk)]
    del texts
    index = Examples(found, y, ids, weight)
    del found
    return index.weigh(*frequencies(docs, text_col, index.terms))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted, evidence.

    evidence holds the nearest examples as struct<example_id, cosine>. Only text enters a score.
    Texts without any term, null and empty ones among them, and texts that share none with any
    example get the score of no votes. Repeated rows and null ids stay; a null id is not held out.
    Equal cosines go by the examples' terms. An empty table gives no rows. Without labels of both
    kinds every score is 0.5, without evidence. Texts are read whole, however long. Other columns
    are not read, whatever their names.
    """
    small_arrow_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, label, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            item = pa.list_(pa.struct([("example_id", batch.column(0).type), ("cosine", pa.float64())]))
            if index is None:
                half = np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(half), pa.array((half >= threshold).astype(np.int32)), pa.array([[]] * batch.num_rows, item)], names=["doc_id", "held_out", "score", "predicted", "evidence"])
                continue
            for chunk in terms(batch.column(2)):
                first, n = chunk[:2]
                found = index.votes([index.vector(term, count) for _, term, count in _split(*chunk)])
                score = index.score(np.array([vote for vote, _ in found]))
                evidence = [[{"example_id": index.ids[i], "cosine": s} for i, s in zip(near.tolist(), cosine.tolist())] for _, (near, cosine) in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32()), pa.array(evidence, item)],
                    names=["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    return read.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<struct<example_id:{kind},cosine:double>>")
