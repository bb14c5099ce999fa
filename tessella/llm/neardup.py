"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

Two permutations make all coordinates. The first scatters a shingle over a universe of 2^20
places; the second is one random table over them, and coordinate k reads it shifted circularly by
k. So a shingle's K values are K neighbouring cells of the table, and a signature is the minimum
over its shingles.

Documents of the same words (A-Z lower-cased, by a cryptographic digest) are one class from the
start. Classes that share a band bucket are candidates, but a bucket never emits all its pairs:
its members are compared with its least member and united. Then only buckets that still span
several components matter. Their members fall into clusters (what such buckets connect), clusters
into blocks bounded in rows and in words, and a task takes two blocks: it compares sketches of
pairs across components, tests the promising ones on sets of shingle hashes and those that pass
on the shingles themselves, and returns links only. Pairs inside a component are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.llm.graph import connected_components, united
from tessella.llm.idfilter import only
from tessella.session import discard, materialize, small_arrow_batches

UNIVERSE = 1 << 20
#: 64 bands of 7 coordinates, drawn from 192. If bands were independent, a pair of Jaccard 0.8 would
#: share none of them with probability (1 - 0.8^7)^64 = 3e-7; as they draw from the same
#: coordinates, a simulation gives some 4e-5.
COORDINATES, BANDS, ROWS = 192, 64, 7
#: Most members and shingles of a cluster's block, but for its largest text; a task holds the
#: texts of two.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
_rng = np.random.default_rng(7)
_SIGMA = np.uint64(int(_rng.integers(1, 1 << 62)) * 2 + 1)


def circulant_table(k: int) -> np.ndarray:
    """The second permutation, continued by its first k cells."""
    pi = np.random.default_rng(11).permutation(UNIVERSE).astype(np.int32)
    return np.concatenate([pi, pi[:k]])


def signatures(doc: np.ndarray, value: np.ndarray, n: int, k: int, table: np.ndarray) -> np.ndarray:
    """(n, k) circulant MinHash of the texts' distinct shingles, sorted by text. Texts without
    shingles get the largest integer everywhere."""
    out = np.full((n, k), np.iinfo(np.int32).max, np.int32)
    if not len(value):
        return out
    cells = ((value * _SIGMA) >> np.uint64(44)).astype(np.int64)
    view = np.lib.stride_tricks.sliding_window_view(table, k)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    step = 2048
    for d in np.flatnonzero(np.diff(bounds)):
        lo, hi = bounds[d], bounds[d + 1]
        row = out[d]
        for i in range(lo, hi, step):
            np.minimum(row, view[cells[i : min(i + step, hi)]].min(axis=0), out=row)
    return out


def shingle_sets(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n_shingles, words_a, words_b (128 bits that identify the sequence of words), sketch
    (the low byte of each coordinate), h. docs: doc_id, text, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = circulant_table(k)
        for batch in batches:
            for first, data, offsets in tokens.chunks(batch.column(1)):
                w = tokens.words(first, data, offsets, lower=True)
                doc, _, value = tokens.shingles(w, size)
                doc, value = tokens.distinct(doc, value)
                bounds = np.searchsorted(doc, np.arange(w.n + 1))
                count = np.diff(bounds)
                lowered = tokens.lowered(data)
                digests = b"".join(hashlib.blake2b(b" ".join(lowered[offsets[d] : offsets[d + 1]].tobytes().split()), digest_size=16).digest() for d in range(w.n))
                ids = np.frombuffer(digests, np.int64).reshape(w.n, 2)
                sketch = (signatures(doc, value, w.n, k, table) & 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, w.n), pa.array(count.astype(np.int64)), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.array([x.tobytes() for x in sketch], pa.binary()), batch.column(2).slice(first, w.n)],
                    names=["doc_id", "n_shingles", "words_a", "words_b", "sketch", "h"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "h").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, words_a bigint, words_b bigint, sketch binary, h bigint")


def band_keys(reps: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, key: a row for each band, whose coordinates are drawn once for all. Coordinates stand
    for themselves by their low bytes; different ones agree in all of a band's by a chance of
    256^-rows at most."""
    rng = np.random.default_rng(13)
    chosen = np.array([rng.choice(k, rows, replace=False) for _ in range(bands)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = tokens.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n = batch.num_rows
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, k)
            keys = np.zeros((n, bands), np.uint64)
            for j in range(rows):
                keys = keys * np.uint64(256) + sketch[:, chosen[:, j]]
            keys = tokens.mix(tokens.mix(keys) ^ salt[None]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)), pa.array(keys.ravel())], names=["id", "key"])

    return reps.select("id", "sketch").mapInArrow(run, "id bigint, key bigint")


def _agree(sketch_a: pd.Series, sketch_b: pd.Series) -> pd.Series:
    if not len(sketch_a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(sketch_a), np.uint8).reshape(len(sketch_a), -1)
    y = np.frombuffer(b"".join(sketch_b), np.uint8).reshape(len(sketch_b), -1)
    return pd.Series((x == y).mean(1))


def _similar(a: pd.Series, b: pd.Series, size: int, percent: int) -> pd.Series:
    """Exact test on the full word shingles of two texts."""
    out = []
    for x, y in zip(a, b):
        one, other = _set(x or "", size), _set(y or "", size)
        both = len(one & other)
        out.append(100 * both >= percent * (len(one) + len(other) - both))
    return pd.Series(out, dtype=bool)


_UPPER = bytes(range(65, 91))
_DOWN = bytes.maketrans(_UPPER, bytes(range(97, 123)))


def _set(text: str, size: int) -> frozenset:
    w = text.encode().translate(_DOWN).split()
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(size))))


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts, of the hashes h_a and h_b, are similar enough. Of the texts,
    those of candidates are shuffled: a fixed-size filter of their ids thins the scan."""
    ends = F.array(*[F.struct(F.col(x).alias("id"), F.col(f"h_{x}").alias("h")) for x in "ab"])
    sided = pairs.select("a", "b", F.posexplode(ends).alias("side", "end")).select("a", "b", "side", "end.id", "end.h")
    texts = sided.join(only(docs, "doc_id", sided, "id").select(F.col("doc_id").alias("id"), "text", "h"), ["id", "h"])
    met = texts.groupBy("a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("y"))
    test = F.pandas_udf(lambda x, y: _similar(x, y, size, percent), "boolean")
    return met.filter(test("x", "y")).select("a", "b")


def _named(members: DataFrame, found: DataFrame) -> DataFrame:
    """members (key, id) with their component so far."""
    return members.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))


def _hash_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted shingle hashes of each text."""
    out = []
    for first, data, offsets in tokens.chunks(texts):
        w = tokens.words(first, data, offsets, lower=True)
        doc, _, value = tokens.shingles(w, size)
        doc, value = tokens.distinct(doc, value)
        bounds = np.searchsorted(doc, np.arange(w.n + 1))
        out += [value[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
    return out


def links_across(ids: np.ndarray, comp: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, least: float, exact: Callable[[int, int], bool] = lambda x, y: True) -> list[tuple[int, int]]:
    """Links that unite components, among pairs of a left and a right member: at most one less
    than there are components. Pairs whose components are united by then are left out. exact has
    the last word on two members whose sets of hashes are similar enough."""
    root = {c: c for c in set(comp.tolist())}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    size = np.array([len(x) for x in sets])
    out = []
    for x in left.tolist():
        near = (sketch[right] == sketch[x]).mean(1)
        fits = (comp[right] != comp[x]) & (near >= least) & (np.minimum(size[right], size[x]) * 100 >= np.maximum(size[right], size[x]) * percent)
        todo = right[fits][np.argsort(-near[fits], kind="stable")]
        while len(todo):
            mine = find(comp[x])
            todo = np.array([y for y in todo.tolist() if find(comp[y]) != mine], np.int64)
            some, todo = todo[:32], todo[32:]
            if not len(some):
                break
            flat = np.concatenate([sets[y] for y in some.tolist()])
            at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
            both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            for y in some[100 * both >= percent * (size[x] + size[some] - both)].tolist():
                if find(comp[y]) != find(comp[x]) and exact(x, y):
                    root[find(comp[y])] = find(comp[x])
                    out.append((int(ids[x]), int(ids[y])))
    return out


def _cross_links(members: DataFrame, texts: DataFrame, reps: DataFrame, size: int, percent: int, least: float, block: int) -> DataFrame:
    """Links between components within the clusters of members (id, comp, cluster)."""
    parts = F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
    sizes = members.join(reps.select("id", "n_shingles"), "id").groupBy("cluster").agg(F.ceil(parts).cast("int").alias("g"))
    placed = members.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    spoken = placed.join(reps.select("id", "sketch", "h"), "id")
    full = spoken.join(only(texts, "doc_id", members, "id").select(F.col("doc_id").alias("id"), "text", "h"), ["id", "h"]).dropDuplicates(["id"])
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "sketch", "text")

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        own, (i, j) = rows["own"].to_numpy(), (key[1].as_py(), key[2].as_py())
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(own), -1)
        sets = _hash_sets(rows["text"], size)
        text = lambda k: rows["text"][k].as_py()
        exact = lambda x, y: bool(_similar([text(x)], [text(y)], size, percent)[0])
        found = links_across(rows["id"].to_numpy(), rows["comp"].to_numpy(), sketch, sets, np.flatnonzero(own == i), np.flatnonzero(own == j), percent, least, exact)
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(search, "a long, b long")


def link_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = COORDINATES, bands: int = BANDS, rows: int = ROWS, margin: float = 0.13, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Links join documents of 100 * intersection >= percent * union of their distinct shingles of
    size words, A-Z lower-cased; shorter texts have one shingle, their whole sequence. Null,
    empty and blank texts have none and link with nothing. component_id is the least doc_id that
    links reach. Rows of a null doc_id get a null component and are kept. Rows that share a
    doc_id are one document: copies of any of their texts are linked with it, and near copies of the
    one of the largest hash among those with words. An empty table gives no rows. Other columns are not read, whatever
    their names. Texts are read whole, however long.

    A candidate whose byte sketch agrees in less than percent / 100 - margin of the coordinates
    isn't verified: at 192 coordinates the margin is over four standard deviations.
    """
    small_arrow_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    sets = materialize(shingle_sets(texts.filter(F.col("doc_id").isNotNull()), size, k), "sets")
    filled = sets.filter("n_shingles > 0")
    classes = materialize(filled.groupBy("words_a", "words_b").agg(F.min("doc_id").alias("id")), "classes")
    chosen = filled.join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "words_a", "words_b"])
    speaking = chosen.groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "sketch", "h"), "h").alias("s"))
    reps = materialize(speaking.select(F.col("doc_id").alias("id"), "s.n_shingles", "s.sketch", "s.h"), "reps")
    band = band_keys(reps, k, bands, rows)
    least = band.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z")
    members = materialize(band.join(least.select("key"), "key"), "buckets")
    agree = F.pandas_udf(_agree, "double")
    least_share = percent / 100 - margin
    size_of = lambda x: reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("h").alias(f"h_{x}"))
    sketch_of = lambda x: reps.select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    met = members.join(least.select("key", "a"), "key").filter("id > a").select("a", F.col("id").alias("b")).distinct()
    sized = met.join(size_of("b"), "b").join(size_of("a"), "a").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs = materialize(sized.select("a", "b", "h_a", "h_b").join(sketch_of("b"), "b").join(sketch_of("a"), "a").filter(agree("sketch_a", "sketch_b") >= least_share).select("a", "b", "h_a", "h_b"), "pairs")
    edges = materialize(verified(pairs, texts, size, percent), "links")
    found = connected_components(edges)
    named = materialize(_named(members, found), "open")
    split = named.groupBy("key").agg(F.min("id").alias("a"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "a")
    rest = materialize(named.join(split, "key").select("a", "id", "comp"), "split")
    if not rest.isEmpty():
        clusters = connected_components(rest.select("a", F.col("id").alias("b")))
        open_ = materialize(rest.select("id", "comp").distinct().join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"), "open")
        more = materialize(_cross_links(open_, texts, reps, size, percent, least_share, block), "links")
        found, before = united(found, more), found
        discard(clusters, open_, more, before)
    discard(members, pairs, edges, named, rest)
    own = reps.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component_id"))
    members = sets.join(classes, ["words_a", "words_b"], "left").join(own, "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    named = members.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    unnamed = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(unnamed)


#: The query's rows (shingles of two words) by counting what every two documents share.
SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
shingle AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END) AS s FROM split),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair p JOIN size i ON i.doc_id = x JOIN size j ON j.doc_id = y WHERE 100 * shared >= 80 * (i.n + j.n - shared)),
edge AS (SELECT x AS u, y AS v FROM link UNION ALL SELECT y, x FROM link),
reach(node, root) AS (SELECT u, u FROM edge UNION SELECT e.v, r.root FROM reach r JOIN edge e ON e.u = r.node WHERE r.root < e.v),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.root, s.doc_id)) AS component_id, least(s.doc_id, coalesce(l.root, s.doc_id)) = s.doc_id AS kept
FROM split s LEFT JOIN size z ON z.doc_id = s.doc_id LEFT JOIN least l ON l.node = s.doc_id
"""
