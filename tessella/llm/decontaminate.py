"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by the number of their shingles into classes of 8, 16, 32 and so on. For
a class of s shingles, its items having more than half of that, a document is a row of
half-overlapping segments of 2 s shingles, so an item stands whole in one of them, whose size fits
its own: containment there is a Jaccard similarity of a fifth or more, however long the document
is. Each of the 64 minima of a segment is a key of its own. In the class of 8, whose items may
have a single shingle, every shingle is a key, so none of its places is missed. Keys are tested against a bit table of all items' keys, whose
size is fixed; hits go to a join with the items. A document with a hit brings those of its
shingles that may be any item's, by a second such table, so that the join's exact intersection
needs no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.session import materialize, small_arrow_batches

SIZE, CONTAINMENT, HASHES, BASE = 5, 0.8, 64, 8
#: Bits of each table of keys that is broadcast: 2 MB, whatever the number of items. More items
#: than it is made for cost more false hits, never a lost one.
TABLE_BITS = 24
U64 = np.uint64
_FACTORS = tokens.mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | U64(1)
_SALT = tokens.mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64)) >> U64(16)


def _bit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(64 - TABLE_BITS)).astype(np.int64)


def _blocks(doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of the blocks of size shingles of each text; the last may be shorter."""
    bounds = np.searchsorted(doc, np.arange(n + 1))
    count = -(-np.diff(bounds) // size)
    text = np.repeat(np.arange(n), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[text] + within * size, text


def shingle_keys(value: np.ndarray) -> np.ndarray:
    """The keys of the lowest class: of single shingles."""
    return tokens.mix(value ^ U64(BASE))


def segment_keys(doc: np.ndarray, value: np.ndarray, n: int, classes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, key) of every segment and hash, class by class and hash by hash; in the lowest class,
    of every shingle. Keys carry their class. A class's blocks are made of two of the class below."""
    if not len(value):
        return
    if BASE in classes:
        yield doc, shingle_keys(value)
    if max(classes) == BASE:
        return
    start, text = _blocks(doc, n, 2 * BASE)
    for k in range(HASHES):
        low = np.minimum.reduceat(value * _FACTORS[k], start)
        own, size = text, 2 * BASE
        while True:
            if size in classes:
                both = low.copy()
                same = own[:-1] == own[1:]
                both[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
                yield own, tokens.mix(both ^ (_SALT[k] + U64(size)))
            if size >= max(classes):
                break
            first = np.searchsorted(own, np.arange(n))
            odd = (np.arange(len(own)) - first[own]) % 2 == 0
            at = np.flatnonzero(odd)
            low, own, size = np.minimum.reduceat(low, at), own[at], 2 * size


def item_index(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item_id, n, class, shingles, keys of each test item of size words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tokens.chunks(batch.column(1)):
                w = tokens.words(first, data, offsets, lower=True)
                doc, _, value = tokens.shingles(w, size)
                long_ = np.isin(doc, np.flatnonzero(np.diff(w.bounds()) >= size))
                doc, value = tokens.distinct(doc[long_], value[long_])
                bounds = np.searchsorted(doc, np.arange(w.n + 1))
                rows = []
                for d in np.flatnonzero(np.diff(bounds)):
                    own = value[bounds[d] : bounds[d + 1]]
                    s = BASE
                    while s < len(own):
                        s *= 2
                    low = (own[None] * _FACTORS[:, None]).min(1)
                    keys = shingle_keys(own) if s == BASE else tokens.mix(low ^ (_SALT + U64(s)))
                    rows.append((first + int(d), len(own), s, own.view(np.int64), keys.view(np.int64)))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c + 1] for r in rows], t) for c, t in enumerate(kinds)]], names=["item_id", "n", "class", "shingles", "keys"])

    kind = items.schema[id_col].dataType.simpleString()
    read = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"item_id {kind}, n bigint, class int, shingles array<bigint>, keys array<bigint>")


def _table(index: DataFrame, column: str) -> np.ndarray:
    """Bit table of a column's values: at most 2^TABLE_BITS distinct places reach the driver."""
    place = F.shiftrightunsigned("value", 64 - TABLE_BITS).cast("int").alias("place")
    places = index.select(F.explode(column).alias("value")).select(place).distinct().toPandas()["place"].to_numpy(np.int64)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[places] = True
    return np.packbits(table)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every document that holds at least that
    part of an item's distinct shingles of size words, A-Z lower-cased.

    Null and empty texts hold nothing. Items of fewer words than a shingle cannot be told from
    chance and give nothing. Null ids take no part. Rows that share a doc_id are searched each and
    reported once, with their best. Empty tables give no rows. Texts are searched whole, however
    long. Other columns are not read, whatever their names.
    """
    small_arrow_batches(docs.sparkSession)
    index = materialize(item_index(items, item_id, item_text, size), "items")
    classes = sorted(r[0] for r in index.select("class").distinct().collect())
    spark = docs.sparkSession
    keys, marks = (spark.sparkContext.broadcast(_table(index, c)) for c in ("keys", "shingles"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_key, is_mark = np.unpackbits(keys.value).view(bool), np.unpackbits(marks.value).view(bool)
        for batch in batches:
            for first, data, offsets in tokens.chunks(batch.column(1)):
                w = tokens.words(first, data, offsets, lower=True)
                doc, _, value = tokens.shingles(w, size)
                hits = [(own[on], key[on]) for own, key in segment_keys(doc, value, w.n, classes) for on in [is_key[_bit(key)]]] if classes else []
                if not hits:
                    continue
                hit_doc, hit = tokens.distinct(np.concatenate([d for d, _ in hits]), np.concatenate([h for _, h in hits]))
                if not len(hit):
                    continue
                on = is_mark[_bit(value)]
                mark_doc, mark = tokens.distinct(doc[on], value[on])
                found = np.unique(hit_doc)
                at, to = np.searchsorted(hit_doc, found), np.searchsorted(hit_doc, found, side="right")
                at2, to2 = np.searchsorted(mark_doc, found), np.searchsorted(mark_doc, found, side="right")
                lists = [pa.array([x[i:j].view(np.int64) for i, j in zip(a, b)], pa.list_(pa.int64())) for x, a, b in ((hit, at, to), (mark, at2, to2))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found + first)), *lists], names=["doc_id", "hits", "marks"])

    read = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = read.mapInArrow(run, f"doc_id {kind}, hits array<bigint>, marks array<bigint>")
    by_key = index.select("item_id", F.explode("keys").alias("hit"))
    pairs = seen.select("doc_id", "marks", F.explode("hits").alias("hit")).join(by_key, "hit").groupBy("doc_id", "item_id").agg(F.max("marks").alias("marks"))
    shared = F.size(F.array_intersect("marks", "shingles")).cast("long")
    exact = pairs.join(index.select("item_id", "n", "shingles"), "item_id").select("doc_id", "item_id", F.col("n").alias("n_item"), shared.alias("n_shared"))
    return exact.filter(F.col("n_shared") >= F.col("n_item") * F.lit(containment)).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, of documents that hold no test item. Null ids stay."""
    hit = contaminated(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_tessella_id")).distinct()
    return docs.join(hit, docs[id_col] == hit["_tessella_id"], "left_anti")


#: The query's rows by counting shared shingles of every document and item.
SQL = r"""
WITH iw AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents WHERE doc_id IS NOT NULL),
ip AS (SELECT item_id, ws, unnest(range(len(ws) - 4)) AS p FROM iw WHERE len(ws) >= 5),
dp AS (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS p FROM dw WHERE len(ws) >= 5),
i AS (SELECT DISTINCT item_id, array_to_string(ws[p + 1 : p + 5], ' ') AS s FROM ip),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 5], ' ') AS s FROM dp),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, CAST(any_value(n.n_item) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared, CAST(count(*) / any_value(n.n_item) AS DOUBLE) AS containment
FROM i JOIN d ON i.s = d.s JOIN n ON i.item_id = n.item_id
GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(n.n_item)
"""
