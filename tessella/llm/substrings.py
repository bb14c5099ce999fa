"""Substring dedup with a count-min prefilter: words of repeated 20-word windows are removed.

Documents are dealt into batches by id. Pass one makes a sketch of each batch: which counters of
one very wide count-min row its windows touch, and which they touch twice. The sketches are
merged by counter range; merged counts never underestimate, so a window whose counter stays at one
is unique and is done with. Each batch gets back those of its counters that reached two. Pass two
groups the remaining windows exactly, by 128 bits made of two independent hashes of their words:
within a batch first, so that a window costs a row per batch at most, however often it repeats,
and then over all batches. All but a window's first place are repeats. The row is wide instead of
deep because a sketch holds touched counters only: bytes follow the windows of a batch, not the
width, and of the counts only "one" or "more" is needed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens

U64 = np.uint64
WINDOW = 20
#: Text bytes of a batch; a task holds the hashes of one batch at a time. Each batch has a blob for
#: each counter range, so batches grow with the root of the input, up to what a task can hold.
LEAST_BATCH, MOST_BATCH = 8 << 20, 64 << 20
#: Counters per window of a counter range.
WIDTH = 32


def _pack(x: np.ndarray) -> bytes:
    """Integers by byte planes, which shuffle files compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _unpack(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint32), dtype=np.uint32)


class _Batch:
    """A batch's documents in order of id, and the windows of all of them."""

    def __init__(self, rows: pa.Table, size: int):
        table = _in_order(rows).combine_chunks()
        self.ids, self.ties, self.texts = (table[c].combine_chunks() for c in ("doc_id", "tie", "text"))
        docs, places, first, second, self.n_words = [], [], [], [], np.zeros(len(self.ids), np.int64)
        for k, data, offsets in tokens.chunks(self.texts):
            w = tokens.words(k, data, offsets, second=True)
            b = w.bounds()
            self.n_words[k : k + w.n] = np.diff(b)
            at, one = tokens.windows(w.hash, w.doc, size)
            _, two = tokens.windows(w.second, w.doc, size, base=0xD1342543DE82EF95)
            docs.append((w.doc[at] + k).astype(np.int32))
            places.append((at - b[w.doc[at]]).astype(np.int32))
            first.append(one)
            second.append(two)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.doc, self.place, self.one, self.two = join(docs, np.int32), join(places, np.int32), join(first, np.uint64), join(second, np.uint64)

    def counters(self, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(range, counter in it) of each window."""
        return (self.one % U64(ranges)).astype(np.int64), ((self.one // U64(ranges)) & U64((1 << bits) - 1)).astype(np.uint32)


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows by id, nulls last and among themselves by the hash of their texts, then by text."""
    table = rows.set_column(rows.column_names.index("text"), "text", rows["text"].cast(pa.large_string())).combine_chunks()
    return table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")]))


def _by(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where each of the n keys starts in it."""
    order = np.argsort(key, kind="stable")
    return order, np.searchsorted(key[order], np.arange(n + 1))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batch_bytes: int | None = None, keep_text: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    A word is removed if a window of consecutive words that covers it stands with the same words
    at an earlier place: a smaller doc_id, or an earlier start in the same document. Windows are
    judged on the input. Null and empty texts have no words; their hash is that of no bytes. Texts
    of fewer words than a window stay whole. Rows of one doc_id stand in the order of their texts;
    null ids come last, among themselves in the order of a hash of their texts, and are dealt by
    it. An empty table gives no rows. Other columns are not read, whatever their names. A text is
    read whole, and one longer than a batch makes its batch larger.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batch_bytes = batch_bytes or min(MOST_BATCH, max(LEAST_BATCH, math.isqrt(total * 2048)))
    n = max(1, math.ceil(total / batch_bytes))
    bits = max(10, min(31, math.ceil(math.log2(WIDTH * max(1, total // 6) / n + 1))))
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tied = read.withColumn("tie", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    dealt = tied.withColumn("batch", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)).cast("int")).repartition(n, "batch")

    def sketch(batch: tuple, rows: pa.Table) -> pa.Table:
        own = _Batch(rows, window)
        part, counter = own.counters(n, bits)
        order, at = _by(part, n)
        out = []
        for k in range(n):
            cells, count = np.unique(counter[order[at[k] : at[k + 1]]], return_counts=True)
            if len(cells):
                out.append((k, batch[0].as_py(), _pack_sorted(cells), _pack_sorted(cells[count > 1])))
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "batch", "cells", "twice"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        cells = [_unpack_sorted(b) for b in rows["cells"]]
        every = np.sort(np.concatenate(cells))
        heavy = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[_unpack_sorted(b) for b in rows["twice"]]]))
        del every
        out = []
        for batch, own in zip(rows["batch"], cells):
            i = np.searchsorted(heavy, own)
            hit = own[(i < len(heavy)) & (heavy[np.minimum(i, max(0, len(heavy) - 1))] == own)] if len(heavy) else own[:0]
            if len(hit):
                out.append((batch, rows["part"].iloc[0], _pack_sorted(hit)))
        return pd.DataFrame(out, columns=["batch", "part", "cells"])

    def suspects(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Rows (part, batch, one, two, ids, ties, doc, place): of each window that may repeat its first place
        in the batch, for the range that groups it; and its other places, which are repeats, for
        range n + batch, which passes them on."""
        own = _Batch(left, window)
        part, counter = own.counters(n, bits)
        heavy = [np.zeros(0, np.uint64)]
        for k, b in zip(right["part"].to_pylist(), right["cells"].to_pylist()):
            heavy.append(U64(k << 32) | _unpack_sorted(b).astype(np.uint64))
        heavy = np.sort(np.concatenate(heavy))
        cell = (part.astype(np.uint64) << U64(32)) | counter
        low = np.zeros(1 << 22, bool)
        low[(tokens.mix(heavy) & U64((1 << 22) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(low[(tokens.mix(cell) & U64((1 << 22) - 1)).astype(np.int64)])
        if len(heavy):
            i = np.minimum(np.searchsorted(heavy, cell[maybe]), len(heavy) - 1)
            maybe = maybe[heavy[i] == cell[maybe]]
        else:
            maybe = maybe[:0]
        one, two = own.one[maybe], own.two[maybe]
        order = np.lexsort((maybe, two, one))
        again = np.zeros(len(order), bool)
        again[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        firsts, repeats = np.sort(maybe[order[~again]]), np.sort(maybe[order[again]])
        ids, ties = np.asarray(own.ids.fill_null(np.iinfo(np.int64).max), np.int64), np.asarray(own.ties, np.int64)
        out = []
        order, at = _by(part[firsts], n)
        batch = key[0].as_py()
        for k in range(n):
            x = firsts[order[at[k] : at[k + 1]]]
            if len(x):
                out.append((k, batch, _pack(own.one[x]), _pack(own.two[x]), _pack(ids[own.doc[x]]), _pack(ties[own.doc[x]]), _pack(own.doc[x]), _pack(own.place[x])))
        if len(repeats):
            out.append((n + batch, batch, b"", b"", b"", b"", _pack(own.doc[repeats]), _pack(own.place[repeats])))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["part", "batch", "one", "two", "ids", "ties", "doc", "place"])

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["part"].iloc[0] >= n:
            return rows[["batch", "doc", "place"]]
        one, two, ids, ties, doc, place = (np.concatenate([_unpack(b, t) for b in rows[c]]) for c, t in (("one", np.uint64), ("two", np.uint64), ("ids", np.int64), ("ties", np.int64), ("doc", np.int32), ("place", np.int32)))
        batch = np.repeat(rows["batch"].to_numpy(), [len(b) // 4 for b in rows["doc"]])
        order = np.lexsort((place, doc, ties, ids, two, one))
        again = np.zeros(len(order), bool)
        again[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        found = np.sort(order[again])
        out = [(b, _pack(doc[x]), _pack(place[x])) for b in np.unique(batch[found]) for x in [found[batch[found] == b]]]
        return pd.DataFrame(out, columns=["batch", "doc", "place"])

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = _in_order(left)
        texts = table["text"].to_pylist()
        doc = np.concatenate([np.zeros(0, np.int32), *[_unpack(b, np.int32) for b in right["doc"].to_pylist()]])
        place = np.concatenate([np.zeros(0, np.int32), *[_unpack(b, np.int32) for b in right["place"].to_pylist()]])
        order, at = _by(doc, len(texts))
        n_words, n_removed, sha, kept = [], [], [], []
        for d, text in enumerate(texts):
            w = (text or "").encode().split()
            starts = place[order[at[d] : at[d + 1]]]
            n_words.append(len(w))
            if len(starts):
                cover = np.zeros(len(w) + window + 1, np.int32)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                stay = np.cumsum(cover)[: len(w)] <= 0
                w = [w[i] for i in np.flatnonzero(stay).tolist()]
            n_removed.append(n_words[-1] - len(w))
            rest = b" ".join(w)
            sha.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                kept.append(rest.decode())
        cols = [table["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * keep_text
        return pa.table(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    sketches = dealt.groupBy("batch").applyInArrow(sketch, "part int, batch int, cells binary, twice binary")
    counters = sketches.groupBy("part").applyInPandas(merge, "batch int, part int, cells binary")
    places = dealt.groupBy("batch").cogroup(counters.groupBy("batch")).applyInArrow(suspects, "part int, batch int, one binary, two binary, ids binary, ties binary, doc binary, place binary")
    repeats = places.groupBy("part").applyInPandas(group, "batch int, doc binary, place binary")
    out = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return dealt.groupBy("batch").cogroup(repeats.groupBy("batch")).applyInArrow(cut, out)


#: The query's rows for small inputs: every window by its words. Quadratic in nothing, but it
#: holds all windows at once.
SQL = r"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(len(ws) - 19)) AS pos, ws FROM split WHERE len(ws) >= 20),
hashed AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 20], ' ')) AS h FROM win),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM hashed),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(pos, pos + 20))))) AS away FROM ranked WHERE k > 1 GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM split),
lost AS (SELECT doc_id, unnest(away) AS pos FROM gone),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.pos) AS t, count(*) AS n FROM word w ANTI JOIN lost l ON w.doc_id = l.doc_id AND w.pos = l.pos GROUP BY w.doc_id)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(len(s.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
