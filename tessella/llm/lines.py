"""Line dedup by pairwise alignment: patience diff against earlier documents, found by shared lines.

Each long line, and each run of two lines of which one is short, is linked with the first document
that holds it, so it costs one pair per later document, however common it is, and every such pair is aligned: how many documents hold a line
makes no difference. The two documents' line hashes are aligned by patience diff, and aligned
common blocks are deleted from the later one: blocks of several lines, or of one long line. Blocks that are
moved or repeated don't fit into one alignment that rises in both documents. What is left of the later one is therefore aligned again, runs first and
long lines then, equal ones as one, until nothing more is. Only what an alignment pairs is deleted.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize, small_arrow_batches

#: A line of fewer words is no anchor alone; a block without a longer one needs so many lines.
ANCHOR_WORDS, BLOCK_LINES = 8, 2


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (rising in the first) that also rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(n)
        else:
            tops[k], at[k] = y, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs of equal items, rising in both: unique common items first, equal items next to
    them, then the same between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        count_a, count_b = Counter(a[i:j]), Counter(b[k:m])
        place = {b[y]: y for y in range(k, m)}
        unique = [(x, place[a[x]]) for x in range(i, j) if count_a[a[x]] == 1 and count_b.get(a[x]) == 1]
        anchors = _longest_rising(unique)
        if not anchors:
            continue
        for x, y in [*anchors, (j, m)]:  # each gap starts at an anchor, which the prefix rule takes
            todo.append((i, x, k, y))
            i, k = x, y
    return sorted(set(out))


def _hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


_BLANK = _hash(b"")


def runs(seq: list[int], least: int = BLOCK_LINES) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(start, hashes) of each run of so many lines that aren't blank, with the blank ones between."""
    full = [i for i, h in enumerate(seq) if h != _BLANK]
    for i, j in zip(full, full[least - 1 :]):
        yield i, tuple(seq[i : j + 1])


def _align_again(items: list[tuple], earlier: list, gone: set[int]) -> None:
    """Adds to gone the lines of items, (item, its lines) of the later document in order, that an alignment with
    the earlier one's items pairs. Equal items are one, so each is unique on both sides; the
    earlier items are taken forwards or backwards, whichever pairs more, and those left are aligned again. So of n
    items in any order, some multiple of the root of n is settled in each round."""
    places: dict = {}
    for item, lines in items:
        places.setdefault(item, []).append(lines)
    rest = [item for item, own in places.items() if not all(gone.issuperset(lines) for lines in own)]
    while rest:
        wanted = set(rest)
        once = [item for item in dict.fromkeys(earlier) if item in wanted]
        paired = max((patience(rest, way) for way in (once, once[::-1])), key=len)
        if not paired:
            return
        for x, _ in paired:
            gone.update(*places[rest[x]])
        taken = {rest[x] for x, _ in paired}
        known = set(once) - taken
        rest, earlier = [item for item in rest if item in known], once


def blocks_to_delete(later: list[int], earlier: list[int], counts: list[bool], long_: list[bool], least: int = BLOCK_LINES) -> list[int]:
    """Line numbers of later in aligned common blocks. counts: lines that aren't blank; a block
    needs so many of them, or a long one."""
    pairs = patience(later, earlier)
    gone: set[int] = set()
    block: list[int] = []
    for n, (x, y) in enumerate(pairs):
        block.append(x)
        if n + 1 == len(pairs) or pairs[n + 1] != (x + 1, y + 1):
            if sum(counts[i] for i in block) >= least or any(long_[i] for i in block):
                gone.update(block)
            block = []
    _align_again([(run, range(i, i + len(run))) for i, run in runs(later, least)], [run for _, run in runs(earlier, least)], gone)
    _align_again([(h, (i,)) for i, h in enumerate(later) if long_[i]], earlier, gone)
    return sorted(gone)


def _hash_lines(batches: Iterator[pa.RecordBatch], anchor_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """Per document: hashes of its trimmed lines, which aren't blank, which have enough words; and
    its anchors: the lines that have enough, and hashes of runs with a line that hasn't."""
    for batch in batches:
        seq, counts, long_, anchors = [], [], [], []
        for i in range(batch.num_rows):
            lines = [x.strip(" ") for x in (batch.column(1)[i].as_py() or "").split("\n")]
            seq.append([_hash(x.encode()) for x in lines])
            counts.append([x != "" for x in lines])
            long_.append([x != "" and x.count(" ") + 1 >= anchor_words for x in lines])
            own = {h for h, yes in zip(seq[-1], long_[-1]) if yes}
            own |= {_hash(struct.pack(f"<{len(run)}q", *run)) for _, run in runs(seq[-1], least) if any(h != _BLANK and h not in own for h in run)}
            anchors.append(list(own))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip((seq, counts, long_, anchors), kinds)]], names=["doc_id", "seq", "counts", "long", "anchors"])


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """doc_id, gone of each pair (doc_id, seq, counts, long, other) that has a block to delete."""
    for batch in batches:
        at, out = [], []
        for i in range(batch.num_rows):
            seq, counts, long_, other = (batch.column(c)[i].as_py() for c in range(1, 5))
            gone = blocks_to_delete(seq, other, counts, long_, least)
            if gone:
                at.append(i)
                out.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "gone"])


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_words: int = ANCHOR_WORDS, least: int = BLOCK_LINES) -> DataFrame:
    """doc_id, deleted: the line numbers to delete (from 0), of each document that has any.

    Lines are split at newlines and compared by a 64-bit hash of their trimmed text; blank lines
    equal each other but anchor nothing. Null texts have no lines, null ids take no part. Rows of
    one doc_id are not compared with each other, and get what each of them would lose together.
    """
    read = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    small_arrow_batches(docs.sparkSession)
    hashed = read.mapInArrow(lambda batches: _hash_lines(batches, anchor_words, least), f"doc_id {kind}, seq array<bigint>, counts array<boolean>, long array<boolean>, anchors array<bigint>")
    hashes = materialize(hashed, "lines")  # hashes only: texts are read once
    anchors = hashes.select("doc_id", F.explode("anchors").alias("h"))
    known = anchors.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("df")).filter("df > 1")
    pairs = anchors.join(known, "h").filter("doc_id > first").select("doc_id", "first").distinct()
    met = pairs.join(hashes.drop("anchors"), "doc_id").join(hashes.select(F.col("doc_id").alias("first"), F.col("seq").alias("other")), "first")

    found = met.select("doc_id", "seq", "counts", "long", "other").mapInArrow(lambda batches: _align(batches, least), f"doc_id {kind}, gone array<int>")
    return found.select("doc_id", F.explode("gone").alias("pos")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("deleted"))


def _marks(deleted: pd.Series) -> pd.Series:
    """Of each list of line numbers, whether each line up to the last of them is in it."""
    out = []
    for numbers in deleted:
        mark = np.zeros(max(numbers) + 1, bool)
        mark[numbers] = True
        out.append(mark.tolist())
    return pd.Series(out, dtype=object)


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _marked(docs: DataFrame, id_col: str, text_col: str, **options) -> tuple[DataFrame, Column, Column, Column]:
    """docs with what each row loses; and its lines, those of them that stay joined again, and how
    many it loses (null: none)."""
    own, mark, lost = (_unused(docs, f"_tessella_{x}") for x in ("id", "mark", "lost"))
    gone = duplicate_lines(docs, id_col, text_col, **options)
    found = gone.select(F.col("doc_id").alias(own), F.pandas_udf(_marks, "array<boolean>")("deleted").alias(mark), F.size("deleted").cast("long").alias(lost))
    lines = F.split(F.coalesce(docs[text_col], F.lit("")), "\n")
    left = F.transform(lines, lambda x, i: F.when(F.coalesce(F.get(F.col(mark), i), F.lit(False)), F.lit(None)).otherwise(x))
    return docs.join(found, docs[id_col] == found[own], "left"), lines, F.array_join(left, "\n"), F.col(lost)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, chars_col: str | None = None, **options) -> DataFrame:
    """The rows of docs, all columns, with the duplicate lines deleted from their texts.

    Documents that lose nothing are unchanged; a null text stays null, a null id keeps its text. A
    document that loses all its lines keeps its row, with an empty text, or goes if drop_emptied is
    set. chars_col names a column that holds the length of the text, to be kept right. An empty
    table stays empty. Other columns may have any names. Texts are read whole, however long.
    """
    joined, lines, kept, lost = _marked(docs, id_col, text_col, **options)
    changed = {text_col: F.when(lost.isNotNull(), kept).otherwise(docs[text_col])}
    if drop_emptied:
        joined = joined.filter(lost.isNull() | (lost < F.size(lines)))
    if chars_col in docs.columns:
        changed[chars_col] = F.when(lost.isNotNull(), F.length(kept).cast(docs.schema[chars_col].dataType)).otherwise(docs[chars_col])
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per row of docs: doc_id, n_lines, n_deleted, kept_md5 (md5 of the text that stays; a
    null text counts as empty, with one line). What dedup_lines says of odd rows holds here too."""
    joined, lines, kept, lost = _marked(docs, id_col, text_col, **options)
    text = F.when(lost.isNull(), F.coalesce(docs[text_col], F.lit(""))).otherwise(kept)
    return joined.select(docs[id_col].alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0)).cast("long").alias("n_deleted"), F.md5(text).alias("kept_md5"))
