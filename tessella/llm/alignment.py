"""Alignment of two tokenizers over a corpus by segment deduplication.

Texts are split before white space where neither vocabulary can merge across: the byte-level pattern
begins a new piece at every white space that follows anything else, and the piece model has no entry with
a space behind another character, or with a line end. Both are verified when the vocabularies are
read. A segment is tokenised and aligned once for the whole corpus, by the part of the key space that owns
it; batches of documents join the alignments back and compose their documents from them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm import tokens
from tessella.llm.exchange import by_part, bytes_of, in_batches, pack, ranges, sums, unpack
from tessella.session import materialize, small_arrow_batches

FOLDER = "/opt/tokenizers"
#: Text bytes of a batch, and of the texts whose segments a part owns; segments that are tokenised at a time.
BATCH, PART, SLICE = 8 << 20, 12 << 20, 4096
SPACE = "▁"
A_ENDS, B_ENDS = 1, 2


class Tokenizers:
    """A byte-level BPE (A) and a piece model with byte fallback (B): tokens of segments, and bytes
    of tokens."""

    def __init__(self, folder: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if not (self.a.pre_tokenizer and type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None):
            raise ValueError("A must be a byte-level BPE that splits by its own pattern")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("B has pieces that reach over a space")
        if any("\n" in p for p in pieces):
            raise ValueError("B has pieces that reach over a line end")
        self.a_bytes = _byte_level({i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()})
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(SPACE)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        one = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B puts a space before what it is given: the segment's own, or one that is taken away again
        two = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s[0] != " ":
                two[k] = two[k][1:]
            elif len(s) == 1:
                two[k] = [self.space]
        return one, two


def _byte_level(entries: dict[int, str]) -> list[bytes]:
    """Bytes of each id: printable Latin-1 characters stand for themselves, the others, in order, for
    the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(byte[c] for c in entries[i]) if i in entries else b"" for i in range(max(entries) + 1)]


@lru_cache(maxsize=1)
def loaded(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def segment_starts(data: np.ndarray) -> np.ndarray:
    """Where segments start in the bytes of a text: at its start, and at each space and line end
    that doesn't follow other white space, of ASCII or not."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at > 0]
    before = data[at - 1]
    free = ~(((before >= 9) & (before <= 13)) | ((before >= 28) & (before <= 32)))
    for k in np.flatnonzero(before >= 128).tolist():
        last = bytes(data[max(0, at[k] - 4) : at[k]]).decode("utf-8", "ignore")
        free[k] = not last[-1:].isspace()
    return np.concatenate([np.zeros(1, np.int64), at[free]])


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All segments of " " + text, text by text, and how many each text has; empty ones have none."""
    arrays, counts = [], np.zeros(len(texts), np.int64)
    for first, data, offsets in tokens.chunks(texts):
        length = np.diff(offsets)
        full = np.flatnonzero(length)
        spaced = np.insert(data, offsets[:-1][full], 32)
        begin = offsets[:-1][full] + np.arange(len(full))
        starts = segment_starts(spaced)
        starts = np.union1d(starts, begin)  # texts begin anywhere, and segments end with them
        counts[first + full] = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
        arrays.append(_strings(spaced, np.append(starts, len(spaced))))
    return pa.concat_arrays(arrays) if arrays else pa.array([], pa.large_string()), counts


def align(t: Tokenizers, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each segment, and A id, B id and ends of each link). Two tokens are linked if their bytes
    overlap, so links are the stretches between ends of either; ends says whose token ends with it. A
    segment that either tokenizer doesn't give back byte by byte has no links."""
    raw = [s.encode() for s in segments]
    one, two = t.encode(segments)
    for k, s in enumerate(raw):
        if b"".join([t.a_bytes[i] for i in one[k]]) != s or b"".join([t.b_bytes[i] for i in two[k]]) != s:
            one[k], two[k] = [], []
    count = np.array([len(x) for x in one])
    a, b = np.array([i for x in one for i in x], np.int64), np.array([i for x in two for i in x], np.int64)
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    ends = np.union1d(a_end, b_end)
    at_a, at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    kind = (a_end[at_a] == ends) * A_ENDS + (b_end[at_b] == ends) * B_ENDS
    last = a_end[np.cumsum(count)[count > 0] - 1]  # of each segment that has links
    links = np.zeros(len(segments), np.int64)
    links[count > 0] = np.diff(np.searchsorted(ends, last, side="right"), prepend=0)
    return links, a[at_a], b[at_b], kind


def _written(links: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> list[str]:
    """Each segment's groups, as a1,a2|b1;a3|b2."""
    out, ends = [], np.cumsum(links)
    for k in range(0, len(links), SLICE):
        n = links[k : k + SLICE]
        i, j = (int(ends[k] - n[0]), int(ends[k + len(n) - 1]))
        out += _written_slice(n.tolist(), a[i:j].tolist(), b[i:j].tolist(), kind[i:j].tolist())
    return out


def _written_slice(links: list[int], a: list[int], b: list[int], kind: list[int]) -> list[str]:
    out, i = [], 0
    for n in links:
        groups, left, right = [], [], []
        for k in range(i, i + n):
            if kind[k] & A_ENDS:
                left.append(str(a[k]))
            if kind[k] & B_ENDS:
                right.append(str(b[k]))
            if kind[k] == A_ENDS | B_ENDS:
                groups.append(f"{','.join(left)}|{','.join(right)}")
                left, right = [], []
        out.append(";".join(groups))
        i += n
    return out


_ROWS = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary()), ("four", pa.binary())])
_SQL_ROWS = "batch bigint, part int, kind int, one binary, two binary, three binary, four binary"
ASK, ALIGNED, PAIRS, COUNTED = range(4)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[c] if c < len(r) else None for r in rows], f.type) for c, f in enumerate(_ROWS)], schema=_ROWS)


def _packed_strings(x: pa.Array) -> tuple[bytes, bytes]:
    data, offsets = tokens.buffers(x)
    return pack(np.diff(offsets)), zstandard.compress(data[offsets[0] : offsets[-1]].tobytes(), 1)


def _unpacked_strings(sizes: bytes, data: bytes) -> pa.Array:
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(unpack(sizes).astype(np.int64))])
    return _strings(np.frombuffer(zstandard.decompress(data), np.uint8), offsets)


def _part_of(segments: pa.Array, parts: int) -> np.ndarray:
    data, offsets = tokens.buffers(segments)
    return (tokens.mix(tokens.ranges(data)(offsets[:-1], offsets[1:])) % np.uint64(parts)).astype(np.int64)


class _Batch:
    """A batch's documents as places in its distinct segments, and what is known of the segments."""

    def __init__(self, body: pa.Table, answers: pa.Table, parts: int):
        self.ids = body["ids"].chunk(0)[0].values
        self.counts, self.at = (unpack(body[c][0].as_py()).astype(np.int64) for c in ("counts", "at"))
        part = unpack(body["part_of"][0].as_py()).astype(np.int64)
        found = {(r["kind"], r["part"]): r for r in answers.to_pylist()}
        n = len(part)
        self.links = np.zeros(n, np.int64)
        a, b, kind, places = ([np.zeros(0, np.int64)] for _ in range(4))
        for k, place in by_part(part, parts):
            row = found[ALIGNED, k]
            self.links[place] = unpack(row["one"])
            for out, c in ((a, "two"), (b, "three"), (kind, "four")):
                out.append(unpack(row[c]).astype(np.int64))
            places.append(place)
        # answers stand part by part; the segments are put in that order
        order = np.concatenate(places)
        new = np.empty(n, np.int64)
        new[order] = np.arange(n)
        self.at, self.links = new[self.at], self.links[order]
        self.a, self.b, self.kind = np.concatenate(a), np.concatenate(b), np.concatenate(kind)
        self.first = np.cumsum(self.links) - self.links
        self.answers = found
        # a document with a segment that doesn't come back byte by byte has no tokens
        bad = sums((self.links == 0)[self.at], self.counts) > 0
        self.at = self.at[np.repeat(~bad, self.counts)]
        self.counts[bad] = 0
        self.pairs, self.pair_of = np.unique((self.a << 32) | self.b, return_inverse=True)

    def documents_of_pairs(self, most: int = 1 << 20) -> np.ndarray:
        """How many documents hold each pair linked, some million links at a time."""
        total = np.zeros(len(self.pairs), np.int64)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        own = np.unique((doc << 32) | self.at)
        doc, segment = own >> 32, own & 0xFFFFFFFF
        reach = np.cumsum(self.links[segment])
        i = 0
        while i < len(doc):
            j = int(np.searchsorted(reach, (reach[i - 1] if i else 0) + most, side="right"))
            j = int(np.searchsorted(doc, doc[min(max(j, i + 1), len(doc)) - 1], side="right"))  # whole documents
            n = self.links[segment[i:j]]
            pair = self.pair_of[ranges(self.first[segment[i:j]], n)]
            held = np.unique((np.repeat(doc[i:j], n) << 32) | pair) & 0xFFFFFFFF
            total += np.bincount(held, minlength=len(total))
            i = j
        return total


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, batch_bytes: int = BATCH, part_bytes: int = PART, keep_groups: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    (and groups, the text that is hashed, if asked for).

    A encodes a space and the text, B the text, which it puts a space before. Null and empty texts,
    and texts that either doesn't give back byte by byte, have zeros and an empty groups_sha256.
    Special tokens in texts are plain text. Each row is a document, so repeated rows and null ids
    count as such. An empty table gives no rows. Other columns are not read, whatever their names.
    Texts are read whole; one without white space is one segment. folder must be there on every
    executor. n_best counts links whose pair is in as many documents as any pair of its A id.
    """
    small_arrow_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_kind = read.schema["doc_id"].dataType.simpleString()
    parts = max(1, -(-bytes_of(docs, text_col) // part_bytes))

    def cut(number: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        segments, counts = split(rows.column(1).combine_chunks())
        coded = segments.dictionary_encode()
        part = _part_of(coded.dictionary, parts)
        body = {"batch": number, "ids": rows.column(0).to_pylist(), "counts": pack(counts), "at": pack(coded.indices.to_numpy()), "part_of": pack(part)}
        out = [body] + [{"batch": number, "part": k, **dict(zip(("sizes", "data"), _packed_strings(coded.dictionary.take(place))))} for k, place in by_part(part, parts)]
        yield from pa.Table.from_pylist(out, schema).to_batches(max_chunksize=64)

    schema = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(to_arrow_type(read.schema["doc_id"].dataType))), ("counts", pa.binary()), ("at", pa.binary()), ("part_of", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
    sql = f"batch bigint, part int, ids array<{id_kind}>, counts binary, at binary, part_of binary, sizes binary, data binary"
    table = materialize(read.mapInArrow(lambda batches: in_batches(batches, batch_bytes, cut), sql), "segments")

    def tokenise(rows: pa.Table) -> pa.Table:
        t = loaded(folder)
        asked = [_unpacked_strings(s.as_py(), d.as_py()) for s, d in zip(rows["sizes"], rows["data"])]
        coded = pa.concat_arrays(asked).dictionary_encode()
        found = [align(t, coded.dictionary.slice(k, SLICE).to_pylist()) for k in range(0, len(coded.dictionary), SLICE)]
        links, a, b, kind = (np.concatenate([f[c] for f in found]) for c in range(4))
        first = np.cumsum(links) - links
        place, out, i = coded.indices.to_numpy(), [], 0
        for batch, own in zip(rows["batch"].to_pylist(), asked):
            own = place[i : i + len(own)]
            i += len(own)
            at = ranges(first[own], links[own])
            out.append((batch, rows["part"][0].as_py(), ALIGNED, pack(links[own]), pack(a[at]), pack(b[at]), pack(kind[at])))
        return _rows(out)

    bodies, asked = table.filter("part is null").drop("part", "sizes", "data"), table.filter("part is not null").select("batch", "part", "sizes", "data")
    aligned = materialize(asked.groupBy("part").applyInArrow(tokenise, _SQL_ROWS), "alignments")
    pair_parts = max(1, min(parts, 1 << 12))

    def pairs(body: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Batch(body, answers, parts)
        count = own.documents_of_pairs()
        return _rows([(body["batch"][0].as_py(), k, PAIRS, pack(own.pairs[place]), pack(count[place])) for k, place in by_part((own.pairs >> 32) % pair_parts, pair_parts)])

    def total(rows: pa.Table) -> pa.Table:
        asked, counts = ([unpack(b.as_py()).astype(np.int64) for b in rows[c]] for c in ("one", "two"))
        every, place = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.zeros(len(every), np.int64)
        np.add.at(count, place, np.concatenate(counts))
        ids, of = np.unique(every >> 32, return_inverse=True)
        most = np.zeros(len(ids), np.int64)
        np.maximum.at(most, of, count)
        best = count == most[of]
        out, i = [], 0
        for batch, own in zip(rows["batch"].to_pylist(), asked):
            at = place[i : i + len(own)]
            i += len(own)
            out.append((batch, rows["part"][0].as_py(), COUNTED, pack(count[at]), pack(best[at])))
        return _rows(out)

    counted = bodies.groupBy("batch").cogroup(aligned.groupBy("batch")).applyInArrow(pairs, _SQL_ROWS).groupBy("part").applyInArrow(total, _SQL_ROWS)

    def compose(body: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Batch(body, answers, parts)
        count, best = np.zeros(len(own.pairs), np.int64), np.zeros(len(own.pairs), np.int64)
        for k, place in by_part((own.pairs >> 32) % pair_parts, pair_parts):
            count[place], best[place] = unpack(own.answers[COUNTED, k]["one"]), unpack(own.answers[COUNTED, k]["two"])
        each = [own.kind & A_ENDS, own.kind >> 1, own.kind == A_ENDS | B_ENDS, np.ones(len(own.kind), np.int64), best[own.pair_of], count[own.pair_of]]
        columns = [pa.array(sums(sums(x, own.links)[own.at], own.counts)) for x in each]
        text = _written(own.links, own.a, own.b, own.kind)
        i, sha, groups = 0, [], []
        for n in own.counts.tolist():
            whole = ";".join([text[k] for k in own.at[i : i + n].tolist()])
            i += n
            sha.append(hashlib.sha256(whole.encode()).hexdigest() if n else "")
            if keep_groups:
                groups.append(whole)
        more = [pa.array(groups, pa.string())] * keep_groups
        return pa.table([own.ids, *columns, pa.array(sha), *more], names=[*names, "groups_sha256", *["groups"] * keep_groups])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = f"doc_id {id_kind}, " + ", ".join(f"{n} bigint" for n in names[1:]) + ", groups_sha256 string" + ", groups string" * keep_groups
    return bodies.groupBy("batch").cogroup(aligned.unionByName(counted).groupBy("batch")).applyInArrow(compose, out)
