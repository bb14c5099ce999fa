"""Scores of texts by an n-gram model that is trained on the corpus and kept as Elias-Fano tries.

Batches of documents send their distinct words to the parts of the key space, which count them over the
corpus, number them with frequent words first, and send numbers and counts back. Then batches send
their distinct trigrams, with their counts in training documents, to the part that owns the middle word: both
contexts of a trigram (u, v, w) and both its n-grams stand there, so that one trie per part is a
model that is whole for its words. Each trie answers its part's distinct trigrams, and the batches
add the answers up by document.

A word that is more frequent than a part can hold is dealt over several parts by the word before
it, and a pair of words that is still too frequent by the word after it. What such a part can't
count itself, the successors of the word and the totals of the pair, is counted apart by
parts of its own and sent to it. Such words and pairs are at most the corpus over the limit, or MOST_HOT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm import tokens
from tessella.llm.exchange import by_part, bytes_of, in_batches, pack, pack_rising, unpack, unpack_rising
from tessella.llm.trie import STEPS, Trie, quantised
from tessella.session import discard, materialize, small_arrow_batches

U64 = np.uint64
#: Text bytes of a batch, and of the texts whose n-grams a part owns; occurrences of a word or pair that stay in one part.
BATCH, PART, HOT = 8 << 20, 5 << 20, 1 << 19
#: Trigrams that are looked up at a time.
SLICE = 1 << 18
#: Most words, or pairs, that are dealt over several parts: the limit rises with the corpus beyond that.
MOST_HOT = 100_000
START, END = 0, 1  # numbers of what isn't a word


def held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 1. A null id counts as no text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def distinct_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one of each distinct triple, in order of a, b and c; which of them each triple is)."""
    most = [int(x.max()) + 1 if len(x) else 1 for x in (a, b, c)]
    if most[0] * most[1] * most[2] < 1 << 63:
        key = (a * most[1] + b) * most[2] + c
    else:
        _, a = np.unique(a, return_inverse=True)
        _, b = np.unique(b, return_inverse=True)
        _, pair = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
        _, c = np.unique(c, return_inverse=True)
        key = pair * (int(c.max()) + 1) + c
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return first, which


def part_of(v: np.ndarray, u: np.ndarray, w: np.ndarray, splits: np.ndarray, pair_splits: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns each trigram. splits: into how many shares its word v is dealt, and pair_splits its pair."""
    share = (tokens.mix(u.astype(U64) + U64(7)) % splits.astype(U64)) * U64(0x9E3779B97F4A7C15)
    again = (tokens.mix(w.astype(U64) + U64(11)) % pair_splits.astype(U64)) * U64(0xC2B2AE3D27D4EB4F)
    return (tokens.mix(v.astype(U64) + share + again + U64(1)) % U64(parts)).astype(np.int64)


_NAMES = ["batch", "part", "kind", "n1", "n2", "n3", "one", "two", "three", "four", "five", "six"]
_SCHEMA = pa.schema([(n, pa.int64() if k < 6 else pa.binary()) for k, n in enumerate(_NAMES)])
_SQL = ", ".join(f"{n} {'bigint' if k < 6 else 'binary'}" for k, n in enumerate(_NAMES))
WORDS, TOTALS, BIGRAMS, OFTEN, GRAMS, SCORES = range(6)


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _SCHEMA)


class _Batch:
    """A batch's tokens as numbers of the corpus, with what is known of its words."""

    def __init__(self, row: dict, docs: tuple[int, int], hot: int):
        self.batch = row["batch"]
        self.counts, at, self.held = (unpack(row[c]).astype(np.int64) for c in ("counts", "at", "held"))
        # words by number, after the start and the end of texts
        self.number = np.concatenate([[START, END], unpack_rising(row["numbers"]).astype(np.int64)])
        self.count = np.concatenate([[0, docs[0]], unpack(row["trained"]).astype(np.int64)])
        self.splits = np.concatenate([[-(-docs[1] // hot) or 1, 1], unpack(row["shares"]).astype(np.int64)])
        place = at + 2
        # each document's words and its end, and the two tokens before each
        ends = np.cumsum(self.counts + 1)
        self.w = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
        inner = np.ones(len(self.w), bool)
        inner[ends - 1] = False
        self.w[inner] = place
        self.v = np.concatenate([[START], self.w[:-1]])[: len(self.w)]
        self.u = np.concatenate([[START], self.v[:-1]])[: len(self.w)]
        begin = ends - self.counts - 1
        self.v[begin] = START
        self.u[begin] = START
        self.u[np.minimum(begin + 1, ends - 1)] = START
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts + 1)

    def trigrams(self, pairs: dict, parts: int) -> None:
        """Distinct trigrams in order of their numbers, and where they are owned. pairs: of the pairs
        (v, u) that are dealt by the word after them, the number of shares."""
        first, self.which = distinct_triples(self.v, self.u, self.w)
        self.gram = [x[first] for x in (self.v, self.u, self.w)]
        self.trained = np.bincount(self.which, self.held[self.doc] == 0, len(first)).astype(np.int64)
        v, u, w = (self.number[x] for x in self.gram)
        shares = np.ones(len(first), np.int64)
        place = {int(n): k for k, n in enumerate(self.number.tolist())} if pairs else {}
        for (word, before), (n, _, _) in pairs.items():
            if word in place and before in place:
                i, j = np.searchsorted(v, word), np.searchsorted(v, word, side="right")
                i, j = i + np.searchsorted(u[i:j], before), i + np.searchsorted(u[i:j], before, side="right")
                shares[i:j] = n
        self.part = part_of(v, u, w, self.splits[self.gram[0]], shares, parts)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, part_bytes: int = PART, hot: int = HOT) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z lower-cased, and its end. Texts whose id's crc32 mod 5 is
    1 are held out; the others train. base_score adds the logarithms of add-a-half unigram probabilities, score
    those of a trigram model with Witten-Bell smoothing over these, in steps of 1 / 2048 per token:
    sums of whole numbers, so reruns agree to the last digit. Words are told apart by 64-bit hashes.

    Null and empty texts have one token, their end. A null id counts as the empty text, which is in training.
    Repeated rows each count and train. If nothing trains, every token has probability 1 in the
    base. An empty table gives no rows. Other columns are not read, whatever their names. Texts are
    read whole; one longer than a batch makes its batch larger.
    """
    small_arrow_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    id_kind = read.schema["doc_id"].dataType.simpleString()
    text_bytes = bytes_of(docs, text_col)
    parts = max(1, -(-text_bytes // part_bytes))
    hot = max(hot, text_bytes // 2 // MOST_HOT)

    def cut(number: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = rows.column(1).combine_chunks()
        held = rows.column(2).to_numpy()
        hashes, counts = [np.zeros(0, U64)], np.zeros(len(texts), np.int64)
        for first, data, offsets in tokens.chunks(texts):
            w = tokens.words(first, data, offsets, lower=True)
            counts[first : first + w.n] = np.bincount(w.doc, minlength=w.n)
            hashes.append(w.hash)
        own, at = np.unique(np.concatenate(hashes), return_inverse=True)
        trained = np.bincount(at, np.repeat(~held, counts), len(own)).astype(np.int64)
        every = np.bincount(at, minlength=len(own))
        part = (own % U64(parts)).astype(np.int64)
        body = {"batch": number, "n1": int((~held).sum()), "n2": len(held), "ids": rows.column(0).to_pylist(), "held": pack(held), "counts": pack(counts), "at": pack(at), "part_of": pack(part)}
        out = [body] + [{"batch": number, "part": k, "words": pack_rising(own[place]), "trained": pack(trained[place]), "every": pack(every[place])} for k, place in by_part(part, parts)]
        yield from pa.Table.from_pylist(out, schema).to_batches(max_chunksize=64)

    blobs = ["held", "counts", "at", "part_of", "words", "trained", "every"]
    schema = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("ids", pa.list_(to_arrow_type(read.schema["doc_id"].dataType))), *[(b, pa.binary()) for b in blobs]])
    sql = f"batch bigint, part bigint, n1 bigint, n2 bigint, ids array<{id_kind}>, " + ", ".join(f"{b} binary" for b in blobs)
    table = materialize(read.mapInArrow(lambda batches: in_batches(batches, batch_bytes, cut), sql), "tokens")
    bodies = table.filter("part is null").select("batch", "ids", "held", "counts", "at", "part_of")
    trained_docs, all_docs = table.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n2"), F.lit(0))).first()
    docs_of = (trained_docs, all_docs)

    def count_words(rows: pa.Table) -> pa.Table:
        asked = [unpack_rising(b.as_py()) for b in rows["words"]]
        own, at = np.unique(np.concatenate(asked), return_inverse=True)
        trained, every = (np.bincount(at, np.concatenate([unpack(b.as_py()) for b in rows[c]]), len(own)).astype(np.int64) for c in ("trained", "every"))
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((own, -every))] = np.arange(len(own))
        part = rows["part"][0].as_py()
        out, i = [{"batch": -1, "part": part, "kind": TOTALS, "n1": int(trained.sum()), "n2": int((trained > 0).sum()), "n3": int(every.max())}], 0
        for batch, words in zip(rows["batch"].to_pylist(), asked):
            k = at[i : i + len(words)]
            i += len(words)
            out.append({"batch": batch, "part": part, "kind": WORDS, "one": pack(rank[k]), "two": pack(trained[k]), "three": pack(-(-every[k] // hot))})
        return _rows(out)

    words = materialize(table.filter("part is not null").select("batch", "part", "words", "trained", "every").groupBy("part").applyInArrow(count_words, _SQL), "words")
    total, kinds, most = words.filter(F.col("kind") == TOTALS).agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n1"), F.sum("n2"), F.max("n3"))]).first()
    total, kinds = total + trained_docs, kinds + (trained_docs > 0)
    known_words = words.filter(F.col("kind") == WORDS)
    one = lambda count: (count + 0.5) / (total + 0.5 * (kinds + 1))

    def number(body: pa.Table, answers: pa.Table) -> pa.Table:
        row = body.drop_columns(["ids"]).to_pylist()[0]
        part = unpack(row["part_of"]).astype(np.int64)
        numbers, trained, shares = (np.zeros(len(part), np.int64) for _ in range(3))
        found = {r["part"]: r for r in answers.to_pylist()}
        for k, place in by_part(part, parts):
            numbers[place] = unpack(found[k]["one"]).astype(np.int64) * parts + k + 2
            trained[place], shares[place] = unpack(found[k]["two"]), unpack(found[k]["three"])
        order = np.argsort(numbers)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        blobs = [row["held"], row["counts"], pack(place[unpack(row["at"]).astype(np.int64)]), pack_rising(numbers[order]), pack(trained[order]), pack(shares[order])]
        return pa.table([body["batch"], body["ids"], *[pa.array([x], pa.binary()) for x in blobs]], names=["batch", "ids", *columns])

    columns = ["held", "counts", "at", "numbers", "trained", "shares"]
    numbered = bodies.groupBy("batch").cogroup(known_words.groupBy("batch")).applyInArrow(number, f"batch bigint, ids array<{id_kind}>, " + ", ".join(f"{c} binary" for c in columns))
    numbered = materialize(numbered, "numbered")  # from here on, batches stay where they are
    discard(table, words)
    texts = numbered.drop("ids")

    def each_batch(run, out: str) -> DataFrame:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for k in range(rows.num_rows):
                    yield from run(_Batch(rows.slice(k, 1).to_pylist()[0], docs_of, hot)).to_batches(max_chunksize=1 << 16)

        return texts.mapInArrow(over, out)

    # words that are dealt over several parts, with their successors; and such pairs, with theirs
    supply, pairs = None, {}
    if max(most, all_docs) > hot:

        def bigrams(own: _Batch) -> pa.Table:
            mine = np.flatnonzero(own.splits[own.v] > 1)
            v, w = own.v[mine], own.w[mine]
            first, which = distinct_triples(v, np.zeros(len(v), np.int64), w)
            trained, every = np.bincount(which, own.held[own.doc[mine]] == 0, len(first)).astype(np.int64), np.bincount(which, minlength=len(first))
            v, w = v[first], w[first]
            part = (tokens.mix(tokens.mix(own.number[v].astype(U64)) + own.number[w].astype(U64)) % U64(parts)).astype(np.int64)
            rows = []
            for k, at in by_part(part, parts):
                blobs = (pack_rising(own.number[v[at]]), pack(own.number[w[at]]), pack(trained[at]), pack(every[at]), pack(own.splits[v[at]]))
                rows.append({"batch": own.batch, "part": k, "kind": BIGRAMS} | dict(zip(_NAMES[6:], blobs)))
            return _rows(rows)

        def add(rows: pa.Table) -> pa.Table:
            v, w, n, every, shares = (np.concatenate([f(b.as_py()).astype(np.int64) for b in rows[c]]) for c, f in zip(_NAMES[6:], (unpack_rising, *[unpack] * 4)))
            first, which = distinct_triples(v, np.zeros(len(v), np.int64), w)
            v, w, shares = v[first], w[first], shares[first]
            n, every = np.bincount(which, n, len(first)).astype(np.int64), np.bincount(which, every, len(first)).astype(np.int64)
            part = rows["part"][0].as_py()
            out = [{"part": part, "kind": OFTEN, "n1": int(v[k]), "n2": int(w[k]), "n3": int(every[k])} for k in np.flatnonzero((every > hot) & (w != END))]
            seen = n > 0
            return _rows([{"part": part, "kind": BIGRAMS} | dict(zip(_NAMES[6:], (pack_rising(v[seen]), pack(w[seen]), pack(n[seen]), pack(shares[seen])))), *out])

        two = materialize(each_batch(bigrams, _SQL).groupBy("part").applyInArrow(add, _SQL), "bigrams")
        often = {(r["n2"], r["n1"]): -(-r["n3"] // hot) for r in two.filter(F.col("kind") == OFTEN).select("n1", "n2", "n3").collect()}  # at most the corpus over hot
        if all_docs > hot:
            often[START, START] = -(-all_docs // hot)  # the first words of texts
        if often:

            def trigrams(own: _Batch) -> pa.Table:
                own.trigrams({}, 1)
                v, u, w = (own.number[x] for x in own.gram)
                mine = np.zeros(len(v), bool)
                for word, before in often:
                    mine |= (v == word) & (u == before)
                mine &= own.trained > 0
                return pa.table([pa.array(x[mine]) for x in (v, u, w, own.trained)], names=["v", "u", "w", "n"])

            three = each_batch(trigrams, "v bigint, u bigint, w bigint, n bigint").groupBy("v", "u", "w").agg(F.sum("n").alias("n"))
            totals = {(r["v"], r["u"]): (r["c"], r["t"]) for r in three.groupBy("v", "u").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("t")).collect()}
            pairs = {k: (n, *totals.get(k, (0, 0))) for k, n in often.items()}
        deliver = _to_shares(parts, pairs)
        supply = two.filter(F.col("kind") == BIGRAMS).select("one", "two", "three", "four").mapInArrow(deliver, "part bigint, one binary, two binary, three binary")

    def send(own: _Batch) -> pa.Table:
        own.trigrams(pairs, parts)
        code = quantised(one(own.count))
        out = []
        for k, place in by_part(own.part, parts):
            v, u, w = (x[place] for x in own.gram)
            last, at = np.unique(w, return_inverse=True)
            # frequent words have small numbers, so codes rise with few exceptions
            rising = np.diff(code[last].astype(np.int64), prepend=0)
            blobs = (pack_rising(own.number[v]), pack(own.number[u]), pack(at), pack_rising(own.number[last]), pack((rising << 1) ^ (rising >> 63)), pack(own.trained[place]))
            out.append({"batch": own.batch, "part": k, "kind": GRAMS} | dict(zip(_NAMES[6:], blobs)))
        return _rows(out)

    asked = each_batch(send, _SQL)

    def answer(rows: pa.Table, hot_words: dict) -> pa.Table:
        v, u, w, p, n, sizes = [], [], [], [], [], []
        for r in (row for batch in rows.to_batches(max_chunksize=8) for row in batch.to_pylist()):
            last, code = unpack_rising(r["four"]), unpack(r["five"]).astype(np.int64)
            code = np.cumsum((code >> 1) ^ -(code & 1))
            at = unpack(r["three"]).astype(np.int64)
            for out, x in ((v, unpack_rising(r["one"])), (u, unpack(r["two"])), (w, last[at]), (p, code[at].astype(np.uint16)), (n, unpack(r["six"]))):
                out.append(x.astype(np.int64) if out is not p else x)
            sizes.append(len(at))
        v, u, w, p, n = (np.concatenate(x) for x in (v, u, w, p, n))
        first, which = distinct_triples(v, u, w)
        count = np.bincount(which, n, len(first)).astype(np.int64)
        v, u, w, p, n, which = v[first], u[first], w[first], p[first], None, which.astype(np.int32)
        asked = (count > 0) | np.isin(v, list(hot_words))
        trie = Trie.build(v[asked], u[asked], w[asked], count[asked], p[asked], hot_words, {k: x[1:] for k, x in pairs.items()})
        codes = np.concatenate([trie.score(*(x[k : k + SLICE] for x in (v, u, w, p))).astype(np.int32) for k in range(0, len(v), SLICE)])[which]
        ends = np.cumsum(sizes)
        part = rows["part"][0].as_py()
        return _rows([{"batch": b, "part": part, "kind": SCORES, "one": pack(codes[end - size : end])} for b, size, end in zip(rows["batch"].to_pylist(), sizes, ends)])

    if supply is None:
        scored = asked.groupBy("part").applyInArrow(lambda rows: answer(rows, {}), _SQL)
    else:

        def supplied(rows: pa.Table, more: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _rows([])
            v, w, n = (np.concatenate([np.zeros(0, np.int64), *[f(b.as_py()).astype(np.int64) for b in more[c]]]) for c, f in zip(("one", "two", "three"), (unpack_rising, unpack, unpack)))
            order = np.lexsort((w, v))
            v, w, n = v[order], w[order], n[order]
            each = np.unique(v)
            ends = np.searchsorted(v, each, side="right")
            hot_words = {int(word): (w[i:j], n[i:j]) for word, i, j in zip(each, [0, *ends[:-1]], ends)}
            return answer(rows, hot_words)

        scored = asked.groupBy("part").cogroup(supply.groupBy("part")).applyInArrow(supplied, _SQL)

    def add_up(body: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Batch(body.drop_columns(["ids"]).to_pylist()[0], docs_of, hot)
        own.trigrams(pairs, parts)
        code = np.zeros(len(own.part), np.int64)
        found = dict(zip(answers["part"].to_pylist(), answers["one"]))
        for k, place in by_part(own.part, parts):
            code[place] = unpack(found[k].as_py()).astype(np.int64)
        n = len(own.counts)
        steps = np.bincount(own.doc, code[own.which], n)
        base = np.bincount(own.doc, np.log10(one(own.count))[own.w], n)
        known = np.bincount(own.doc, own.count[own.w] > 0, n).astype(np.int64)
        columns = [own.held == 1, own.counts + 1, known, np.full(n, total), base, -steps / STEPS]
        return pa.table([body["ids"].chunk(0)[0].values, *[pa.array(c) for c in columns]], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = f"doc_id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return numbered.groupBy("batch").cogroup(scored.groupBy("batch")).applyInArrow(add_up, out)


def _to_shares(parts: int, pairs: dict):
    """A function from packed bigrams (v, w, n, shares) to the same for each part that holds a share of v."""
    most = {}
    for (word, _), (n, _, _) in pairs.items():
        most[word] = max(n, most.get(word, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            v, (w, n, shares) = unpack_rising(row["one"]).astype(np.int64), (unpack(row[c]).astype(np.int64) for c in ("two", "three", "four"))
            each, first, size = np.unique(v, return_index=True, return_counts=True)
            to: dict[int, list[np.ndarray]] = {}
            for word, i, k in zip(each.tolist(), first.tolist(), size.tolist()):
                every, more = np.arange(shares[i], dtype=U64), np.arange(most.get(word, 1), dtype=U64)
                at = U64(word) + (every * U64(0x9E3779B97F4A7C15))[:, None] + (more * U64(0xC2B2AE3D27D4EB4F))[None, :] + U64(1)
                for part in np.unique(tokens.mix(at.ravel()) % U64(parts)).tolist():
                    to.setdefault(part, []).append(np.arange(i, i + k))
            for part, places in to.items():
                at = np.concatenate(places)
                blobs = (pack_rising(v[at]), pack(w[at]), pack(n[at]))
                yield pa.RecordBatch.from_arrays([pa.array([part]), *[pa.array([b], pa.binary()) for b in blobs]], names=["part", "one", "two", "three"])

    return run
