"""Tokenizer alignment against whole documents that are tokenised whole."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import alignment
from tests.llm.conftest import prose

ODD = [
    None, "", " ", "  ", "\n", "a ", "a  ", "\n\n a\n", "x▁y", "é\xa0z  q", "<|endoftext|> <s> </s> <unk>", "日本語　 テスト", "it's  don't\r\n ok", "a\t b\t\nc",
    "\x00a \x85 b", "  x\x1c y", "x" * 3000, "ｆｕｌｌ  wide", " lead", "tab\there", "🙂 🙂🙂 a🙂\n🙂", "a\n\nb\n c", "same words", "same words",
]


def spans(ids, sizes):
    ends = np.cumsum([sizes[i] for i in ids]).tolist()
    return list(zip([0, *ends], ends, ids))


def brute(texts):
    t = alignment.Tokenizers(alignment.FOLDER)
    found = []
    for text in texts:
        text = text or ""
        a = t.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        whole = (" " + text).encode()
        if not text or b"".join(t.a_bytes[i] for i in a) != whole or b"".join(t.b_bytes[i] for i in b) != whole:
            found.append(None)
            continue
        a, b = spans(a, t.a_size), spans(b, t.b_size)
        links = [(i, j) for s, e, i in a for p, q, j in b if s < q and p < e]
        groups, before = [], 0
        for cut in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
            groups.append("|".join(",".join(str(i) for _, e, i in side if before < e <= cut) for side in (a, b)))
            before = cut
        found.append((len(a), len(b), groups, links))
    held = Counter(pair for f in found if f for pair in set(f[3]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(n, best.get(a, 0))
    for f in found:
        if f is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = f
            yield (n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 50, "part_bytes": 100}])
def test_odd_texts(spark, sizes):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, at string, part int")
    got = [tuple(r)[1:] for r in alignment.align_tokenizers(docs, **sizes).orderBy("doc_id").collect()]
    assert got == list(brute(ODD))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = [tuple(r)[1:] for r in alignment.align_tokenizers(docs, batch_bytes=50_000, part_bytes=100_000).orderBy("doc_id").collect()]
    assert len(got) > 50 and got == list(brute(texts))


def test_groups_are_what_is_hashed(spark):
    docs = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, "others")], "doc_id long, text string")
    rows = alignment.align_tokenizers(docs, keep_groups=True).collect()
    assert len(rows) == 3 and all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in rows)


def test_segments_cover_their_texts():
    texts = pa.array([*ODD, prose(3, 500), *ODD])
    segments, counts = alignment.split(texts)
    at, words = 0, segments.to_pylist()
    for text, n in zip(texts.to_pylist(), counts.tolist()):
        assert "".join(words[at : at + n]) == (" " + text if text else "")
        at += n
    assert at == len(words)


def test_vocabularies_are_verified(tmp_path, monkeypatch):
    t = alignment.Tokenizers(alignment.FOLDER)
    assert len(t.a_bytes) == 50_257 and len(t.b_bytes) == 32_000
    pieces = type("Pieces", (), {"id_to_piece": lambda self, i: ["a", "b▁c"][i], "get_piece_size": lambda self: 2})
    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", lambda model_file: pieces())
    with pytest.raises(ValueError, match="over a space"):
        alignment.Tokenizers(alignment.FOLDER)
