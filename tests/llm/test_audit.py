"""The audit of filters against filtering in every order."""

import re
from itertools import permutations

from tessella.llm import audit
from tests.llm.conftest import prose



def brute(docs, labels):
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and smallest[text] < i}
        rows.append((lang or "", {k for k, yes in fails.items() if yes}, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(t == 1 for j, _, t in labels if j == i and i is not None)))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, found = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                earlier = [r for r in own if f in r[1] and r[1] & set(order[: step - 1])]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), len(earlier), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def awkward():
    long_ = prose(1, 120).replace("\n", " ")
    texts = [None, "", " \t", "ABC", long_, long_, long_ + " #", "same " * 150, "Same SAME " * 80, prose(2, 400), prose(2, 400).upper(), "x" * 5000, "é " * 120 + "$"]
    docs = [(k, t, ["en", "de", None][k % 3]) for k, t in enumerate(texts)]
    docs += [(4, long_, "en"), (4, long_, "de"), (4, "another text", "en"), (None, long_, "en"), (None, "", None), (30, prose(2, 400), "en")]
    return docs, [(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (7, 1, 1), (99, 1, 1), (9, 1, 0)]


def test_every_order(spark):
    docs, labels = awkward()
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, mask string, digest int")
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, part int")
    got = sorted(tuple(r) for r in audit.audit(frame, marks).collect())
    assert got == brute(docs, labels)
    assert sorted(tuple(r) for r in audit.audit(frame, marks, hot=1).collect()) == got


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and sum(r["removed"] for r in rows) == 120
