"""License scans with a positional rare-token index. DataFrame functions only.

Templates are word sequences with a mandatory key phrase. Each is posted under the word of its
key phrase that is rarest over the whole corpus; the index maps such words to their postings. A
file looks up those of its words, each hit puts the templates of its posting at relative
positions, and there the other words are intersected and the key phrase verified. As a key phrase
holds its own rarest word, no place of it is missed. There is one expression for all templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words: all of ASCII but digits and (lower-cased) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: label, whole template, mandatory key phrase.
BASE = (
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
#: The words of common licence notices, with the phrase that each must hold.
NOTICES = (
    ("afl", "licensed under the academic free license version 3 0", "academic free license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("artistic", "the artistic license 2 0", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "used to endorse or promote products derived from"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause"),
    ("bsd", "bsd 2 clause license", "bsd 2 clause"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("cddl", "common development and distribution license version 1 0", "common development and distribution license"),
    ("creative-commons", "creative commons attribution", "creative commons"),
    ("epl", "eclipse public license version 2 0", "eclipse public license"),
    ("eupl", "european union public licence version 1 2", "european union public licence"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms"),
    ("ms-pl", "microsoft public license ms pl", "microsoft public license"),
    ("odbl", "open data commons open database license", "open database license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement is hereby granted"),
    ("python", "python software foundation license version 2", "python software foundation license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license", "fuck you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)
#: Names that stand after a file's license tag.
TAGS = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")


def _tagged(name: str) -> tuple[str, str, str]:
    words = "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")
    return f"spdx:{name.lower()}", words, words


TEMPLATES = (*NOTICES, *map(_tagged, TAGS))


def _table(templates) -> list[dict]:
    """Templates with their words, and where the key phrase stands in them."""
    found = []
    for number, (label, text, phrase) in enumerate(templates):
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        found.append({"number": number, "label": label, "words": words, "key_at": at, "key": key})
    return found


def words_of(text: Column) -> Column:
    """Lower-cased words of a whole text; null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), BETWEEN), ""), F.array().cast("array<string>"))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each licence word stands, over all documents. The result has at most
    one row per word of the templates, whatever the size of the corpus."""
    present = F.array_intersect(words_of(F.col(text_col)), F.array(*[F.lit(w) for w in vocabulary]))
    counted = docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {row["word"]: row["n"] for row in counted.collect()}


def _postings(table: list[dict], df: dict[str, int]) -> list[dict]:
    """Each template under the rarest word of its key phrase: the highest IDF, ties to the first."""
    for t in table:
        word = min(t["key"], key=lambda w: (df.get(w, 0), t["key"].index(w)))
        t |= {"anchor": word, "anchor_at": t["key_at"] + t["key"].index(word)}
    return table


def _index(table: list[dict]) -> Column:
    """map<anchor, array<struct<number, label, key, shift, words, key_at>>>: the postings."""
    by: dict[str, list[Column]] = {}
    for t in table:
        fields = {"number": F.lit(t["number"]), "label": F.lit(t["label"]), "key": F.array(*map(F.lit, t["key"])), "shift": F.lit(t["anchor_at"] - t["key_at"]), "words": F.array(*map(F.lit, t["words"])), "key_at": F.lit(t["key_at"])}
        by.setdefault(t["anchor"], []).append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return F.create_map(*[x for word, postings in by.items() for x in (F.lit(word), F.array(*postings))])


def _matches(words: Column, present: Column, index: Column) -> Column:
    """array<struct<number, label, start, score>>: verified places of all templates in an array of
    words, of which present are anchors. start is where a key phrase starts."""
    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(present, F.get(words, i)))

    def verified(i: Column) -> Column:
        def fits(p: Column) -> Column:
            start, length = i - p["shift"], F.size(p["key"])
            inside = (start >= 0) & (start + length <= F.size(words))
            return F.when(inside, F.slice(words, F.greatest(start, F.lit(0)) + 1, length) == p["key"]).otherwise(F.lit(False))

        def scored(p: Column) -> Column:
            start = i - p["shift"]
            whole = p["words"]
            same = F.filter(F.sequence(F.lit(0), F.size(whole) - 1), lambda k: F.coalesce(F.get(words, start - p["key_at"] + k) == F.get(whole, k), F.lit(False)))
            return F.struct(p["number"].alias("number"), p["label"].alias("label"), start.cast("long").alias("start"), (F.size(same) / F.size(whole).cast("double")).alias("score"))

        return F.transform(F.filter(F.element_at(index, F.get(words, i)), fits), scored)

    return F.flatten(F.transform(hits, verified))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, matches.

    matches holds every verified place as struct<label, start, score>; score is its best, the
    part of a template's words that stand where the template has them, 0 without a match. Base
    templates are the first ones; n_base, first_word, last_word and base_labels are theirs alone.
    Null and empty texts have no words and no match. Repeated rows stay, as do rows with a null
    id. An empty table gives none. Other columns of docs are not read, whatever their names. A text
    is split whole, however long; its words are in memory at once.
    """
    table = _table((*base, *templates))
    vocabulary = sorted({w for t in table for w in t["key"]})
    table = _postings(table, document_frequencies(docs, vocabulary, text_col))
    read = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    empty = F.array().cast("array<struct<number:int,label:string,start:bigint,score:double>>")
    anchors = F.array(*[F.lit(w) for w in sorted({t["anchor"] for t in table})])
    looked = read.withColumn("present", F.array_intersect("words", anchors))
    found = F.when(F.size("present") > 0, _matches(F.col("words"), F.col("present"), _index(table))).otherwise(empty)
    placed = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("every"))
    placed = placed.withColumn("base", F.filter("every", lambda m: m["number"] < len(base)))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform(F.col("base"), lambda m: m["start"])
    matches = F.transform("every", lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"), m["score"].alias("score")))
    return placed.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("every")).alias("labels"),
        F.coalesce(F.array_max(F.transform("every", lambda m: m["score"])), F.lit(0.0)).alias("score"), matches.alias("matches"),
    )


def _values() -> str:
    rows = []
    for t in _table((*BASE, *TEMPLATES)):
        for i, w in enumerate(t["words"]):
            key = t["key_at"] <= i < t["key_at"] + len(t["key"])
            rows.append(f"({t['number']}, '{t['label']}', {i - t['key_at']}, '{w}', {int(key)}, {len(t['key'])}, {len(t['words'])})")
    return ",\n  ".join(rows)


#: The query's rows by joining all words with all template words at equal relative positions.
SQL = (
    r"""
WITH template(number, label, k, word, is_key, n_key, n_all) AS (VALUES
  """
    + _values()
    + r"""),
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM split),
place AS (
  SELECT w.doc_id, t.number, t.label, w.pos - t.k AS start, count(*) AS n, sum(t.is_key) AS n_key_found, any_value(t.n_key) AS n_key, any_value(t.n_all) AS n_all
  FROM word w JOIN template t ON w.word = t.word GROUP BY w.doc_id, t.number, t.label, w.pos - t.k),
found AS (SELECT doc_id, number, label, start, n / n_all AS score FROM place WHERE n_key_found = n_key),
per AS (
  SELECT doc_id, count(*) FILTER (number < 3) AS n_base, min(start) FILTER (number < 3) AS first_word, max(start) FILTER (number < 3) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (number < 3) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(coalesce(p.n_base, 0) AS BIGINT) AS n_base, CAST(p.first_word AS BIGINT) AS first_word, CAST(p.last_word AS BIGINT) AS last_word,
  coalesce(p.base_labels, '') AS base_labels, coalesce(p.labels, '') AS labels, CAST(coalesce(p.score, 0) AS DOUBLE) AS score
FROM split s LEFT JOIN per p ON s.doc_id = p.doc_id
"""
)
