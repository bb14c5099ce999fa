"""Secret scans with multipart credential linking.

Strong secrets are reported wherever they stand. Weak candidates (account names, short or odd
tokens, endpoints) are too common for that: each opens a scope around itself, scopes are
interval-joined with the parts that complement it, and only a candidate with a complement is
reported: a name needs a secret, a weak secret a name, and an endpoint a secret.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import small_arrow_batches

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NAME = re.compile(r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.ASCII)
SITE = re.compile(r"""(?i:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,}""", re.ASCII)
NAME_HINTS = ("@", "user", "login", "account", "client", "access")
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT_HINTS = ("://", "host", "endpoint", "server")


def _from_run(characters: str, rest: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns for what starts with a run of characters and goes on with rest: from the start of a run anywhere, and
    from a given place inside one. The run is taken whole or not at all, so a long one that leads to nothing is read once. Group 1 is the match."""
    return re.compile(rf"(?<![{characters}]){rest}", re.ASCII), re.compile(rest, re.ASCII)


MAIL = _from_run("A-Za-z0-9._+-", r"([A-Za-z0-9._+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
#: A scheme starts with a letter: the first of its run.
URL = _from_run("a-z0-9+.-", r"""[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s"'<>|]+)""")
#: In the order in which spans of one start are listed; the first three are the strong ones.
KINDS = ("assign", "access", "hex", "name", "weak", "endpoint")
#: Code points that a scope reaches to either side.
REACH = 120

Span = tuple[int, int, int]


def strong_spans(text: str, low: str) -> list[Span]:
    """(start, kind, end) of the strong secrets: leftmost matches of each kind, failing ones dropped."""
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def either(word: re.Pattern, run: tuple[re.Pattern, re.Pattern], text: str) -> list[tuple[int, int]]:
    """Leftmost matches of word or run that don't overlap, word's before run's of the same start."""
    anywhere, here = run
    out, at = [], 0
    w, r = word.search(text), anywhere.search(text)
    while True:
        if w and w.start() < at:
            w = word.search(text, at)
        if r and r.start(1) < at:
            r = anywhere.search(text, at)
        found = [(w.start(), 0, w.end())] if w else []
        if r:
            found.append((r.start(1), 1, r.end(1)))
        if at and (inside := here.match(text, at)):  # the last match may have ended within a run
            found.append((inside.start(1), 1, inside.end(1)))
        if not found:
            return out
        start, _, at = min(found)
        out.append((start, at))


def _near(spans: list[Span], others: list[Span], reach: int) -> list[bool]:
    """Which spans have another one within reach: others by start, with running maxima of ends."""
    others = sorted(others)
    starts, ends = [o[0] for o in others], list(accumulate((o[2] for o in others), max))
    out = []
    for start, _, end in spans:
        i = bisect_right(starts, end + reach)
        out.append(i > 0 and ends[i - 1] >= start - reach)
    return out


def linked_spans(text: str, low: str, strong: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates with a complement in scope. Candidates inside strong secrets are those."""
    names = [(start, 3, end) for start, end in either(NAME, MAIL, text)] if any(h in low for h in NAME_HINTS) else []
    sites = [(start, 5, end) for start, end in either(SITE, URL, text)] if any(h in low for h in ENDPOINT_HINTS) else []
    secrets = [s for s in strong if s[1] != 1]
    ids = names + [s for s in strong if s[1] == 1]
    if not ids and (not sites or not strong):
        return []
    weak = []
    if ids:
        weak = [(m.start(), 4, m.end()) for m in WEAK.finditer(text)]
        for taken in (strong, names, sites):
            weak = [s for s, inside in zip(weak, _near(weak, taken, -1)) if not inside]
    weak = [s for s, yes in zip(weak, _near(weak, ids, reach)) if yes]
    names = [s for s, yes in zip(names, _near(names, secrets + weak, reach)) if yes]
    sites = [s for s, yes in zip(sites, _near(sites, strong + weak, reach)) if yes]
    return names + weak + sites


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans lists kind:start:end (code points, end exclusive) by start and kind, joined by commas;
    base_sha256 is the SHA-256 of the strong ones listed so. Null and empty texts have none.
    Spans of different kinds may overlap; those of one kind don't. Repeated rows and null ids
    stay; an empty table gives no rows. Whole texts are scanned, a document per step, without a
    shuffle.
    """
    small_arrow_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans, linked = ([], [], []), [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                low = text.lower()
                strong = strong_spans(text, low)
                more = linked_spans(text, low, strong, reach)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in strong))
                sha.append(hashlib.sha256(listed(strong).encode()).hexdigest())
                spans.append(listed(strong + more))
                linked.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(linked, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return read.mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint")
