"""Secret scans over a trigram index.

Every rule's regular expression is turned into a Boolean query over trigrams that any
match must contain (:func:`trigram_query`). Texts are read in blocks; for each block an
inverted index maps the trigrams that the rules ask for to the texts that have them, a
rule's query is answered by intersecting and joining postings, and only candidates are
verified with the expression. A rule without a mandatory trigram scans all texts. The
index is per block and lives in the task, so nothing is shuffled or written and hot
trigrams stay inside their block; :func:`postings` gives it as a table for reuse.

Offsets are code points, end exclusive. Trigrams are of lower-cased ASCII bytes, so a
query never misses a match in other letter case; candidates are verified exactly.

Defined results: a null text counts as empty and has no span; null and repeated ids
stay rows of their own; an empty table gives an empty result; other columns are
ignored. Spans of one kind never overlap; equal starts are listed in the order of the
rules.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text indexed together, about; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``; dropped if ``measured`` group is shorter than ``least``."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 0


# The base kinds' patterns and least lengths.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# A private key from its first line to its last; without one, to the end of its headers and base64 lines.
# Lines may be parted by escaped line breaks or blanks.
_KEY_ENDS = r"(?:(?!-----)[\s\S])*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
_KEY_LINES = (
    r"(?:(?:\s|\\[nr])+(?:Proc-Type|DEK-Info): [^\n\\]*)*(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{16,})+"
    r"(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]{1,15}={0,2}(?=\s*\Z|[ \t]*\r?\n|\\n))?"
)
# Published token shapes of common services, and private keys.
MORE = (
    Rule("private_key", rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:{_KEY_ENDS}|{_KEY_LINES})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


# --- trigram queries ----------------------------------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", members).

_MOST_STRINGS = 16


def _combine(kind: str, members: list):
    if kind == "and":
        members = [m for m in members if m is not True]
        if not members:
            return True
    elif any(m is True for m in members):
        return True
    members = list(dict.fromkeys(members))
    return members[0] if len(members) == 1 else (kind, tuple(members))


def _of_string(s: str):
    return _combine("and", [s[i:i + 3] for i in range(len(s) - 2)])


def _of_strings(strings: list[str]):
    return _combine("or", [_of_string(s) for s in strings])


def _sequence(items) -> tuple[list[str] | None, object]:
    """(all strings an expression can match, or None if too many; query that any match meets)."""
    exact: list[str] = [""]
    query: list = []

    def close() -> None:
        nonlocal exact
        query.append(_of_strings(exact))
        exact = [""]

    closed = False
    for item in items:
        strings, needs = _item(item)
        if strings is None:
            close()
            closed = True
            query.append(needs)
            continue
        if len(exact) * len(strings) > _MOST_STRINGS:
            close()
            closed = True
        exact = [a + b for a in exact for b in strings]
        if len(exact) > _MOST_STRINGS:
            exact, closed = [""], True
    if closed:
        close()
        return None, _combine("and", query)
    return exact, _of_strings(exact)


def _item(item) -> tuple[list[str] | None, object]:
    kind, value = item
    if kind == op.LITERAL:
        c = chr(value).lower()
        return ([c], True) if c.isascii() else (None, True)
    if kind == op.SUBPATTERN:
        return _sequence(value[3])
    if kind == op.BRANCH:
        parts = [_sequence(b) for b in value[1]]
        if all(s is not None for s, _ in parts):
            strings = list(dict.fromkeys(x for s, _ in parts for x in s))
            if len(strings) <= _MOST_STRINGS:
                return strings, _of_strings(strings)
        return None, _combine("or", [q for _, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, needs = _sequence(body)
        if low == high == 1:
            return strings, needs
        if low == 0 and high == 1 and strings is not None:
            return ["", *strings], True
        return None, needs if low else True
    if kind == op.IN and all(k == op.LITERAL for k, _ in value):
        members = sorted({chr(v).lower() for _, v in value})
        if len(members) <= _MOST_STRINGS and all(c.isascii() for c in members):
            return members, True
    if kind == op.AT:
        return [""], True
    return None, True


def trigram_query(pattern: str):
    """What any text that ``pattern`` matches must contain: True if nothing can be said."""
    return _sequence(parser.parse(pattern))[1]


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


# --- the index of a block -----------------------------------------------------------

class TrigramIndex:
    """Postings (ascending text numbers) of the wanted trigrams in one block of texts."""

    def __init__(self, texts: list[bytes], wanted: dict[str, int], slots: np.ndarray):
        self.all = np.arange(len(texts))
        joined = np.frombuffer(b"\n".join(texts), np.uint8)
        joined = np.where((joined >= 65) & (joined <= 90), joined + 32, joined).astype(np.uint32)
        code = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:] if len(joined) > 2 else np.zeros(0, np.uint32)
        slot = slots[code]
        at = np.flatnonzero(slot)
        ends = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(ends, at, "right")
        pairs = np.unique(slot[at].astype(np.int64) * len(texts) + owner) if len(texts) else np.zeros(0, np.int64)
        slot, owner = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        cut = np.searchsorted(slot, np.arange(1, len(wanted) + 2))
        self.postings = {g: owner[cut[i - 1]:cut[i]] for g, i in wanted.items()}

    def answer(self, query) -> np.ndarray:
        """Texts that meet a query; trigrams do not cross texts as none contains the newline between them."""
        if query is True:
            return self.all
        if isinstance(query, str):
            return self.postings[query]
        kind, members = query
        found = sorted((self.answer(m) for m in members), key=len)
        out = found[0]
        for f in found[1:]:
            if kind == "and":
                if not len(out):
                    break
                out = np.intersect1d(out, f, assume_unique=True)
            else:
                out = np.union1d(out, f)
        return out


class Scanner:
    """Compiled rules with their queries; made once per task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.wanted = {g: i + 1 for i, g in enumerate(sorted(set().union(*[_trigrams(q) for _, _, q in self.rules])))}
        self.slots = np.zeros(1 << 24, np.uint16)
        for g, i in self.wanted.items():
            a, b, c = g.encode()
            self.slots[a << 16 | b << 8 | c] = i

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text, spans (start, number of the rule, end), sorted."""
        index = TrigramIndex([t.encode() for t in texts], self.wanted, self.slots)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, compiled, query) in enumerate(self.rules):
            for i in index.answer(query).tolist():
                for m in compiled.finditer(texts[i]):
                    a, b = m.span(rule.measured)
                    if b - a >= rule.least:
                        out[i].append((m.start(), n, m.end()))
        for spans in out:
            spans.sort()
        return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Slices of a column of texts of about BLOCK_BYTES: (place of the first, texts)."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= BLOCK_BYTES:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans as (kind, begin, end), by begin and then the order of the rules; one row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first, texts in _blocks(batch["text"]):
                rows = [[{"kind": kinds[n], "begin": a, "end": b} for a, n, b in s] for s in scanner.scan(texts)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(first, len(texts)), pa.array(rows, kind)], names=["doc_id", "spans"])

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,begin:bigint,end:bigint>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, their digest and all spans as text, from :func:`find_secrets`."""
    base = [r.kind for r in BASE]

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin.cast("string"), s.end.cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    found = find_secrets(docs, RULES, id_col, text_col)
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in base],
        F.sha2(said(F.filter("spans", lambda s: s.kind.isin(base))).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = "[{kind}]") -> DataFrame:
    """The rows with every span replaced by its mask, other columns as they are; a null text stays null.

    Overlapping spans of different kinds are masked as one, under the first one's kind.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = []
            for _, block in _blocks(batch.column(at).fill_null("")):
                for text, spans in zip(block, scanner.scan(block)):
                    parts, done = [], 0
                    for a, n, b in spans:
                        if a >= done:
                            parts += [text[done:a], mask.format(kind=rules[n].kind)]
                        done = max(done, b)
                    texts.append("".join(parts) + text[done:] if spans else text)
            old = batch.column(at)
            new = pa.array([None if gone else t for gone, t in zip(old.is_null().to_pylist(), texts)], pa.string())
            columns = [new if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc_ids): the inverted index as a table, one row per block and trigram; hot trigrams stay in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for first, texts in _blocks(batch["text"]):
                ids = batch["id"].slice(first, len(texts))
                index = TrigramIndex([t.encode() for t in texts], scanner.wanted, scanner.slots)
                have = [(g, ids.take(pa.array(p)).to_pylist()) for g, p in index.postings.items() if len(p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in have], pa.string()), pa.array([p for _, p in have], pa.list_(pa.int64()))],
                    names=["trigram", "doc_ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "trigram string, doc_ids array<long>")
