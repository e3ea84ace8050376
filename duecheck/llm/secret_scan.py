"""Secret scans: a trigram index per block of documents, Boolean trigram queries, verified candidates.

Each rule is a regular expression. From its parse tree a Boolean query over
trigrams is derived that every match fulfils (a trigram, a conjunction or a
disjunction; True where nothing is mandatory). A block of documents is indexed:
one vectorised pass over its bytes, lower-cased, gives the postings of every
trigram that some query names. Postings are intersected and united as the query
says, and only the documents left are matched by the expression itself. Rules
without mandatory trigrams match every document. Blocks are Arrow batches, so
memory is bounded by the batch and the single text, and a lost task repeats its
own batches only. No rows are shuffled.

Defined results: a null text counts as empty and has no spans. Spans count code
points. Overlapping spans of unlike kinds all stay. Every input row, repeated
or without an id, gives one row. An empty table gives none.
"""

import re
import re._constants as c
import re._parser as parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecheck.llm.common import small_batches

SPANS = "array<struct<kind:string,start:int,end:int>>"
_MOST_STRINGS = 64
_CLASS_LIMIT = 12


@dataclass(frozen=True)
class Rule:
    """``keep`` decides whether a match counts."""

    kind: str
    pattern: str
    ignore_case: bool = False
    keep: Callable[[re.Match], bool] | None = None

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


BASE = [
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        True,
        lambda m: m.end(2) - m.start(2) >= 12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", keep=lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of 16 and more; a run has no shorter match inside
]

ADDED = [
    Rule("aws_temporary", r"\bASIA[A-Z0-9]{16}\b"),
    Rule("github", r"\bgh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"\bgithub_pat_[A-Za-z0-9_]{40,}"),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"\bya29\.[A-Za-z0-9_-]{20,}"),
    Rule("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]{4,}@[^\s/]+", True),
    Rule("bearer", r"\bbearer\x20+[A-Za-z0-9._~+/-]{20,}=*", True),
    Rule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("twilio", r"\b(?:AC|SK)[0-9a-f]{32}\b"),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"\bpypi-AgEI[A-Za-z0-9_-]{40,}"),
    Rule("azure_key", r"AccountKey=[A-Za-z0-9+/]{60,}={0,2}"),
    Rule("digitalocean", r"\bdo[por]_v1_[0-9a-f]{64}"),
    Rule("shopify", r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}"),
]
RULES = BASE + ADDED

Query = object  # True, a trigram (bytes), or ("and" | "or", frozenset of queries)


def _combine(how: str, parts) -> Query:
    """A flat conjunction or disjunction; True where it says nothing."""
    flat: set = set()
    for p in parts:
        if p is True and how == "or":
            return True
        if p is not True:
            flat |= p[1] if isinstance(p, tuple) and p[0] == how else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (how, frozenset(flat))


def _trigrams(strings) -> Query:
    """One of ``strings`` occurs."""

    def one(s: bytes) -> Query:
        return _combine("and", {s[i : i + 3] for i in range(len(s) - 2)})

    return _combine("or", [one(s) for s in strings]) if strings else True


@dataclass(frozen=True)
class Shape:
    """What a sub-expression matches: exactly these strings, or ones that begin, end and hold so."""

    exact: frozenset | None = None
    prefix: frozenset = frozenset({b""})
    suffix: frozenset = frozenset({b""})
    query: Query = field(default=True)


_ANY = Shape()


def _settle(s: Shape) -> Shape:
    """Give up sets that have grown too large, keeping the trigrams they force."""
    if s.exact is not None and len(s.exact) > _MOST_STRINGS:
        s = Shape(None, s.exact, s.exact, _combine("and", [s.query, _trigrams(s.exact)]))
    if s.exact is not None:
        return s
    query, prefix, suffix = s.query, s.prefix, s.suffix
    if len(prefix) > _MOST_STRINGS:
        query, prefix = _combine("and", [query, _trigrams(prefix)]), frozenset(p[:2] for p in prefix)
    if len(suffix) > _MOST_STRINGS:
        query, suffix = _combine("and", [query, _trigrams(suffix)]), frozenset(p[-2:] for p in suffix)
    prefix = prefix if len(prefix) <= _MOST_STRINGS else frozenset({b""})
    suffix = suffix if len(suffix) <= _MOST_STRINGS else frozenset({b""})
    return Shape(None, prefix, suffix, query)


def _ends(s: Shape) -> tuple[frozenset, frozenset]:
    return (s.exact, s.exact) if s.exact is not None else (s.prefix, s.suffix)


def _then(a: Shape, b: Shape) -> Shape:
    if a.exact is not None and b.exact is not None:
        return _settle(Shape(frozenset(x + y for x in a.exact for y in b.exact)))
    middle = {x + y for x in _ends(a)[1] for y in _ends(b)[0]}
    query = _combine("and", [a.query, b.query, _trigrams(middle)])
    prefix = frozenset(x + y for x in a.exact for y in b.prefix) if a.exact is not None else a.prefix
    suffix = frozenset(x + y for x in a.suffix for y in b.exact) if b.exact is not None else b.suffix
    forced = [query, _trigrams(prefix), _trigrams(suffix)]
    return _settle(Shape(None, prefix, suffix, _combine("and", forced)))


def _either(a: Shape, b: Shape) -> Shape:
    if a.exact is not None and b.exact is not None:
        return _settle(Shape(a.exact | b.exact))

    def whole(s: Shape) -> Query:
        return _combine("and", [s.query, _trigrams(s.exact)]) if s.exact is not None else s.query

    (ap, az), (bp, bz) = _ends(a), _ends(b)
    return _settle(Shape(None, ap | bp, az | bz, _combine("or", [whole(a), whole(b)])))


def _chars(items) -> Shape:
    codes: set[int] = set()
    for op, value in items:
        if op is c.LITERAL:
            codes.add(value)
        elif op is c.RANGE and value[1] - value[0] < _CLASS_LIMIT:
            codes |= set(range(value[0], value[1] + 1))
        else:
            return _ANY
    return Shape(frozenset(chr(x).lower().encode() for x in codes)) if len(codes) <= _CLASS_LIMIT else _ANY


def _shape(tree) -> Shape:
    out = Shape(frozenset({b""}))
    for op, value in tree:
        if op is c.LITERAL:
            part = Shape(frozenset({chr(value).lower().encode()}))
        elif op is c.IN:
            part = _chars(value)
        elif op is c.SUBPATTERN:
            part = _shape(value[3])
        elif op is c.BRANCH:
            part = reduce(_either, [_shape(x) for x in value[1]])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, inner = value
            once = _shape(inner)
            if most == 1:
                part = _either(once, Shape(frozenset({b""})))
            elif least == 0:
                part = _ANY
            else:
                head = reduce(_then, [once] * min(least, 3))
                part = head if least == most <= 3 else _then(head, _ANY)
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            continue
        else:
            part = _ANY
        out = _then(out, part)
    return out


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query (lower case, UTF-8) that each text with a match fulfils."""
    s = _shape(parser.parse(pattern, flags))
    return _trigrams(s.exact) if s.exact is not None else s.query


def _named(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(_named(q) for q in query[1]))


class TrigramIndex:
    """Postings of the trigrams that ``queries`` name, for one block of documents at a time."""

    def __init__(self, queries: list[Query]) -> None:
        named = sorted(set().union(*(_named(q) for q in queries)))
        self.place = {t: i for i, t in enumerate(named)}
        letters = sorted({b for t in named for b in t})
        if len(letters) > 255:
            raise ValueError("too many unlike bytes in the rules")
        self.codes = np.zeros(256, np.uint32)
        self.codes[letters] = np.arange(1, len(letters) + 1)
        upper = np.arange(ord("A"), ord("Z") + 1)
        self.codes[upper] = self.codes[upper + 32]
        self.bits = max(1, len(letters).bit_length())
        self.known = np.zeros(1 << (3 * self.bits), np.int32)
        for t, i in self.place.items():
            x, y, z = (int(self.codes[b]) for b in t)
            self.known[(x << 2 * self.bits) | (y << self.bits) | z] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of flags per trigram: which documents hold it."""
        out = np.zeros((len(self.place) + 1, len(offsets) - 1), bool)
        if len(data) < 3:
            return out
        code = self.codes[data]
        grams = (code[:-2] << 2 * self.bits) | (code[1:-1] << self.bits) | code[2:]
        found = self.known[grams]
        at = np.flatnonzero(found)
        doc = np.searchsorted(offsets, at, "right") - 1
        whole = at + 3 <= offsets[doc + 1]
        out[found[at[whole]], doc[whole]] = True
        return out

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.place[query] + 1]
        how = np.logical_and if query[0] == "and" else np.logical_or
        return how.reduce([self.candidates(q, postings) for q in query[1]])


def spans_of(rule: Rule, matcher: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in matcher.finditer(text) if rule.keep is None or rule.keep(m)]


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and spans of every row; spans by start, then by the order of the rules."""
    small_batches(docs.sparkSession)
    queries = [trigram_query(r.pattern, r.flags) for r in rules]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(queries)
        matchers = [re.compile(r.pattern, r.flags) for r in rules]
        for batch in batches:
            texts = pa.compute.fill_null(batch.column("text"), "").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            postings = index.postings(data, offsets - offsets[0])
            found: list[list] = [[] for _ in range(len(texts))]
            strings: dict[int, str] = {}
            for n, (rule, query, matcher) in enumerate(zip(rules, queries, matchers, strict=True)):
                for i in np.flatnonzero(index.candidates(query, postings)):
                    if i not in strings:
                        strings[i] = texts[int(i)].as_py().decode()
                    found[i] += [(s, n, rule.kind, e) for s, e in spans_of(rule, matcher, strings[i])]
            spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(x)] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        blocks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}"
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, a hash of the base spans and all spans as one string."""
    kinds = [r.kind for r in BASE]
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(F.concat_ws(",", F.transform(base, text)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"),
    )
