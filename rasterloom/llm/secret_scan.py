"""Secrets in texts: fixed patterns, and literals that end up in names that say they are secret.

Beside the patterns, a small lexer reads source and configuration syntax: names, quoted literals, bare values,
assignment signs, block scalars and elements. It keeps what each name was last given, follows names and folds
concatenations (constant propagation), and scores each literal that reaches a sensitive name, alone and as part of
what it is concatenated to, by the name and by the value's look. Values are kept as counts of characters and terms
refer to earlier ones, so texts that double a value on every line cost what their lines do. Every text that holds an
assignment sign or an element's end is lexed whole, however long.

Nulls count as empty texts. Repeated rows come back as often as they came; an empty table gives no rows; extra
columns don't matter. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rasterloom.llm.common import bounded_batches

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Literals are added from this sum of their own score and their name's on.
THRESHOLD = 1.5
LOWER, UPPER, DIGITS = (frozenset(map(chr, range(ord(a), ord(b) + 1))) for a, b in ("az", "AZ", "09"))
#: What a name's parts say.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "auth": 0.5, "key": 0.4, "private": 0.4, "access": 0.2, "api": 0.4, "signature": 0.3, "pass": 0.6,
}
PLACEHOLDER = re.compile(r"(?i)(?:your|my|changeme|example|placeholder|dummy|xxx+|\*+|<.*>|\$\{.*\}|none|null|true|false|todo|test)[\w-]*\Z")
LEX = re.compile(
    r"""(?P<comment>(?<![:\w])(?:\#|//)[^\n]*)"""
    r"""|(?P<quoted>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<element><(?P<tag>[A-Za-z_][\w.-]*)(?:[ \t][^<>\n]*)?>(?P<body>[^<>\n]+)</(?P=tag)>)"""
    r"""|(?P<block>(?<=:[ ])[|>][+-]?[ \t]*\n(?:[ \t]+\S[^\n]*(?:\n|\Z))+)"""
    r"""|(?P<sign>:=|=>|->|==|!=|<=|>=|[=:+(),;{}\[\]])"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*)"""
    r"""|(?P<bare>[A-Za-z0-9+/_.=-]{6,})"""
    r"""|(?P<end>\n)"""
)
#: An unquoted value, read whole where a value is due.
BARE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
LINE = re.compile(r"[^\s][^\n]*?(?=[ \t]*(?:\n|\Z))")


def name_score(name: str) -> float:
    """The sum of what a name's parts say; camelCase, snake_case, kebab-case and dots separate parts."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    joined = "".join(parts)
    return max([sum(SENSITIVE.get(p, 0.0) for p in parts), *(w for k, w in SENSITIVE.items() if w >= 1 and k in joined)], default=0.0)


@dataclass(frozen=True)
class Value:
    """What a score needs of a string: however often concatenations double it, it stays as small as its alphabet."""

    length: int
    counts: Counter
    stand_in: bool  # nothing but placeholders

    @staticmethod
    def of(text: str) -> Value:
        return Value(len(text), Counter(text), bool(PLACEHOLDER.match(text)))

    def __add__(self, other: Value) -> Value:
        return Value(self.length + other.length, self.counts + other.counts, self.stand_in and other.stand_in)

    def score(self) -> float:
        """How much it looks like a secret: its length, its kinds of characters and its entropy."""
        if self.length < 6 or self.stand_in or " " in self.counts:
            return 0.0
        shares = [n / self.length for n in self.counts.values()]
        entropy = -sum(x * math.log2(x) for x in shares if x)
        kinds = len({"a" if c in LOWER else "A" if c in UPPER else "0" if c in DIGITS else "." for c in self.counts})
        return 0.3 * (kinds >= 2) + 0.3 * min(1.0, entropy / 3.5) + 0.4 * min(1.0, self.length / 16)


def literal_score(text: str) -> float:
    return Value.of(text).score()


@dataclass
class Term:
    """A concatenation that a name is given: literals of its own, and terms that it takes from names."""

    name: str
    value: Value
    literals: list[tuple[int, int, Value]]
    uses: list[Term]


def terms(text: str) -> list[Term]:
    """Every concatenation that an assignment gives a name, in the order of the text."""
    found: list[Term] = []
    known: dict[str, list[Term]] = {}
    target: str | None = None  # the name being assigned
    last: str | None = None  # the name just read
    mine: list[Term] = []  # what the target got so far
    glued = False  # a plus sign was read after it

    def close() -> None:
        nonlocal target, mine, glued
        if target is not None and mine:
            known[target] = mine
            found.extend(mine)
        target, mine, glued = None, [], False

    def take(value: Value, literals: list[tuple[int, int, Value]], uses: list[Term]) -> None:
        nonlocal glued
        if glued and mine:
            mine[-1] = Term(target, mine[-1].value + value, mine[-1].literals + literals, mine[-1].uses + uses)
        else:
            mine.append(Term(target, value, literals, uses))
        glued = False

    def literal(start: int, end: int) -> None:
        if end > start:
            take(value := Value.of(text[start:end]), [(start, end, value)], [])

    at = 0
    while m := LEX.search(text, at):
        at, kind, read = m.end(), m.lastgroup, m.group()
        if kind == "end" or kind == "sign" and read in ",;{}":
            if not (kind == "end" and glued):  # a line that ends in a plus sign goes on
                close()
            last = None
        elif kind == "sign":
            if read in ("=", ":", ":=", "=>") and last is not None:
                close()
                target, last = last, None
            glued = read == "+" or glued and read in "()"
        elif m["element"] is not None:
            close()
            target = m["tag"]
            literal(*m.span("body"))
            close()
            last = None
        elif kind == "block":
            for line in LINE.finditer(text, *m.span()):
                if line.start() > m.start():
                    literal(*line.span())
            if len(mine) > 1:  # whole, and line by line
                mine.append(Term(target, functools.reduce(Value.__add__, (t.value for t in mine)), [x for t in mine for x in t.literals], []))
            close()
            last = None
        elif kind == "quoted":
            if target is None:
                last = read[1:-1]  # a quoted key
            else:
                literal(m.start() + 1, m.end() - 1)
        elif target is None:
            last = read if kind == "name" else None
        elif kind == "name" and read in known:
            for t in known[read]:
                take(t.value, [], [t])
            last = read
        else:
            if not mine or glued:
                whole = BARE.match(text, m.start())
                if kind == "bare" or whole and re.search(r"\d", whole.group()):
                    at = max(at, whole.end())
                    literal(*whole.span())
            last = read if kind == "name" else None
    close()
    return found


def added(text: str) -> set[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly, by other names or in concatenations, and score.

    Terms use only earlier ones, so one sweep from the last to the first tells of each the most sensitive name that it
    reaches, and whether a concatenation that it is part of scores as a whole.
    """
    reach: dict[int, float] = {}
    spans: set[tuple[int, int]] = set()
    part: set[int] = set()
    scores: dict[str, float] = {}
    for t in reversed(terms(text)):
        own = scores.get(t.name)
        if own is None:
            own = scores[t.name] = name_score(t.name)
        best = max(own, reach.pop(id(t), 0.0))
        whole = id(t) in part or secret(own, t.value.score())
        spans.update((a, b) for a, b, v in t.literals if whole or secret(best, v.score()))
        for u in t.uses:
            reach[id(u)] = max(best, reach.get(id(u), 0.0))
            if whole:
                part.add(id(u))
    return spans


def secret(name: float, literal: float) -> bool:
    return name > 0.5 and literal > 0 and name + literal >= THRESHOLD


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans (start, end, kind) by start, and all spans."""
    text = text or ""
    low = text.lower()
    base = []
    if any(c in low for c in CUES):
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    order = {"assign": 0, "access": 1, "hex": 2, "pair": 3}
    base.sort(key=lambda s: (s[0], order[s[2]]))
    more = {(a, b, "pair") for a, b in added(text)} if "=" in text or ":" in text or "</" in text else set()
    return base, sorted({*base, *more}, key=lambda s: (s[0], order[s[2]]))


def join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and digest of the base spans, and all spans."""
    import pyarrow as pa

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            counts = [Counter(k for *_, k in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in ("assign", "access", "hex")),
                    pa.array([hashlib.sha256(join(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([join(spans) for _, spans in found], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
