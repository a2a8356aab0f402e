"""Secret scans: pattern spans, and literals assigned to sensitive names.

Base spans are leftmost non-overlapping matches of fixed patterns, dropped when
too short. On top of them the text is lexed as source or configuration: each
``name = literal``, ``name: literal``, ``"name": literal``, ``name := literal``
or ``name => literal`` becomes a name-literal pair; a value that is itself a
name (or a sum of names and literals) is followed to the literals that were
assigned to that name anywhere in the document. Each line of a triple-quoted
literal, or of a block below ``name: |`` or ``name: >``, is a literal of its
own. A literal is a secret when the name it reaches is sensitive and its score,
from the name's weight and the literal's variety, is high enough. Placeholders
never are. Names have any length, and every name is followed once a text, from
the most sensitive targets on, so time grows with the text alone.

Offsets are code points, ends exclusive. A null text is an empty text. Every
row is judged by itself, so repeated rows and null ids give equal results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm.common import ship, tidy

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "literal", "constant")

# Weights of the words of a target name, and placeholder literals.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "secrets": 0.9,
             "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0,
                   ("encryption", "key"): 0.9, ("signing", "key"): 0.9}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{?.*\}?|%.*%|\{\{.*\}\}|none|null|true|false|string|changeme|change_me|"
                         r"example.*|your[_-].*|placeholder|todo|redacted|password|secret|token)$")
LEAST_SCORE = 0.6

_LONG = r"""(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})"""
_TERM = "(?:" + _LONG + r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[A-Za-z0-9_+/.=@$%^&*!~-]+)"""
_PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*+)["'\]]{0,2}[\x20\t]*+(?::[\x20\t]*[A-Za-z_][\w\[\]]*[\x20\t]*(?==[^=])|)"""
                   r"""(?::=|=>|=(?!=)|:(?!:))[\x20\t]*(""" + _TERM + r"""(?:[\x20\t]+\+[\x20\t]+""" + _TERM + r""")*)""")
_BLOCK = re.compile(r"""^([\x20\t]*+)(?:-[\x20\t]+)?["']?([A-Za-z_][A-Za-z0-9_.-]*+)["']?[\x20\t]*:[\x20\t]*[|>][-+0-9]{0,2}[\x20\t]*\r?\n"""
                    r"""((?:\1[\x20\t]+[^\n]*(?:\n|\Z)|[\x20\t]*\r?\n)*+)""", re.M)
_LINES = re.compile(r"[^\n]+")
_TERMS = re.compile(_TERM)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*$")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    singles = [SENSITIVE.get(w, 0.0) for w in words]
    pairs = [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:])]
    return max([0.0, *singles, *pairs])


def literal_weight(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret value, 0 to 1."""
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    classes = sum((any(c.islower() for c in value), any(c.isupper() for c in value),
                   any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    if not quoted and (classes < 2 or len(value) < 8 or not any(c.isdigit() for c in value)):
        return 0.0   # prose after a colon
    return min(1.0, 0.4 + 0.15 * classes + 0.02 * min(len(value), 20))


def _lines(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """The lines of a long literal, without the white space around them."""
    terms = []
    for m in _LINES.finditer(text, start, end):
        line = m.group()
        low = m.start() + len(line) - len(line.lstrip())
        if line.strip():
            terms.append((low, low + len(line.strip()), True))
    return terms


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, bool]]]]:
    """Name-literal pairs: (name, terms as (start, end, quoted)); quotes not included."""
    found = []
    for m in _PAIR.finditer(text):
        terms = []
        for t in _TERMS.finditer(text, m.start(2), m.end(2)):
            if t.group() == "+":
                continue
            if t.end() - t.start() >= 6 and t.group()[:3] in ('"' * 3, "'" * 3):
                terms += _lines(text, t.start() + 3, t.end() - 3)
                continue
            quoted = t.group()[0] in "\"'`"
            terms.append((t.start() + quoted, t.end() - quoted, quoted))
        found.append((m.group(1), terms))
    if "|" in text or ">" in text:
        found += [(m.group(2), _lines(text, m.start(3), m.end(3))) for m in _BLOCK.finditer(text)]
    return found


def lexed_spans(text: str) -> set[tuple[int, str, int]]:
    """(start, kind, end) of literals that reach a sensitive name.

    A literal assigned to a sensitive name itself is a ``literal``, one found by
    following a name is a ``constant``. What a heavier target reaches needs no
    second look for a lighter one: its literals were scored higher already.
    """
    found = [(name_weight(name), name, terms) for name, terms in pairs(text)]
    targets = sorted((t for t in found if t[0]), key=lambda t: -t[0])
    if not targets:
        return set()
    assigned: dict[str, list[tuple[int, int, bool]]] = {}
    for _, name, terms in found:
        assigned.setdefault(name.rsplit(".", 1)[-1], []).extend(terms)
    spans, followed = set(), set()
    for weight, _, terms in targets:
        todo = [(t, "literal") for t in terms]
        while todo:
            (start, end, quoted), kind = todo.pop()
            value = text[start:end]
            if not quoted and _NAME.match(value) and (key := value.rsplit(".", 1)[-1]) in assigned:
                if key not in followed:
                    followed.add(key)
                    todo.extend((t, "constant") for t in assigned[key])
            elif weight * literal_weight(value, quoted) >= LEAST_SCORE:
                spans.add((start, kind, end))
    return spans


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return _ordered(spans)


def _ordered(spans) -> list[tuple[int, str, int]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def find(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans) of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = lexed_spans(text) if "=" in text or ":" in text else set()
    return base, _ordered([*base, *more]) if more else base


def redacted(text: str, mark: str = "[secret]") -> str:
    """``text`` with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    last = -1
    for start, _, end in find(text)[1]:
        if start >= last:
            out += [text[at:start], mark]
        at = last = max(last, end)
    return text if last < 0 else "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts, shas, spans = [], [], []
            for text in part.column(1).to_pylist():
                base, every = find(text)
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in KINDS[:3]])
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                 pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


@tidy
def _redact(batches: Iterator[pa.RecordBatch], at: int, mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t and redacted(t, mark) for t in batch.column(at).to_pylist()]
        columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with the secrets in its text column replaced by ``mark``."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_redact, at=df.columns.index(text), mark=mark), df.schema)
