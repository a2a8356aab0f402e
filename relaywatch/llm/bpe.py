"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token arcs; a path spells a text's bytes, and exactly one
accepted path, the BPE tokenization, spells each text. It is built from the one
state automaton of the single bytes by one gadget for each merge (u, v) -> w:

* every state with an arc u that can be followed by v gains an arc w, entering
  a copy of the state that v enters;
* the state that u enters loses its arc v, so the unmerged path is gone.

The state an arc enters depends on the arc's token only, so the automaton is a
relation "token y may follow token x". The gadgets are kept in the order of the
merges (which token is made when, and of what), and a transition is derived
from them once and then read from the table: going back in time, the newer of
the two tokens is replaced by the part that the gadget copied or extended, and
the arc is gone if a gadget took it away before that time.

A word is encoded by following transitions from its start; each prefix has one
path at most, so a place that leads nowhere is left for good. Decoding emits
the label bytes of the arcs.

Null text is empty text (no tokens). Words are cut by the byte-level pattern
below; special tokens standing in a text are tokens of their own, as in the
tokenizers library. Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.llm.common import ship, tidy

# Fixed value: the byte-level pre-tokenization pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000      # pieces a worker remembers; emptied when full
ROWS = 512           # texts handled at a time
SIDE = 40            # words of more bytes are encoded one by one


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Table:
    """Fixed int64 -> int32 map read for whole arrays at once; -1 where absent."""

    def __init__(self, entries: dict[int, int]):
        bits = max(8, (4 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        for key, at in zip(entries, self._slot(np.fromiter(entries, np.int64, len(entries))).tolist()):
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, entries[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (held != -1)]
        return out


class Automaton:
    """Transitions derived from the merges of a byte-level BPE vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        self.special = special
        self.label = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.label[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            self.label[i] = token.encode()
        size = len(self.label)
        self.birth, self.left, self.right = [0] * size, [0] * size, [0] * size
        self.gadget: dict[tuple[int, int], int] = {}
        for k, (u, v) in enumerate(merges, 1):
            made, pair = vocab[u + v], (vocab[u], vocab[v])
            if self.birth[made] or pair in self.gadget:
                raise ValueError(f"two merges make the token {u + v!r}")
            self.gadget[pair] = k
            self.birth[made], self.left[made], self.right[made] = k, *pair
        self.ready()

    def ready(self) -> None:
        self.table: dict[int, bool] = {}
        one = {b: i for i, b in enumerate(self.label) if len(b) == 1 and self.birth[i] == 0}
        live = set(one.values())
        made = {k: i for i, k in enumerate(self.birth) if k}
        for (u, v), k in sorted(self.gadget.items(), key=lambda x: x[1]):
            if u in live and v in live and self._arc(u, v, k - 1):
                live.add(made[k])
        self.ids = {self.label[i]: i for i in live}
        self.longest = max(map(len, self.ids))
        self._compile()
        self.digits = [str(i) for i in range(len(self.label))]
        self.pieces = _Pieces(self, " ")
        self.starts = _Pieces(self, "")
        self.words = _Words(self)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("special", "label", "birth", "left", "right", "gadget")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def _arc(self, x: int, y: int, time: float) -> bool:
        """Whether, after the gadgets up to ``time``, arc y leaves the state that arc x enters."""
        birth, gadget = self.birth, self.gadget
        while True:
            gone = gadget.get((x, y))
            if gone is not None and gone <= time:
                return False
            if birth[x] > birth[y]:
                time, x = birth[x] - 1, self.right[x]   # x's state was copied from its right part's
            elif birth[y]:
                time, y = birth[y], self.left[y]        # y was added beside its left part
            else:
                return True

    def follows(self, x: int, y: int) -> bool:
        key = x << 20 | y
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= 4 * CACHE:
                self.table.clear()
            known = self.table[key] = self._arc(x, y, float("inf"))
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one path that spells ``word``.

        The longest arc is tried first. A prefix has one path at most, so a
        place from which the end cannot be reached is never entered again.
        """
        ids, n, longest = self.ids, len(word), self.longest
        whole = ids.get(word)
        if whole is not None:
            return (whole,)
        path: list[int] = []
        dead: set[int] = set()
        at, most = 0, min(n - 1, longest)
        while at < n:
            for end in range(most, at, -1):
                token = ids.get(word[at:end])
                if token is not None and end not in dead and (not path or self.follows(path[-1], token)):
                    path.append(token)
                    at, most = end, min(n, end + longest)
                    break
            else:
                dead.add(at)
                most = at - 1
                at -= len(self.label[path.pop()])
        return tuple(path)

    def _compile(self) -> None:
        """Arrays for following many words' paths side by side."""
        nodes, ends = {}, [-1]
        for label, token in self.ids.items():
            at = 0
            for byte in label:
                at = nodes.setdefault(at << 8 | byte, len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = token
        self.trie, self.trie_token = _Table(nodes), np.array(ends, np.int32)
        self.gone = _Table({u << 20 | v: k for (u, v), k in self.gadget.items()})
        self.births = np.array(self.birth, np.int32)
        self.lefts, self.rights = np.array(self.left, np.int32), np.array(self.right, np.int32)
        self.sizes = np.array([len(x) for x in self.label], np.int64)
        shorter = np.full(len(self.label), -1, np.int32)   # the longest live token that begins a token
        for label, token in self.ids.items():
            for n in range(len(label) - 1, 0, -1):
                if (begin := self.ids.get(label[:n])) is not None:
                    shorter[token] = begin
                    break
        self.shorter = shorter

    def _arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Like ``_arc`` after all gadgets, for arrays of token pairs."""
        out = np.ones(len(x), bool)
        rows, time = np.arange(len(x)), np.full(len(x), 1 << 30, np.int32)
        while len(rows):
            gone = self.gone[x.astype(np.int64) << 20 | y]
            lost = (gone >= 0) & (gone <= time)
            out[rows[lost]] = False
            bx, by = self.births[x], self.births[y]
            on = ~lost & ((bx > 0) | (by > 0))
            rows, x, y, bx, by = rows[on], x[on], y[on], bx[on], by[on]
            newer = bx > by
            time = np.where(newer, bx - 1, by)
            x, y = np.where(newer, self.rights[x], x), np.where(newer, y, self.lefts[y])
        return out

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``encode_word`` of many words, all moved one arc on, or back, at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        end = np.cumsum(size)
        at = end - size
        side = int(min(SIDE, size.max(initial=1)))
        path = np.full((len(words), side + 1), -1, np.int32)
        depth = np.zeros(len(words), np.int64)
        next_arc = np.full(len(words), -2, np.int32)          # -2: not looked up, -1: none left
        active = np.flatnonzero((size > 0) & (size <= side))
        for _ in range(8 * side):
            if not len(active):
                break
            fresh = active[next_arc[active] == -2]
            next_arc[fresh] = -1
            walk, here, node = fresh, at[fresh], np.zeros(len(fresh), np.int64)
            while len(walk):
                node = self.trie[node << 8 | data[here]].astype(np.int64)
                alive = node >= 0
                walk, here, node = walk[alive], here[alive] + 1, node[alive]
                found = self.trie_token[node]
                next_arc[walk[found >= 0]] = found[found >= 0]
                more = here < end[walk]
                walk, here, node = walk[more], here[more], node[more]
            check = active[(depth[active] > 0) & (next_arc[active] >= 0)]
            while len(check):
                wrong = check[~self._arcs(path[check, depth[check] - 1], next_arc[check])]
                next_arc[wrong] = self.shorter[next_arc[wrong]]
                check = wrong[next_arc[wrong] >= 0]
            on = next_arc[active] >= 0
            ahead, back = active[on], active[~on]
            path[ahead, depth[ahead]] = next_arc[ahead]
            at[ahead] += self.sizes[next_arc[ahead]]
            depth[ahead] += 1
            next_arc[ahead] = -2
            depth[back] -= 1
            left = path[back, depth[back]]
            at[back] -= self.sizes[left]
            next_arc[back] = self.shorter[left]
            active = active[at[active] < end[active]]
        done = np.zeros(len(words), bool)
        done[(at == end) & (size <= side)] = True
        rows, counts = path.tolist(), depth.tolist()
        return [tuple(row[:n]) if ok else self.encode_word(word)
                for word, row, n, ok in zip(words, rows, counts, done.tolist())]

    def learn(self, texts: list[str]) -> None:
        """Encode the words of ``texts`` that are not in the tables yet."""
        if len(self.pieces) > CACHE or len(self.words) > CACHE:
            self.pieces.clear()
            self.words.clear()
        pieces = set(chain.from_iterable(text.split(" ") for text in texts if text)).difference(self.pieces)
        cut = {p: _WORD.findall(" " + p) for p in pieces if not _unsafe(p)}
        words = list({w for ws in cut.values() for w in ws if w not in self.words})
        self.words.update(zip(words, self.encode_words([w.encode() for w in words])))
        known = self.words.__getitem__
        self.pieces.joined = {p: tuple(chain.from_iterable(map(known, ws))) for p, ws in cut.items() if _joined(ws)}
        self.pieces.update((p, tuple(chain.from_iterable(map(known, ws)))) for p, ws in cut.items() if not _joined(ws))

    def _plain(self, text: str) -> list[int]:
        """Tokens of a text without special tokens.

        A space between two characters that are not spaces always starts a word
        of the pattern, so such pieces are looked up whole; a text with other
        space beside a space is cut by the pattern itself.
        """
        pieces = text.split(" ")
        try:
            return list(chain(self.starts[pieces[0]], chain.from_iterable(
                map(self.pieces.__getitem__, islice(pieces, 1, None)))))
        except _Unsafe:
            return list(chain.from_iterable(map(self.words.__getitem__, _WORD.findall(text))))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = [x for x in self.cut.split(text) if x]
        return list(chain.from_iterable([self.special[x]] if x in self.special else self._plain(x) for x in parts))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        self.learn(texts)
        return map(self.encode, texts)

    def decode(self, ids) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_WORD = regex.compile(PATTERN)


class _Unsafe(Exception):
    """A piece begins or ends with space, so its words depend on what is beside it."""


class _Words(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self.automaton.encode_word(word.encode())
        return ids


def _unsafe(piece: str) -> bool:
    return not piece or piece[0].isspace() or piece[-1].isspace()


def _joined(words: list[str]) -> bool:
    """Several words in one piece (two lines, mostly): seldom met again."""
    return len(words) > 2 or len(words) == 2 and len(words[1]) > 1


class _Pieces(dict):
    """Tokens of the pieces between single spaces, each led by ``before``."""

    def __init__(self, automaton: Automaton, before: str):
        self.automaton, self.before = automaton, before
        self.joined: dict[str, tuple[int, ...]] = {}    # of the texts at hand only

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if piece in self.joined:
            return self.joined[piece]
        if _unsafe(piece):
            raise _Unsafe
        return tuple(chain.from_iterable(map(self.automaton.words.__getitem__, _WORD.findall(self.before + piece))))


def load(path: str) -> Automaton:
    """The automaton of a tokenizer file of byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    return Automaton(model["vocab"], merges, special)


def shared(spark: SparkSession, path: str):
    """Broadcast automaton; its size is the vocabulary's, not the data's."""
    return ship(spark).sparkContext.broadcast(load(path))


@tidy
def _encoded(batches: Iterator[pa.RecordBatch], automaton, names: list[str], text_at: int) -> Iterator[pa.RecordBatch]:
    a = automaton.value
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = list(a.encode_all(part.column(text_at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=names)


def _without(df: DataFrame, made: str, read: str) -> DataFrame:
    """``df`` without columns named as the one to make, whatever their case."""
    if made.lower() == read.lower():
        raise ValueError(f"the column to make is the one to read: {made}")
    return df.select(*[c for c in df.columns if c.lower() != made.lower()])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array<int> column of token ids; a column of that name is replaced."""
    df = _without(df, ids, text)
    names = [*df.columns, ids]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(partial(_encoded, automaton=shared(df.sparkSession, path), names=names,
                                 text_at=df.columns.index(text)), f"{fields}, `{ids}` array<int>")


@tidy
def _decoded(batches, automaton, names, ids_at):
    a = automaton.value
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = [None if i is None else a.decode(i) for i in part.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that the token ids spell; null ids give null text; a column of that name is replaced."""
    df = _without(df, text, ids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(partial(_decoded, automaton=shared(df.sparkSession, path), names=[*df.columns, text],
                                 ids_at=df.columns.index(ids)), f"{fields}, `{text}` string")


@tidy
def _digests(batches, automaton):
    a = automaton.value
    digits, label = a.digits, a.label
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            counts, coded, spelled = [], [], []
            texts = part.column(1).to_pylist()
            for text, ids in zip(texts, a.encode_all(texts)):
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                raw = b"".join(map(label.__getitem__, ids))
                if raw != (text or "").encode():
                    raw = raw.decode("utf-8", "replace").encode()
                spelled.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(coded), pa.array(spelled)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, then decoded."""
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pairs.mapInArrow(partial(_digests, automaton=shared(docs.sparkSession, path)),
                            "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
