"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding.  A sequence of tokens is the encoding of its bytes if and only if every two neighbours
are the encoding of their joined bytes.  So encodings are the paths of a finite automaton
whose places are (last whole token, place in the trie of tokens): it guesses where a token ends and
checks the pair when the next one ends.  The transducer follows all guesses at once; a state is the
set of places that are alive, made when a text first needs it.  At every byte exactly one guess
ends a token, and the transition gives that token.  Guesses that do not lead on die within the
length of the longest token, and what all living guesses share is emitted (`Stream.commit`).

Decoding.  Bytes pass through a table-driven UTF-8 automaton that keeps its state between tokens, so
that a character may be spread over several.  What cannot be part of a character becomes U+FFFD.

The rank file's path and the pattern are parameters; every task loads the file once.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelweave.llm.text import byte_slices, small_batches, text_or_empty

#: Matches (up to a length) in a generation of those whose ids a task keeps; states and pairs it keeps.
KEPT_PIECES, KEPT_LENGTH, KEPT_STATES, KEPT_PAIRS = 350_000, 64, 300_000, 500_000
#: A place: last whole token, trie node.
PLACE = struct.Struct("<ii")
#: Bytes after which what all guesses share is emitted.
WINDOW = 512


class Ranks:
    """Tokens of a rank file, and which pairs stay apart."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        for token, r in self.rank.items():
            self.token[r] = token
        self.length = [len(t) for t in self.token]
        self.apart: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Merges of the lowest rank, leftmost first; used on two tokens' bytes."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, self.size) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == self.size:
                break
            at = ranks.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def pair(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes; left is -1 at the start."""
        key = (left + 1) * self.size + right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= KEPT_PAIRS:
                self.apart.clear()
            if left < 0:
                known = self.merged(self.token[right]) == [right]
            else:
                known = self.merged(self.token[left] + self.token[right]) == [left, right]
            self.apart[key] = known
        return known


class Transducer:
    """States made on demand: sets of (last whole token, trie node of the token being read).

    A state is a number; its places are kept as bytes, and steps as numbers, so that many states take little room.
    """

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        # the trie: node and byte -> node, and per node the token that ends there, whether it goes on, and its depth
        self.child: dict[int, int] = {}
        self.ends, self.leads, self.depth = [-1], [True], [0]
        for token, r in ranks.rank.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.leads[node] = True
                    self.ends.append(-1)
                    self.leads.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            self.ends[node] = r
        self.width = max(ranks.size.bit_length(), 1)
        self.reset()

    def reset(self) -> None:
        start = PLACE.pack(-1, 0)
        self.states = {start: 0}
        self.places = [start]
        #: state and byte -> next state and the token that ends there
        self.steps: dict[int, int] = {}

    def move(self, state: int, byte: int) -> int:
        """The step one byte leads to: next state << width | token that ends there."""
        alive, done = [], -1
        for last, node in PLACE.iter_unpack(self.places[state]):
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.ends[to]
            if done < 0 <= token and self.ranks.pair(last, token):
                done = token
            if self.leads[to]:
                alive.append(PLACE.pack(last, to))
        if done < 0:
            raise ValueError("the rank file lacks a single byte or a step towards one of its tokens")
        alive.append(PLACE.pack(done, 0))
        key = b"".join(alive)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.places)
            self.places.append(key)
        self.steps[state << 8 | byte] = step = to << self.width | done
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.rank.get(piece)
        if whole is not None:
            return [whole]
        stream = Stream(self)
        for at in range(0, len(piece), WINDOW):
            stream.feed(piece[at:at + WINDOW])
        return stream.close()


class Stream:
    """One piece read byte by byte; holds only tokens that some living guess may still change."""

    __slots__ = ("ended", "machine", "out", "state")

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.state = 0
        self.out: list[int] = []
        self.ended: list[int] = []  # the token that ends at each byte after the emitted ones

    def feed(self, data: bytes) -> None:
        machine, state, put = self.machine, self.state, self.ended.append
        step_of, width = machine.steps.get, machine.width
        token = (1 << width) - 1
        for byte in data:
            step = step_of(state << 8 | byte)
            if step is None:
                step = machine.move(state, byte)
            state = step >> width
            put(step & token)
        self.state = state
        if len(self.ended) >= WINDOW:
            self.commit()

    def _path(self, end: int) -> list[int]:
        """Ends of the tokens up to `end`, last first."""
        length, ended, ends = self.machine.ranks.length, self.ended, []
        while end > 0:
            ends.append(end)
            end -= length[ended[end - 1]]
        return ends

    def commit(self) -> None:
        """Emit the tokens all living guesses share."""
        size = len(self.ended)
        shared = None
        for _, node in PLACE.iter_unpack(self.machine.places[self.state]):
            ends = set(self._path(size - self.machine.depth[node]))
            shared = ends if shared is None else shared & ends
        if shared:
            last = max(shared)
            self.out += [self.ended[e - 1] for e in reversed(self._path(last))]
            self.ended = self.ended[last:]

    def close(self) -> list[int]:
        ended = self.ended
        return self.out + [ended[e - 1] for e in reversed(self._path(len(ended)))]


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoder(dict):
    """Packed ids of the matches seen lately, in two generations; others are encoded when asked for."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.machine = Transducer(ranks(path))
        self.pattern = regex.compile(pattern)
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            if len(self.machine.states) >= KEPT_STATES:
                self.machine.reset()
            packed = np.array(self.machine.encode(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, so that tasks profit from each other's states."""
    return Encoder(path, pattern)


def _encode(path: str, pattern: str, packed: bool):
    def run(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            for part in byte_slices(batch, batch.num_columns - 1):
                coded = [encoder.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                if packed:
                    made = pa.array(coded, pa.binary())
                else:
                    ends = np.r_[0, np.cumsum([len(c) // 4 for c in coded])].astype("i4")
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<u4").astype("i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], "ids"])
    return run


def _own(df: DataFrame, *made: str) -> tuple[list[str], list[T.StructField]]:
    own = [c for c in df.columns if c.lower() not in made]
    return own, list(df.select(*own).schema.fields)


def encode(docs: DataFrame, path: str, pattern: str, packed: bool = False) -> DataFrame:
    """docs without `text`, with `ids`, the tokens of the whole text (null: empty).

    Each match of `pattern` is encoded on its own; there are no special tokens.  ids is an array
    of integers or, `packed`, their bytes as little-endian unsigned 32-bit integers.  Other columns pass through; a column named ids is replaced; repeated rows stay.
    """
    small_batches(docs.sparkSession)
    own, fields = _own(docs, "text", "ids")
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])
    rows = docs.select(*(docs[f"`{c}`"] for c in own), text_or_empty().alias("text"))
    return rows.mapInArrow(_encode(path, pattern, packed), schema)


#: UTF-8 automaton: first byte, last byte, bytes to follow, and the range the next one must lie in.
LEADS = ((0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
         (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF),
         (0xF4, 0xF4, 3, 0x80, 0x8F))


@functools.cache
def utf8_moves() -> np.ndarray:
    """[state, byte] -> state: 0 between characters, -1 where the byte cannot follow."""
    states = {(0, 0, 0): 0}
    for _, _, rest, low, high in LEADS:
        while rest:
            states.setdefault((rest, low, high), len(states))
            rest, low, high = rest - 1, 0x80, 0xBF
    move = np.full((len(states), 256), -1, "i1")
    for first, last, rest, low, high in LEADS:
        move[0, first:last + 1] = states[(rest, low, high)] if rest else 0
    for (rest, low, high), state in states.items():
        if rest:
            move[state, low:high + 1] = states[(rest - 1, 0x80, 0xBF)] if rest > 1 else 0
    return move


class Utf8Stream:
    """Characters as soon as their last byte is in; the state outlives a call."""

    def __init__(self):
        self.state = 0
        self.held = b""

    def feed(self, data: bytes) -> str:
        move, out, start, state = utf8_moves(), [], 0, self.state
        data = self.held + data
        at = len(self.held)
        while at < len(data):
            to = move[state, data[at]]
            if to < 0:  # the held bytes, or this one alone, are no character
                out.append("\ufffd")
                at = at if state else at + 1
                start, state = at, 0
                continue
            at += 1
            state = int(to)
            if state == 0:
                out.append(data[start:at].decode("utf-8"))
                start = at
        self.state, self.held = state, data[start:]
        return "".join(out)

    def close(self) -> str:
        left, self.state, self.held = self.held, 0, b""
        return "\ufffd" if left else ""


@functools.lru_cache(maxsize=2)
def _decoder(path: str) -> tuple[pa.Array, np.ndarray]:
    """Bytes of the tokens, and the state each token leads to from each state."""
    known, move = ranks(path), utf8_moves()
    leads = np.full((len(move), known.size), -1, "i1")
    for state in range(len(move)):
        for r, token in enumerate(known.token):
            to = state
            for byte in token:
                to = move[to, byte]
                if to < 0:
                    break
            leads[state, r] = to
    return pa.array(known.token, pa.binary()), leads


def broken(ids: np.ndarray, starts: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Which of the runs of ids, beginning at starts, are no whole UTF-8.

    Tokens that are whole characters keep state 0; only the others are followed one by one.
    """
    bad = np.zeros(len(starts), bool)
    odd = np.flatnonzero(leads[0, ids] != 0)
    if not len(odd):
        return bad
    run = np.searchsorted(starts, odd, "right") - 1
    ends = np.r_[starts[1:], len(ids)]
    state, before = 0, -2
    for at, k in zip(odd.tolist(), run.tolist()):
        if at < before:
            continue  # already followed
        end = int(ends[k])
        while at < end:
            state = int(leads[state, ids[at]])
            at += 1
            if state <= 0:
                break
        if state:
            bad[k] = True
        state, before = 0, at
    return bad


def _decode(path: str, packed: bool):
    def run(batches):
        tokens, leads = _decoder(path)
        for batch in batches:
            for part in byte_slices(batch, batch.num_columns - 1):
                column = part.column(part.num_columns - 1)
                if packed:
                    coded = [c or b"" for c in column.to_pylist()]
                    ids, counts = np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], "i8")
                else:
                    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("i8")
                    ids = column.flatten().to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(counts)].astype("i4")
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.take(pa.array(ids))), b"")
                full = np.flatnonzero(counts)
                bad = full[broken(ids, ends[:-1][full], leads)]
                if len(bad):
                    texts = joined.to_pylist()
                    for k in bad.tolist():
                        stream = Utf8Stream()
                        texts[k] = (stream.feed(texts[k]) + stream.close()).encode()
                    joined = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], joined.cast(pa.string())],
                                                 names=[*part.schema.names[:-1], "decoded"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with `decoded`, the text of `ids` (either form; null: empty).

    Bytes that are no character, which ids of `encode` never yield, become U+FFFD, one for the longest
    beginning of a character that breaks off.  A column named decoded is replaced.
    """
    small_batches(encoded.sparkSession)
    own, fields = _own(encoded, "decoded")
    packed = isinstance(encoded.schema["ids"].dataType, T.BinaryType)
    rows = encoded.select(*(encoded[f"`{c}`"] for c in own), encoded["ids"].alias("__ids"))
    return rows.mapInArrow(_decode(path, packed), T.StructType([*fields, T.StructField("decoded", T.StringType())]))
