"""BPE encoding and decoding with batched numpy merge rounds.

A batch of texts is normalised, cut at blanks and split into words; each different word
is encoded once.  The symbols of all words lie in one flat array.  In a round every word finds
its lowest-ranked pair by binary search over the sorted keys of all pairs, and all
occurrences of that pair are merged, from left to right; words without a pair drop out.
Merging all occurrences at once equals merging one by one, as long as no merge can
yield a pair of a lower rank than its own; ranks for which the vocabulary breaks that
are merged one occurrence at a time.

The vocabulary is a tokenizers file whose path is a parameter; every task loads it once.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from panelweave.llm.text import small_batches, text_or_empty

#: Chunks of text whose ids are held between batches.  Workers outlive their stage, so this stays with the executor.
CACHE_CHUNKS = 100_000
#: Texts are joined into flat arrays of about so many words at a time.
GROUP_CHARS = 8_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], "i8")
        self.last = np.array([ids[c + self.suffix] for c in letters], "i8")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], "i8")
        right = np.array([ids[b] for _, b in merges], "i8")
        made = np.array([ids[a + b] for a, b in merges], "i8")
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made[order]
        self.by_rank = made
        # the lowest rank of a merge that takes each token in
        least = np.full(self.size, len(merges), "i8")
        np.minimum.at(least, left, np.arange(len(merges)))
        np.minimum.at(least, right, np.arange(len(merges)))
        self.single = least[made] < np.arange(len(merges))
        self.none = len(merges)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        special = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.pattern, self.specials = regex.compile(split), regex.compile(f"({special})") if special else None
        # id -> text: without a decoder the tokens are joined by one space
        self.tokens = [""] * self.size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut at blanks and line ends, which no word crosses; special tokens stand for themselves."""
        if self.specials is None or "<|" not in text:
            return self._cut(text)
        out: list[str] = []
        for piece in self.specials.split(text):
            out += ["\0" + piece] if piece in self.special else self._cut(piece)
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter, so that a final sigma is lowered like any other; white space is never part of a word
        lower = text.lower() if "Σ" not in text else "σ".join(t.lower() for t in text.split("Σ"))
        return lower.replace("\n", " ").split(" ")

    def words(self, chunk: str) -> list[bytes]:
        return [w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(chunk)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of non-empty words, flat, and the number of each word's tokens."""
        size = np.array([len(w) for w in words], "i8")
        symbol = self.first[np.frombuffer(b"".join(words), "u1")]
        ends = np.cumsum(size)
        symbol[ends - 1] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), "u1")]
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        while len(symbol):
            rank = np.full(len(symbol), self.none, "i8")
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = (self.key[at] == key) & (word[:-1] == word[1:])
            rank[:-1] = np.where(hit, self.rank[at], self.none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            index = np.cumsum(np.r_[0, word[1:] != word[:-1]])
            best = least[index]
            live = best < self.none
            done_symbol.append(symbol[~live])
            done_word.append(word[~live])
            symbol, word, rank, best = symbol[live], word[live], rank[live], best[live]
            if not len(symbol):
                break
            hit = rank == best
            # of a run of overlapping hits every second one merges, from its left end
            place = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            take = hit & ((place - begin) % 2 == 0)
            lone = self.single[best]
            if lone.any():
                picked = np.flatnonzero(take & lone)
                _, firsts = np.unique(word[picked], return_index=True)
                take &= ~lone
                take[picked[firsts]] = True
            at = np.flatnonzero(take)
            symbol[at] = self.by_rank[best[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts; keeps the ids of chunks seen before."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {"\0" + t: k for k, t in enumerate(self.vocab.special)}
        self.flat = [np.array(list(self.vocab.special.values()), "i4")]
        self.start = [np.arange(len(self.number), dtype="i8")]
        self.count = [np.ones(len(self.number), "i8")]
        self.used = len(self.number)

    def learn(self, new: list[str]) -> None:
        words = [self.vocab.words(c) for c in new]
        every = [w for ws in words for w in ws]
        distinct = list(dict.fromkeys(every))
        ids, count = self.vocab.merge(distinct) if distinct else (np.empty(0, "i8"), np.empty(0, "i8"))
        place = {w: k for k, w in enumerate(distinct)}
        which = np.fromiter((place[w] for w in every), "i8", len(every))
        flat = _gather(ids.astype("i4"), np.cumsum(count) - count, count, which)
        ends = np.r_[0, np.cumsum(count[which])]
        bounds = ends[np.r_[0, np.cumsum([len(ws) for ws in words])].astype("i8")]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.flat, self.start, self.count = (
            [np.concatenate([*old, add])] for old, add in
            ((self.flat, flat), (self.start, self.used + bounds[:-1]), (self.count, np.diff(bounds))))
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids of each."""
        if len(self.number) > CACHE_CHUNKS:
            self.reset()
        cut = [self.vocab.chunks(t) for t in texts]
        number = self.number
        new = list({c: None for cs in cut for c in cs if c not in number})
        if new:
            self.learn(new)
        which = np.fromiter((number[c] for cs in cut for c in cs), "i8", sum(map(len, cut)))
        count = self.count[0][which]
        ids = _gather(self.flat[0], self.start[0], self.count[0], which)
        bounds = np.r_[0, np.cumsum([len(cs) for cs in cut])].astype("i8")
        return ids, np.diff(np.r_[0, np.cumsum(count)][bounds])


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count] of `which`, one after another."""
    n = count[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[which] - ends + n, n)]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One per worker process, so that tasks profit from each other's words."""
    return Encoder(vocabulary(path))


def _groups(column: pa.Array):
    """Slices of a column of texts that hold a bounded number of characters, or one text."""
    texts = column.to_pylist()
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > GROUP_CHARS:
            yield texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield texts[first:]


def _encode(path: str):
    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            ids, counts = [np.empty(0, "i4")], [np.empty(0, "i8")]
            for texts in _groups(batch.column(batch.num_columns - 1)):
                own, n = encoder.encode(texts)
                ids.append(own)
                counts.append(n)
            offsets = np.r_[0, np.cumsum(np.concatenate(counts))].astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs without `text`, with `ids`, the token ids of the whole text (null: empty).

    Special tokens written in a text are encoded as such.  Other columns pass through;
    a column named ids is replaced.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("text", "ids")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    rows = docs.select(*own, text_or_empty().alias("text"))
    return rows.mapInArrow(_encode(path), f"{schema}{', ' if own else ''}ids array<int>")


def _decode(path: str):
    def run(batches):
        tokens = pa.array(vocabulary(path).tokens)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            pieces = tokens.take(column.flatten())
            offsets = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy())].astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.binary_join(lists, " ")],
                                             names=[*batch.schema.names[:-1], "decoded"])
    return run


def _both(path: str):
    """Encode and decode in one pass."""
    def twice(batches):
        for batch in batches:
            yield batch.append_column("__ids", batch.column("ids"))

    def run(batches):
        return _decode(path)(twice(_encode(path)(batches)))
    return run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs, path), path) in one Python worker a task instead of two, each with its own vocabulary."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("text", "ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    rows = docs.select(*own, text_or_empty().alias("text"))
    return rows.mapInArrow(_both(path), f"{schema}{', ' if own else ''}ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with `decoded`: the tokens of `ids` joined as the file, which names no decoder, asks for."""
    own = [c for c in encoded.columns if c.lower() not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*own).schema)
    return encoded.select(*own, "ids", encoded["ids"].alias("__ids")).mapInArrow(
        _decode(path), f"{schema}{', ' if own else ''}ids array<int>, decoded string")
