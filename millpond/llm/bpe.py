"""BPE encoding and decoding.

Each pre-token is merged with a priority queue of merge ranks over a doubly linked list of symbols. Entries of the
queue whose symbols were merged meanwhile are stale and skipped. Decoding joins the vocabulary's strings.

The tokenizer file (bounded, checked) is read on the driver and broadcast; everything else is row by row, without a
shuffle. Texts are taken whole.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.llm.common import slices

TOKENIZER_BYTES = 64 << 20  # a larger tokenizer file is refused instead of broadcast
CACHED_WORDS = 500_000  # different words of a text a task remembers, and pre-tokens; a full cache is emptied
CACHED_CHARS = 64  # longer ones are not remembered, so a full cache has some 200 MB at most
# White space by Unicode, and the four separators that only str.split() takes for white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class WordBpe(dict):
    """Text between white space -> ids, filled on demand. Reads the layout with word ends, byte symbols, lower case."""

    def __init__(self, spec: dict):
        import regex

        super().__init__()
        model = spec["model"]
        self.merged: dict[str, tuple[int, ...]] = {}
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        self.ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.mark = os.path.commonprefix(list(self.added))  # no added token without it
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.first = [self.ids[c] for c in byte_symbols()]
        self.last = [self.ids[c + self.end] for c in byte_symbols()]

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        # Added tokens are found in the raw text; what lies between is normalised piece by piece.
        for piece in self.specials.split(chunk) if self.specials and self.mark in chunk else [chunk]:
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                # Lower case is taken letter by letter, so a capital sigma is never a final one.
                plain = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                for word in self.words.findall(plain.lower()):
                    out += self._word(word)
        found = tuple(out)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[chunk] = found
        return found

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.merged.get(word)
        if found is None:
            raw = word.encode()
            found = tuple(merge([*(self.first[b] for b in raw[:-1]), self.last[raw[-1]]], self.ranks))
            if len(word) <= CACHED_CHARS:
                if len(self.merged) >= CACHED_WORDS:
                    self.merged.clear()
                self.merged[word] = found
        return found

    def forget(self) -> None:
        """Give the caches back; a Python worker lives on after its task."""
        self.clear(), self.merged.clear()

    def encode(self, text: str) -> list[int]:
        # White space only separates: no token holds any, and it joins with nothing in normalisation.
        chunks = self.spaces.split(text) if any(c in text for c in SEPARATORS) else text.split()
        out: list[int] = []
        for chunk in chunks:
            out += self[chunk]
        return out

    def decode(self, ids: list[int], joint: str = " ") -> str:
        """The vocabulary's strings in order. The format has no decoder, so they stand apart by one space."""
        strings = self.strings
        return joint.join([strings[i] for i in ids if i in strings])


def byte_symbols() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next code point from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges in order of rank, leftmost first among equals."""
    n = len(symbols)
    find = ranks.get
    queue = []
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if found := find(pair):
            queue.append((found[0], i, pair, found[1]))
    if not queue:
        return symbols
    symbols = symbols.copy()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        _, i, pair, joined = pop(queue)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue  # stale: one of the two has been merged since
        symbols[i], symbols[j] = joined, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = (joined, symbols[k])
            if found := find(pair):
                push(queue, (found[0], i, pair, found[1]))
        h = before[i]
        if h >= 0:
            pair = (symbols[h], joined)
            if found := find(pair):
                push(queue, (found[0], h, pair, found[1]))
    return [s for s in symbols if s >= 0]


@lru_cache(maxsize=2)
def _bpe(raw: str) -> WordBpe:
    return WordBpe(json.loads(raw))


def _shared(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        raw = f.read(TOKENIZER_BYTES + 1)
    if len(raw) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} has more than {TOKENIZER_BYTES} characters")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>), and with ``decoded`` the text that those ids decode to.

    Null and empty texts give an empty array and an empty string. Other columns pass through; a column already named
    like an output is replaced. Repeated rows stay repeated.
    """
    shared = _shared(df, tokenizer)
    names = [ids] + ([decoded] if decoded else [])
    kept = [f for f in df.schema.fields if f.name not in names]
    own = "__text"  # the text under a name of no other column
    while own in df.columns:
        own += "_"
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = _bpe(shared.value)
        gc.disable()  # millions of small tuples and no cycles: collecting finds nothing
        try:
            for part in slices(batches, own):
                found = [bpe.encode(t) if t else [] for t in part.column(own).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
                columns = [part.column(f.name) for f in kept] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        finally:
            bpe.forget()
            gc.enable()

    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias(own))
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text that ``ids`` decode to; ids outside the vocabulary are skipped, a null array gives an empty text."""
    shared = _shared(df, tokenizer)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _bpe(shared.value)
        for batch in batches:
            done = pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [done], names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def digests(df: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, taken from what ``encode`` returns."""
    done = encode(df.select("doc_id", "text"), tokenizer, decoded="decoded")
    # Hashed from the ids as they are; text and ids never leave the stage.
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
