"""Alignment of two tokenizers over the same text, with corpus-wide counts of linked token ids.

A is a byte-level BPE vocabulary, B a piece model that marks spaces and falls back to bytes. Both cut the bytes of a
space and the text. Where tokens of A and B end at one offset a group ends; a token of A and one of B are linked where
their byte ranges overlap, and each stretch between two neighbouring ends of either side is exactly one link.

A space behind a visible character starts a new token on both sides, so a text is a row of words whose alignments are
independent: a slice of texts aligns each different word once and puts the texts together from them.

The first pass aligns all documents and writes, for each task, in how many of its documents each id pair is linked. The
distinct pairs get a minimal perfect hash, block by block. Counts are dense vectors indexed by it, one for each block and
group of tasks, summed as a tree of bounded fan-in. A second pass aligns the documents again and looks the counts up;
the key stored at a place is compared first. Tables are sent out in parts of at most PART_PAIRS pairs, so a vocabulary with
more pairs takes further passes.

Nulls, empty texts and texts that one side does not give back byte by byte have no tokens: zeros, and '' as digest.
Repeated rows count as documents of their own, a null doc_id stays null, an empty table gives no rows. Texts are whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millpond.llm.bpe import byte_symbols
from millpond.llm.common import slices, stored
from millpond.llm.perfect_hash import BLOCK_KEYS, PerfectHash, block_column, build

MODEL_BYTES = 64 << 20  # a larger tokenizer file is refused instead of broadcast
PART_PAIRS = 4_000_000  # pairs that are broadcast at once, some 28 bytes each
TASK_PAIRS = 4_000_000  # pair counts a task holds before it writes them out
FAN = 32  # count vectors, or tasks' pair counts, added in one group
WORDS_AT_ONCE = 1000  # words encoded by one call
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Both tokenizers, and the offsets of their tokens over a slice of texts."""

    def __init__(self, vocabulary: str, model: bytes):
        import numpy as np
        import sentencepiece
        import tiktoken

        spec = json.loads(vocabulary)
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(raw[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        made = [spec["model"]["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError("ids of merged tokens have to follow the order of merges")
        # Merges are ranked by id; special strings are not known to it and so are plain text.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = size
        # A piece that holds a space behind something else would join words; then texts are aligned as one piece.
        joins = any("▁" in p.lstrip("▁") for p in pieces)
        self.words = (lambda text: [text]) if joins else WORD_STARTS.split
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        ids = range(max(len(self.bytes_a), size))
        self.written = np.array([[f"{i}{mark}" for i in ids] for mark in ",|;"], object)

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides of a space and the text; none if one side does not give its bytes back."""
        raw = " " + text
        a, b = self.a.encode_ordinary(raw), self.b.encode(text)
        whole = raw.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return [], []
        return a, b

    def tokens_of(self, words: list[str]):
        """Ids of both sides of all words, end to end, and how many each word has.

        Words are encoded many at a time, where the bytes tell which token belongs to which word.
        """
        import numpy as np

        ids, numbers, lens = ([], []), ([], []), (self.len_a, self.len_b)
        for at in range(0, len(words), WORDS_AT_ONCE):
            chunk = words[at : at + WORDS_AT_ONCE]
            found = [np.array(x, np.int64) for x in self.tokens(" ".join(chunk))]
            ends = np.cumsum([len(w.encode()) + 1 for w in chunk])
            cuts = [np.cumsum(n[x]) for x, n in zip(found, lens)]
            if not chunk[-1][-1].isspace() and all(len(c) and np.isin(ends, c, assume_unique=True).all() for c in cuts):
                for side in (0, 1):
                    ids[side].append(found[side])
                    numbers[side].append(np.diff(np.searchsorted(cuts[side], ends, "right"), prepend=0))
            else:
                # Some word does not come back, or runs into the next one: one by one.
                for word in chunk:
                    for side, own in enumerate(self.tokens(word)):
                        ids[side].append(np.array(own, np.int64))
                        numbers[side].append(np.array([len(own)]))
        return [np.concatenate([np.empty(0, np.int64), *x]) for x in (*ids, *numbers)]

    def align(self, texts: list) -> "Documents":
        return Documents(self, texts)


class Aligned:
    """Tokens of several words, their bytes laid end to end; both sides of each word end together."""

    def __init__(self, pair: Aligner, words: list[str]):
        import numpy as np

        self.pair = pair
        self.ids_a, self.ids_b, self.n_a, self.n_b = pair.tokens_of(words)
        ends_a, ends_b = np.cumsum(pair.len_a[self.ids_a]), np.cumsum(pair.len_b[self.ids_b])
        mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
        mark[ends_a] += 1
        mark[ends_b] += 2
        ends = np.flatnonzero(mark)  # the end of each link
        kind = mark[ends]
        self.in_a, self.in_b, both = (kind & 1) > 0, kind > 1, kind == 3
        before = lambda x: np.cumsum(x) - x
        # What ends at or after a stretch's end covers it.
        self.key = self.ids_a[before(self.in_a)] * pair.size_b + self.ids_b[before(self.in_b)] if len(ends) else ends
        self.group = before(both)
        # Link bounds of each word: its last token's end is its last link's.
        last = np.concatenate(([0], np.cumsum(self.n_a)))
        link_of_a = np.concatenate(([0], np.flatnonzero(self.in_a) + 1))
        self.bounds = link_of_a[last]
        self.n_links = np.diff(self.bounds)
        self.n_groups = np.diff(np.concatenate(([0], np.cumsum(both)))[self.bounds])

    def sums(self, values):
        """Sum over the links of each word."""
        import numpy as np

        return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[self.bounds])

    def groups(self) -> list[str]:
        """The ids of A and B of each word by group, as text; '' without tokens."""
        import numpy as np

        side = np.concatenate((self.group[self.in_a] * 2, self.group[self.in_b] * 2 + 1))
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate((self.ids_a, self.ids_b))[order], side[order]
        step = np.append(np.diff(side), 1)
        mark = np.where(step == 0, 0, np.where(side % 2 == 0, 1, 2))
        parts = self.pair.written[mark, ids].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip([0, *ends], ends)]


class Documents:
    """A slice of texts as rows of words. A text has no tokens if it is empty or a word of it has none."""

    def __init__(self, pair: Aligner, texts: list):
        import numpy as np

        index: dict[str, int] = {}
        rows = [[index.setdefault(w, len(index)) for w in pair.words(t)] if t else [] for t in texts]
        # What ends in white space can't stand before another word.
        words = list(index)
        odd = np.array([w[-1].isspace() for w in words], bool)
        order = np.argsort(odd, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words = Aligned(pair, [words[i] for i in order.tolist()])
        word = place[np.fromiter(chain.from_iterable(rows), np.int64, sum(map(len, rows)))]
        text = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
        lost = np.bincount(text[self.words.n_a[word] == 0], minlength=len(rows)) > 0
        kept = ~lost[text]
        self.pair, self.word, self.text = pair, word[kept], text[kept]
        self.bounds = np.searchsorted(self.text, np.arange(len(rows) + 1))
        self.n_a, self.n_b, self.n_groups, self.n_links = map(self._sums, (self.words.n_a, self.words.n_b, self.words.n_groups, self.words.n_links))

    def _sums(self, of_word):
        import numpy as np

        return np.diff(np.concatenate(([0], np.cumsum(of_word[self.word], dtype=np.int64)))[self.bounds])

    @property
    def key(self):
        """The pairs of all links of the different words."""
        return self.words.key

    def sums(self, values):
        """Sum over the links of each text of values given for ``key``."""
        return self._sums(self.words.sums(values))

    def documents_by_pair(self):
        """The distinct linked pairs, and in how many texts each is linked."""
        import numpy as np

        n = len(self.words.n_links)
        own = np.unique(self.text * n + self.word)  # each word once a text
        text, word = own // max(n, 1), own % max(n, 1)
        many = self.words.n_links[word]
        at = np.repeat(self.words.bounds[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        space = len(self.pair.bytes_a) * self.pair.size_b
        return np.unique(np.unique(np.repeat(text, many) * space + self.words.key[at]) % space, return_counts=True)

    def groups(self) -> list[str]:
        """The ids of A and B of each text by group, as text; '' without tokens."""
        parts, word, bounds = self.words.groups(), self.word.tolist(), self.bounds.tolist()
        return [";".join(map(parts.__getitem__, word[i:j])) for i, j in zip(bounds, bounds[1:])]


WORD_STARTS = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
# How the byte-level vocabulary cuts text before merging; a fixed value of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _aligner(vocabulary: str, model: bytes) -> Aligner:
    return Aligner(vocabulary, model)


class Tokenizers:
    """The two tokenizer files, read on the driver and broadcast."""

    def __init__(self, spark, byte_file: str, piece_file: str):
        with open(byte_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
            files = f.read(MODEL_BYTES + 1), g.read(MODEL_BYTES + 1)
        if max(map(len, files)) > MODEL_BYTES:
            raise ValueError(f"a tokenizer file has more than {MODEL_BYTES} bytes")
        self.files = spark.sparkContext.broadcast(files)
        self.size_b = _aligner(*files).size_b

    def __call__(self) -> Aligner:
        return _aligner(*self.files.value)

    def __getstate__(self):
        return {"files": self.files, "size_b": self.size_b}


def linked(docs: DataFrame, both: Tokenizers) -> DataFrame:
    """chunk, key and n: in how many documents of a task each pair is linked; key is A's id times B's size plus B's id."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        chunk, held, size = TaskContext.get().partitionId() // FAN, [], 0

        def added():
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, where, np.concatenate([n for _, n in held]))
            return keys, counts

        def written(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk, np.int32)), pa.array(keys), pa.array(counts)], names=["chunk", "key", "n"])

        for part in slices(batches, "text"):
            found = both().align(part.column("text").to_pylist()).documents_by_pair()
            held.append(found)
            size += len(found[0])
            if size >= TASK_PAIRS:
                held = [added()]
                size = len(held[0][0])
                if 2 * size >= TASK_PAIRS:
                    yield written(*held[0])
                    held, size = [], 0
        if held:
            yield written(*added())

    return docs.select("text").mapInArrow(run, "chunk int, key long, n long")


def _hash_blocks(keys: DataFrame) -> DataFrame:
    """block, sizes, taken (packed bits) and keys of the perfect hash of each block."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        sizes, taken, order = build(group.column("key").to_numpy())
        row = {"block": [group.column("block")[0].as_py()], "sizes": [sizes], "taken": [np.packbits(taken).tobytes()], "keys": [order]}
        return pa.table(row, schema=pa.schema([("block", pa.int32()), ("sizes", pa.list_(pa.int64())), ("taken", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    return keys.groupBy("block").applyInArrow(run, "block int, sizes array<long>, taken binary, keys array<long>")


def _slots(sizes: list[int], taken: bytes):
    import numpy as np

    return np.unpackbits(np.frombuffer(taken, np.uint8), count=sum(sizes)).astype(bool)


def _vectors(partial: DataFrame, hashes: DataFrame) -> DataFrame:
    """block, chunk and the dense count vector of the pair counts of a group of tasks."""

    def run(counts, hash_):
        import numpy as np
        import pyarrow as pa

        sizes = hash_.column("sizes")[0].as_py()
        places = PerfectHash([sizes], [_slots(sizes, hash_.column("taken")[0].as_py())])
        keys = counts.column("key").to_numpy()
        vector = np.zeros(int(places.place.max()) + 1, np.int64)
        np.add.at(vector, places(keys, np.zeros(len(keys), np.int64)), counts.column("n").to_numpy())
        row = {"block": [counts.column("block")[0].as_py()], "chunk": [counts.column("chunk")[0].as_py()], "counts": [vector]}
        return pa.table(row, schema=pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("counts", pa.list_(pa.int64()))]))

    dealt = partial.select("block", "chunk").distinct().join(hashes.select("block", "sizes", "taken"), "block")
    dealt = dealt.select(F.col("block").alias("own_block"), F.col("chunk").alias("own_chunk"), "sizes", "taken")
    return partial.groupBy("block", "chunk").cogroup(dealt.groupBy("own_block", "own_chunk")).applyInArrow(run, "block int, chunk int, counts array<long>")


def _summed(vectors: DataFrame) -> DataFrame:
    """One level of the tree: FAN vectors of a block become one."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        total = sum(np.asarray(v.values) for v in group.column("counts"))
        row = {"block": group.column("block")[:1], "chunk": group.column("chunk")[:1], "counts": pa.array([total], pa.list_(pa.int64()))}
        return pa.table(row)

    next_level = vectors.select("block", F.floor(F.col("chunk") / FAN).cast("int").alias("chunk"), "counts")
    return next_level.groupBy("block", "chunk").applyInArrow(run, "block int, chunk int, counts array<long>")


def pair_counts(docs: DataFrame, both: Tokenizers, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """The hashed count table: block, of (number of blocks), sizes, taken, keys and counts (documents that hold the key's
    pair linked)."""
    pairs = stored(linked(docs, both), "linked")
    distinct = stored(pairs.select("key").distinct(), "pairs")
    blocks = max(1, -(-distinct.count() // block_keys))
    own = block_column(F.col("key"), blocks)
    hashes = stored(_hash_blocks(distinct.select(own.alias("block"), "key")), "hashes")
    vectors = stored(_vectors(pairs.select(own.alias("block"), "chunk", "key", "n"), hashes), "vectors")
    last = pairs.agg(F.max("chunk")).first()[0] or 0
    while last > 0:
        vectors, last = stored(_summed(vectors), "vectors"), last // FAN
    return stored(hashes.join(vectors.select("block", "counts"), "block").withColumn("of", F.lit(blocks)), "counts")


def token_links(counts: DataFrame, both: Tokenizers) -> DataFrame:
    """a, b and n_docs of every linked pair of token ids."""
    each = counts.select(F.explode(F.arrays_zip("keys", "counts")).alias("e"))
    return each.select(F.floor(F.col("e.keys") / both.size_b).alias("a"), (F.col("e.keys") % both.size_b).alias("b"), F.col("e.counts").alias("n_docs"))


class CountTable:
    """Blocks of the count table, looked up by key."""

    def __init__(self, blocks: list[dict], n_blocks: int):
        import numpy as np

        self.places = PerfectHash([b["sizes"] for b in blocks], [_slots(b["sizes"], b["taken"]) for b in blocks])
        self.keys = np.concatenate([b["keys"] for b in blocks]) if blocks else np.empty(0, np.int64)
        self.counts = np.concatenate([b["counts"] for b in blocks]) if blocks else np.empty(0, np.int64)
        # Blocks of other parts are not here.
        self.local = np.full(n_blocks, -1, np.int64)
        self.local[[b["block"] for b in blocks]] = np.arange(len(blocks))

    def __call__(self, keys):
        """Count of each key, 0 for a key that is not in this part."""
        import numpy as np

        from millpond.llm.perfect_hash import block_of

        out = np.zeros(len(keys), np.int64)
        block = self.local[block_of(keys, len(self.local))]
        here = np.flatnonzero(block >= 0)
        place = self.places(keys[here], block[here])
        known = place >= 0
        here, place = here[known], place[known]
        same = self.keys[place] == keys[here]
        out[here[same]] = self.counts[place[same]]
        return out


def align(docs: DataFrame, both: Tokenizers, counts: DataFrame | None = None, part_pairs: int = PART_PAIRS) -> DataFrame:
    """Per document of ``docs`` the numbers and the digest of its groups; ``counts`` are those of another corpus, if given."""
    counts = pair_counts(docs, both) if counts is None else counts
    sizes = counts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.max("of"), F.lit(1))).first()
    total, n_blocks = int(sizes[0]), int(sizes[1])
    # One row for each token of A at most: its vocabulary bounds what is sent.
    best = token_links(counts, both).groupBy("a").agg(F.max("n_docs").alias("most")).toArrow()
    spark, parts = docs.sparkSession, min(n_blocks, max(1, -(-total // part_pairs)))
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for part in range(parts):
        found = counts.where(F.col("block") % parts == part).orderBy("block").toArrow()
        packed = spark.sparkContext.broadcast((found, best, n_blocks))
        rows = _looked_up(rows, both, packed, part == parts - 1)
        if part < parts - 1:
            rows = stored(rows, "aligned")
    return rows


_tables: dict = {}


def _table(packed):
    """The broadcast table, unpacked once for each Python worker."""
    import numpy as np

    if packed.id not in _tables:
        _tables.clear()
        found, best, n_blocks = packed.value
        blocks = [
            {"block": b, "sizes": s, "taken": t, "keys": np.asarray(k.values), "counts": np.asarray(c.values)}
            for b, s, t, k, c in zip(*(found.column(n).to_pylist() for n in ("block", "sizes", "taken")), found.column("keys"), found.column("counts"))
        ]
        ids, most = best.column("a").to_numpy(), best.column("most").to_numpy()
        by_id = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        by_id[ids] = most
        _tables[packed.id] = CountTable(blocks, n_blocks), by_id
    return _tables[packed.id]


class _Shared:
    """A broadcast with a name that is the same in every task."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _looked_up(rows: DataFrame, both: Tokenizers, packed, last: bool) -> DataFrame:
    packed = _Shared(packed)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, most = _table(packed)
        for part in slices(batches, "text"):
            found = both().align(part.column("text").to_pylist())
            n = table(found.key)
            token = found.key // both.size_b
            top = (n > 0) & (n == most[np.minimum(token, len(most) - 1)])
            best = part.column("n_best").to_numpy() + found.sums(top)
            total = part.column("count_sum").to_numpy() + found.sums(n)
            if not last:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(best), pa.array(total)], names=["doc_id", "text", "n_best", "count_sum"])
                continue
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups()]
            numbers = [found.n_a, found.n_b, found.n_groups, found.n_links, best, total]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(digests, pa.string())],
                names=[c.split()[0] for c in COLUMNS.split(", ")])

    return rows.mapInArrow(run, COLUMNS if last else "doc_id long, text string, n_best long, count_sum long")


def report(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    return align(docs.select("doc_id", "text"), Tokenizers(docs.sparkSession, byte_file, piece_file))
