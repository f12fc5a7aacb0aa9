"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows of ``WINDOW`` characters (a shorter item is one window). A text region
within k edits of a window of m characters shares at least m - q + 1 - kq of its q-grams, on diagonals that lie within
k of each other. Documents are scanned for the windows' q-grams, hits are counted in overlapping bands of diagonals,
and bands that reach the bound are verified by a banded alignment. All edits up to the budget are found: the filter
loses no window, and one whose budget leaves no bound is given a smaller one that does. Windows start ``STEP`` characters
apart, so a verbatim quote of WINDOW + STEP - 1 = 149 folded characters is found wherever it starts in an item; one of 100
to 148 only if it holds a whole window or comes within the budget of one.

The benchmark is a stated query set: it goes to the tasks in blocks of at most ``BLOCK`` windows on average, and each
block scans all documents, whole and row by row, without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.llm.common import slices, stored

Q = 8
WINDOW = 100
STEP = 50
EDITS = 0.08  # edits for each character of a window
BAND = 16  # width of a band of diagonals, before the overlap of k; no window has more edits than that
HITS = 2_000_000  # places where a text and a window share a q-gram, counted at once
BLOCK = 20_000  # windows of a block: their q-grams make some 50 MB of a broadcast


def plain(text: str) -> str:
    """Letters and digits in lower case, all else one space."""
    import re

    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def budget(length: int) -> int:
    """Edits allowed in a window: the share of its length, as far as the lemma still asks for a shared q-gram."""
    return max(0, min(int(EDITS * length), BAND, (length - Q) // Q))


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, start, window) of all items; null texts and texts without letters or digits have none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, "text"):
            out = []
            for item, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()):
                t = plain(text or "")
                last = max(0, len(t) - WINDOW)
                out += [(item, s, t[s : s + WINDOW]) for s in sorted({*range(0, last, STEP), last}) if t]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["item_id", "start", "window"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, start long, window string")


class Index:
    """The q-grams of a block of windows."""

    def __init__(self, rows: list[tuple]):
        import numpy as np

        from millpond.llm.ngrams import codes

        # Windows below q characters have no q-gram and are looked for as whole words.
        self.short = [(item, w) for item, _, w in rows if len(w) < Q]
        rows = [r for r in rows if len(r[2]) >= Q]
        self.items = [item for item, _, _ in rows]
        self.letters = [codes(w) for _, _, w in rows]
        self.length = np.array([len(x) for x in self.letters], np.int64)
        self.edits = np.array([budget(n) for n in self.length], np.int64)
        self.least = self.length - Q + 1 - self.edits * Q
        grams = [self.grams(x) for x in self.letters]
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.hashes, self.first = np.unique(every[order], return_index=True)
        self.past = np.append(self.first[1:], len(every))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def grams(letters):
        import numpy as np

        h = np.zeros(max(0, len(letters) - Q + 1), np.uint64)
        for i in range(Q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + letters[i : len(h) + i]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xD1B54A32D192ED03)

    def find(self, texts: list[str]) -> list[dict]:
        """For each text, item -> [windows found, least edits]."""
        import numpy as np

        from millpond.llm.ngrams import codes

        texts = [plain(t) for t in texts]
        found: list[dict] = [{} for _ in texts]
        for item, w in self.short:
            for i, t in enumerate(texts):
                if f" {w} " in f" {t} ":
                    found[i].setdefault(item, [0, 0])[0] += 1
        # One array of all texts. No window holds a line feed, and there are more of them between texts than any budget, so
        # no region reaches from one text into the next.
        apart = "\n" * (BAND + 1)
        letters = codes(apart.join(texts) + apart)
        ends = np.cumsum([len(t) + len(apart) for t in texts]) - 1
        h = self.grams(letters)
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        if not len(at) or not len(self.hashes):
            return found
        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[i] == h[at]
        at, i = at[same], i[same]
        n = self.past[i] - self.first[i]
        key, count = self.counted(at, i, n, len(letters) + WINDOW)
        window, band = np.divmod(key, len(letters) + WINDOW)
        enough = count >= self.least[window]
        window, band = window[enough], band[enough]
        for w, start, edits in self.verify(letters, window, band * BAND - WINDOW):
            doc = int(np.searchsorted(ends, start))
            item = self.items[w]
            best = found[doc].setdefault(item, [set(), edits])
            if isinstance(best[0], set):
                best[0].add(int(w))
            best[1] = min(best[1], edits)
        for each in found:
            for best in each.values():
                best[0] = len(best[0]) if isinstance(best[0], set) else best[0]
        return found

    def counted(self, at, gram, n, span: int):
        """(window * span + band, hits) of all places ``at`` whose q-gram, number ``gram``, has n places in windows.

        In repetitive texts every place meets every place of the same q-gram, so hits are made some at a time.
        """
        import numpy as np

        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        cuts = np.searchsorted(np.cumsum(n), np.arange(HITS, int(n.sum()) + HITS, HITS)) + 1
        for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
            own, some = n[a:b], gram[a:b]
            if not len(own):
                continue
            hit = np.repeat(self.first[some] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            window, diagonal = self.window[hit], np.repeat(at[a:b], own) - self.offset[hit] + WINDOW
            band = diagonal // BAND
            twice = diagonal - band * BAND <= self.edits[window]
            key, count = np.unique(np.concatenate((window * span + band, (window * span + band - 1)[twice])), return_counts=True)
            keys, where = np.unique(np.concatenate((keys, key)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, count)), len(keys)).astype(np.int64)
        return keys, counts

    def verify(self, letters, window, diagonal, chunk: int = 4096):
        """(window, a place in the region, edits) of the candidates whose best alignment in the band is within budget.

        Column c of the table is the diagonal c - k off the band's first; a row is a character of the window. The
        alignment starts and ends anywhere in the text.
        """
        import numpy as np

        out = []
        order = np.argsort(self.length[window], kind="stable")
        window, diagonal = window[order], diagonal[order]
        for s in range(0, len(window), chunk):
            w, d = window[s : s + chunk], diagonal[s : s + chunk]
            k, most = int(self.edits[w].max()), int(self.length[w].max())
            width = BAND + 3 * k + 1
            pattern = np.full((len(w), most), 0, np.uint32)
            for r, x in enumerate(w):
                pattern[r, : self.length[x]] = self.letters[x]
            steps = np.arange(width)
            place = d[:, None] - k + steps  # text place that column c meets at row 0
            cost = np.zeros((len(w), width), np.int64)
            result = np.full(len(w), 1 << 20)
            reached = np.zeros(len(w), np.int64)
            for i in range(most):
                spot = place + i
                text = np.where((spot >= 0) & (spot < len(letters)), letters[np.clip(spot, 0, len(letters) - 1)], 10)
                step = cost + (text != pattern[:, i : i + 1])
                # A character of the window left out moves one diagonal down, one of the text one up.
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(step - steps, axis=1) + steps
                done = self.length[w] == i + 1
                if done.any():
                    result[done] = cost[done].min(axis=1)
                    reached[done] = place[done, cost[done].argmin(axis=1)] + i
            good = result <= self.edits[w]
            out += zip(w[good].tolist(), np.clip(reached[good], 0, len(letters) - 1).tolist(), result[good].tolist())
        return out


def blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator:
    """An index of each block of windows, broadcast."""
    cut = stored(windows(benchmark), "windows")
    n = cut.count()
    parts = -(-n // block)
    for b in range(parts):
        rows = cut.where(F.pmod(F.xxhash64("item_id", "start"), F.lit(parts)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(sorted((tuple(r) for r in rows), key=repr)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, edits) of each document and item that have a window in common.

    ``n_windows`` counts the item's windows found, ``edits`` is the least number of edits of any. Rows that repeat a
    doc_id count as one document, whose numbers are the largest and the smallest. Null or empty texts leak nothing,
    null ids stay null.
    """
    found = None
    for shared in blocks(benchmark):

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for part in slices(batches, "text"):
                got = shared.value.find([t or "" for t in part.column("text").to_pylist()])
                rows = [(doc, item, n, edits) for doc, items in zip(part.column("doc_id").to_pylist(), got) for item, (n, edits) in items.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "n_windows", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_windows long, edits long")
        part = part.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("edits").alias("edits"))
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, edits long")
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.min("edits").alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with the columns of ``docs``; null and empty texts hold
    none and stay."""
    for shared in blocks(benchmark):

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for part in slices(batches, "text"):
                got = shared.value.find([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array([not items for items in got], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
