"""Near-duplicate classes by BagMinHash.

A text is a multiset of its five-word shingles. Each shingle has a Poisson process for each level of its weight (the
unit interval, then intervals that double in width); a point at weight position p counts for a text that holds the
shingle more than p times. Points fall into the components of the signature at random and the earliest one wins, so two
signatures agree in a component with the probability of their weighted Jaccard similarity. Only points before a time
limit are drawn, enough to fill all components with a high chance; else the limit doubles.

Bands of the signature make buckets. Texts of a bucket are compared with its centre first. In buckets that then still
hold several classes every pair across classes is estimated from the signatures, in large buckets block by block, and in
the first bucket that the pair shares only. Texts with a likely partner meet again in the same blocks with their shingle
multisets, all pairs across classes are computed exactly there, and a block gives out only the links that join its
classes, at most one less than it has members. So the rows between stages are in proportion to the texts, whatever the
number of pairs. The first bands go first: the classes they join need no more work in the others.
Equal texts are one node from the start. Nothing that grows with the data goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millpond.llm.common import slices, stored, text_or_empty

WORDS = 5
SIMILARITY = 0.8
COMPONENTS = 192
BAND = 6  # components in a band: of pairs at 0.8 six in 100,000 share none of 32 bands, at 0.85 three in 10 million
SMALL = 32  # buckets up to this size are one block, larger ones are dealt to several
BLOCK = 1024  # about as many texts of a large bucket meet as many others in a block
BLOCK_BYTES = 16 << 20  # or as many as have multisets of this size
LIKELY = 0.66  # estimated similarity from which a pair of a bucket is computed: 4.8 deviations below SIMILARITY
ROUNDS = ((0, 4), (4, COMPONENTS // BAND))  # bands whose mixed buckets are worked on together
COLUMNS_AT_ONCE = 4096  # shingles of a block that are multiplied at once


def mixed(x):
    """A 64-bit finaliser, on arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingles:
    """Distinct shingle hashes of a text and how often it holds each; words are lower-case runs between white space."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, WordHashes()

    def __call__(self, text: str):
        import numpy as np

        tokens = text.lower().split()
        h = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        n = min(self.words, len(h))  # a shorter text is one shingle
        if not n:
            return h, np.empty(0, np.int64)
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return np.unique(mixed(out), return_counts=True)


def signatures(bags: list, components: int = COMPONENTS):
    """One row of component hashes for each bag (hashes, counts); bags must not be empty."""
    import numpy as np

    out = np.zeros((len(bags), components), np.uint64)
    todo, spread = np.arange(len(bags)), np.log(components) + 5.0
    totals = np.array([c.sum() for _, c in bags], float)
    while len(todo):
        key = np.concatenate([bags[d][0] for d in todo])
        weight = np.concatenate([bags[d][1] for d in todo]).astype(float)
        doc = np.repeat(np.arange(len(todo)), [len(bags[d][0]) for d in todo])
        limit = components * spread / totals[todo]
        best = np.full(len(todo) * components, np.inf)
        points = []
        level = 0
        while len(key):
            # Level 0 covers weights below 1, level k those from 2^(k-1) to 2^k.
            low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            there = weight > low
            key, weight, doc = key[there], weight[there], doc[there]
            seed = mixed(key + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            at, w, d, time = seed, weight, doc, np.zeros(len(key))
            while len(at):
                at = mixed(at + np.uint64(0xD1B54A32D192ED03))
                time = time - np.log(((at >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / width
                early = time <= limit[d]
                at, w, d, time = at[early], w[early], d[early], time[early]
                which = mixed(at ^ np.uint64(0xA0761D6478BD642F))
                slot = d * components + (which % np.uint64(components)).astype(np.int64)
                counts = low + width * ((which >> np.uint64(11)).astype(float) * 2.0**-53) < w
                slot, stamp, name = slot[counts], time[counts], at[counts]
                np.minimum.at(best, slot, stamp)
                points.append((slot, stamp, name))
            level += 1
        slot, stamp, name = (np.concatenate(x) for x in zip(*points))
        first = stamp == best[slot]
        found = np.zeros(len(best), np.uint64)
        found[slot[first]] = name[first]
        full = np.isfinite(best.reshape(-1, components)).all(axis=1)
        out[todo[full]] = found.reshape(-1, components)[full]
        todo, spread = todo[~full], spread * 2
    return out


def banded(signature, band: int = BAND):
    """One hash for each run of ``band`` components; it tells the bands apart."""
    import numpy as np

    n = signature.shape[1] // band
    out = np.tile(np.arange(n, dtype=np.uint64), (len(signature), 1))
    for i in range(band):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, i : n * band : band])
    return out.view(np.int64)


def text_hash():
    return F.unhex(F.md5(text_or_empty()))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), bands, signature (a byte of each component) and size (bytes of the shingle multiset)
    of every row; bands and signature are null without words."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles = Shingles()
        for part in slices(batches, "text"):
            bags = [shingles(t) for t in part.column("text").to_pylist()]
            some = [i for i, b in enumerate(bags) if len(b[0])]
            bands: list = [None] * len(bags)
            short: list = [None] * len(bags)
            if some:
                full = signatures([bags[i] for i in some])
                for i, row, own in zip(some, banded(full), full.astype(np.uint8)):
                    bands[i], short[i] = row, own.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array([8 * int(n.sum()) for _, n in bags], pa.int64())], names=["doc_id", "th", "bands", "signature", "size"])

    return docs.select("doc_id", text_hash().alias("th"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, th binary, bands array<long>, signature binary, size long")


def similar(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of text hashes whose shingle multisets are similar enough. ``b`` is the side that may be hot."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles, centres = Shingles(), {}
        for part in slices(batches, "text_a"):
            near = []
            for b, text_a, text_b in zip(part.column("b").to_pylist(), part.column("text_a").to_pylist(), part.column("text_b").to_pylist()):
                if b not in centres:
                    if len(centres) >= 64:
                        centres.clear()
                    centres[b] = shingles(text_b)
                (h, n), (k, m) = shingles(text_a), centres[b]
                _, x, y = np.intersect1d(h, k, assume_unique=True, return_indices=True)
                both = int(np.minimum(n[x], m[y]).sum())
                near.append(both >= least * (int(n.sum() + m.sum()) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    own = texts.select(F.col("th").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("th").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(own, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def blocks(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """band, i, j, g: the members (th, label, side, signature, bands, no) of a block, from the buckets that hold several
    classes. ``no`` is the number of the band.

    The largest class of a large bucket and the rest are dealt to parts by a hash; each part of the rest meets every part.
    A pair counts where its sides are 0 and 1, or both 2. So each pair across classes of a bucket counts in one block.
    """
    held = members.join(labels.withColumnRenamed("node", "th"), "th", "left").join(nodes.select("th", "size"), "th").select("band", "no", "th", "size", F.coalesce("label", "th").alias("label"))
    sizes = held.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    several = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("k"), F.max(F.struct("n", "label", "size")).alias("top")).where("k > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    whole = (F.col("n") <= SMALL) & (F.col("size") <= BLOCK_BYTES)
    several = several.select("band", whole.alias("whole"), F.col("top.label").alias("top"), parts(F.col("top.n"), F.col("top.size")).alias("p"), parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("q"))
    found = held.join(stored(several, "several"), "band")
    salt = lambda n: F.pmod(F.xxhash64("th"), F.col(n)).cast("int")
    at = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    top = F.transform(each("q"), lambda j: at(-1 - salt("p"), j, F.lit(0)))
    own = salt("q")
    rest = F.concat(
        F.transform(each("p"), lambda i: at(-1 - i, own, F.lit(1))),
        F.transform(each("q"), lambda j: at(F.least(own, j), F.greatest(own, j), F.when(own < j, 0).when(own > j, 1).otherwise(2))))
    where = F.when(F.col("whole"), F.array(at(F.lit(0), F.lit(0), F.lit(2)))).when(F.col("label") == F.col("top"), top).otherwise(rest)
    return found.select("band", "no", "th", "label", F.explode(where).alias("at")).select("band", "no", "th", "label", "at.*")


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each block with its members in ``g``."""
    return rows.groupBy("band", "i", "j").agg(F.collect_list(F.struct("th", "label", "side", *columns)).alias("g"))


def numbered(values: list):
    """Equal values as equal numbers."""
    import numpy as np

    return np.unique(np.array([v.hex() for v in values]), return_inverse=True)[1]


def facing(i: int, side, label):
    """Members that member i is paired with in a block."""
    return (label != label[i]) & (side == (0 if side[i] == 1 else 2))


def hopeful(dealt: DataFrame, nodes: DataFrame, least: float = LIKELY) -> DataFrame:
    """The members of blocks that have a partner of another class, likely similar by signature, whose first common bucket
    this is: band, i, j, th, label, side."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep: list = []
            for at, g in enumerate(batch.column("g")):
                g = g.as_py()
                # Rows are components, so that agreements add up along whole rows; their number fits in a byte.
                own = np.ascontiguousarray(np.frombuffer(b"".join(m["signature"] for m in g), np.uint8).reshape(len(g), -1).T)
                bands, no = np.array([m["bands"] for m in g]), g[0]["no"]
                side, label = np.array([m["side"] for m in g]), numbered([m["label"] for m in g])
                some = np.zeros(len(g), bool)
                # Different components have an equal byte once in 256.
                enough = (least * (1 - 1 / 256) + 1 / 256) * len(own)
                for i in np.flatnonzero(side > 0).tolist():
                    near = (own == own[:, i : i + 1]).sum(axis=0, dtype=np.uint8) >= enough
                    near &= facing(i, side, label)
                    if some[i]:
                        near &= ~some
                    near = np.flatnonzero(near)
                    near = near[(bands[near] == bands[i]).argmax(axis=1) == no]
                    if len(near):
                        some[near] = some[i] = True
                keep += [(at, g[i]["th"], g[i]["label"], g[i]["side"]) for i in np.flatnonzero(some).tolist()]
            if keep:
                where, th, label, side = zip(*keep)
                place = [batch.column(c).take(pa.array(where)) for c in ("band", "i", "j")]
                yield pa.RecordBatch.from_arrays([*place, pa.array(th, pa.binary()), pa.array(label, pa.binary()), pa.array(side, pa.int32())], names=["band", "i", "j", "th", "label", "side"])

    signed = dealt.join(nodes.select("th", "signature", "bands"), "th")
    return gathered(signed, "signature", "bands", "no").mapInArrow(run, "band long, i int, j int, th binary, label binary, side int")


def multisets(texts: DataFrame) -> DataFrame:
    """th and bag of each text: 64-bit hashes of its shingles, the k-th occurrence of one counted as an element of its own."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles = Shingles()
        for part in slices(batches, "text"):
            bags = []
            for text in part.column("text").to_pylist():
                h, n = shingles(text)
                each = np.repeat(h, n)
                again = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                bags.append(np.where(again > 0, mixed(each + again.astype(np.uint64)), each).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("th"), pa.array(bags, pa.binary())], names=["th", "bag"])

    return texts.select("th", "text").mapInArrow(run, "th binary, bag binary")


def overlaps(bags: list):
    """Elements that each two sets have in common, as a matrix."""
    import numpy as np

    sizes = np.array([len(b) for b in bags])
    names, at = np.unique(np.concatenate(bags), return_inverse=True)
    owner = np.repeat(np.arange(len(bags)), sizes)
    # An element of one set alone counts for no pair.
    shared = np.bincount(at, minlength=len(names)) > 1
    at, owner = (np.cumsum(shared) - 1)[at[shared[at]]], owner[shared[at]]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(bags), len(bags)), np.float64)
    wide = min(COLUMNS_AT_ONCE, int(shared.sum()))
    for start in range(0, int(shared.sum()), max(wide, 1)):
        i, j = np.searchsorted(at, [start, start + wide])
        held = np.zeros((len(bags), wide), np.float32)
        held[owner[i:j], at[i:j] - start] = 1
        out += held @ held.T
    return out


def joining(bags: list, label, side, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of members that are similar enough and together join all classes of a block that such pairs join."""
    import numpy as np

    both = overlaps(bags)
    sizes = np.array([len(b) for b in bags], float)
    near = both >= least * (sizes[:, None] + sizes[None, :] - both)
    found, reached = [], np.zeros(int(label.max()) + 1, bool)
    for start in range(len(reached)):
        if reached[start]:
            continue
        reached[start] = True
        todo = [start]
        while todo:
            for i in np.flatnonzero(label == todo.pop()).tolist():
                # Both directions of the rule which sides meet.
                meet = (side == 2) if side[i] == 2 else (side == 1 - side[i])
                for j in np.flatnonzero(near[i] & meet & ~reached[label]).tolist():
                    if not reached[label[j]]:
                        reached[label[j]] = True
                        todo.append(label[j])
                        found.append((i, j))
    return found


def block_links(members: DataFrame, bags: DataFrame) -> DataFrame:
    """The links (a, b) that join classes of the blocks, computed on the multisets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for g in batch.column("g"):
                g = g.as_py()
                held = [np.frombuffer(m["bag"], np.uint64) for m in g]
                pairs = joining(held, numbered([m["label"] for m in g]), np.array([m["side"] for m in g]))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([g[i]["th"] for i, _ in pairs], pa.binary()), pa.array([g[j]["th"] for _, j in pairs], pa.binary())], names=["a", "b"])

    return gathered(members.join(bags, "th"), "bag").select("g").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of edges (a, b): the smallest node reaches all others.

    Labels spread to neighbours and then jump to their own label's label, so paths shorten by doubling. Every step is
    a stored table; only whether anything changed comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("near"))
        further = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = stored(spread.join(further, "near").select("node", F.least("near", "far").alias("new"), (F.least("near", "far") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", F.col("new").alias("label"))
        if not new.where("moved").limit(1).count():
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, th, class_id, n_copies, class_rows and keeper of every row.

    ``class_id`` is the smallest doc_id of the class, ``n_copies`` counts the rows of equal text, ``class_rows`` those of
    the class. One row of each class is its keeper (one key: repeats of a row are keepers
    together). A null text is an empty one; texts without words are near no other text. A null doc_id is never a class
    id while its class has another. An empty table gives no rows.
    """
    rows = stored(sketch(docs), "bagminhash")
    nodes = stored(rows.groupBy("th").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "nodes")
    every = nodes.where("bands is not null").select("th", F.posexplode("bands").alias("no", "band"))
    # Written, so that both sides of the join are plain shuffles, which Spark splits where a bucket is hot.
    first = F.min(F.struct(F.xxhash64("th"), "th")).alias("c")
    buckets = stored(every.groupBy("band").agg(F.count("*").alias("n"), first).where("n > 1").select("band", F.col("c.th").alias("centre")), "buckets")
    members = stored(every.join(buckets, "band"), "members")
    needed = members.select("th").distinct().join(nodes.select("th", "first"), "th")
    source = docs.select("doc_id", text_hash().alias("th"), text_or_empty().alias("text"))
    # One row of each node; more only where a row is repeated as a whole.
    texts = stored(source.join(needed, "th").where(F.col("doc_id").eqNullSafe(F.col("first"))).dropDuplicates(["th"]).select("th", "text"), "texts")

    # One order of nodes decides the centres of all buckets, so a family has few different ones.
    star = members.where("th != centre").select(F.col("th").alias("a"), F.col("centre").alias("b")).distinct()
    links = stored(similar(star, texts), "links")
    labels = components(links)

    for low, high in ROUNDS:
        own = members.where((F.col("no") >= low) & (F.col("no") < high)).select("band", "no", "th")
        meeting = stored(hopeful(blocks(own, labels, nodes), nodes), "meeting")
        bags = stored(multisets(texts.join(meeting.select("th").distinct(), "th", "left_semi")), "bags")
        more = stored(block_links(meeting, bags), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)

    named = nodes.select("th", "first", "n_copies").join(labels.withColumnRenamed("node", "th"), "th", "left").withColumn("label", F.coalesce("label", "th"))
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "th")).alias("head"), F.sum("n_copies").alias("class_rows"))
    named = named.join(heads, "label")
    named = stored(named.select("th", F.col("head.first").alias("class_id"), "n_copies", "class_rows", (F.col("head.th") == F.col("th")).alias("_head")), "named")
    out = rows.select("doc_id", "th").join(named, "th")
    return out.select("doc_id", "th", "class_id", "n_copies", "class_rows", (F.col("_head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keeper"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_copies and class_rows of every row."""
    return classes(docs).select("doc_id", "class_id", "n_copies", "class_rows")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``; of wholly repeated rows one stays."""
    keep = stored(classes(docs).where("keeper").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count("*").alias("_n")), "keepers")
    # The row travels as one column, so none of its names can clash.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text_hash().alias("_key"), F.col("doc_id").alias("_own"))
    found = marked.join(keep, (marked._key == keep._th) & marked._own.eqNullSafe(keep._id))
    once = found.where("_n = 1").select("_doc")
    again = found.where("_n > 1").dropDuplicates(["_key", "_id"]).select("_doc")
    return once.union(again).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
