"""Sharding along a Hilbert curve over several metadata dimensions, in DataFrame functions only.

Each dimension is cut at its quantiles, numbers as numbers and texts as whole texts, into 2^bits cells, the cell numbers
give an index on a Hilbert curve, rows are sorted by it and the order is cut into runs of equal length. Files of one run then span little of every dimension, so
their minima and maxima prune on any of them.

Texts are read once, into a stored table of ids, sizes and checksums. That is dealt by ranges of (curve index, checksum,
id hash), which splits a cell or a text that holds a third of all rows, and each row's place follows from its place in
its range and the counts of the ranges before it. Only the cut points and one count for each range are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.llm.common import stored, text_or_empty

SHARDS = 16
BITS = 4
ACCURACY = 10_000


def cut_points(df: DataFrame, dims: list[str], bits: int) -> dict[str, list]:
    """The 2^bits - 1 inner quantiles of each dimension. A frequent value repeats, so values get cells by their share."""
    cells = 1 << bits
    at = [i / cells for i in range(1, cells)]
    texts = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in texts]
    row = df.agg(*[F.percentile_approx(d, at, ACCURACY).alias(d) for d in numbers]).first() if numbers else {}
    return {d: text_quantiles(df, d, cells) if d in texts else sorted(row[d] or []) for d in dims}


def text_quantiles(df: DataFrame, column: str, cells: int) -> list[str]:
    """The cells - 1 inner quantiles of a column of texts, by their whole value.

    Rows are counted by value first, and the values dealt by ranges, so neither a hot value nor many different ones meet in
    one task; a value's place follows from those before it in its range and from the counts of the ranges before.
    """
    counts = stored(df.groupBy(column).agg(F.count("*").alias("_n")).repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "values")
    ranges = counts.groupBy("_part").agg(F.sum("_n").alias("_all"))
    # One row for each range: as many as there are tasks.
    before = ranges.select("_part", (F.sum("_all").over(W.orderBy("_part")) - F.col("_all")).alias("_before"))
    upto = counts.join(F.broadcast(before), "_part").withColumn("_upto", F.col("_before") + F.sum("_n").over(W.partitionBy("_part").orderBy(column)))
    total = df.count()
    # Values that reach a further cut: fewer than there are cells.
    cut = lambda n: F.floor(n * cells / F.lit(max(total, 1)))
    rows = upto.select(column, cut(F.col("_upto") - F.col("_n")).alias("low"), cut(F.col("_upto")).alias("high")).where("low < high").collect()
    reached = sorted((r.high, r[column]) for r in rows)
    return [next(value for high, value in reached if high >= i) for i in range(1, cells)] if total else []


def hilbert_index(df: DataFrame, dims: list[str], bits: int, name: str = "curve") -> DataFrame:
    """Add the index on the Hilbert curve of the point whose coordinates, each of ``bits`` bits, are in ``dims``.

    The transposed form is worked out bit by bit, from the high one down, and then interleaved. Every step is a
    projection of its own, so no expression is repeated inside another one.
    """
    n = len(dims)
    x = [f"_x{i}" for i in range(n)]
    df = df.withColumns({x[i]: F.col(d).cast("int") for i, d in enumerate(dims)})
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            set_ = F.getbit(F.col(x[i]).cast("long"), F.lit(bit)) == 1
            if i == 0:
                df = df.withColumn(x[0], F.when(set_, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0])))
            else:
                # A set bit turns the first axis round; else the low bits of both axes change places.
                differ = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(low))
                df = df.withColumn("_turn", F.when(set_, F.lit(low)).otherwise(differ)).withColumn("_swap", F.when(set_, F.lit(0)).otherwise(differ))
                df = df.withColumns({x[0]: F.col(x[0]).bitwiseXOR(F.col("_turn")), x[i]: F.col(x[i]).bitwiseXOR(F.col("_swap"))})
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    mask = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        mask = mask.bitwiseXOR(F.when(F.getbit(F.col(x[-1]).cast("long"), F.lit(bit)) == 1, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_mask", mask)
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for c in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.getbit(F.col(c).bitwiseXOR(F.col("_mask")).cast("long"), F.lit(bit)).cast("long"))
    return df.withColumn(name, index).drop(*x, "_mask", "_turn", "_swap")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add each row's place, from 0, in the order of all rows. Rows equal in all of ``order`` come in either order."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    dealt = stored(dealt, "ranked")
    # The upper bits of the place are the range, the lower 33 the row in it.
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row for each range: as many as there are tasks.
    starts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + row).drop("_part", "_start", "_place")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of every row.

    Law ``rows``: run s takes the places from s * n / shards on, so counts are at most one apart. Dimensions are lang,
    source and size; a null text is empty, null languages and sources sort as empty texts. Rows of equal texts lie
    next to each other within a cell; wholly equal rows get neighbouring slots in either order. An empty table gives
    no rows.
    """
    text = text_or_empty()
    light = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("lang", "source")]), "shards")
    dims = {"_lang": "_c0", "_source": "_c1", "size": "_c2"}
    cuts = cut_points(light, list(dims), bits)
    cells = light.withColumns({c: sum((F.col(d) > F.lit(v)).cast("int") for v in cuts[d]) + F.lit(0) for d, c in dims.items()})
    curved = hilbert_index(cells, list(dims.values()), bits).withColumn("_tie", F.xxhash64("doc_id")).drop("_lang", "_source", *dims.values())
    placed = ranked(curved, ["curve", "text_crc32", "_tie", "doc_id"])
    n = light.count()
    shard = F.expr(f"(rank * {shards}L) div {max(n, 1)}L")
    out = placed.withColumn("shard", shard.cast("int"))
    # The first place of shard s is the least one whose shard is s.
    start = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
