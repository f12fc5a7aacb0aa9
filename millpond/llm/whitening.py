"""Whitening of quantised embeddings by their weighted covariance.

Equal vectors are one row with their count as weight. Sums and the covariance are taken over these rows: each task
centres its vectors, multiplies them (weighted) into one matrix and gives out its rows, which are added by row number. The
eigenvectors of the d x d matrix whiten each distinct vector once; the rows get their results by a join.

Integer work is exact: sums are added as decimals, and n * x - S is taken before it is divided or squared. What goes to the
driver is d sums and the d x d matrix. A row is left out if its vector is null, empty, holds a null or non-finite entry or
one too large for a long, or has another length than most vectors (ties: the longer). An empty table gives no rows; a
component whose variance is zero, up to rounding, can't be whitened and is left out, so one vector alone gives none. A
deviation beyond a long is null. Null and repeated ids stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millpond.llm.common import stored

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LONG = 1 << 63


def quantised(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key`` and x, the array of longs floor(SCALE * c) + SHIFT, of the rows that remain."""
    small = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**56)
    # Guarded by itself: the optimizer may compute it before the filter.
    entry = lambda c: F.floor(F.when(small(c), c.cast("double")) * SCALE) + SHIFT
    fit = F.col(vector).isNotNull() & F.forall(vector, small) & (F.size(vector) > 0)
    rows = df.where(F.coalesce(fit, F.lit(False))).select(F.col(key), F.transform(vector, entry).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")))
    d = lengths.first()[0]
    return rows.where(F.size("x") == (d.d if d else 0))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """id, x and n of each distinct x."""
    return rows.groupBy("x").agg(F.count("*").alias("n")).select(vector_id("x").alias("id"), "x", "n")


def vector_id(x: str):
    return F.unhex(F.md5(F.array_join(F.col(x).cast("array<string>"), ",")))


def matrix(column):
    """An Arrow list column, all of one length, as a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), flat.dtype)


def largest(x) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def sums(df: DataFrame, column: str) -> tuple[int, list]:
    """Number of rows and per-dimension sums of an array column under weights n: exact ints of longs, floats of doubles."""
    whole = df.schema[column].dataType.elementType.typeName() == "long"

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        count, total = 0, None
        for batch in batches:
            x, n = matrix(batch.column(column)), batch.column("n").to_numpy()
            if not len(n):
                continue
            count += int(n.sum())
            if whole and largest(x) * int(n.sum()) >= LONG:
                x = x.astype(object)
            own = (x * n[:, None]).sum(axis=0)
            total = (own.astype(object) if whole else own) if total is None else total + own
        if total is not None:
            values = [Decimal(int(v)) for v in [count, *total]] if whole else [float(count), *map(float, total)]
            kind = pa.decimal128(38, 0) if whole else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(values) - 1), pa.int32()), pa.array(values, kind)], names=["i", "s"])

    parts = df.select(column, "n").mapInArrow(run, f"i int, s {'decimal(38,0)' if whole else 'double'}")
    found = parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    if not found:
        return 0, []
    return int(found[0].s), [int(r.s) if whole else r.s for r in found[1:]]


def centred(x, n: int, total: list):
    """x minus the mean, as doubles; of whole numbers n * x - S is exact before the division."""
    import numpy as np

    if x.dtype.kind == "f":
        return x - np.array(total) / n
    return apart(x, n, total).astype(float) / n


def apart(x, n: int, total: list):
    """n * x - S, exact."""
    import numpy as np

    if n * largest(x) + max(map(abs, total), default=0) < LONG:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def covariance(df: DataFrame, column: str, n: int, total: list):
    """The covariance of an array column under weights n, divisor n, centred before multiplying."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        product = np.zeros((len(total), len(total)))
        for batch in batches:
            if batch.num_rows:
                x = centred(matrix(batch.column(column)), n, total)
                product += (x * batch.column("n").to_numpy()[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(product), pa.list_(pa.float64()))], names=["i", "row"])

    def add(group):
        import pyarrow as pa

        row = np.sum([np.asarray(r.values) for r in group.column("row")], axis=0)
        return pa.table({"i": group.column("i")[:1], "row": pa.array([row], pa.list_(pa.float64()))})

    parts = df.select(column, "n").mapInArrow(run, "i int, row array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").toArrow()
    out = np.zeros((len(total), len(total)))
    for i, row in zip(rows.column("i").to_pylist(), rows.column("row").to_pylist()):
        out[i] = row
    return out / max(n, 1)


def eigenvectors(v, components: int = COMPONENTS):
    """The largest eigenvalues and their unit eigenvectors (columns); those that are zero up to rounding are left out."""
    import numpy as np

    if not len(v):
        return np.empty(0), np.empty((0, 0))
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    some = values > max(values[0], 0) * len(v) * np.finfo(float).eps
    return values[some], vectors[:, some]


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row: ``key``, whitened (array<double>, one entry per component), deviation, and, the same in all rows,
    n, explained (array<double>) and identity_error."""
    import numpy as np

    rows = quantised(df, vector, key)
    groups = stored(distinct_vectors(rows), "vectors")
    n, total = sums(groups, "x")
    v = covariance(groups, "x", n, total)
    values, vectors = eigenvectors(v, components)
    turn = vectors / np.sqrt(values)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            far = apart(x, n, total)
            if far.dtype == object or len(total) * largest(far) ** 2 >= LONG:
                far = far.astype(object)
            deviation = [int(d) if int(d) < LONG else None for d in (far * far).sum(axis=1)]
            white = centred(x, n, total) @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n"), pa.array(deviation, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                names=["id", "n", "deviation", "whitened"])

    white = stored(groups.mapInArrow(run, "id binary, n long, deviation long, whitened array<double>"), "whitened")
    error = 0.0
    if len(values):
        left = covariance(white, "whitened", *sums(white, "whitened")) - np.eye(len(values))
        error = float(np.abs(left).max())
    explained = F.array(*[F.lit(float(e)) for e in values / np.trace(v)]) if len(values) else F.array().cast("array<double>")
    # A hot vector is one row on the right; adaptive execution splits its rows on the left.
    back = rows.select(F.col(key), vector_id("x").alias("id")).join(white.drop("n"), "id")
    return back.select(
        F.col(key), "whitened", "deviation", F.lit(n).cast("long").alias("n"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def report(df: DataFrame) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    done = whiten(df)
    each = done.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
