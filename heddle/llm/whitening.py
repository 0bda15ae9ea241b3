"""Whitening of embeddings by a covariance of two passes.

The first pass adds the quantised entries up as exact integers, which gives the mean; the second adds the outer
products of the centred vectors, a batch at a time by one matrix product. Each task sends one partial result, which
treeAggregate merges, so the driver gets a few matrices whatever the number of tasks. LAPACK's symmetric solver gives
the components, which are broadcast (width times components numbers) and applied in batches. A third pass measures
the covariance of what comes out.

An entry c is taken as floor(1024 c) + 100000, held to 2^62 either way. Vectors that are null or hold a null or a
non-finite entry are left out. Vectors of another width are a fit list of their own, with the n, sums and components of
that width; a vector without entries has no components and so gives no rows. Equal vectors and equal or null vec_ids are
rows like all others. A component of no variance (a list of one vector, or of fewer than there are components) is
given with whitened null and takes no part in identity_error, which is 0 where no component has variance; explained is
0 where the whole variance is. An empty table gives no rows. Extra columns are ignored. No row is keyed or gathered, so
there are no hot groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, BOUND = 1024, 100_000, 1 << 62
COMPONENTS = 8
ROWS_AT_ONCE = 1024
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """What is learnt of the vectors of one width."""

    n: int
    total: list[int]  # sums of each dimension
    values: np.ndarray  # of the components, falling
    components: np.ndarray  # a column for each
    explained: np.ndarray
    identity_error: float = 0.0

    def __post_init__(self):
        parts = [divmod(s, self.n) for s in self.total]
        self.whole = np.array([q for q, _ in parts], np.int64)
        self.rest = np.array([r for _, r in parts], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the whole part is taken off as integers, so that no digits are lost."""
        return (x - self.whole).astype(float) - (self.rest / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.has_variance(), self.values, np.nan)
        return self.centred(x) @ self.components / np.sqrt(scale)

    def has_variance(self) -> np.ndarray:
        return self.values > len(self.total) * np.finfo(float).eps * max(0.0, *self.values) if len(self.values) else np.zeros(0, bool)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2 over the dimensions, exact whatever its size; null beyond 38 digits."""
        far = x - self.whole
        if (int(np.abs(far).max(initial=0)) + 1) ** 2 * self.n**2 * x.shape[1] < 1 << 63:
            own = self.n * far - self.rest.astype(np.int64)
            return pa.array((own * own).sum(1)).cast(pa.decimal128(38, 0))
        own = self.n * far.astype(object) - self.rest
        return pa.array([d if d < 10**38 else None for d in (own * own).sum(1).tolist()], pa.decimal128(38, 0))


def quantised(batch: pa.RecordBatch):
    """(width, places in the batch, x) of the usable vectors, some rows at a time."""
    column = batch.column("embedding")
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for width in np.unique(size[size > 0]).tolist():
        places = np.flatnonzero(size == width)
        for a in range(0, len(places), ROWS_AT_ONCE):
            at = places[a : a + ROWS_AT_ONCE]
            flat = pc.fill_null(column.take(pa.array(at)).flatten().cast(pa.float64()), float("nan"))
            c = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(c).all(1)
            if good.any():
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(c[good] * SCALE), -BOUND, BOUND - 2 * SHIFT).astype(np.int64) + SHIFT
                yield width, at[good], x


def _merged(a: dict, b: dict) -> dict:
    """Partial results by width, added up."""
    return a | {width: tuple(x + y for x, y in zip(a[width], part)) if width in a else part for width, part in b.items()}


def _summed(vectors: DataFrame, part) -> dict:
    """Partial results of part(width, x) of all vectors by width: added up in each task, then merged as a tree."""

    def of_batches(batches):
        import pickle

        held: dict = {}
        for batch in batches:
            for width, _, x in quantised(batch):
                held = _merged(held, {width: part(width, x)})
        if held:
            yield pa.RecordBatch.from_pydict({"held": [pickle.dumps(held)]}, schema=pa.schema([("held", pa.binary())]))

    def with_row(held: dict, row) -> dict:
        import pickle

        return _merged(held, pickle.loads(row["held"]))

    return vectors.mapInArrow(of_batches, "held binary").rdd.treeAggregate({}, with_row, _merged)


def _exact_sums(width: int, x: np.ndarray) -> tuple:
    """Rows, and the sums of the dimensions as Python's integers: halves are added apart, so that nothing overflows."""
    return len(x), (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A Fit for each width of the vectors (embedding). The driver holds a matrix for each width."""
    vectors = vectors.select("embedding")
    fits = {width: Fit(n, total.tolist(), np.zeros(0), np.zeros((width, 0)), np.zeros(0)) for width, (n, total) in _summed(vectors, _exact_sums).items()}

    def outer(width: int, x: np.ndarray) -> tuple:
        y = fits[width].centred(x)
        return (y.T @ y,)

    for width, (products,) in _summed(vectors, outer).items():
        values, own = np.linalg.eigh(products / fits[width].n)
        trace = float(np.trace(products)) / fits[width].n
        values, own = np.maximum(0.0, values[::-1][:components]), own[:, ::-1][:, :components]
        fits[width] = Fit(fits[width].n, fits[width].total, values, own, values / trace if trace > 0 else np.zeros(len(values)))

    def moments(width: int, x: np.ndarray) -> tuple:
        w = np.nan_to_num(fits[width].whitened(x))
        return w.sum(0), w.T @ w

    for width, (total, products) in _summed(vectors, moments).items():
        own = fits[width]
        mean = total / own.n  # 0 but for rounding, so nothing is lost by taking it off last
        off = products / own.n - np.outer(mean, mean) - np.eye(len(mean))
        there = own.has_variance()
        own.identity_error = float(np.abs(off[np.ix_(there, there)]).max(initial=0.0))
    return fits


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector (vec_id, embedding) and component, of SCHEMA; deviation is exact."""
    fits = vectors.sparkSession.sparkContext.broadcast(fit(vectors, components))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip((f.split()[0] for f in SCHEMA.split(", ")), kinds)))

    def of_batches(batches):
        for batch in batches:
            for width, at, x in quantised(batch):
                own = fits.value[width]
                w, rows, k = own.whitened(x), len(x), len(own.values)
                wide = lambda v: np.tile(v, rows)
                each = pa.array(np.repeat(np.arange(rows), k))
                columns = [batch.column("vec_id").take(pa.array(at)).take(each), wide(np.arange(1, k + 1, dtype=np.int32)), np.full(rows * k, own.n), own.deviation(x).take(each), pa.array(w.ravel(), from_pandas=True), wide(own.explained), np.full(rows * k, own.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(of_batches, SCHEMA)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; deviation is null where the exact number isn't a long."""
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
