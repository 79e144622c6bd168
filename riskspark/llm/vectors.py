"""What the two vector operators share: usable vectors, vectors as matrices, bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def matrix(vectors: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def by_width(vectors: pa.Array) -> list[tuple[int, np.ndarray]]:
    """Lengths of the vectors, each with the places of its vectors."""
    sizes = np.diff(vectors.offsets.to_numpy())
    return [(int(w), np.flatnonzero(sizes == w)) for w in np.unique(sizes)]


def drawn(df: DataFrame, order: Column, most: int) -> DataFrame:
    """A sample of at most ``most`` rows, the first by ``order``."""
    return df.orderBy(order).limit(most)
