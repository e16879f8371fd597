"""Bitmaps of fixed size that executors fill and the driver puts together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a place within its chunk.
CHUNK_BITS = 15


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits, those of the ints in the only column set. Chunks are packed where they are; the driver sees bytes of fixed number."""
    low = bits if bits < CHUNK_BITS else CHUNK_BITS
    chunks = (
        places.toDF("p").where("p is not null").distinct()
        .groupBy(F.shiftright("p", low).alias("chunk"))
        .agg(F.collect_list(F.col("p").bitwiseAND((1 << low) - 1).cast("int")).alias("own"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own in batch.column(1):
                seen = np.zeros(1 << low, bool)
                seen[own.values.to_numpy()] = True
                made.append(np.packbits(seen, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["chunk", "bytes"])

    out = np.zeros((1 << bits) >> 3, np.uint8)
    size = (1 << low) >> 3
    filled = chunks.mapInArrow(pack, "chunk int, bytes binary").toArrow()
    for chunk, data in zip(filled.column(0).to_pylist(), filled.column(1), strict=True):
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(data.as_buffer(), np.uint8)
    return out


def held(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place's bit is set. ``places``: uint64."""
    return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
