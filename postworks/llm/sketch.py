"""Filters of bounded size that tell tasks which ids are not in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postworks.llm.words import mix

#: Bits of a filter, at least and at most (32 MB), and for each id in between.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 28, 16
_U = np.uint64
_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(ids.view(np.uint64) ^ _U(seed)) & _U(bits - 1)).astype(np.int64) for seed in _SEEDS]


def id_filter(table: DataFrame, column: str) -> np.ndarray:
    """The words of a Bloom filter of a column of whole numbers; tasks make parts of it that Spark puts together.

    Its size follows the table up to a bound; of a larger table more ids pass,
    which a join must sort out in any case.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(BITS_EACH * table.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.sort(np.concatenate(_places(b.column(0).to_numpy(), bits)))
            if len(at):
                begin = np.flatnonzero(np.concatenate(([True], at[1:] >> 6 != at[:-1] >> 6)))
                words = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(np.uint64), begin)
                yield pa.RecordBatch.from_arrays([pa.array(at[begin] >> 6), pa.array(words.view(np.int64))], ["word", "bits"])

    made = table.select(F.col(column).cast("long")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[made["word"].to_numpy()] = made["bits"].to_numpy()
    return out


def may_have(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the table that the filter was made from."""
    out = np.ones(len(ids), bool)
    for at in _places(np.ascontiguousarray(ids), len(words) * 64):
        out &= (words.view(np.uint64)[at >> 6] >> (at & 63).astype(np.uint64) & _U(1)).astype(bool)
    return out


def maybe_in(rows: DataFrame, column: str, words: np.ndarray, wanted: bool = True) -> DataFrame:
    """Rows whose id may be in the table that the filter was made from; or the others (wanted is false), which surely aren't, null ids among them."""
    sent, at = rows.sparkSession.sparkContext.broadcast(words), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(at)
            may = may_have(sent.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(may == wanted))

    return rows.mapInArrow(run, rows.schema)
