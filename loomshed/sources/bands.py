"""Packed strips of frame files, read in bands of rows by many tasks.

One pass reads the directories of every frame by ranges (``trees.Ranges``) and lists its strip as bands of
whole rows, each of which begins where a packed word does: with an odd width and 12 bits that is every
other row. Bands are dealt out over tasks, whatever file they are of; a task reads a band's bytes alone and
unpacks them, so a frame of any size is many tasks, and no file is read whole.

Defined results: a frame that breaks a rule of the strict reader is one row with its error and no band;
one whose bytes cannot be read when a band is, fails the job, for its sums would be wrong; an empty tree
gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.operators.planes import unpacked
from loomshed.sources import tiff
from loomshed.sources.trees import WINDOW, Ranges, frame_files, opened

#: Samples of a band, about.
SAMPLES = 1 << 20
BANDS = (
    "rel string, error string, width int, height int, bits int, first_row int, n_rows int, offset long, n_bytes long"
)
_KINDS = [pa.string(), pa.string(), *[pa.int32()] * 5, *[pa.int64()] * 2]
_NAMES = [c.split()[0] for c in BANDS.split(", ")]


def band_rows(width: int, bits: int, samples: int = SAMPLES) -> int:
    """Rows of a band: about ``samples`` samples, and a whole number of packed words."""
    rows = max(samples // max(width, 1), 1)
    return rows + rows % 2 if bits == 12 and width % 2 else rows


def frame_bands(spark: SparkSession, root: str, samples: int = SAMPLES, window: int = WINDOW) -> DataFrame:
    """A row a band of every frame below ``root`` (columns of ``BANDS``)."""

    def run(batches):
        fs, path = opened(root)
        for batch in batches:
            rows = []
            for rel in batch.column(0).to_pylist():
                try:
                    with fs.open_input_file(f"{path}/{rel}") as f:
                        t = tiff.raw_frame(Ranges(f, f.size(), window))
                except (tiff.Broken, OSError) as e:
                    rows.append((rel, str(e), *[None] * 7))
                    continue
                w, h, bits = t["width"], t["height"], t["bits"]
                step = band_rows(w, bits, samples)
                for y in range(0, h, step):
                    n = min(step, h - y)
                    rows.append((rel, None, w, h, bits, y, n, t["strip_offset"] + y * w * bits // 8, -(-n * w * bits // 8)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return frame_files(spark, root, ["rel"]).mapInArrow(run, BANDS)


def map_bands(bands: DataFrame, root: str, make: Callable, schema: str) -> DataFrame:
    """What ``make(samples, first_row, width)`` gives, a dict of columns, for each band's rows x columns samples, behind (rel)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        fs, path = opened(root)
        for batch in batches:
            told = []
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['rel']}") as f:
                    data = f.read_at(row["n_bytes"], row["offset"])
                if len(data) < row["n_bytes"]:
                    raise OSError(f"{row['rel']} ends at {row['offset'] + len(data)}")
                samples = unpacked(data, row["bits"])[: row["n_rows"] * row["width"]].reshape(row["n_rows"], row["width"])
                told.append({"rel": row["rel"]} | make(samples, row["first_row"], row["width"]))
            yield pa.RecordBatch.from_pylist(told, schema=out)

    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    out = pa.schema([("rel", pa.string()), *[(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)]])
    dealt = bands.filter("error is null").repartition("rel", "first_row")
    return dealt.mapInArrow(run, f"rel string, {schema}")


def frame_statistics(bands: DataFrame, root: str) -> DataFrame:
    """(rel, lo, hi, n, total, squares) of every frame's samples, exact, as ``stats.frame_stats`` gives them."""

    def sums(samples, first_row, width):
        wide = samples.astype("int64")
        return {
            "lo": int(wide.min()),
            "hi": int(wide.max()),
            "n": wide.size,
            "total": int(wide.sum()),
            "squares": int((wide * wide).sum()),
        }

    parts = map_bands(bands, root, sums, "lo long, hi long, n long, total long, squares long")
    return parts.groupBy("rel").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum(F.col("squares").cast("decimal(18,0)")).cast("decimal(38,0)").alias("squares"),
    )
