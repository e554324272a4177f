"""Words as several operators count them: A-Z lower-cased, parted by ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that no more than these texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(text: str | None) -> list[bytes]:
    """``bytes.lower`` touches A-Z only, and ``bytes.split`` parts at 0x20 and 0x09-0x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(parts: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; fewer words give the whole sequence."""
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) <= size:
        return [joined]
    return [joined[a:b] for a, b in zip(starts[: -size + 1].tolist(), ends[size - 1 :].tolist())]
