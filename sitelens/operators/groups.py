"""Streaming over rows that come sorted by a group key, whole groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group as one table; at most one group and one batch are held."""
    have: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        have = now if have is None else pa.concat_tables([have, now])
        columns = [have[k].to_numpy() for k in keys]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield have.slice(a, b - a)
        if cuts:
            have = have.slice(cuts[-1])
    if have is not None and len(have):
        yield have
