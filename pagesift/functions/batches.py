"""Arrow batches in parts of bounded size, so that a task's Python holds the objects of one part at a time."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def parts(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and length of consecutive parts of an array of strings, each of about `limit` bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
        if total and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += int(n) + 64  # rows without text count, too
    if start < len(texts):
        yield start, len(texts) - start
