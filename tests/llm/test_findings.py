"""Memory of the quality classifier's tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa

from codeloom.llm import _text, quality
from codeloom.llm._features import Counts


def test_features_take_bounded_memory():
    texts = [f"Some words of text number {k}, and {k * 7} more of them; line\n" * 16 for k in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    whole = np.concatenate([Counts(data, offsets).features() for _, _, data, offsets in _text.slices(batch, "text")])
    tracemalloc.start()
    try:
        got = np.concatenate([x for _, _, x in quality._counted(batch)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(got, whole)
    assert peak < 40 << 20
