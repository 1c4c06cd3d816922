"""What the neighbour search holds on the driver and broadcasts."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from veilwright.operators.neighbours import Index


@pytest.mark.parametrize("width", [3, 40])
def test_index_travels_with_little_more_than_its_rows(width):
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.normal(size=(n, width))
    ids = rng.permutation(n)
    table = pa.table({"tid": ids, "x": pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(x.ravel()))})
    index = Index.of(table, 0)
    assert len(pickle.dumps(vars(index), 5)) < 1.25 * (x.nbytes + 2 * ids.nbytes)
    # What arrives answers like brute force, also a second time.
    there = Index.__new__(Index)
    vars(there).update(pickle.loads(pickle.dumps(vars(index), 5)))
    asked = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([list(x[9]), list(x[77] + 0.1)])], ["qid", "x"])
    for _ in range(2):
        found = there.answer(asked, 3).to_pydict()
        for q, v in ((0, x[9]), (1, x[77] + 0.1)):
            gaps = np.sqrt(((x - v) ** 2).sum(axis=1))
            best = np.lexsort((ids, gaps))[:3]
            assert [t for t, a in zip(found["tid"], found["qid"], strict=True) if a == q] == ids[best].tolist()
            assert np.allclose([d for d, a in zip(found["distance"], found["qid"], strict=True) if a == q], gaps[best])
