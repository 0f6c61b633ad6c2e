"""What a task leaves behind in its Python worker, which waits for later tasks."""

import pyarrow as pa

from leaksieve.llm import bpe
from leaksieve.llm.common import handing_back


def test_a_coder_forgets_its_pieces_with_the_task():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    coder = bpe.Coder(ranks, r"\p{L}+|[^\p{L}]")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["abc abd", None])], names=["doc_id", "text"])
    first = [b.to_pydict() for b in bpe._encoded([batch], coder)]
    assert coder._known == {} and coder._held == 0
    assert [b.to_pydict() for b in bpe._encoded([batch], coder)] == first


def test_memory_is_handed_back_after_the_last_batch(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    passed = handing_back(iter([1, 2, 3]))
    assert next(passed) == 1 and Pool.released == 0
    assert list(passed) == [2, 3] and Pool.released == 1
    stopped = handing_back(iter([1, 2]))
    next(stopped)
    stopped.close()  # a task that reads no further
    assert Pool.released == 2
