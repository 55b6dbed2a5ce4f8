import tracemalloc
import types

import public_tokenizers
import pyarrow as pa
import pyspark

from sitewright.llm import bpe


def test_a_block_of_pieces_takes_few_bytes_for_each(monkeypatch):
    """Beside the document's own list of pieces: numbers of 32 bits, and no array of places for a whole block."""
    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(bpe, "written", lambda made: made)
    blocks = bpe._blocks(types.SimpleNamespace(mapInArrow=lambda f, _: f), public_tokenizers.PATTERN, 4)
    docs = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([" ".join(["some", "words"] * 1000)] * 400)], names=["doc_id", "text"])
    tracemalloc.start()
    made = list(blocks(iter([docs])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made[0].column("n_codes")[0].as_py() == [2000] * 400
    assert peak < 32 * 800_000, peak
