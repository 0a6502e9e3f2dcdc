from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillmend.llm import context_tree as ct


def test_trees_are_built_from_few_runs_at_a_time():
    keys = np.arange(300_000, dtype=np.int64) << 30
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.ones(len(k), np.int64))], names=["key", "n"])
               for k in np.split(keys, 30)]
    pieces = list(ct.whole_contexts(iter(batches)))
    assert np.array_equal(np.concatenate([k for k, _ in pieces]), keys)
    assert max(len(k) for k, _ in pieces) <= 60_000
    two = [set((k >> 8 * (ct.DEPTH - 1)).tolist()) for k, _ in pieces]
    assert all(not a & b for a, b in zip(two, two[1:]))


def test_frequent_segments_outlast_rare_ones(monkeypatch):
    import public_tokenizers

    from quillmend.llm import piece_bpe
    from quillmend.llm.queries import PIECES

    monkeypatch.setattr(piece_bpe, "CACHE_BYTES", 60_000)
    enc = piece_bpe.PieceEncoder(public_tokenizers.path(PIECES))
    coded, encode = [], enc.encode_segments

    def told(segments):
        coded.extend(segments)
        return encode(segments)

    monkeypatch.setattr(enc, "encode_segments", told)
    texts = [f"the frequent words {' '.join(f'rare{k}x{i}' for i in range(60))}" for k in range(12)]
    for text in texts:
        (ids,) = enc.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == enc.library.encode(text, add_bos=True, add_eos=True)
    assert coded.count("▁the") == 1 and coded.count("▁rare0x0") == 1
    assert len(enc.cache) + len(enc.older) < 600
