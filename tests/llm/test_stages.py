"""The line and packing stages of the pipeline against plain versions, on the smallest documents."""

import zlib

import numpy as np
from test_ops import best_fit_decreasing, naive_lines

import corpus_pipeline
from runlake.llm.common import table
from runlake.llm.queries import tokenizer_file
from runlake.llm.tokens import TokenIds

SMALL = "/root/testdata/sf0.001"


def test_the_line_stage(spark):
    docs = table(spark, SMALL, "documents")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    dropped = naive_lines([r.text for r in rows])
    want = {}
    for i, r in enumerate(rows):
        text = None if r.text is None else "\n".join(x for p, x in enumerate(r.text.split("\n")) if (i, p) not in dropped)
        if text == r.text or text.strip():
            want[r.doc_id] = text
    got = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, docs, SMALL).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert len(dropped) > 10
    assert all(got[r.doc_id].n_chars == (r.n_chars if want[r.doc_id] == r.text else len(want[r.doc_id])) for r in rows if r.doc_id in want)


def test_the_packing_stage(spark):
    docs = table(spark, SMALL, "documents")
    plain = TokenIds(tokenizer_file()[0]).tokenizer
    want = []
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for n, a in enumerate(range(0, len(ids), 2048))]
    rows = corpus_pipeline.packed(spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(sequences) <= best_fit_decreasing([r.length for r in rows], 2048)
