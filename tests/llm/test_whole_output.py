"""Queries return what their operators find, not a part of it."""

import zlib

import numpy as np

from spectraloom.llm import pieces, queries


def test_op5_returns_every_segmentation(spark, tmp_path):
    import public_tokenizers

    texts = {0: "the naïve 日本 text, the text", 1: None, 2: "", 3: "x " * 300, 4: "one\n\ntwo  ▁three"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    p = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.QUERIES["op5_piece_segmentations"](spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        text = (texts[d] or "").replace("▁", " ")
        assert pieces.decode(r.ids, p) == text and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert len(r.changes) == len(r.scores) - 1 and len(r.scores) == (4 if text else 1)
        for way, score in zip(r.changes, r.scores[1:]):
            assert way and score <= r.scores[0]
            for place in way:  # a differing segment stands for a segment of the text: its pieces spell a part of it
                spelt = b"".join(p.bytes[i] if i >= 0 else chr(-1 - i).encode() for i in place.ids).decode()
                assert spelt and spelt in " " + text
        assert len({str(w) for w in r.changes}) == len(r.changes)
