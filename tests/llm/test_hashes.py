"""Long texts that a polynomial modulo 2**64 cannot tell apart: 0 and 1 by the digit sum of the place, and its complement."""

import zlib

import numpy as np
import pytest

from spectraloom.llm import near_dup, packing, pieces, ppm
from spectraloom.llm.textblock import TextBlock

SIZES = [256, 512, 1024, 2048, 4096]


def pair(n):
    a = "".join(str(i.bit_count() % 2) for i in range(n))
    return a, a.translate(str.maketrans("01", "10"))


@pytest.fixture(scope="module")
def long_words(spark):
    rows = [(2 * k + i, t, "x") for k, n in enumerate(SIZES) for i, t in enumerate(pair(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, part string").coalesce(1), {i: t for i, t, _ in rows}


def test_spans_differ_and_equal_spans_agree():
    texts = [t.encode() for n in SIZES for t in pair(n)]
    b = TextBlock([*texts, *texts])
    h = b.hashes(b.first, b.last)
    assert len(set(h.tolist())) == len(texts) and (h[: len(texts)] == h[len(texts) :]).all()
    shifted = TextBlock([b"xy" + texts[6]])
    assert shifted.hashes(np.array([2]), shifted.last)[0] == h[6]


def test_packing_gives_each_its_own_ids(long_words):
    from tokenizers import Tokenizer

    docs, texts = long_words
    own = Tokenizer.from_file(packing.tokenizer_folder() + "/byte_bpe_50k.json")
    for r in packing.sequences(docs).collect():
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_pieces_decode_to_their_own_text(long_words):
    docs, texts = long_words
    out = pieces.segmentations(docs)
    assert out.filter("NOT decoded_equal").count() == 0
    assert out.select("ids").distinct().count() == len(texts)


def test_near_duplicates_do_not_link_them(long_words):
    got = near_dup.near_duplicates(long_words[0]).collect()
    assert len(got) == 2 * len(SIZES) and all(r.component_id == r.doc_id and r.kept for r in got)


def test_ppm_does_not_know_the_unseen_word(spark):
    seen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    a, b = pair(1024)
    got = {r.doc_id: r for r in ppm.score_texts(spark.createDataFrame([(seen, a), (held, b)], "doc_id long, text string").coalesce(1)).collect()}
    assert got[seen].n_known == 2 and got[held].n_known == 1


@pytest.mark.parametrize("bad_order", [False, True])
def test_sequences_do_not_depend_on_the_split(docs, bad_order):
    counts = set()
    for n in (1, 3, 8):
        d = docs.repartition(n).sortWithinPartitions("doc_id", ascending=not bad_order)
        counts.add(packing.sequences(d, partition=100).select("sequence_id").distinct().count())
    assert len(counts) == 1
