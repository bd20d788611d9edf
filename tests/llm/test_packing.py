"""Pieces against the tokenizers library and the rules of packing."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from dataplumb.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cut_is_binary():
    counts = np.array([0, 1, 2, 3, 7, 8, 4095, 4096, 4097, 20000])
    doc, start, length = packing.cut(counts)
    for k, n in enumerate(counts.tolist()):
        mine = length[doc == k]
        assert mine.sum() == n and (start[doc == k] == np.cumsum(mine) - mine).all()
        rest = mine[mine < 4096]
        assert (mine == 4096).sum() == n // 4096 and len(set(rest.tolist())) == len(rest)
        assert all(x & (x - 1) == 0 for x in mine.tolist())


def prose(k, n):
    draw = random.Random(k)
    return " ".join("".join(draw.choice(["ri", "ver", "mill", "sto", "ne"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


TEXTS = [None, "", " \n", "one", prose(1, 500), prose(1, 500), prose(2, 9000), "\U0001f600 é <|endoftext|> " + prose(3, 40), prose(4, 77)]


@pytest.mark.parametrize("longest", [4096, 64])
def test_pieces(spark, longest):
    rows = [(k if k != 5 else None, t, "mine", "mine") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, ids string").repartition(3)
    t = Tokenizer.from_file(PATH)
    got = packing.report(docs, PATH, longest=longest).collect()
    raw = {(r.doc_id, r.start): r for r in packing.pack(docs, PATH, longest=longest).collect()}
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.offset == 0 for r in got)
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True) and max(lengths) <= longest
    for doc, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        at = 0
        for r in mine:
            data = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(data)) and bytes(raw[doc, at].ids) == data
            at += r.length
        assert at == len(ids)


def test_buckets_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 30)) for k in range(20)], "doc_id long, text string")
    packing.write(docs, PATH, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert all(len(r.ids) == 4 * r.length for r in back.collect()) and back.select("doc_id").distinct().count() == 20
    assert packing.report(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, longest=100)
