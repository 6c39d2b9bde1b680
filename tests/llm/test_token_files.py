"""Lengths against a plain split, for blocks of any size."""

import random

import numpy as np
import pytest

from tickloom.llm import token_files as t

END = 7


def plain(ids):
    out, n = [], 0
    for i in ids:
        if i == END:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] if n else out


@pytest.mark.parametrize("block_bytes", [4, 8, 64, 1 << 20])
@pytest.mark.parametrize("width", [2, 4])
def test_blocks_are_stitched(spark, tmp_path, block_bytes, width):
    rng = random.Random(block_bytes)
    files = [
        [], [END], [END, END], [1, 2, 3], [1, END, 2], [END, 5], [1] * 50 + [END], [1] * 41, [END] * 33,
        *[[END if rng.random() < p else rng.randrange(8, 60_000) for _ in range(rng.randrange(1, 400))] for p in (0.01, 0.1, 0.5, 0.9)],
        [7 * 256] * 20 + [END, 256 * 7 + 1],
    ]
    want = {}
    for i, ids in enumerate(files):
        (tmp_path / f"part-{i:05d}").write_bytes(np.asarray(ids, f"<u{width}").tobytes())
        if plain(ids):
            want[i] = plain(ids)
    rows = t.token_counts(spark, str(tmp_path), END, width, block_bytes).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.position)):
        own = got.setdefault(int(r.file.rsplit("-", 1)[1]), [])
        assert r.position == len(own)
        own.append(r.n_tokens)
    assert got == want


def test_half_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"\x01\x02\x03")
    with pytest.raises(Exception, match="inside an id"):
        t.token_counts(spark, str(tmp_path)).collect()


def test_documents_round_trip(spark):
    texts = [None, "", "hello world", "x" * 20_000, "é 😀\n", "<|endoftext|>", "same", "same"]
    coder = t.Tokenizer.load().coder()
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, position int").coalesce(1)
    rows = t.report(df, t.Tokenizer.load()).orderBy("part", "position").collect()
    assert [r.n_tokens for r in rows] == [len(coder.encode_ordinary(x or "")) for x in texts]
    assert t.report(df.limit(0), t.Tokenizer.load()).count() == 0


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coder = t.Tokenizer.load().coder()
    want = sorted(len(coder.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted(r.n_tokens for r in t.report(docs, t.Tokenizer.load()).collect()) == want
