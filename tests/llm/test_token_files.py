import random

import numpy as np
import pytest

from lumenta.llm import token_files, tokens


def by_hand(ids, separator):
    out, at = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((at, i - at, True))
            at = i + 1
    if at < len(ids):
        out.append((at, len(ids) - at, False))
    return out


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks(spark, block):
    rng = random.Random(block)
    files = {f: [rng.choice([9, 1, 2, 3] + [4] * rng.choice([0, 30])) for _ in range(rng.randint(0, 300))] for f in range(8)}
    rows = [(f, i, bytes(np.array(ids, "<u2").tobytes()[at : at + block])) for f, ids in files.items() for i, at in enumerate(range(0, 2 * len(ids), block))]
    got = token_files.scan(spark.createDataFrame(rows, "file long, block long, data binary").repartition(4), 9).collect()
    for f, ids in files.items():
        own = sorted((r for r in got if r.file == f), key=lambda r: r.nth)
        assert [r.nth for r in own] == list(range(len(own)))
        assert [(r.start, r.n_tokens, r.ended) for r in own] == by_hand(ids, 9)


def test_documents_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "<|endoftext|>", "œuvre", "x\n"]) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    files = token_files.flatten(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=64)
    got = {r.doc_id: r.n_tokens for r in token_files.counted(files).collect()}
    encode = tokens.encoder(tokens.vocabulary())
    assert got == {i: len(encode(t)) for i, t in rows}


def test_plain_files(spark, tmp_path):
    ids = [5, 9, 9, 6, 7, 9, 8]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = token_files.scan(token_files.read_files(spark, str(tmp_path), block=4), 9).collect()
    assert sorted((r.start, r.n_tokens, r.ended) for r in got) == by_hand(ids, 9)


@pytest.mark.parametrize("name", ["", "file:", "file://"])
def test_files_are_read_in_ranges(spark, tmp_path, name):
    rng = random.Random(9)
    files = {f"f{i}.bin": [rng.choice([1, 2, 3, 9]) for _ in range(n)] for i, n in enumerate([0, 1, 1000, 777])}
    for f, ids in files.items():
        (tmp_path / f).write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    blocks = token_files.read_files(spark, f"{name}{tmp_path}", block=128)
    assert blocks.count() == sum(-(-2 * len(x) // 128) for x in files.values())
    got = token_files.scan(blocks, 9).collect()
    for f, ids in files.items():
        assert sorted((r.start, r.n_tokens, r.ended) for r in got if r.file.endswith(f)) == by_hand(ids, 9)
    one = token_files.scan(token_files.read_files(spark, f"{name}{tmp_path}/f2.bin", block=100), 9).collect()
    assert sorted((r.start, r.n_tokens, r.ended) for r in one) == by_hand(files["f2.bin"], 9)


def test_odd_rows(spark, odd, none):
    got = token_files.counted(token_files.flatten(odd("file"))).collect()
    assert len(got) == 9 and [r.n_tokens for r in got if r.doc_id == 2] == [0]
    assert token_files.counted(token_files.flatten(none)).count() == 0
    empty = spark.createDataFrame([(1, 0, None), (1, 1, b"")], "file long, block long, data binary")
    assert token_files.scan(empty).count() == 0
