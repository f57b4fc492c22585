"""Token files: the coder, the file format, and ids read back against the tokenizers library on whole texts."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import idcoder, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


@pytest.mark.parametrize("bits", [1, 7, 16, 20])
def test_blocks_round_trip(bits):
    rng = np.random.default_rng(bits)
    for rows, length in ((1, 1), (1, 700), (3, 2), (40, 500)):
        skewed = (rng.zipf(1.3, (rows, length)) % (1 << bits)).astype(np.int64)
        skewed[0] = (1 << bits) - 1  # one id only
        skewed[-1] = rng.integers(0, 1 << bits, length)  # no order at all
        payloads = idcoder.encode_blocks(skewed, bits)
        assert np.array_equal(idcoder.decode_blocks(payloads, length, bits), skewed)
        # a block does not depend on those beside it
        assert idcoder.encode_blocks(skewed[-1:], bits) == payloads[-1:]
    assert idcoder.decode_blocks([], 5, bits).shape == (0, 5)


def test_more_ids_than_places_and_carries():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.permutation(1 << 16)[: idcoder.PLACES + 900], rng.integers(0, 40, 3000), rng.permutation(1 << 16)[:5000]])[None]
    assert np.array_equal(idcoder.decode_blocks(idcoder.encode_blocks(ids, 16), ids.shape[1], 16), ids)
    many = rng.integers(0, 6, (300, 900)) * 9000
    assert np.array_equal(idcoder.decode_blocks(idcoder.encode_blocks(many, 16), 900, 16), many)
    with pytest.raises(ValueError):
        idcoder.encode_blocks(np.array([[1 << 16]]), 16)


def test_predictable_ids_take_few_bits():
    phrase = np.random.default_rng(1).integers(0, 50_000, 60)
    repeated = np.tile(phrase, 68)[None, :4096]
    few = np.random.default_rng(2).zipf(1.5, (1, 4096)) % 300
    assert len(idcoder.encode_blocks(repeated, 16)[0]) < 600
    assert len(idcoder.encode_blocks(few, 16)[0]) < 4096 * 0.8


def test_chunks_equal_whole_texts():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\xa0", "　", " ", "a", "don't", "'s", "12", "é", "日本", "\U0001f600", "_", "!?", "<|endoftext|>", "x" * 90, "\r\n", "\x85", " ."]
    texts = ["", " ", "  ", " a", "a ", "\n a", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(4000))]
    coder = token_files.encoder(PATH)
    assert coder.cuts
    for k in range(0, len(texts), 500):
        for text, ids, want in zip(texts[k : k + 500], coder.encode_all(texts[k : k + 500]), whole(texts[k : k + 500]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want[:-1], repr(text)


def test_file_parts_and_damage():
    rng = np.random.default_rng(9)
    sizes = [1, 5000, 1, 1, 300, 9000, 2]
    names = [None, None, -(2**63), -5, 0, 7, 2**63 - 1]
    ids = rng.integers(0, 900, sum(sizes)).astype("<u4")
    content = token_files.pack_file(list(zip(names, sizes, strict=True)), ids, 3, 4, 16, block_ids=256) + token_files.END_MARK.encode()
    file = token_files.TokenFile(content)
    assert (file.part, file.number, file.docs) == (3, 4, list(zip(names, sizes, strict=True)))
    assert np.array_equal(file.ids(), ids)
    at = 0
    for k, n in enumerate(sizes):
        assert np.array_equal(file.document(k), ids[at : at + n])
        at += n
    for place in (0, 9, 60, len(content) // 2, len(content) - 9, len(content) - 1):
        broken = bytearray(content)
        broken[place] ^= 4
        with pytest.raises((ValueError, struct.error)):
            token_files.TokenFile(bytes(broken))
    with pytest.raises((ValueError, struct.error)):
        token_files.TokenFile(content[: len(content) // 2])


def test_documents_read_back(spark):
    rng = random.Random(2)
    words = ["alpha", "beta,", "don't", "étage", "日本語", "12,5", "x\ny", "  z"]
    texts = [None, "", " ", "one", "one", *(" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(150)), " ".join(rng.choices(words, k=30_000))]
    rows = [(None, "lost"), (None, None), *((k * 7 % 100 - 20, t) for k, t in enumerate(texts))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' as value", "1 as part", "2 as row", "3 as h").repartition(5)
    got = token_files.token_documents(docs, PATH).collect()
    want = {}
    for (doc, _), ids in zip(rows, whole([t for _, t in rows]), strict=True):
        want.setdefault(doc, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    found = {}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d or 0))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_files.token_documents(docs.limit(0), PATH).collect() == []


def test_small_files_and_ids(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} " * (900 if k % 10 == 0 else 3)) for k in range(60)], "doc_id bigint, text string")
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, PATH, file_blocks=1)
    assert len(list((tmp_path / "files").glob("part-*"))) > 2
    texts = [f"text {k} " * (900 if k % 10 == 0 else 3) for k in range(60)]
    got = sorted(token_files.read_documents(spark, path, with_ids=True).collect())
    assert [r.ids for r in got] == whole(texts)
    assert [r.start for r in got] == [0, *np.cumsum([len(x) for x in whole(texts)])[:-1].tolist()]
    victim = sorted((tmp_path / "files").glob("part-*"))[0]
    data = bytearray(victim.read_bytes())
    data[len(data) // 2] ^= 1
    victim.write_bytes(bytes(data))
    (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_documents(spark, path).collect()
