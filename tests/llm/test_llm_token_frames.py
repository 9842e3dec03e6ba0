import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from windowmatch.llm import token_frames
from windowmatch.llm.shared import vocabulary
from windowmatch.llm.tokens import Encoder
from windowmatch.staging import fresh_path

WORDS = vocabulary("word_bpe_49k.json")


class Counting:
    """A file that counts the bytes read."""

    def __init__(self, data):
        self.source, self.read = pa.BufferReader(data), 0

    def size(self):
        return self.source.size()

    def read_at(self, n, at):
        self.read += n
        return self.source.read_at(n, at)


def written(documents):
    out = pa.BufferOutputStream()
    writer = token_frames.Writer(out)
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    return out.getvalue().to_pybytes()


def some(n):
    rng = np.random.default_rng(n)
    return [(10 * i, rng.integers(0, 49_000, int(rng.integers(1, 4000))).astype("<u4").tobytes()) for i in range(n)]


def test_frames_of_requested_documents_alone_are_read():
    documents = [*some(300), (7_000, b"\0" * 4_000_000), (None, b"\1\0\0\0")]
    data = written(documents)
    assert list(token_frames.read_documents(pa.BufferReader(data))) == documents
    source = Counting(data)
    assert list(token_frames.read_documents(source, [500, 7_001])) == [documents[50]]
    tail = token_frames.read_tail(pa.BufferReader(data))
    assert len(tail.starts) > 5
    assert source.read < int(tail.packed.max()) + 12 * len(tail.starts) + 20 * len(documents) + 100


def test_files_are_ordinary_zstandard():
    documents = some(40)
    reader = zstandard.ZstdDecompressor().stream_reader(pa.BufferReader(written(documents)), read_across_frames=True)
    assert reader.read() == b"".join(ids for _, ids in documents)


def test_damage_is_found():
    data = bytearray(written(some(3)))
    data[len(data) // 4] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_frames.read_documents(pa.BufferReader(bytes(data))))


def test_round_trip(spark):
    manifest = token_frames.write(cases.documents(spark), fresh_path(spark, "frames"), WORDS)
    got = [tuple(r) for r in token_frames.read(manifest).collect()]
    tokenizer = Encoder(WORDS, False).tokenizer
    want = {}
    for i, text, _ in cases.TEXTS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, token_frames.END], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(got) == len(cases.TEXTS)
    at = 0
    for i, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at and (n, crc) in want[i]
        at += n
    ids = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    chosen = spark.createDataFrame([(2,), (7,), (99,)], "doc_id long")
    assert sorted(r[0] for r in token_frames.read(manifest, chosen).collect()) == [2, 2, 7]
    none = token_frames.write(cases.empty(spark), fresh_path(spark, "frames"), WORDS)
    assert token_frames.read(none).count() == 0
