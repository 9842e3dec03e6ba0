import random
import zlib

import cases
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from windowmatch.llm import packing
from windowmatch.llm.shared import vocabulary
from windowmatch.llm.tokens import Encoder

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_ids_are_those_of_the_library_as_it_is(path, spaced):
    plain = Tokenizer.from_file(path)
    special = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "endoftext|>"]
    texts = [f"{a}{s}{b}" for s in special for a in ("", "a ", "a", "a\n", "  ") for b in ("", " b", "b", "\tb", "!? c")]
    texts += [" ".join(special), "<|endoftext|><|endoftext|>", "<|EndOfText|> x", cases.LONG, ""]
    encoder = Encoder(path, spaced)
    for text in texts:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want, text


def fill(entries):
    bins, counts = {}, {}
    for e in entries:
        assert counts.get(e.length, 0) == e.first
        counts[e.length] = e.first + e.count
        for p in range(e.count):
            bins.setdefault(e.bin + p // e.each, []).append((e.offset + p % e.each * e.length, e.length))
    return bins, counts


@pytest.mark.parametrize("capacity", [10, 64, 2048])
def test_plan_packs_everything_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [
            min(capacity, max(1, int(rng.choice([rng.uniform(1, capacity), rng.expovariate(4 / capacity), capacity]))))
            for _ in range(rng.randint(0, 600))
        ]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        bins, counts = fill(packing.plan(histogram, capacity))
        assert counts == histogram
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in placed) <= 2
        bound = -(-sum(lengths) // capacity)
        large = sum(2 * n > capacity for n in lengths)
        assert len(bins) <= max(bound * 1.05 + 1, large + bound * 0.1 + 1)


def test_cut():
    assert packing.cut(1) == [(0, 1)]
    assert packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)]
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


@pytest.mark.parametrize(("path", "spaced"), [(BYTES, True), (WORDS, False)])
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("abÉß é'’stre\n\t\r.,1 $|<>endoftxt_\x1c\x85\xa0́İ漢")), max_size=24))
def test_remembered_words_give_the_library_ids(path, spaced, text):
    own = ENCODERS.setdefault(path, Encoder(path, spaced, known=50))
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == want


@pytest.mark.parametrize(("path", "spaced"), [(BYTES, True), (WORDS, False)])
def test_a_word_is_merged_once_whatever_marks_or_capitals_it_has(path, spaced):
    own, calls = Encoder(path, spaced), []
    merge, words = own.tokenize, [f"{a}{b}{c}ng" for a in "bdfk" for b in ("a", "\xe9") for c in "lmnr"]
    own.tokenize = lambda text: calls.append(text) or merge(text)
    forms = [str, "{},".format, "{}!?".format] + ([] if spaced else [str.upper, str.capitalize])
    for form in forms:
        for text in ("x " + " ".join(map(form, words)), *(f"x {form(w)}" for w in words)):
            want = own.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == want
    assert len(calls) == len(words) + 3  # x and the marks


ENCODERS = {}


def test_packed_documents(spark):
    got = packing.pack(cases.documents(spark), BYTES, capacity=512).collect()
    tokenizer = Encoder(BYTES, True).tokenizer
    want = []
    for i, text, _ in cases.TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        for piece, (start, n) in enumerate(packing.cut(len(ids), 512)):
            want.append((i, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(cases.empty(spark), BYTES).count() == 0


def test_a_worker_forgets_its_pieces_when_another_operator_begins(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    assert packing.pieces(docs, BYTES).count() == 64

    @F.pandas_udf("long")
    def kept(ids: pd.Series) -> pd.Series:
        import gc

        found = [o for o in gc.get_objects() if type(o).__name__ == "Encoder" and type(o).__module__ == "windowmatch.llm.tokens"]
        return ids * 0 + len(found)

    assert spark.range(0, 64, 1, 8).agg(F.max(kept("id"))).first()[0] == 0
