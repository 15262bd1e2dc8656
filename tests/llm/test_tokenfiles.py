"""Token files: exact round trips, order, access to single documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm import tokenfiles
from tests.llm.data import clashing, corpus, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text, end=1):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def odd_texts(seed, n):
    rng = random.Random(seed)
    letters = [*"abcXYZ'sretvmld 0129!?.,-_\"<|>\t\n\r\x0b\x0c\x1c\x1f\x7f\x00 \u0085 　",
               "é", "É", "é", "́", "漢", "Σ", "İ", "ß", "ﬁ", "ǅ", "‍", "²", "½", "Ⅷ", "﻿", "😀",
               "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'S", "'ll", "'RE"]
    return ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(n)]


def test_encoder_equals_the_library(library):
    encode = tokenfiles.encoder(open(PATH, "rb").read(), 1)
    texts = odd_texts(5, 8000) + [t for _, t in corpus(3)]
    texts += [f"a{chr(c)} {chr(c)}b {chr(c)} C" for c in (*range(0x3000), *range(0xE000, 0x11000))
              if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert np.frombuffer(encode(t), "<u2").tolist() == ids_of(library, t).tolist(), repr(t)


def test_files_that_do_not_separate_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    assert not tokenfiles.separable(other)
    encode = tokenfiles.encoder(open(path, "rb").read(), 0)
    for t in odd_texts(6, 500):
        assert np.frombuffer(encode(t), "<u2").tolist() == ids_of(other, t, 0).tolist()


def expected(library, rows):
    """Counter-like list of (doc_id, n, crc) and the starts of ids that occur once."""
    ids = [(i, ids_of(library, t)) for i, t in rows]
    return sorted(((i is not None, i or 0), len(a), zlib.crc32(a.tobytes())) for i, a in ids)


def test_round_trip_with_awkward_rows(spark, tmp_path, library):
    rows = corpus(9) + [(3, "again"), (3, "again"), (None, "no id"), (None, None), (-5, "below zero"),
                        (10 ** 15, "é " * 50_000)]
    docs = clashing(frame(spark, rows, parts=5), ("start", "doc", "hash", "row", "range", "n_tokens"))
    got = tokenfiles.round_trip(docs, PATH, path=str(tmp_path / "t")).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == expected(library, rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered)


def test_empty_tables_and_small_blocks(spark, tmp_path, library, monkeypatch):
    assert tokenfiles.round_trip(frame(spark, []), PATH).count() == 0
    rows = [(i, f"document {i} " * (i % 40)) for i in range(400)]
    path = tokenfiles.write_tokens(frame(spark, rows), PATH, str(tmp_path / "t"))
    assert tokenfiles.read_dictionary(spark, path)
    back = tokenfiles.placed(tokenfiles.read_tokens(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in back] == list(range(400))
    for (_, text), r in zip(rows, back):
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(library, text).tolist()


def test_single_documents_are_read_by_the_index(spark, tmp_path, library):
    rows = [(i, f"text of {i} " * (1 + i % 50)) for i in range(500)]
    path = tokenfiles.write_tokens(frame(spark, rows), PATH, str(tmp_path / "t"))
    wanted = spark.createDataFrame([(7,), (401,), (77_777,)], "doc_id long")
    got = {r.doc_id: r for r in tokenfiles.read_tokens(spark, path, wanted).collect()}
    assert set(got) == {7, 401}
    assert np.frombuffer(got[401].ids, "<u4").tolist() == ids_of(library, rows[401][1]).tolist()
    # The frame alone, opened at its place with the dictionary, is the document.
    place = tokenfiles.read_index(spark, path).filter("doc_id = 7").first()
    dictionary = tokenfiles.read_dictionary(spark, path)
    with open(place.file.removeprefix("file:"), "rb") as f:
        f.seek(place.at)
        frame_ = f.read(place.length)
    opened = zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(frame_)
    assert np.frombuffer(opened, "<u2").tolist() == ids_of(library, rows[7][1]).tolist()


def test_another_dictionary_is_refused(spark, tmp_path):
    a, b = (tokenfiles.write_tokens(frame(spark, [(i, f"{w} {i} " * 30) for i in range(300)]), PATH,
                                    str(tmp_path / w)) for w in ("one", "two"))
    frames = tokenfiles.Frames(tokenfiles.read_dictionary(spark, a))
    with open(tokenfiles.read_index(spark, b).select("file").first()[0].removeprefix("file:"), "rb") as f:
        data = memoryview(f.read())
    _, width, key, _, index, at = next(tokenfiles.read_blocks(data))
    with pytest.raises(ValueError, match="another dictionary"):
        frames.ids(data[at:at + int(index[0]["length"])], width, key)
    with pytest.raises(ValueError, match="no block"):
        next(tokenfiles.read_blocks(data[1:]))


def test_dictionary_makes_short_documents_smaller(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(2000)]
    path = tokenfiles.write_tokens(frame(spark, rows), PATH, str(tmp_path / "t"))
    packed = tokenfiles.read_index(spark, path).agg(F.sum("length")).first()[0]
    plain = zstandard.ZstdCompressor(level=3)
    encode = tokenfiles.encoder(open(PATH, "rb").read(), 1)
    assert packed < 0.8 * sum(len(plain.compress(encode(t))) for _, t in rows)
