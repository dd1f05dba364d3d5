import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import sstable as S

SCHEMA = "doc_id long, text string"


def brute(rows, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(S.default_tokenizer())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in rows}


TEXTS = ["Hello, World! don't", "", "a  b\n\tc", "É é naïve Straße ñ", "x<|endoftext|>y <|ENDOFTEXT|>", "12.5% of 1,000", "日本語 text", "\x1c odd \x85 space", "H̱ k̊", "word " * 3000, "😀 ok"]


def test_words_equal_whole_texts():
    e = S.WordEncoder(S.default_tokenizer(), limit=5)
    want = brute(list(enumerate(TEXTS)))
    for _ in range(2):
        got = e.encode_batch([t.encode() for t in TEXTS])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [want[i][:-1] for i in range(len(TEXTS))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text(texts):
    e = S.encoder_of(S.default_tokenizer())
    want = brute(list(enumerate(texts)))
    assert [np.frombuffer(g, "<u2").tolist() for g in e.encode_batch([t.encode() for t in texts])] == [want[i][:-1] for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aAbzZéÉßÑñçÿÀ÷×.,!?;:'s3$ -\u0301", max_size=25), max_size=4))
def test_letters_and_marks(texts):
    e = S.encoder_of(S.default_tokenizer())
    assert e.by_letters
    want = brute(list(enumerate(texts)))
    assert [np.frombuffer(g, "<u2").tolist() for g in e.encode_batch([t.encode() for t in texts])] == [want[i][:-1] for i in range(len(texts))]


def test_shards_round_trip_and_lookup(spark, tmp_path):
    rows = [(i * 3 - 7, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, None), (None, "last one")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", start int").repartition(5)
    uri = f"file://{tmp_path}/sst"
    manifest = S.write_shards(docs, uri, block_bytes=400)
    got = S.read_shards(spark, uri, manifest).orderBy("start").collect()
    want = brute([r for r in rows if r[0] is not None])
    start = 0
    for r in got[:60]:
        ids = np.array(want[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert S.lookup(uri, manifest, r.doc_id)[0].tolist() == want[r.doc_id]
        start += len(ids)
    assert [r.doc_id for r in got[:60]] == sorted(want) and [r.doc_id for r in got[60:]] == [None, None]
    assert S.lookup(uri, manifest, 10**9) == []
    assert len(S.lookup(uri, manifest, None)) == 2


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b")] * 40 + [(5, "c")] * 3, SCHEMA)
    got = S.token_shards(spark, docs).collect()
    assert len(got) == 43 and sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == 40 * 3 + 3 * 2
    assert S.token_shards(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_file_format_refuses_damage():
    out = io.BytesIO()
    w = S.ShardWriter(out, 2, 200)
    keys = [S.encode_key(i) for i in range(-50, 50)]
    assert keys == sorted(keys) and S.decode_key(keys[0]) == -50 and S.decode_key(S.encode_key(None)) is None
    for k in keys:
        w.add(k, b"\1\0" * 9)
    w.finish()
    data = out.getvalue()
    r = S.ShardReader(pa.BufferReader(data))
    assert [k for k, _ in r.scan()] == keys and len(r.index) > 3 and all(r.get(k) == [b"\1\0" * 9] for k in keys)
    assert sum(r.may_hold(S.encode_key(i)) for i in range(1000, 3000)) < 100
    with pytest.raises(ValueError, match="magic"):
        S.ShardReader(pa.BufferReader(data[:-1] + b"?"))
    with pytest.raises(ValueError, match="checksum"):
        S.ShardReader(pa.BufferReader(data[:10] + b"\xff\xff" + data[12:])).block(0)


def test_a_word_met_with_and_without_marks_is_merged_once():
    """The memory serves a bare word and the same word before closing marks."""
    encoder = S.WordEncoder(S.default_tokenizer())
    asked, letters = [], encoder._letters
    encoder._letters = lambda word: asked.append(word) or letters(word)
    texts = ["Zorplim, quent", "zorplim; Quent. quent!", "quent zorplim"]
    got = encoder.encode_batch([t.encode() for t in texts])
    assert got == [encoder._whole(t) for t in texts]
    assert sorted(asked) == [b"quent", b"zorplim"]


def test_marks_and_digits_are_pieces_and_frequent_words_stay():
    """Letters before any marks or digits go to the merges alone, and a word that is asked for again and again is not forgotten."""
    encoder = S.WordEncoder(S.default_tokenizer(), limit=40)
    asked, letters, whole = [], encoder._letters, encoder._whole
    encoder._letters = lambda word: asked.append(word) or letters(word)
    texts = [f"Zorplim*** zorplim$$$ zorplim-{i} q{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x<" for i in range(100)]
    got = encoder.encode_batch([t.encode() for t in texts])
    assert got == [whole(t) for t in texts]
    assert asked.count(b"zorplim") == 1 and len(asked) == 101
    assert len(encoder.known) + len(encoder.known.before) <= 40
