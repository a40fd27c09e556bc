import random
from pathlib import Path

import pytest

from foldstone.llm import bpe, tokens
from tables import rows

VOCABULARY = Path(tokens.DEFAULT_VOCABULARY)
pytestmark = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def own():
    return bpe.Transducer(VOCABULARY.read_text())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "  \n\n x", "don't they'll I'M", "naïve Straße œuvre", "a" * 3000, "ab" * 999, "1234567890 12", "🙂👨‍👩‍👧 日本語", "<|endoftext|> a<|endoftext|>", "\t\r\n \xa0", "ſchön − “quoted”", "\x00\x01�", "  leading and trailing  "]


@pytest.mark.parametrize("text", TEXTS)
def test_agrees_with_the_public_library_and_decodes(own, reference, text):
    ids = own.encode(text)
    assert ids == reference(text) and own.decode(ids) == text


def test_agrees_on_random_texts(own, reference):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz     etaoin'ABC019.,;-\néüßж中"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))
        assert own.encode(text) == reference(text)


def test_transducer_equals_the_merges(own):
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"aeiounrstlhd ") for _ in range(rng.randrange(1, 25)))
        assert list(own.word(word)) == own.merge(word)


def test_state_tables_may_be_dropped_at_any_time(own, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog and dogs"
    before = own.encode(text)
    monkeypatch.setattr(bpe, "MAX_LETTERS", 1)
    assert own.encode(text) == before == own.encode(text)


def test_emission_waits_no_longer_than_the_longest_token(own):
    state, read, sent = own.start, 0, 0
    for byte in b"internationalization" * 5:
        step = state.get(byte) or own.grow(state, byte)
        state, emitted = step
        read += 1
        sent += sum(len(own.bytes_of[i]) for i in emitted)
        assert read - sent <= max(map(len, own.vocab))


def test_streaming_utf8_in_any_cuts():
    rng = random.Random(3)
    for _ in range(300):
        good = "".join(chr(rng.choice([65, 0xE9, 0x20AC, 0x1F642, 0xD7FF, 0xE000, 0x10FFFF])) for _ in range(6)).encode()
        data = good if rng.random() < 0.5 else bytes(rng.randrange(256) for _ in range(12))
        machine, out, i = bpe.Utf8Machine(), "", 0
        while i < len(data):
            n = rng.randrange(1, 4)
            out += machine.feed(data[i : i + n])
            i += n
        assert out + machine.end() == data.decode("utf-8", "replace")


def test_table(spark, own):
    long = "word and words " * 20_000
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 6), (3, None, 7), (4, long, 8), (5, "hello world", None)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    assert got == {1: own.encode("hello world"), 2: [], 3: [], 4: own.encode(long), 5: own.encode("hello world")}
    back = tokens.texts_of(tokens.token_ids(df))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "hello world", 2: "", 3: "", 4: long, 5: "hello world"}
    assert tokens.token_ids(df.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [10**9, -1]), (3, [0])], "doc_id long, ids array<int>")
    assert rows(tokens.texts_of(odd)) == [(1, ""), (2, ""), (3, own.decode([0]))]


def test_corpus(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.ids for r in tokens.token_ids(docs).collect()} == {k: reference(t) if t else [] for k, t in texts.items()}
