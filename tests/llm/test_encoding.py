import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import encoding
from weftline.llm.encoding import TOKENIZERS, _Encoder, encode_corpus, with_token_counts
from weftline.llm.lexicon import Lexicon, compile_lexicon, packed

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WHOLE.encode_special_tokens = True
PIECES = [chr(c) for c in (0, 9, 10, 13, 28, 31, 32, 32, 32, 39, 48, 65, 97, 115, 116, 133, 160, 0xE9, 0x301, 0x661, 0x180E, 0x200B, 0x2028, 0x3000, 0x4E2D, 0xFEFF, 0x1F600)]
PIECES += ["'s", "'ll", "<|endoftext|>", "the", " the", "http://x.y"]


def want(texts):
    return [e.ids for e in WHOLE.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_lexicon_is_exact_and_minimal(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(0, 6))): [rng.randrange(9) for _ in range(rng.randrange(4))] for _ in range(200)}
    words.pop(b"", None)
    arrays = compile_lexicon(words)
    (tmp_path / "lexicon").write_bytes(packed(arrays))
    lexicon = Lexicon(str(tmp_path / "lexicon"))
    asked = sorted(words) + [b"", b"abx", b"\xff" * 9]
    for word, rank in zip(asked, lexicon.ranks(asked).tolist(), strict=True):
        assert (rank >= 0) == (word in words)
        if rank >= 0:
            assert lexicon.ids[lexicon.offsets[rank] : lexicon.offsets[rank + 1]].tolist() == words[word]
    # Two words with one ending share its states: start, two middles that are one, end.
    assert len(compile_lexicon({b"xab": [1], b"yab": [2]})["arcs"]) == 4
    (tmp_path / "none").write_bytes(packed(compile_lexicon({})))
    assert Lexicon(str(tmp_path / "none")).ranks([b"a"]).tolist() == [-1]


def test_encoder_on_odd_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(16))) for _ in range(5000)]
    encoder = _Encoder(TOKENIZERS, None)
    assert encoder.encode(texts).to_pylist() == want(texts)
    assert list(map(encoding._counter(encoding.TOKENIZERS), texts)) == [len(x) for x in want(texts)]


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(encoding, "LONG", 40)
    monkeypatch.setattr(encoding, "CHUNK", 9)
    rng = random.Random(4)
    texts = ["".join(rng.choice([*PIECES, " a", "\nb", ", 7"]) for _ in range(rng.randrange(120))) for _ in range(600)] + ["x" * 500, " " * 500, ""]
    encoder = _Encoder(TOKENIZERS, None)
    got = [ids for chunk in encoding._chunks(texts) for ids in encoder.encode(chunk).to_pylist()]
    assert got == want(texts)
    assert list(map(encoding._counter(encoding.TOKENIZERS), texts)) == [len(x) for x in got]
    assert any(len(list(encoding._pieces(t))) > 2 for t in texts)


@pytest.mark.parametrize("max_words", [0, 20, 1000])
def test_corpus(spark, max_words):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " ", "\n" * 50, "ab " * 120_000, "<|endoftext|>"]
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, word int")
    got = encode_corpus(df, max_words=max_words).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted((r[0] or -1, ids) for r, ids in zip(rows, want(texts), strict=True))
    assert encode_corpus(df.limit(0)).count() == 0
    counted = with_token_counts(df).select("doc_id", "n_tokens").collect()
    assert sum(r.n_tokens for r in counted) == sum(map(len, want(texts)))


def test_the_vocabulary_goes_to_workers_without_its_folder(spark):
    encoding.publish_vocabulary(spark, TOKENIZERS)
    table = spark.range(1).select("id").mapInPandas(lambda batches: (b.assign(n=len(encoding._merger("/nowhere")("Hello there"))) for b in batches), "id long, n int")
    assert [r.n for r in table.collect()] == [len(want(["Hello there"])[0])]
