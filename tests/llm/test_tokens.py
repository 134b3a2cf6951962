import hashlib
import random
import sys

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import piece_codec, token_counts

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   \n\n x", "can't 'stop it's", "<|endoftext|>a<|endoftext|><|endoftext|>", "▁▁ a▁", "<0x41><s></s>", "漢字 😀 né 1234", "\x00\x85՘𐥀", "a" * 5000, " " * 3000, "ab" * 40 + " end"]


@pytest.fixture(scope="module")
def tools():
    return token_counts.PieceCounter(BPE), Tokenizer.from_file(BPE), piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text_as_the_libraries(tools, text):
    counter, bpe, codec, pieces = tools
    assert counter.count([text]) == [len(bpe.encode(text, add_special_tokens=False).ids)]
    assert codec.encode(text) == pieces.encode(text)
    assert codec.encoded(text)[1] == codec.decoded(codec.encode(text)) == pieces.decode(pieces.encode(text))


def test_words_as_the_library(tools):
    _, _, codec, pieces = tools
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("abcdefghinorstuéèß ▁\n.,0<") for _ in range(rng.randint(1, 25)))
        assert codec.encode(text) == pieces.encode(text)


def test_ids_round_trip(tools):
    _, _, codec, pieces = tools
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(3, 32000) for _ in range(rng.randint(0, 9))]
        assert codec.decoded(ids) == pieces.decode(ids)


def test_operators(spark, docs, tools):
    _, bpe, _, pieces = tools
    rows = [*enumerate(TEXTS), (50, None), (51, TEXTS[3]), (51, TEXTS[3]), (None, "x")]
    frame = docs(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(bpe.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = token_counts.token_counts(frame, BPE, 1024).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = piece_codec.digests(frame, PIECES).collect()
    want = sorted((-1 if i is None else i, len(x := pieces.encode(t or "")), sha(",".join(map(str, x))), sha(pieces.decode(x))) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = piece_codec.decode(piece_codec.encode(frame, PIECES), PIECES)
    assert {r.text for r in back.where("doc_id = 7").collect()} == {"漢字 😀 né 1234"}
    assert token_counts.token_counts(docs([]), BPE, 1).count() == piece_codec.digests(docs([]), PIECES).count() == 0


def test_what_a_codec_remembers_is_small():
    """Two workers and a JVM share 3 GB: what each worker keeps, at its bounds, stays under 100 MB."""
    import tracemalloc

    c = piece_codec.PieceCodec(PIECES)
    segments = [f"{piece_codec.MARK}w{k}x{k % 7}" for k in range(5000)]
    for s in segments:
        c.ids(s)  # the pairs are known before
    tracemalloc.start()
    try:
        for s in segments:
            c.entry(s)
        each = tracemalloc.get_traced_memory()[0] / len(c.table) + sys.getsizeof(segments[-1])  # the test holds the names
        tracemalloc.clear_traces()
        c.pairs = {}
        for s in segments:
            c.ids(s)
        pair = tracemalloc.get_traced_memory()[0] / len(c.pairs)
    finally:
        tracemalloc.stop()
    assert len(c.table) == len(segments)
    assert 2 * piece_codec.KEPT_SEGMENTS * each + piece_codec.KEPT_PAIRS * pair < 100e6
