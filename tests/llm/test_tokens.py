import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import pieces
from colloquy.llm.pieces import PieceCodec, encode_pieces, id_array
from colloquy.llm.simple8b import ChunkTokenizer, pack, read_tokens, token_dataset, unpack
from colloquy.llm.token_counts import TokenCounter, count_tokens
from tests.llm.helpers import none, with_clashes

PIECE, WORD = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json"))
SP = sentencepiece.SentencePieceProcessor(model_file=PIECE)
TK = Tokenizer.from_file(WORD)
LONG = "The quick brown fox, naïve and über-old,\njumps  over 123 lazy dogs. " * 300
ROWS = [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (None, "x"), (4, LONG), (5, "<s>a</s> <|endoftext|> ▁▁ \t\r\n"), (6, "日本語😀" * 50), (7, " "), (8, "a" * 4000)]
TEXT = st.text(alphabet="aaabehtTH E  \n\t.,'s<>|é▁日😀0\x00", max_size=60)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PIECE, kept=50)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_are_the_librarys(codec, text):
    ids = SP.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode_text([b"%d" % i for i in ids]) == SP.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, SP.vocab_size() - 1).filter(lambda i: i > 2), max_size=12))
def test_prefix_tables_agree_on_any_pieces(codec, ids):
    text = SP.decode(ids)
    assert codec.encode(text) == SP.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aaab tTh.\né日▁", min_size=1, max_size=400), st.integers(4, 60), st.integers(1, 20))
def test_spliced_chunks_are_the_whole(text, chunk, overlap):
    own = TokenCounter(PIECE, chunk, overlap)
    if len(text) > chunk:
        assert np.concatenate(own.pieces(text)).tolist() == SP.encode(text)
    assert own.count([text]) == [len(SP.encode(text))]


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "▁" * 900 + LONG, LONG.replace(" ", ""), "ab " * 900])
@pytest.mark.parametrize("chunk,overlap", [(300, 8), (50, 16), (1000, 1)])
def test_splicing_where_chunks_hardly_agree(text, chunk, overlap):
    assert np.concatenate(TokenCounter(PIECE, chunk, overlap).pieces(text)).tolist() == SP.encode(text)


def test_counts(spark):
    got = sorted((tuple(r) for r in count_tokens(with_clashes(spark, ROWS), limit=100, chunk=500, overlap=20).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 100) for i, t in ROWS]
    assert got == sorted(want, key=str)
    assert count_tokens(none(spark)).count() == 0


def test_encoded_and_decoded(spark):
    got = sorted((r for r in encode_pieces(with_clashes(spark, ROWS)).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = SP.encode(t or "")
        text = SP.decode(ids) if ids else ""
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(text), ids, text))
    assert [tuple(r) for r in got] == sorted(want, key=str) or sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert encode_pieces(none(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**63 - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    words, at, escapes = pack(np.array(ids, np.uint64))
    assert unpack(words, len(ids), at, escapes).tolist() == ids
    assert len(words) <= len(ids)


def test_simple8b_is_compact():
    assert len(pack(np.zeros(600, np.uint64))[0]) == 10
    assert len(pack(np.full(400, 32_767, np.uint64))[0]) == 100
    assert len(pack(np.full(300, 49_407, np.uint64))[0]) == 100


WORDY = st.text(alphabet="aabtTHé É 'sremv019.,!?<|>\n\t\xa0\x1ćΣİßﬁ日😀", max_size=40) | st.sampled_from(["<|endoftext|>", "don't WE'LL", "a<|startoftext|>b", "ΑΣ ΑΣ.", "x\r\ny"])


@pytest.fixture(scope="module")
def own():
    return ChunkTokenizer(WORD, kept=20)


@settings(max_examples=500, deadline=None)
@given(st.lists(WORDY, min_size=1, max_size=4))
def test_chunked_words_are_the_librarys(own, texts):
    for text in (*texts, " ".join(texts)):
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == TK.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_of_other_rules_gets_whole_texts(tmp_path):
    rules = json.loads(TK.to_str())
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]  # keeps capitals
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    own, library = ChunkTokenizer(str(path)), Tokenizer.from_file(str(path))
    assert ChunkTokenizer(WORD).by_words and not own.by_words
    assert np.frombuffer(own.ids([LONG])[0], "<u4").tolist() == library.encode(LONG, add_special_tokens=False).ids


def test_a_model_with_a_normaliser_or_symbols_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in (lambda m: m.pieces[5000].__setattr__("type", 4), lambda m: m.normalizer_spec.__setattr__("remove_extra_whitespaces", True)):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(SP.serialized_model_proto())
        change(model)
        for p in model.pieces[5000:5001]:
            p.score = 0.0 if p.type == 4 else p.score
        path = tmp_path / "other.model"
        path.write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            PieceCodec(str(path))


@pytest.mark.parametrize("block_ids", [1, 64, 1 << 16])
def test_token_dataset(spark, block_ids):
    docs = with_clashes(spark, ROWS)
    got = read_tokens(spark, token_dataset(docs, block_ids=block_ids)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0], zlib.crc32((r[1] or "").encode())))
    want, start = [], 0
    for i, t in order:
        ids = [*TK.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.start)] == want


def test_empty_token_dataset(spark):
    assert read_tokens(spark, token_dataset(none(spark))).count() == 0


def test_ids_of_more_than_five_digits():
    assert id_array([b"7", b"123456", b"99999"]).tolist() == [7, 123456, 99999] and id_array([]).tolist() == []


def test_a_worker_holds_a_bounded_part_of_a_batch(spark, monkeypatch):
    """Ids and digests of a batch come in parts, so that memory does not follow the rows of Spark's batches."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([f"one two {k % 7}" for k in range(2000)])], names=["doc_id", "text"])
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    found = list(pieces.encode_pieces(docs)(iter([batch])))
    assert max(b.num_rows for b in found) <= 512
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(2000))
