"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import piece_bpe

from .conftest import edge_rows, prose

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encoded(texts):
    return [([int(i) for _, ids, _ in words for i in ids.split()] + [2],
             "".join(d for _, _, d in words).removeprefix(" ")) for words in piece_bpe.encode_texts(texts, MODEL)]


TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab  eeirstnn\n\t,▁<>/0é中\U0001f600"), st.characters(
    exclude_categories=("Cs",))), max_size=80)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_any_text(library, texts):
    for t, (ids, back) in zip(texts, encoded(texts)):
        assert ids == library.encode(t, add_eos=True)
        assert back == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 262), max_size=12))
def test_any_ids_decode(library, ids):
    assert piece_bpe.decode_ids(piece_bpe.pieces(MODEL), ids) == library.decode(ids)


@pytest.mark.parametrize("alphabet,size", [
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1_000_000),
    ("aeinrst", 100_000), ("x", 1_000_000), (" ", 5_000), (" x", 20_000), ("▁a ", 5_000), ("Ɤ\n", 5_000)])
def test_long_words(library, alphabet, size):
    rnd = random.Random(size)
    t = "".join(rnd.choice(alphabet) for _ in range(size))
    (ids, back), = encoded([t])
    assert ids == library.encode(t, add_eos=True)
    assert back == library.decode(ids)


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_are_told_apart_by_themselves(library):
    """Two words that polynomial fingerprints modulo 2**64 do not tell apart."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    for t, (ids, back) in zip([word, other], encoded([word, other])):
        assert ids == library.encode(t, add_eos=True) and back == t


def test_a_full_store_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MAX_WORDS", 5)
    for k in range(4):
        t = prose(k, 50)
        assert encoded([t])[0][0] == library.encode(t, add_eos=True)


def test_table_with_edge_rows(spark, edge, nothing, library):
    rows = piece_bpe.encode_documents(edge, digests=True).collect()
    want = []
    for d, t in edge_rows():
        ids = library.encode(t or "", add_eos=True)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert piece_bpe.encode_documents(nothing, digests=True).collect() == []
    assert piece_bpe.encode_documents(nothing).columns == ["doc_id", "ids", "decoded"]


def test_round_trip_through_tables(spark, edge, library):
    enc = piece_bpe.encode_documents(edge)
    back = {r.doc_id: r.decoded for r in piece_bpe.decode_documents(enc).collect()}
    for d, t in edge_rows():
        assert back[d] == library.decode(library.encode(t or "")) == (t or "")
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in piece_bpe.decode_documents(null).collect()] == ["", ""]


def test_other_models_are_refused(monkeypatch):
    import sentencepiece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, s: s.strip())
    with pytest.raises(ValueError):
        piece_bpe.Pieces(MODEL)
