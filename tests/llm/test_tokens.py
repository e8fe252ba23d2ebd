"""SentencePiece and token counts against the libraries' own results."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import pieces, token_counts
from .cases import edge_docs, empty_docs, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_spans_and_decoded_texts(spark, model):
    encoded = pieces.decode_pieces(pieces.encode_pieces(edge_docs(spark), MODEL), MODEL).toPandas()
    by = {}
    for r in encoded.itertuples():
        by.setdefault(None if np.isnan(r.doc_id) else int(r.doc_id), []).append(r)
    for key, text, _, _ in texts():
        text = text or ""
        got = [r for r in by[key] if r.decoded == model.decode(model.encode(text, add_bos=True, add_eos=True))]
        assert got
        r = next(r for r in got if list(r.ids) == model.encode(text, add_bos=True, add_eos=True))
        raw = text.encode()
        inner = [raw[b:e] for b, e in zip(r.begins[1:-1], r.ends[1:-1])]
        assert b"".join(inner) == raw  # the spans cover every byte of the text once
        for p, span in zip(model.encode(text, return_type="proto").pieces, inner):
            if span and p.piece[0] != "<" and not p.piece.startswith("▁"):
                assert p.piece.replace("▁", " ").encode() == span
    assert pieces.encode_pieces(empty_docs(spark), MODEL).count() == 0


def test_digests(spark, model):
    got = {r.doc_id: r for r in pieces.piece_digests(edge_docs(spark).where("doc_id in (1, 6, 11)"), MODEL).collect()}
    for key, text, _, _ in texts():
        if key in got:
            ids = model.encode(text or "", add_bos=True, add_eos=True)
            assert got[key].n_tokens == len(ids)
            assert got[key].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[key].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40))
def test_spans_cover_any_text(text):
    if "p" not in _held:
        _held["p"] = pieces.aligned_encoder(MODEL)
    model, encode = _held["p"]
    ids, begins, ends = encode(text)
    assert list(ids) == model.encode(text, add_bos=True, add_eos=True)
    assert b"".join(text.encode()[b:e] for b, e in zip(begins, ends)) == text.encode()


@pytest.mark.parametrize("rule, trim", [("nmt_nfkc", True), ("nmt_nfkc_cf", False)])
def test_longest_prefix_through_a_character_map(rule, trim):
    """A compiled map of the library itself: same text, and offsets that fall on its own."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=trim)
    spec = proto.ModelProto.FromString(norm.serialized_model_proto()).normalizer_spec
    aligner = pieces.Aligner(spec)
    assert len(aligner.map) > 1000
    for text in ["ﬁne ①②  ㌔㍍ Ａｂｃ  ½ ", " ｶﾞｷﾞ é Å ﷺ", "plain", "", "ÄÖ  x\ty", "ǆ ŉ ﬀ"]:
        made, begin, end = aligner.align(text.encode())
        assert made.decode() == norm.normalize(text)
        assert len(begin) == len(made) and all(b <= e for b, e in zip(begin, end)) and list(begin) == sorted(begin)
        for at, ch in ((i, c) for i, c in enumerate(text) if c.isascii() and c.islower() and text[i + 1:i + 2].isascii()):
            source = len(text[:at].encode())
            assert any(made[i:i + 1] == ch.encode() for i in np.flatnonzero(begin == source))


def test_counts(spark):
    t = Tokenizer.from_file(WORDS)
    rows = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(edge_docs(spark), WORDS).collect())
    want = []
    for key, text, _, _ in texts():
        n = len(t.encode(text or "", add_special_tokens=False))
        want.append((key or -1, len((text or "").encode()), n, n > 2048))
    assert rows == sorted(want)
    assert token_counts.token_counts(empty_docs(spark), WORDS).count() == 0
    assert token_counts.token_counts(edge_docs(spark).where("doc_id = 4"), MODEL).first().n_tokens == len(
        sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("one"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t'sSẞΣ́ͅ<|>endoftx")), max_size=60))
def test_splitting_at_white_space_is_safe(text):
    whole = len(_whole().encode(text, add_special_tokens=False))
    assert _count()([text]) == [whole]


_held = {}


def _whole():
    return _held.setdefault("t", Tokenizer.from_file(WORDS))


def _count():
    if "c" not in _held:
        _held["c"] = token_counts.piece_counter(WORDS)
    return _held["c"]
