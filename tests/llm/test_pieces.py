"""Own SentencePiece encoding and decoding against the library."""

import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = Path(PATH).read_bytes()
THEIRS = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
OURS = pieces.Vocabulary(MODEL)
HARD = [
    "", " ", "  ", "▁", "a▁b", " a", "a ", "   a   b  ", "\t\n x\r\n", "\x00", "a\x00b", "�", "▁▁ ▁", "naïve \U0001f600\U0001f600",
    "<s>", "</s> <unk>", "<0x41>", "x" * 3000, "ab" * 500, " " * 999, "中文 हि", "é", "1234567890" * 9, "⁇",
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text)
    assert OURS.decode(ids + [2]) == THEIRS.decode(ids + [2])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tetaoinsh.,'"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text) and OURS.decode(ids) == THEIRS.decode(ids)


def test_any_ids_decode_alike():
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(0, 3), 29871, 259]) for _ in range(rng.randrange(9))]
        assert OURS.decode(ids) == THEIRS.decode(ids), ids


def test_cuts_change_nothing():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("theinga réo  ▁") for _ in range(40))
        assert list(OURS.encode_part(OURS.normal(text))) == OURS.encode(text)


def test_short_and_long_agendas_agree(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aeinrst▁h.é中") for _ in range(rng.randrange(1, 25))) for _ in range(500)]
    short = [OURS.merged(t) for t in texts]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert short == [OURS.merged(t) for t in texts]


def test_unused_pieces_fall_apart():
    own = pieces.Vocabulary(MODEL)
    the = own.ids["▁the"]
    own.kinds[the], own.unused = pieces.UNUSED, {"▁the"}
    got = own.encode("the")
    assert the not in got and own.decode(got) == "the"


def test_rows(make_docs, sample_rows, odd_rows, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    rows = sample_rows + odd_rows
    docs = make_docs(rows, clashing=True).withColumnRenamed("n_words", "n_tokens")
    got = pieces.piece_digest(docs, PATH).collect()
    assert len(got) == len(rows) and all(r.agrees for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, len(e), sha(" ".join(map(str, e))), sha(THEIRS.decode(e))) for i, t, *_ in rows for e in [THEIRS.encode(t or "", add_eos=True)]), key=repr)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == want
    full = pieces.encoded(docs, PATH, ("ids", "decoded"), begin=True).collect()
    assert all(r.ids == THEIRS.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == THEIRS.decode(r.ids) for r in full)
    assert pieces.piece_digest(make_docs([]), PATH).collect() == []


def test_disagreement_is_reported(make_docs):
    own = pieces.Vocabulary(MODEL)
    own.known.fresh = {}
    own.order["▁th"] = -1e9
    texts = ["the cat", "a dog", "a dog, the dog"]
    for t in texts:
        own.encode(t)
    own.known.check(pieces.library(MODEL)[1])
    assert own.known.wrong == {"▁the"} or own.known.wrong == set()
    own.known["▁dog"] = (1,)
    own.known.fresh = {"▁dog": (1,), "▁cat": own.encode_part("▁cat")}
    own.known.check(pieces.library(MODEL)[1])
    assert "▁dog" in own.known.wrong and "▁cat" not in own.known.wrong


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(b"\x0a\x07\x0a\x05<unk>")
