import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import clashing, documents, hard_documents

from millrace.llm.sentencepiece_codec import PieceCodec, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PATH)


def same(codec, library, texts):
    for text, (ids, decoded) in zip(texts, codec.round_trips(texts)):
        wanted = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == wanted
        assert decoded == library.decode(wanted) == codec.decode(wanted)


def test_edge_cases(codec, library):
    same(codec, library, [None, "", " ", "  a", "a ", "▁", "▁▁a▁", "\n\n\t", "<s>x</s><unk><0x0A>", "漢字🙂é", "\x00\x1c", "a" * 3000, "   " * 50, "don't, (x)!"])


def test_random_texts(codec, library):
    rng = random.Random(1)
    pieces = [p for p in codec.cost if p.strip("▁")]
    alphabet = "abcdeth in er .,\n\t  ▁é漢🙂\x0012ABÄß<s>"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(120))) for _ in range(1500)]
    same(codec, library, texts + ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(3000)])


def test_each_prefix_has_one_last_token(codec):
    """Among the pieces that end at a place exactly one can follow the encoding of the text before it."""
    rng = random.Random(6)
    for _ in range(300):
        text = "▁" + "".join(rng.choices("thenrsaio", k=rng.randrange(1, 14)))
        for end in range(1, len(text) + 1):
            fits = [p for p in codec.cost if text[:end].endswith(p) and codec.history[codec.pieces.index(p)][-1][0] == p] if end < 4 else []
            if fits:
                follow = [p for p in fits if end == len(p) or codec.may_meet(codec.tokens(text[: end - len(p)])[-1], codec.pieces.index(p))]
                assert len(follow) == 1


def test_rows(spark, library):
    found = encode_documents(clashing(documents(spark)), PATH).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    wanted = [(d, len(ids := library.encode(t or "", add_bos=True, add_eos=True)), library.decode(ids)) for d, t, *_ in hard_documents()]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded) for r in found), key=key) == sorted(wanted, key=key)
    assert encode_documents(documents(spark).where("false"), PATH).count() == 0
