import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wortnetz.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_odd_texts(vocabulary, texts):
    odd = [t or "" for t in texts] + ["  a  b", " x", "a\n\nb \n c", "\n", "a▁b", "▁", "a  \n b", "end ", " " * 300, "\ta\tb", "a \n", " \n a", "\n a", "<s> </s> <unk> <0x41>", "a" * 3000]
    assert vocabulary.encode(odd) == vocabulary.library.encode(odd)
    assert vocabulary.encode(odd) == vocabulary.library.encode(odd)  # from memory


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("the in▁ \n\tab.,éß日🙂\x00"), max_size=60))
def test_any_text(text):
    import public_tokenizers

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert v.encode([text]) == [v.library.encode(text)]


def test_both_agendas_agree(vocabulary):
    rng = random.Random(1)
    for _ in range(500):
        text = "▁" + "".join(rng.choice("theinadorstlé") for _ in range(rng.randint(1, 40)))
        assert vocabulary._merge_short(text) == vocabulary._merge_long(text)


def test_a_difference_is_an_error(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.check("x", [1], [2])


def test_memory_is_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    v = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for k in range(20):
        t = [" ".join(f"w{k}x{i}" for i in range(20))]
        assert v.encode(t) == v.library.encode(t)
        assert len(v.known) <= 50 and len(v.older) <= 50


def test_columns(spark, docs, no_docs, vocabulary):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode_texts(docs, path)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = vocabulary.library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == ids and r["decoded"] == vocabulary.library.decode(ids)
    assert pieces.encode_texts(no_docs, path).count() == 0
    again = out.select("decoded", pieces.decoded(out["ids"], path).alias("again")).collect()
    assert all(r["decoded"] == r["again"] for r in again)
