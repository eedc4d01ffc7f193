import hashlib
import random

import pytest
from conftest import SF_SMALL
from dqlens.llm import byte_bpe as BPE
from dqlens.llm.queries import VOCABULARY
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def coder():
    return BPE.ByteBPE(BPE.load_spec(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


ODD = ["", "a", " a  b\n\n c \t\r\n", "I'll don't 'S 's", "½ Ⅷ 一二三 ١٢٣ ²x", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d \x85 \xa0 x​ y",
       "🎉🎉 é́ 𝒳𝟙", "\x00\x01", "ÀÉ汉字  漢" * 50, "ªº ¹²³ aªb", "ab ٠¼", "a" * 3000, "the " * 2000, "  \n  " * 40]


@pytest.mark.parametrize("text", ODD)
def test_equals_the_library(coder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == want
    assert coder.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_random_texts_equal_the_library(coder, library):
    rng = random.Random(5)
    pool = "abcdeéèß '’ .,\n\t12²½–—🎉漢字Ωж  st"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    assert [coder.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_invalid_utf8_decodes_like_the_library(coder, library):
    for ids in ([coder.byte_id[0xC3]], [coder.byte_id[0xE2], coder.byte_id[0x82], coder.byte_id[65]],
                [coder.byte_id[0xFF]] * 3, [coder.byte_id[0xF0], coder.byte_id[0x9F]]):
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_small_cache_changes_nothing(library):
    small = BPE.ByteBPE(BPE.load_spec(VOCABULARY), cache_pieces=3)
    text = "one two three four five six seven one two three"
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(small.cache) <= 3


def test_query_matches_the_library(spark, small_docs, library):
    from dqlens.llm.queries import op7_byte_bpe
    got = {r["doc_id"]: tuple(r)[1:] for r in op7_byte_bpe(spark, SF_SMALL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in small_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(ids), sha(",".join(map(str, ids))), sha(text))


def test_awkward_rows(awkward, no_docs, library):
    out = BPE.encode_frame(awkward, VOCABULARY)
    assert out.columns == [*awkward.columns, "ids_", "decoded_"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["ids_"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded_"] == (r["text"] or "")
    assert BPE.encode_frame(no_docs, VOCABULARY).count() == 0


def test_pieces_met_lately_stay():
    made = []
    pieces = BPE._Pieces(lambda p: made.append(p) or (len(p),), 6)
    for i in range(50):
        assert pieces["often"] == (5,) and pieces[f"once {i}"] == (len(f"once {i}"),)
        assert len(pieces) + len(pieces.before) <= 6
    assert made.count("often") == 1


def test_workers_get_the_vocabulary_as_text(spark):
    """What it is parsed to is several times larger and goes once the coder stands."""
    shared = BPE._Shared(spark, BPE._text_of(VOCABULARY))
    assert isinstance(shared.value, str)
    assert BPE.ByteBPE(BPE.json.loads(shared.value)).encode("a b") == BPE.ByteBPE(BPE.load_spec(VOCABULARY)).encode("a b")


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    from dqlens.llm import common
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and calls == [1]


def test_a_coder_stays_for_its_own_tasks_only(spark):
    from dqlens.llm import common
    shared = BPE._Shared(spark, BPE._text_of(VOCABULARY))
    coder = BPE._coder(shared)
    same = common.tidy(lambda batches: (BPE._coder(shared) for _ in batches), shared.id)
    assert list(same([1])) == [coder] and BPE._coder(shared) is coder
    assert list(common.tidy(lambda batches: batches)([1])) == [1]
    assert not common._KEPT
