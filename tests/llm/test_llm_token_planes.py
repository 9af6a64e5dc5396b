import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from medalmart.llm.token_planes import ShardReader, ShardWriter, encoder, from_planes, to_planes, token_planes, tokenizer_path

WORDS = st.sampled_from(["The", "don't", "thon.", "a,b", "İx", "Σας", "É", "é", "naïve,", "1.5", "<|endoftext|>", " ", " ", "漢字", "\n", "ß", "ÿ", "×", "It's,", "x.", "ﬁ", "A\x1cB"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.lists(WORDS, max_size=8).map(" ".join)), min_size=1, max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    t = Tokenizer.from_file(tokenizer_path())
    counts, ids = encoder(tokenizer_path())(pa.array(texts), 1)
    want = [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_odd_letters_before_stops_encode_like_whole_texts():
    rng = random.Random(6)
    bits = ["\u0130", "I", "i\u0307", "\u0131", "e\u0301", "\u00e9", "\u1e9e", "\ufb01", "\u01c5", "\u03a3", "\u0345", "\u4e2d", "a", "Z", "7", "'s", ".", ",", "!", " ", "\n", "\u00a0", "\u2003"]
    odd = ["\u0130. x", "\u0130, ", "a\u0130."] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    t = Tokenizer.from_file(tokenizer_path())
    counts, ids = encoder(tokenizer_path())(pa.array(odd), 1)
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in odd]
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [x for x, a, b in zip(odd, got, want, strict=True) if a.tolist() != b] == []


def test_added_tokens_are_matched_in_their_own_case():
    texts = ["Some <|ENDOFTEXT|> here, THERE.", "A<|StartOfText|>B x", "<|endoftext|> <|Endoftext|>", "NO token, Here."]
    t = Tokenizer.from_file(tokenizer_path())
    counts, ids = encoder(tokenizer_path())(pa.array(texts), 1)
    want = [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(unit, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (from_planes(to_planes(ids, unit), n) == ids).all()


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_any_range_of_a_shard(unit):
    rng, out = np.random.default_rng(1), io.BytesIO()
    ids, w = rng.integers(0, 49408, 1234).astype(np.uint32), ShardWriter(out, unit, block=100)
    for a in range(0, 1234, 77):
        part = ids[a : a + 77]
        w.add(pa.array([a]), np.array([len(part)]), part)
    w.close(pa.int64())
    r = ShardReader(out, len(out.getvalue()))
    for a, b in ((0, 1234), (99, 101), (250, 250), (1200, 1234)):
        assert np.concatenate([np.empty(0, np.uint32), *r.ids(a, b)]).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1)


def brute(rows):
    t, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for key, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_documents(docs, rows, tmp_path):
    got = token_planes(docs, folder=f"file://{tmp_path}/out", block=500)
    assert sorted(map(tuple, got.collect())) == brute([(r[0], r[1]) for r in rows])
    assert got.count() == len(rows)  # reading again writes nothing again


def test_odd_rows(odd, empty):
    got = sorted(map(tuple, token_planes(odd).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 1, 2]
    assert got[-1][1:] == (3 * got[0][2], 1, zlib.crc32(np.array([1], "<u4").tobytes()))
    assert token_planes(empty).count() == 0
