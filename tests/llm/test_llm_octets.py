import random

import pytest

from medalmart.llm.octets import word_lists


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1 << 20])
def test_words_of_pieces_are_the_words_of_the_text(size):
    rng = random.Random(size)
    for _ in range(200):
        text = "".join(rng.choice("ab é\t\n \r\x0b\x0c漢") for _ in range(rng.randint(0, 60))).encode()
        assert [w for part in word_lists(text, size=size) for w in part] == text.split()


def test_a_table_is_applied_before_the_blanks_are_sought():
    table = bytes(32 if b == ord("-") else b for b in range(256))
    assert [w for part in word_lists(b"a-bb--ccc d", table, 2) for w in part] == [b"a", b"bb", b"ccc", b"d"]
