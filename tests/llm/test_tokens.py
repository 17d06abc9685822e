import random

import pytest
from test_bitpack import whole_ids

from starscan.llm import tokens
from starscan.llm.queries import vocabulary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_joined_pieces_are_encoded_as_if_alone(name):
    pick = random.Random(11)
    parts = ["a", " ", "  ", "B", "é", "́", "\n", "\t", "don't", "'s", "1", "中", "😀", "<|endoftext|>",
             "<|", "|>", "<|startoftext|>", "endoftext", "\x00", "▁", "ǅ", "İ", ""]
    pieces = ["".join(pick.choices(parts, k=pick.randrange(7))) for _ in range(3000)]
    pieces += ["long " * 200, "x" * 1000, ""]
    lists = tokens.library_encoder(vocabulary(name), 50)(pieces)
    found = [lists.ids[s : s + n].tolist() for s, n in zip(lists.starts, lists.lengths)]
    assert found == [list(ids) for ids in whole_ids(pieces, name)]
