"""Words of texts cut into pieces."""

from __future__ import annotations

import pytest

from recollect.llm import words


@pytest.mark.parametrize("text", [b"a " + b"x" * 50 + b" b", b" " + b"x" * 50, b"x" * 50 + b" y", b"  \n " + b"x" * 9, "語".encode() * 30, b" " * 40])
def test_pieces_step_over_leading_white_space(monkeypatch, text):
    monkeypatch.setattr(words, "PIECE_BYTES", 8)
    pieces = []
    for piece in words.plain_pieces(text):
        pieces += piece
        assert len(pieces) <= len(text)
    assert pieces == text.split()
