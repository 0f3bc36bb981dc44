import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrydex.operators.chunk import chunk_spans

TEXT = "Small start.\n\nA sentence that runs on, with marks: one; two, and three more words to be over it. Next one.\n\nEnd."


def chunks(text, *args):
    return [text[a:b] for a, b in chunk_spans(text, *args)]


def test_levels():
    assert chunks(TEXT, 100) == [TEXT]
    found = chunks(TEXT, 8)
    assert "".join(found) == TEXT
    assert found[0].startswith("Small start.\n\n")
    assert all(len(c.split()) <= 8 for c in found)


def test_least_size_stands_alone():
    assert len(chunks(TEXT, 8, 5)) >= len(chunks(TEXT, 8))
    with pytest.raises(ValueError):
        chunk_spans(TEXT, 5, 6)


def test_long_word():
    assert chunks("x" * 50 + " y", 1) == ["x" * 50 + " ", "y"]
    assert chunk_spans("", 5) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,;:!?()\n\té", max_size=200), st.integers(1, 12))
def test_covers_text(text, most):
    spans = chunk_spans(text, most)
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(a < b for a, b in spans)
    assert all(len(text[a:b].split()) <= most for a, b in spans)


def test_chunker_by_name():
    from quarrydex.operators import chunk

    assert chunk.chunker("recursive", 4, None)("a b c. d e f.") == chunk.chunk_spans("a b c. d e f.", 4)
    with pytest.raises(ValueError):
        chunk.chunker("odd")
