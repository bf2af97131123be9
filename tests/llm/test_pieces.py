"""What a function over texts gets at once."""

from dossier.llm import neardup
from dossier.llm.common import pieces, spans


def test_sketching_gets_few_texts_at_once(monkeypatch):
    """Working arrays of a sketch take eight kilobytes a text and dozens of bytes a byte of text."""
    asked = []
    monkeypatch.setattr(neardup, "map_texts", lambda *a: asked.append(a[5:]))
    neardup.signatures(None, "doc_id", "text", 5, 32, 4)
    assert asked and asked[0][0] <= 1_000_000 and asked[0][1] <= 500


def test_spans_cover_all_texts_in_order():
    sizes = [3, None, 900, 0, 5, 5, 2000, 1]
    assert list(spans(sizes, 1000, 3)) == [(0, 3), (3, 3), (6, 1), (7, 1)]
    texts = [None if k is None else b"x" * k for k in sizes]
    assert [t for _, part in pieces(texts, 10, 2) for t in part] == texts and list(spans([], 10, 2)) == []
