"""Passages are found wherever a text holds them."""

import random

import pandas as pd

from cairn.operators import contain
from cairn.operators.contain import holders

TEXTS = ["xxlongestword in there", "the ---- end", "", "ab", None, "ñandú ñandú über Ünder", "aΣ ΟΔΟΣ and", "a a a a a a a a a a a a", "in the"]
ASKED = ["longestword in ther", "----", "", "b", None, "ñandú ñandú ü", "Σ ΟΔΟΣ an", "a a a a a a", "the ", "longestwords", "in there", "in the"]


def test_passages_at_edges_of_words_and_without_words(spark):
    """A passage may begin and end within a word, and may hold none."""
    chunks = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(TEXTS)], "chunk_idx long, paper_id string, text string").repartition(2)
    asked = spark.createDataFrame([*enumerate(ASKED), (99, "in there")], "query long, text string")
    want = {(q, i, f"p{i}") for q, p in [*enumerate(ASKED), (99, "in there")] for i, t in enumerate(TEXTS) if t is not None and p is not None and p in t}
    got = [tuple(r) for r in holders(chunks, asked).collect()]
    assert set(got) == want and len(got) == len(want)


def test_search_in_pieces(monkeypatch):
    """Matches over the ends of pieces, at both ends of a text, and never over two texts."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcé ", k=rng.randrange(60))) for _ in range(80)]
    asked = sorted({t[a : a + n] for t in texts for n in (3, 9, 14, 30) for a in (0, max(0, len(t) - n), 5)} | {texts[0][-5:] + texts[1][:5]})
    passages = {p.encode(): [q, q + 1000] for q, p in enumerate(asked)}
    frames = [pd.DataFrame({"chunk_idx": range(lo, min(lo + 30, 80)), "paper_id": "p", "raw": [t.encode() for t in texts[lo : lo + 30]]}) for lo in range(0, 80, 30)]
    want = sorted((q + n, i) for q, p in enumerate(asked) for n in (0, 1000) for i, t in enumerate(texts) if p in t)
    for size in (1, 7, 40, 1 << 22):
        monkeypatch.setattr(contain, "PIECE", size)
        got = pd.concat(contain._search(passages)(iter(frames)))
        assert sorted(zip(got["query"], got.chunk_idx)) == want
