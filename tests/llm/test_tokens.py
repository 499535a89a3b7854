"""What the encoder holds, which a worker keeps between tasks, and what cutting takes."""

import random
import sys
import tracemalloc

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from quillgraph.llm import tokens  # noqa: E402
from quillgraph.llm.tokens import TextEncoder  # noqa: E402


def held_bytes(encoder):
    """Bytes of all that an encoder keeps of what it encoded: dictionaries, keys, ids."""
    parts = [encoder.known, encoder.pieces, encoder.flat, encoder.starts, *getattr(encoder, "before", ())]
    own = lambda x: sys.getsizeof(x) + (sum(map(sys.getsizeof, x)) + sum(map(sys.getsizeof, x.values())) if isinstance(x, dict) else 0)
    return sum(map(own, parts))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_bounded_in_bytes(monkeypatch, name):
    """Chunks without spaces are few and long: a bound on their number is none on a worker's memory. Ids stay the same."""
    monkeypatch.setattr(tokens, "MOST_BYTES", 2 << 20, raising=False)
    monkeypatch.setattr(tokens, "SLICE", 1 << 18, raising=False)
    r = random.Random(3)
    wide = ["".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(1_000)) for _ in range(900)]
    made = [" ".join(wide[k : k + 3]) + f" it's {k % 7} plain, {k}'x" for k in range(0, 900, 3)] + ["", "it's plain"]
    encoder = TextEncoder(str(public_tokenizers.path(name)))
    for texts in (made, made[:30] + made[-5:]):
        flat, counts = encoder.encode(pa.array(texts, pa.large_string()))
        wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, wanted)) and flat.tolist() == [i for ids in wanted for i in ids]
    assert held_bytes(encoder) < 6 << 20


def test_cutting_takes_little_memory():
    """4 MB of text: what is allocated at once."""
    column = pa.array(["plain words, 12 of them; \u00e9t\u00e9 \u4e2d\u6587 " * 1_000] * 100, pa.large_string())
    encoder = TextEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    encoder.encode(column[:1])
    tracemalloc.start()
    try:
        encoder.encode(column)
        assert tracemalloc.get_traced_memory()[1] < 45e6
    finally:
        tracemalloc.stop()
