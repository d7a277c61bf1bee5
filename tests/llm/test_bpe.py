from __future__ import annotations

import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrun.llm import bpe

from .helpers import LONG, ROWS, documents

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
WHOLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.encoder(bpe.RANKS, public_tokenizers.PATTERN)
DECODER = bpe.decoder(bpe.RANKS)
ids_of = lambda x: np.frombuffer(x, "<u4").tolist()


def streamed(ids: list[int], chunk: int) -> list[bytes]:
    return list(bpe.decode_bytes(DECODER.stream(), np.array(ids, "<u4"), chunk))


@settings(max_examples=200, deadline=None)
@given(st.text() | st.text(alphabet="  \n\t\r'sdlabtheing1²<|>\x1c\x85 éß🙂漢"), st.integers(1, 4))
def test_same_ids_and_round_trip(text, chunk):
    ids = ids_of(ENCODER.encode(text))
    assert ids == WHOLE.encode_ordinary(text)
    parts = streamed(ids, chunk)
    assert b"".join(parts) == text.encode()
    for part in parts:
        part.decode()  # whole characters only


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(RANKS) - 1), max_size=12), st.integers(1, 5))
def test_any_ids_decode_to_their_bytes(ids, chunk):
    assert b"".join(streamed(ids, chunk)) == WHOLE.decode_bytes(ids)


def test_joined_tokens():
    """Texts of joined tokens, in which neighbours often merge over the cut; a few states and pieces are kept."""
    rng, tokens = random.Random(1), list(RANKS)
    small = bpe.Encoder(bpe.vocabulary(bpe.RANKS), public_tokenizers.PATTERN, most_pieces=20, most_states=100)
    for _ in range(3000):
        text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))).decode("utf-8", "ignore")
        assert ids_of(small.encode(text)) == WHOLE.encode_ordinary(text)
        assert len(small.transducer.states) <= 101 and len(small) <= 20


def brute(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_ranks(data):
    """Vocabularies in any order, also with tokens that merges never reach."""
    texts = data.draw(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=12))
    order = data.draw(st.permutations(["a", "b", "c", *texts]))
    ranks = {t.encode(): i for i, t in enumerate(order)}
    transducer = bpe.Transducer(bpe.Vocabulary(ranks), most_states=data.draw(st.sampled_from([3, 1000])))
    for piece in data.draw(st.lists(st.text("abc", min_size=1, max_size=30), max_size=6)):
        assert transducer.run(piece.encode()) == brute(ranks, piece.encode())


def test_lookahead_is_bounded():
    """Tokens leave while a long piece is still being read."""
    state, waiting = ENCODER.transducer.start, 0
    for byte in b"thequickbrownfoxjumpsoverthelazydog" * 200:
        state, out = state[byte]
        waiting = max(waiting, len(state.open))
    assert waiting <= 4 * max(map(len, RANKS))


@pytest.mark.parametrize("unit", ["a", " ", "\n", " \n", "é", "ab", "0", "=-"])
def test_long_runs(unit):
    text = "x" + unit * (200_000 // len(unit)) + "y"
    assert ids_of(ENCODER.encode(text)) == WHOLE.encode_ordinary(text)


def test_classes_of_all_characters():
    """The split agrees with the library's for every code point, next to letters, digits, blanks and signs."""
    points = [c for c in [*range(0x32000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]  # planes with characters
    for at in range(0, len(points), 4096):
        text = "\n".join(f"a{c}1{c}  {c}-{c}" for c in map(chr, points[at : at + 4096]))
        assert ids_of(ENCODER.encode(text)) == WHOLE.encode_ordinary(text)


def test_malformed_bytes():
    one = {struct.pack("B", i): RANKS[struct.pack("B", i)] for i in range(256)}
    for bad in (b"\xff", b"\xe2\x28", b"\xf0\x9f", b"\xed\xa0\x80", b"\xc3\xc3\xa9", b"a\x80b", b"\xf4\x90\x80\x80", b"\xe2\x82"):
        data = b"ab" + bad + "é🙂".encode()
        for chunk in (1, 2, 3, 100):
            parts = streamed([one[data[i : i + 1]] for i in range(len(data))], chunk)
            assert b"".join(parts) == data
            assert "".join(p.decode("utf-8", "replace") for p in parts[:-1]) in data.decode("utf-8", "replace") or chunk < 100


def test_cases(spark):
    docs = documents(spark)
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = WHOLE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(documents(spark, [])).count() == 0
    ids = bpe.encoded(docs)
    assert {(r["doc_id"], r["n_tokens"]) for r in ids.collect()} == {(i, len(WHOLE.encode_ordinary(t or ""))) for i, t in ROWS}
    back = bpe.decoded(ids.where("doc_id = 4")).collect()
    assert [r["text"] for r in back] == [LONG]


def test_unknown_id():
    with pytest.raises((IndexError, TypeError)):
        streamed([len(RANKS) + 10], 1)
