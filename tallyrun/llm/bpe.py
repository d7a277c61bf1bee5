"""Byte-level BPE as a finite-state transducer, and streaming decoding with an incremental UTF-8 machine.

A piece of text (one match of the split pattern) is read byte by byte. Rank merges have the property that a sequence of
tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs; so the last token before
every place is found from those before it, and a place matters only while the bytes since are the beginning of some
token. The transducer's state is what still matters: the bytes since the last place that all open readings share, and
the token before that place if a reading may start there. States are made when first met, with one edge per byte seen;
an edge carries the tokens that all open readings share by then, so a token leaves after a lookahead that the longest
token bounds. When a text ends a piece, the state gives the tokens that are still open. States and known pieces are
thrown away and made anew beyond a fixed number, so that memory is bounded on any text.

Decoding takes ids in chunks. A table states for each token and each of the UTF-8 machine's states the state after it; runs
of tokens that begin and end between characters pass at once, others step by step. Bytes of an unfinished character are
held back until the next chunk.

Defined cases: a null or empty text has no tokens; a text of any length is read whole, and split and encoded in linear time;
repeated rows are encoded alike, each for itself; a null key is kept; an empty table gives an empty result; other columns of
the input are not looked at. No shuffle takes place, so no key can be hot. Ids without a token raise an error; bytes that are
not UTF-8 decode as they are with ``decode_bytes`` and as U+FFFD in texts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
#: States and pieces that a worker keeps, and the longest piece that it keeps.
MOST_STATES, MOST_PIECES, LONG_PIECE = 300_000, 700_000, 64
NEVER = 1 << 62
#: Ids that are decoded at a time.
CHUNK = 1 << 16


class Vocabulary:
    """Tokens by rank, the tree of their beginnings, and which tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {r: t for t, r in ranks.items()}
        self._merges: dict[int, list[tuple[int, bytes, bytes]]] = {}
        self.known: dict[int, bool] = {}
        #: node * 256 + byte -> node; the token that ends at a node; nodes that some token goes on from. The root is 0.
        self.child: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.inner: set[int] = set()
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                self.inner.add(node)
                node = self.child.setdefault(node << 8 | byte, len(self.child) + 1)
            self.ends[node] = rank

    def merges(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """The merges of the token's own bytes, lowest rank and leftmost first: (rank of the next merge, the first part and
        the last part until then); the last entry, with an infinite rank, is what remains."""
        known = self._merges.get(token)
        if known is None:
            parts, known = [self.token[token][i : i + 1] for i in range(len(self.token[token]))], []
            while True:
                ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
                best = min(ranks, default=NEVER)
                known.append((best, parts[0], parts[-1]))
                if best == NEVER:
                    break
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._merges[token] = known
        return known

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes: no merge over the cut is ever the next one. At a
        piece's start (-1), whether the right one is that of its own."""
        a, b = [(NEVER, b"", b"")] if left < 0 else self.merges(left), self.merges(right)
        if len(b[-1][1]) < len(self.token[right]):
            return False
        i = j = 0
        while True:
            (next_left, _, last), (next_right, first, _) = a[i], b[j]
            over = self.ranks.get(last + first, NEVER) if last else NEVER
            if over < next_left and over <= next_right and over != NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def forget(self) -> None:
        self.known.clear()


#: The place among a state's open bytes, the tokens up to there, and the node of the bytes since.
Reading = tuple[int, tuple[int, ...], int]


class State(dict):
    """byte -> (next state, tokens that leave), filled as bytes are met.

    ``before`` is the token before the open bytes, -1 at a piece's start, None where it does not matter. A reading is a place
    where a token may still begin; the last one is the end of the bytes.
    """

    __slots__ = ("of", "before", "open", "readings", "rest")

    def __init__(self, of: Transducer, before: int | None, open_: bytes, readings: list[Reading]):
        super().__init__()
        self.of, self.before, self.open, self.readings, self.rest = of, before, open_, readings, None

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        v = self.of.vocabulary
        readings, path = [], None
        for place, tokens, node in self.readings:
            node = v.child.get(node << 8 | byte)
            if node is None:
                continue
            if path is None:
                token = v.ends.get(node)
                if token is not None:
                    left = tokens[-1] if tokens else self.before
                    fits = v.known.get(left << 32 | token)
                    if fits is None:
                        fits = v.known[left << 32 | token] = v.neighbours(left, token)
                    if fits:
                        path = (*tokens, token)
                    elif left == -1:  # merges do not reach this token, but a piece that ends here is it
                        readings.append((place, tokens, node))
                        continue
            if node in v.inner:
                readings.append((place, tokens, node))
        if path is None:
            raise ValueError(f"no token for byte {byte}")
        text = self.open + bytes((byte,))
        if readings and not readings[0][1]:  # place 0 may still begin a token, so nothing is shared yet
            readings.append((len(text), path, 0))
            found = self[byte] = self.of.state(self.before, text, readings), ()
            return found
        n, begun = len(path), True
        for _, tokens, _ in readings:
            if len(tokens) < n:
                n = len(tokens)
            while tokens[:n] != path[:n]:
                n -= 1
            begun = False
        shared = path[:n]
        readings.append((len(text), path, 0))
        for _, tokens, _ in readings:
            begun = begun or len(tokens) == n
        shift = 0
        for token in shared:
            shift += len(v.token[token])
        before = (shared[-1] if shared else self.before) if begun else None
        found = self[byte] = self.of.state(before, text[shift:], [(p - shift, t[n:], at) for p, t, at in readings]), shared
        return found

    def ending(self) -> tuple[int, ...]:
        """The tokens still open where a piece ends; a piece that is a token as it stands is that token."""
        if self.rest is None:
            whole = self.of.vocabulary.ranks.get(self.open) if self.before == -1 else None
            self.rest = self.readings[-1][1] if whole is None else (whole,)
        return self.rest


class Transducer:
    """Bytes of a piece in, token ids out; states are determinised as texts reach them."""

    def __init__(self, vocabulary: Vocabulary, most_states: int = MOST_STATES):
        self.vocabulary, self.most = vocabulary, most_states
        self.states: dict[tuple[int | None, bytes], State] = {}
        self.start = self.state(-1, b"", [(0, (), 0)])

    def state(self, before: int | None, open_: bytes, readings: list[Reading]) -> State:
        known = self.states.get((before, open_))
        if known is None:
            if len(self.states) >= self.most:
                self.forget()
            known = self.states[before, open_] = State(self, before, open_, readings)
        return known

    def forget(self) -> None:
        """Throws all states away; their edges too, so that no cycle keeps them. A run that is in one goes on from it."""
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.vocabulary.forget()
        self.start = self.states[-1, b""] = State(self, -1, b"", [(0, (), 0)])

    def run(self, piece: bytes) -> list[int]:
        state, out = self.start, []
        for byte in piece:
            state, tokens = state[byte]
            if tokens:
                out += tokens
        return [*out, *state.ending()]


class Encoder(dict):
    """Known pieces and their ids as little-endian 32-bit bytes; unknown ones go through the transducer."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, most_pieces: int = MOST_PIECES, most_states: int = MOST_STATES):
        import regex

        super().__init__()
        self.split, self.most, self.transducer = regex.compile(pattern), most_pieces, Transducer(vocabulary, most_states)

    def __missing__(self, piece: str) -> bytes:
        found = self.transducer.run(piece.encode("utf-8"))
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split.findall(text)))


#: The UTF-8 machine: states are what may come next; 0 between characters, -1 for a byte that cannot follow.
BETWEEN, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4 = range(8)


def utf8_steps() -> np.ndarray:
    """step[state, byte], by the ranges of well-formed byte sequences."""
    step = np.full((8, 256), -1, np.int8)
    for low, high, to in ((0x00, 0x7F, BETWEEN), (0xC2, 0xDF, ONE), (0xE0, 0xE0, AFTER_E0), (0xE1, 0xEC, TWO), (0xED, 0xED, AFTER_ED), (0xEE, 0xEF, TWO), (0xF0, 0xF0, AFTER_F0), (0xF1, 0xF3, THREE), (0xF4, 0xF4, AFTER_F4)):
        step[BETWEEN, low : high + 1] = to
    for state, low, high, to in ((ONE, 0x80, 0xBF, BETWEEN), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO), (AFTER_E0, 0xA0, 0xBF, ONE), (AFTER_ED, 0x80, 0x9F, ONE), (AFTER_F0, 0x90, 0xBF, TWO), (AFTER_F4, 0x80, 0x8F, TWO)):
        step[state, low : high + 1] = to
    return step


class Decoder:
    """Token ids in chunks to bytes, cut between characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = [vocabulary.token.get(i) for i in range(max(vocabulary.token, default=-1) + 1)]
        steps = utf8_steps()
        self.after = np.full((8, len(self.tokens)), -1, np.int8)
        for i, token in enumerate(self.tokens):
            for state in range(8) if token is not None else ():
                at = state
                for byte in token:
                    at = steps[at, byte] if at >= 0 else -1
                self.after[state, i] = at

    def stream(self) -> Stream:
        return Stream(self)


class Stream:
    """One text's decoding. ``feed`` returns the bytes of all characters that are whole by now."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.held = decoder, BETWEEN, b""

    def feed(self, ids: np.ndarray) -> bytes:
        after, tokens = self.decoder.after, self.decoder.tokens
        data = self.held + b"".join(map(tokens.__getitem__, ids.tolist()))
        state, at = self.state, 0
        odd = np.flatnonzero(after[BETWEEN, ids] != BETWEEN) if len(ids) else ids
        while at < len(ids):
            if state == BETWEEN:  # all tokens before the next odd one leave the machine between characters
                next_odd = int(np.searchsorted(odd, at))
                if next_odd == len(odd):
                    break
                at = int(odd[next_odd])
            state = int(after[state, ids[at]]) if state >= 0 else -1
            if state < 0:  # not UTF-8: the bytes are taken as they are, and the machine looks for the next beginning
                state = _tail(data_until(self.held, tokens, ids, at))
            at += 1
        self.state = state
        keep = 0 if state == BETWEEN else _open_bytes(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep]

    def finish(self) -> bytes:
        rest, self.held, self.state = self.held, b"", BETWEEN
        return rest


def data_until(held: bytes, tokens: list[bytes], ids: np.ndarray, at: int) -> bytes:
    """The last bytes up to and with the token at ``at``, enough to hold an unfinished character."""
    out, i = b"", at
    while i >= 0 and len(out) < 4:
        out, i = tokens[int(ids[i])] + out, i - 1
    return held + out if i < 0 else out


def _open_bytes(data: bytes) -> int:
    """How many bytes at the end are an unfinished, so far well-formed character."""
    steps = utf8_steps_of()
    for n in range(1, min(3, len(data)) + 1):
        state = BETWEEN
        for byte in data[-n:]:
            state = int(steps[state, byte]) if state >= 0 else -1
        if state > 0 and data[-n] >= 0xC0:
            return n
    return 0


def _tail(data: bytes) -> int:
    """The machine's state after malformed bytes."""
    steps, state, n = utf8_steps_of(), BETWEEN, _open_bytes(data)
    for byte in data[len(data) - n :]:
        state = int(steps[state, byte])
    return state


@lru_cache(1)
def utf8_steps_of() -> np.ndarray:
    return utf8_steps()


@lru_cache(2)
def vocabulary(ranks: str) -> Vocabulary:
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(ranks), "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@lru_cache(2)
def encoder(ranks: str, pattern: str) -> Encoder:
    return Encoder(vocabulary(ranks), pattern)


@lru_cache(2)
def decoder(ranks: str) -> Decoder:
    return Decoder(vocabulary(ranks))


def decode_bytes(stream: Stream, ids: np.ndarray, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of whole characters, chunk by chunk of ids."""
    for at in range(0, len(ids), chunk):
        yield stream.feed(ids[at : at + chunk])
    yield stream.finish()


def pattern_of(pattern: str | None) -> str:
    import public_tokenizers

    return pattern or public_tokenizers.PATTERN


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids): each text's token ids as little-endian unsigned 32-bit numbers."""
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(ranks, pattern_of(pattern))
        for batch in slices(batches, text):
            ids = [known.encode(t or "") for t in column(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [key, "n_tokens", "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_tokens long, ids binary")


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """(key, text) of rows with token ids."""
    rows = rows.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = decoder(ranks)
        for batch in slices(batches, ids):
            texts = [b"".join(decode_bytes(known.stream(), np.frombuffer(x or b"", "<u4"))).decode("utf-8", "replace") for x in column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(texts, pa.string())], [key, "text"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes that these decode to.

    Ids and decoded bytes of one text at a time stay in the task.
    """
    rows = docs.select(key, text)

    def digests(texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        into, out = encoder(ranks, pattern_of(pattern)), decoder(ranks)
        for t in texts:
            ids, back = into.encode(t or ""), hashlib.sha256()
            for part in decode_bytes(out.stream(), np.frombuffer(ids, "<u4")):
                back.update(part)
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            n, ids, back = zip(*digests(column(batch, text).to_pylist()))
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
