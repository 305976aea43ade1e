"""Byte-level BPE as a finite-state transducer, built while it runs.

The merges give every prefix of a word exactly one last token, and a row of tokens
is the encoding exactly if every two neighbours in it are (two neighbours are
if merging their bytes alone gives them back). So reading one more byte only
has to look at the tokens that end there and begin at a *live* place, one from which
some token may still be under way.

A state of the nondeterministic machine is a live place with the tokens that lead to
it; a state of the transducer is the set of them. States and their arcs, ``byte -> (state, tokens)``, are
made when they are asked for again. What all live places have in common
can no longer change and is emitted: that is the bounded lookahead, as no place stays
live for longer than the longest token. If the table outgrows ``MAX_STATES`` it is
emptied, which costs time only.

Decoding is a table lookup; :class:`Utf8Stream` turns the bytes into text piece by
piece and holds back a character that is not complete yet.

Defined cases: null text is empty and gives no tokens; ids outside the vocabulary are an
error; bytes that are no UTF-8 decode to U+FFFD in text and stay as they are in bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import extended, slices

MAX_STATES = 100_000
#: Arcs that have been asked for once and are remembered by their number.
MAX_ASKED = 400_000
#: Words whose tokens are remembered by each task, and the longest such word in characters:
#: together they bound the memory, some 100 bytes a word.
MAX_WORDS = 400_000
LONGEST_KEPT = 64
#: Symbols of the table, a power of two.
SYMBOLS = 128

_BYTES = [bytes((b,)) for b in range(256)]
_NO_ARCS = array("i", [-1]) * SYMBOLS


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank, line by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """``table[state << 7 | symbol]`` is -1 (no arc yet) or twice the next state, and one more if ids
    are settled by then: ``settled`` has them (little-endian, 32 bits each). ``ends[state]`` are the
    ids left when a word ends there. The bytes most common in the vocabulary have a symbol each; the
    others share one, which has no arcs."""

    def __init__(self, ranks: dict[bytes, int], max_states: int | None = None):
        self.ranks, self.max_states = ranks, max_states or MAX_STATES
        self.codes = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        # 1 for what longer tokens begin with, 2 for tokens, 3 for both.
        self.kinds = dict.fromkeys((t[:n] for t in ranks for n in range(1, len(t))), 1)
        for t in ranks:
            self.kinds[t] = self.kinds.get(t, 0) | 2
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.halves: dict[bytes, list[bytes]] = {}
        common = Counter(b"".join(ranks)).most_common(SYMBOLS - 1)
        self.symbols = bytearray([SYMBOLS - 1]) * 256
        for i, (byte, _) in enumerate(common):
            self.symbols[byte] = i
        self.table = array("i")
        self.settled: dict[int, bytes] = {}
        self.numbers: dict[tuple, int] = {}
        self.asked: set[int] = set()
        self._reset()

    def _reset(self) -> None:
        # A live place: the bytes since it, and the tokens that lead to it.
        for kept in (self.settled, self.numbers, self.asked, self.pairs):
            kept.clear()
        del self.table[:]
        self.states, self.ends = [], []
        self._added(((b"", ()),))

    def _is_pair(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of two tokens alone gives them back.

        The merges that made them are undone from the last one on. If at any of these times a
        merge across the border would have come before the one undone, it was made instead."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        left, right, ranks, limit = a, b, self.ranks, len(self.ranks) + 1
        while True:
            across = ranks.get(left + right)
            if across is not None and across < limit:
                known = False
                break
            if len(left) > 1 and (len(right) == 1 or ranks[left] > ranks[right]):
                limit, left = ranks[left], self._halves(left)[1]
            elif len(right) > 1:
                # Of equal merges the one further left comes first.
                limit, right = ranks[right] + 1, self._halves(right)[0]
            else:
                known = True
                break
        self.pairs[a, b] = known
        return known

    def _halves(self, token: bytes) -> list[bytes]:
        """The two parts of the last merge that makes a token."""
        known = self.halves.get(token)
        if known is None:
            known = self.halves[token] = self.merged(token, 2)
        return known

    def _is_whole(self, token: bytes) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(token) == [token]
        return known

    def _ids(self, tokens: tuple[bytes, ...]) -> bytes:
        return b"".join([self.codes[t] for t in tokens])

    def merged(self, word: bytes, least: int = 1) -> list[bytes]:
        """By the definition: again and again the leftmost pair of lowest rank, until there are
        no more than ``least`` parts."""
        rank, none = self.ranks.get, len(self.ranks) + 1
        parts = [word[i : i + 1] for i in range(len(word))]
        ranked = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
        while len(ranked) >= least and (best := min(ranked)) != none:
            i = ranked.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            # Only the pairs on both sides of the new part change.
            del ranked[i]
            if i:
                ranked[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranked):
                ranked[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _next(self, live: tuple, byte: int) -> tuple[tuple, bytes]:
        """The live places one byte further, and the ids that are settled by it."""
        last, going, ends = _BYTES[byte], [], None
        kinds, pairs = self.kinds, self.pairs
        for since, path in live:
            word = since + last
            kind = kinds.get(word)
            if kind is None:
                continue
            if kind & 1:
                going.append((word, path))
            if ends is None and kind & 2 and self._is_whole(word):
                fits = not path or pairs.get((path[-1], word))
                if fits or (fits is None and self._is_pair(path[-1], word)):
                    ends = (*path, word)
        if ends is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        # The last shared token stays: whether the next one may follow depends on it.
        if not going:
            return ((b"", ends[-1:]),), self._ids(ends[:-1])
        going.append((b"", ends))
        most = min([len(p) for _, p in going]) - 1
        if most > 0:
            paths = [p for _, p in going]
            low, high, shared = min(paths), max(paths), 0
            while shared < most and low[shared] == high[shared]:
                shared += 1
            if shared:
                return tuple([(w, p[shared:]) for w, p in going]), self._ids(ends[:shared])
        return tuple(going), b""

    def _added(self, live: tuple) -> int:
        known = self.numbers[live] = len(self.states)
        self.states.append(live)
        self.table.extend(_NO_ARCS)
        self.ends.append(self._ids(live[-1][1]))
        return known

    def packed(self, word: str) -> bytes:
        """Ids of a word of the split text, as little-endian 32-bit integers."""
        raw = word.encode()
        return self.codes.get(raw) or b"".join(self.pieces(raw))

    def pieces(self, word: bytes) -> list[bytes]:
        """Ids in order, noted as soon as they are settled.

        An arc is added when it is asked for a second time. Before that the live places go on by
        themselves, until they are those of a state: the ends of rare words leave nothing behind."""
        table, number, found = self.table, self.numbers.get, []
        state, live = 0, None
        for byte, symbol in zip(word, word.translate(self.symbols)):
            if live is None:
                at = state << 7 | symbol
                step = table[at]
                if step >= 0:
                    if step & 1:
                        found.append(self.settled[at])
                    state = step >> 1
                    continue
                live, out = self._next(self.states[state], byte)
                known = number(live)
                if known is None and at in self.asked:
                    if len(self.states) >= self.max_states:
                        self._reset()
                        at = -1
                    known = self._added(live)
                if known is not None:
                    if at >= 0 and symbol != SYMBOLS - 1:
                        table[at] = known << 1 | bool(out)
                        if out:
                            self.settled[at] = out
                    state, live = known, None
                else:
                    if len(self.asked) >= MAX_ASKED:
                        self.asked.clear()
                    self.asked.add(at)
            else:
                live, out = self._next(live, byte)
                known = number(live)
                if known is not None:
                    state, live = known, None
            if out:
                found.append(out)
        found.append(self.ends[state] if live is None else self._ids(live[-1][1]))
        return found

    def tokens_of(self, word: bytes) -> Iterator[bytes]:
        """The same as tokens."""
        names = {v: k for k, v in self.codes.items()}
        for piece in self.pieces(word):
            yield from (names[piece[i : i + 4]] for i in range(0, len(piece), 4))


class Words(dict):
    """Ids by word, of words that are not too long; emptied when there are ``limit`` of them."""

    def __init__(self, machine: Transducer, limit: int = MAX_WORDS):
        super().__init__()
        self.machine, self.limit = machine, limit

    def __missing__(self, word: str) -> bytes:
        found = self.machine.packed(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found


class Utf8Stream:
    """Bytes to text, piece by piece. The state is what is left of a character:
    none to three bytes."""

    #: Bytes that a character takes, by its first byte from C2, E0 and F0 on.
    NEEDS = ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4))

    def __init__(self):
        self.rest = b""

    def feed(self, piece: bytes) -> str:
        data = self.rest + piece
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if 0x80 <= byte <= 0xBF:
                continue
            if any(lo <= byte <= hi and back < n for lo, hi, n in self.NEEDS):
                cut -= back
            break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        text, self.rest = self.rest.decode("utf-8", "replace"), b""
        return text


def _text(raw: bytes, piece: int = 4096) -> str:
    stream = Utf8Stream()
    found = [stream.feed(raw[i : i + piece]) for i in range(0, len(raw), piece)]
    return "".join([*found, stream.end()])


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    max_words: int = MAX_WORDS,
    max_states: int | None = None,
) -> DataFrame:
    """Add ``ids`` (array of int) to the columns; a column of that name is replaced.
    ``ranks`` has the size of a vocabulary file and goes to the workers once. ``max_words`` and
    ``max_states`` bound what a worker remembers: less memory, more time, same ids."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Transducer(shared.value, max_states), max_words)
        find, of = regex.compile(pattern).findall, words.__getitem__
        gc.disable()  # the tables are many objects without a cycle
        try:
            for part in (x for p in parts for x in slices(p, text)):
                ids = [b"".join(map(of, find(t))) if t else b"" for t in part.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield _with(part, "ids", column)
        finally:
            gc.enable()

    return docs.mapInArrow(run, extended(docs, "ids array<int>"))


def decode(docs: DataFrame, ranks: dict[bytes, int], as_text: bool = False, digests: bool = False) -> DataFrame:
    """Add ``decoded``: the bytes of ``ids``, or with ``as_text`` the text. Null
    ids give none. With ``digests`` also ``n_tokens`` and ``ids_sha256`` in place of ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Token i of the column has id i; taking tokens puts their bytes in a row.
        words, most = shared.value, max(shared.value.values(), default=-1) + 1
        known = [None] * most
        for token, i in words.items():
            known[i] = token
        known = pa.array(known, pa.large_binary())
        for part in (x for p in parts for x in _token_slices(p)):
            column = part.column("ids")
            taken = known.take(column.flatten().cast(pa.int64()))
            if taken.null_count:
                raise ValueError("an id is not in the vocabulary")
            places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
            data = taken.buffers()[2] or pa.py_buffer(b"")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            ends = places[np.cumsum(np.append(0, sizes))]
            flat = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends), data])
            if as_text:
                flat = pa.array(map(_text, flat.to_pylist()), pa.string())
            part = _with(part, "decoded", flat.cast(pa.string() if as_text else pa.binary()))
            yield _digested(part) if digests else part

    kind = "string" if as_text else "binary"
    if digests:
        return docs.mapInArrow(run, extended(docs.drop("ids"), f"decoded {kind}, {_DIGESTS}"))
    return docs.mapInArrow(run, extended(docs, f"decoded {kind}"))


def _token_slices(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``limit`` tokens."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes.astype(np.int64) + 16) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def id_bytes(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()


_DIGESTS = "n_tokens bigint, ids_sha256 string"


def _digested(part: pa.RecordBatch) -> pa.RecordBatch:
    found = part.column("ids")
    # A slice keeps the values of its whole batch; its offsets point into them.
    ends, flat = found.offsets.to_numpy(), found.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends, ends[1:])]
    part = _with(part, "n_tokens", pa.array([len(r) for r in rows], pa.int64()))
    part = _with(part, "ids_sha256", pa.array([id_bytes(r) for r in rows], pa.string()))
    return part.select([n for n in part.schema.names if n != "ids"])


def with_id_digest(encoded: DataFrame) -> DataFrame:
    """``n_tokens`` and ``ids_sha256`` in place of ``ids``: SHA-256 of the ids as
    little-endian unsigned 32-bit integers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_digested, parts)

    return encoded.mapInArrow(run, extended(encoded.drop("ids"), _DIGESTS))


def _with(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in part.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], [*names, name])
