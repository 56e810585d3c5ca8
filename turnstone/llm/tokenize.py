"""Whole-corpus encoding with a public byte-level BPE vocabulary (problem 6).

Pre-tokenisation runs without a regular expression. A batch of texts becomes
one array of code points, a table maps each to a symbol (letter, number, white
space, apostrophe and so on), and an automaton reads the symbols: a state for
each kind of run and for what may become a contraction, with marks at which
position a piece begins. Every symbol is a function from states to states, and
composition of functions is associative, so the automaton runs as a scan: blocks
of the array compose their functions side by side, a scan over the blocks gives
the state at which each begins, and a second pass over all blocks side by side
gives the state before every code point.

The slices between boundaries are looked up by two 64-bit hashes in a per-worker
table of encoded pieces; only pieces not met before are merged.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabularies, a parameter of every operator here.
TOKENIZERS = os.environ.get("TURNSTONE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

_LIMIT = 0x110000
#: Pieces beyond this many code points skip the hash table and are looked up as strings.
_HASHED = 48
#: Code points handled in one pass, which bounds the arrays of a worker.
_PASS = 1 << 20
#: Slots of the piece table; it is emptied when three quarters are used.
_SLOTS = 1 << 19


#: Symbols. The letters of contractions are symbols of their own: s t m d end one at once, r v l may begin one of two letters.
SYMBOLS = ("letter", "s", "r", "v", "l", "e", "number", "blank", "space", "quote", "other", "end")
LETTER, S, R, V, L, E, NUMBER, BLANK, SPACE, QUOTE, OTHER, END = range(12)
#: States: what the code points read last are part of. ``quoted``: an apostrophe that begins a piece.
STATES = ("start", "letters", "numbers", "others", "blank", "space", "quoted", "quoted r", "quoted v", "quoted l", "contraction")
#: Marks: a piece begins here, a piece begins one code point before.
HERE, BEFORE = 1, 2
#: Code points that a block of the scan reads one after the other.
_BLOCK = 256


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Symbol of every code point: Unicode L*, N*, White_Space, apostrophe and the rest."""
    t = np.full(_LIMIT + 1, OTHER, np.uint8)
    for cp in range(_LIMIT):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            t[cp] = LETTER
        elif major == "N":
            t[cp] = NUMBER
    # The code points with the Unicode property White_Space.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    t[spaces] = SPACE
    # Fixed values: 's 't 'm 'd and 're 've 'll of the vocabulary's split pattern.
    for letters, symbol in (("stmd", S), ("r", R), ("v", V), ("l", L), ("e", E)):
        t[[ord(c) for c in letters]] = symbol
    t[0x20], t[0x27], t[_LIMIT] = BLANK, QUOTE, END
    return t


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and symbol, from the rules of the split pattern."""
    state = {name: i for i, name in enumerate(STATES)}
    follow, marks = np.zeros((len(STATES), len(SYMBOLS)), np.uint8), np.zeros((len(STATES), len(SYMBOLS)), np.uint8)
    second = {"quoted r": E, "quoted v": E, "quoted l": L}  # what completes a contraction of two letters
    runs = {"letters": {LETTER, S, R, V, L, E}, "numbers": {NUMBER}, "others": {QUOTE, OTHER}}
    for name, i in state.items():
        for symbol in range(len(SYMBOLS)):
            kind = "space" if symbol in (BLANK, SPACE) else next((k for k, own in runs.items() if symbol in own), "end")
            late = BEFORE if name in second else 0  # no contraction after all: its letter began a piece of its own
            if name in second and symbol == second[name]:
                to, mark = "contraction", 0
            elif symbol == END:
                to, mark = "start", HERE | late
            elif kind == "space":  # white space continues white space, the last of it is set apart below
                to, mark = STATES[state["blank"] if symbol == BLANK else state["space"]], 0 if name in ("blank", "space") else HERE | late
            elif name in ("blank", "space"):  # a blank leads the run, other white space stands alone
                to, mark = kind, BEFORE | (0 if name == "blank" else HERE)
                if name == "space" and symbol == QUOTE:
                    to = "quoted"
            elif name == "quoted" and symbol in (S, R, V, L):
                to, mark = {S: "contraction", R: "quoted r", V: "quoted v", L: "quoted l"}[symbol], 0
            elif kind == {"quoted": "others"}.get(name, "letters" if name in second else name):
                to, mark = kind, late
            else:
                to, mark = "quoted" if symbol == QUOTE else kind, HERE | late
            follow[i, symbol], marks[i, symbol] = state[to], mark
    return follow, marks


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, by composing transition functions."""
    follow, _ = transitions()
    n, q = len(symbols), len(STATES)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    flat = follow.ravel()
    wide = (np.arange(q, dtype=np.uint16) * len(SYMBOLS)).astype(np.uint16)
    # Each block's function: where it leads from every state.
    whole = np.repeat(np.arange(q, dtype=np.uint8)[:, None], blocks, 1)
    for row in grid:
        whole = flat[wide[whole] + row]
    # Composition over the blocks before, in doubling steps.
    step = 1
    while step < blocks:
        joined = whole.copy()
        joined[:, step:] = np.take_along_axis(whole[:, step:], whole[:, :-step].astype(np.intp), 0)
        whole, step = joined, 2 * step
    state = np.concatenate([[0], whole[0, :-1]]).astype(np.uint8)
    before = np.empty((_BLOCK, blocks), np.uint8)
    for j, row in enumerate(grid):
        before[j] = state
        state = flat[wide[state] + row]
    return before.T.ravel()[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Start flags of the pieces in code points where texts are divided by the value 0x110000.

    The divider itself is flagged too; every text is cut on its own.
    """
    if not len(points):
        return np.empty(0, bool)
    # A divider after the last text too, so that what waits for one more symbol sees its end.
    symbols = class_table()[np.append(points, np.uint32(_LIMIT))]
    marks = transitions()[1][scan(symbols), symbols]
    start = (marks & HERE) > 0
    start[:-1] |= (marks[1:] & BEFORE) > 0
    return start[:-1]


class Vocabulary:
    """Ranks of a byte-level BPE and the merge loop over them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is joined until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= 256 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        """Keeps the rank of every adjacent pair in a list; a join renews two of them."""
        ranks, none = self.ranks, 1 << 30
        part = [piece[i : i + 1] for i in range(len(piece))]
        pair = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            part[i] += part.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(part[i] + part[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(part[i - 1] + part[i], none)
        return [ranks[x] for x in part]

    def _merge_long(self, piece: bytes) -> list[int]:
        """A heap of candidate pairs over a linked list: n log n for a piece of n bytes, so texts without any boundary stay affordable."""
        ranks, n = self.ranks, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, width = heapq.heappop(heap)
            left = part[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or part[j] is None or len(left) + len(part[j]) != width or ranks.get(left + part[j]) != rank:
                continue
            part[i], part[j] = left + part[j], None
            k = after[i] = after[j]
            if k < n:
                prior[k] = i
                pair = part[i] + part[k]
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (r, i, len(pair)))
            h = prior[i]
            if h >= 0:
                pair = part[h] + part[i]
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (r, h, len(pair)))
        return [ranks[x] for x in part if x is not None]


class Encoder:
    """Encodes batches of texts; keeps the pieces met so far in a table."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._powers(_PASS + 2)
        self._clear()

    def _powers(self, n: int) -> None:
        """An odd multiplier's powers and their inverses: hashes of all slices come from one running sum."""
        self.powers, self.inverse = [], []
        for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            for out, factor in ((self.powers, base), (self.inverse, pow(base, -1, 1 << 64))):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))

    def _clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.checks = np.zeros(_SLOTS, np.uint64)
        self.offset = np.zeros(_SLOTS, np.int64)
        self.length = np.zeros(_SLOTS, np.int32)
        self.used = 0
        self.pool = np.zeros(1 << 20, np.int32)
        self.filled = 0
        self.long: dict[str, tuple[int, int]] = {}

    def _store(self, ids: list[int]) -> tuple[int, int]:
        at, n = self.filled, len(ids)
        while at + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at : at + n] = ids
        self.filled += n
        return at, n

    def _pieces(self, text: str, points: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids in the pool for each slice."""
        if len(points) > len(self.powers[0]):  # one text without any place to cut
            self._powers(2 * len(points))
        values, sums = points.astype(np.uint64) + np.uint64(1), []
        for powers, inverse in zip(self.powers, self.inverse):
            running = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(values * powers[: len(points)], out=running[1:])
            sums.append((running[e] - running[s]) * inverse[s])
        width = e - s
        h, check = sums
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= width.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)  # zero marks an empty slot
        mask = np.uint64(_SLOTS - 1)
        slot = ((h >> np.uint64(20)) & mask).astype(np.int64)
        at, n = np.empty(len(s), np.int64), np.empty(len(s), np.int32)
        todo = np.flatnonzero(width <= _HASHED)
        for _ in range(4):  # short probes; what stays is inserted below
            own = (self.keys[slot[todo]] == h[todo]) & (self.checks[slot[todo]] == check[todo])
            done = todo[own]
            at[done], n[done] = self.offset[slot[done]], self.length[slot[done]]
            todo = todo[~own]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (_SLOTS - 1)
        if len(todo):
            order = np.lexsort((check[todo], h[todo]))
            todo = todo[order]
            new = np.concatenate([[True], (h[todo][1:] != h[todo][:-1]) | (check[todo][1:] != check[todo][:-1])])
            first, back = np.flatnonzero(new), np.cumsum(new) - 1
            where = np.empty(len(first), np.int64)
            count = np.empty(len(first), np.int32)
            for k, i in enumerate(todo[first].tolist()):
                where[k], count[k] = self._insert(int(h[i]), int(check[i]), text[s[i] : e[i]])
            at[todo], n[todo] = where[back], count[back]
        for i in np.flatnonzero(width > _HASHED).tolist():
            piece = text[s[i] : e[i]]
            found = self.long.get(piece)
            if found is None:
                found = self._store(self.vocabulary.merge(piece.encode("utf-8", "replace")))
                if len(piece) < 512 and len(self.long) < 50_000:
                    self.long[piece] = found
            at[i], n[i] = found
        return at, n

    def _insert(self, key: int, check: int, piece: str) -> tuple[int, int]:
        slot = (key >> 20) & (_SLOTS - 1)
        for probe in range(64):
            k = (slot + probe) & (_SLOTS - 1)
            held = int(self.keys[k])
            if held == key and int(self.checks[k]) == check:
                return int(self.offset[k]), int(self.length[k])
            if not held:
                at, n = self._store(self.vocabulary.merge(piece.encode("utf-8", "replace")))
                if probe < 4:
                    self.keys[k], self.checks[k], self.offset[k], self.length[k] = key, check, at, n
                    self.used += 1
                return at, n
        return self._store(self.vocabulary.merge(piece.encode("utf-8", "replace")))

    def encode(self, texts: list[str | None], ids: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Yields, pass by pass: (text number, number of ids, ids, code point offset of each id's piece).

        A text longer than a pass is cut at a boundary that no rule looks
        across and continues in the next pass under the same number.
        """
        group: list[str] = []
        numbers: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            t = t or ""
            parts = [t] if len(t) < _PASS // 2 else list(_cut(t, _PASS // 2))
            for part in parts:
                if group and size + len(part) + 1 > _PASS:
                    yield self._pass(group, numbers, ids)
                    group, numbers, size = [], [], 0
                group.append(part)
                numbers.append(i)
                size += len(part) + 1
        if group:
            yield self._pass(group, numbers, ids)

    def _pass(self, group: list[str], numbers: list[int], ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self.used > _SLOTS * 3 // 4 or self.filled > 1 << 23:
            self._clear()
        size = np.fromiter(map(len, group), np.int64, len(group))
        text = "\0".join(group)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        divider = np.cumsum(size + 1)[:-1] - 1
        points[divider] = _LIMIT
        start = np.flatnonzero(boundaries(points))
        end = np.append(start[1:], len(points))
        real = points[start] != _LIMIT if len(start) else np.zeros(0, bool)
        start, end = start[real], end[real]
        at, n = self._pieces(text, points, start, end)
        owner = np.searchsorted(np.append(divider, len(points)), start, side="right")
        total = np.bincount(owner, weights=n, minlength=len(group)).astype(np.int64)
        out = offset = np.zeros(0, np.int32)
        if ids:
            begin = np.cumsum(n, dtype=np.int64) - n
            out = self.pool[np.repeat(at - begin, n) + np.arange(int(n.sum()), dtype=np.int64)]
            first = np.concatenate([[0], divider + 1])
            offset = np.repeat(start - first[owner], n).astype(np.int32)
        return np.asarray(numbers, np.int64), total, out, offset


def _cut(text: str, limit: int) -> Iterator[str]:
    """Parts of about ``limit`` code points whose pieces are those of the whole text.

    Cuts fall only between a letter or number and a following blank that leads
    another letter or number: there a piece ends whatever surrounds it. Where a
    stretch has no such place, the search goes on until one is found.
    """
    table = class_table()
    at = 0
    while len(text) - at > limit:
        k = text.find(" ", at + limit)
        while k != -1 and k + 1 < len(text) and not (table[ord(text[k - 1])] <= NUMBER and table[ord(text[k + 1])] <= NUMBER):
            k = text.find(" ", k + 1)
        if k == -1 or k + 1 >= len(text):
            break
        yield text[at:k]
        at = k
    yield text[at:]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


def decode(ids: list[int], path: str) -> str:
    """The text of ids; inverse of the encoding for valid Unicode."""
    inverse = _inverse(path)
    return b"".join(inverse[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _inverse(path: str) -> dict[int, bytes]:
    return {v: k for k, v in Vocabulary(path).ranks.items()}


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False
) -> DataFrame:
    """One row per input row: the id, ``ids`` and, if asked, ``offsets`` (code point start of each id's piece).

    Null and empty texts give an empty list. Ids may be null or repeated; every
    row is encoded on its own. Other columns are left out, so their names
    cannot clash. No shuffle: the plan is one scan of two columns.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            lists, where = [np.zeros(len(texts), np.int64)], 0
            counts, ids, offs = lists[0], [], []
            for numbers, total, out, off in enc.encode(texts):
                np.add.at(counts, numbers, total)
                ids.append(out)
                offs.append(off)
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [keys, pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32)))]
            names = [id_col, "ids"]
            if offsets:
                columns.append(pa.ListArray.from_arrays(bounds, pa.array((np.concatenate(offs) if offs else np.zeros(0)).astype(np.int32))))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens) per row, 0 for null and empty texts; the ids themselves never leave the worker."""
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for numbers, total, _, _ in enc.encode(batch.column(1).to_pylist(), ids=False):
                np.add.at(counts, numbers, total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
