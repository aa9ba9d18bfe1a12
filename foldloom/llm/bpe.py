"""Byte-level BPE: splitting text into pieces, batched merges, decoding.

A vocabulary file is JSON as the ``tokenizers`` library writes it (byte-level BPE without normaliser).
Its path is a parameter; nothing is copied.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from foldloom.llm.common import CHUNK_BYTES, text_buffer

OTHER, LETTER, NUMBER, SPACE, UNKNOWN, UNMET = 0, 1, 2, 3, 4, 5
#: The white space of the splitting pattern.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pieces kept by a worker in the newer half of its cache; beyond it that becomes the older half, and what isn't met
#: again goes.
CACHE_PIECES = 200_000
#: New pieces that the library encodes as one text.
JOINED = 200
#: Pieces of more bytes are merged by rank over all of them, not round by round.
LONG = 64


@functools.cache
def char_classes() -> np.ndarray:
    """Classes of code points, of those met so far: the rest are ``UNMET``, as each worker would take over a second for
    all of them."""
    table = np.full(0x110000, UNMET, np.uint8)
    table[list(WHITE)] = SPACE
    return table


def class_of(points: np.ndarray) -> np.ndarray:
    """Classes of code points. What Python's character data doesn't know yet is asked of the library, once."""
    table = char_classes()
    kind = table[points]
    if kind.max(initial=0) == UNMET:
        for c in np.unique(points[kind == UNMET]).tolist():
            category = unicodedata.category(chr(c))
            table[c] = {"L": LETTER, "N": NUMBER}.get(category[0], UNKNOWN if category == "Cn" else OTHER)
        kind = table[points]
    if kind.max(initial=0) == UNKNOWN:
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in np.unique(points[kind == UNKNOWN]).tolist():
            table[c] = next((k for k, near in ((LETTER, "a"), (NUMBER, "1")) if len(split(near + chr(c))) == 1), OTHER)
        kind = table[points]
    return kind


def piece_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pieces start in code points; splitting begins anew at each of ``breaks`` (0 is one)."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = class_of(points)
    broken = np.zeros(n + 1, bool)
    broken[breaks] = True
    broken[0] = broken[n] = True
    start = broken[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    # White space before other text gives its last character away: a blank to the next piece, others alone.
    inner = (kind[begin] == SPACE) & ~broken[end]
    last = end[inner] - 1
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # A lone apostrophe that begins a piece takes one of a few endings with it.
    at = begin[(points[begin] == 39) & (end - begin == 1) & ~broken[end]]
    at = at[start[at]]
    if len(at):
        one = points[at + 1]
        two = np.where(broken[np.minimum(at + 2, n)], 0, points[np.minimum(at + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(long, 2, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + 1 + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


def special_places(raw: np.ndarray, offsets: np.ndarray, special: bytes) -> list[int]:
    """Where ``special`` occurs inside the rows, from the left and without overlaps."""
    data, found = raw.tobytes(), []
    if not special or special not in data:
        return found
    at = data.find(special)
    while at >= 0:
        inside = at + len(special) <= int(offsets[np.searchsorted(offsets, at, "right")])
        found += [at] if inside else []
        at = data.find(special, at + (len(special) if inside else 1))
    return found


def split_pieces(raw: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> np.ndarray:
    """Byte places where the pieces of UTF-8 rows start. An occurrence of ``special`` is one piece."""
    places = special_places(raw, offsets, special)
    cuts = np.array([c for at in places for c in (at, at + len(special))], np.int64)
    breaks = np.union1d(offsets, cuts)
    if raw.max(initial=0) < 128:
        starts = piece_starts(raw, breaks[breaks < len(raw)])
    else:
        first = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        starts = first[piece_starts(points, np.searchsorted(first, breaks[breaks < len(raw)]))]
    if places:
        skip = np.zeros(len(raw) + 1, bool)
        for at in places:
            skip[at + 1 : at + len(special)] = True
        starts = starts[~skip[starts]]
    return starts


def windows(raw: np.ndarray, offsets: np.ndarray, limit: int, special: bytes = b"") -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes that together are all of ``raw``. They end with a row or, inside a long one,
    before a blank between two ASCII letters (a piece always starts there)."""
    at, n = 0, len(raw)
    while at < n:
        end, size = n, limit
        while at + size < n:
            row = int(offsets[np.searchsorted(offsets, at + size, "right") - 1])
            if row > at:
                end = row
                break
            part = raw[at : at + size + 1] | 32
            blank = (raw[at + 1 : at + size] == 32) & (part[:-2] >= 97) & (part[:-2] <= 122) & (part[2:] >= 97) & (part[2:] <= 122)
            if len(blanks := np.flatnonzero(blank)) and not (special and b" " in special):
                end = at + 1 + int(blanks[-1])
                break
            size *= 2
        yield at, end
        at = end


class Vocabulary:
    """Merge ranks in sorted arrays, token bytes, and the special token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        tokens, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        # The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        shown = {b: c for c, b in self.stand_in.items()}
        self.byte_id = np.array([tokens[shown[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([tokens[a] for a, _ in pairs], np.int64)
        right = np.array([tokens[b] for _, b in pairs], np.int64)
        made = np.array([tokens[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        size = max([*tokens.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for word, i in tokens.items():
            self.token_bytes[i] = bytes(self.stand_in[c] for c in word)
        for word, i in self.special.items():
            self.token_bytes[i] = word.encode()

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the sorted pair keys, and its rank (``never`` if it doesn't merge)."""
        pair = (left << 32) | right
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return found, np.where(self.keys[found] == pair, self.ranks[found], len(self.keys))

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Long pieces have rounds of their own."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        for some, rounds in (([k for k, p in enumerate(pieces) if len(p) <= LONG], self.rounds), ([k for k, p in enumerate(pieces) if len(p) > LONG], self.long_rounds)):
            if some:
                for k, ids in zip(some, rounds([pieces[k] for k in some]), strict=True):
                    out[k] = ids
        return out

    def rounds(self, pieces: list[bytes]) -> list[np.ndarray]:
        """In each round every piece merges its lowest-ranked pair, all pieces at once in one flat array."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_symbols, done_owner = [], []
        never = len(self.keys)
        while len(symbols):
            rank = np.full(len(symbols), never)
            found, ranks = self.ranked(symbols[:-1], symbols[1:])
            rank[:-1] = np.where(owner[:-1] == owner[1:], ranks, never)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(owner)]))
            over = best == never
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            chosen = (rank == best) & ~over
            at = every_other(np.flatnonzero(chosen))
            symbols = symbols.copy()
            symbols[at] = self.made[found[at]]
            keep = ~over
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate([np.zeros(0, np.int64), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        symbols = symbols[order].astype("<u4")
        bounds = np.searchsorted(owner[order], np.arange(len(pieces) + 1))
        return [symbols[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def long_rounds(self, pieces: list[bytes]) -> list[np.ndarray]:
        """A round merges the lowest rank that is left, wherever it is, and then only looks at the pairs that this
        made: so a piece of n bytes costs about n log n, not n for every one of its ranks."""
        ends = np.cumsum([len(p) for p in pieces])
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n, never = len(symbols), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[np.r_[0, ends[:-1]]] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        ranks_left: list[int] = []

        def look(at: np.ndarray) -> None:
            """Let the pairs that start at these places wait for their rank's turn."""
            at = at[after[at] < n]
            _, rank = self.ranked(symbols[at], symbols[after[at]])
            at, rank = at[rank < never], rank[rank < never]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(at) else at
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=False):
                if int(rank[a]) not in waiting:
                    heapq.heappush(ranks_left, int(rank[a]))
                waiting.setdefault(int(rank[a]), []).append(at[a:b])

        look(np.arange(n))
        while ranks_left:
            turn = heapq.heappop(ranks_left)
            at = np.unique(np.concatenate(waiting.pop(turn)))
            # What has merged meanwhile is no pair of this rank any more.
            at = at[(symbols[at] >= 0) & (after[at] < n)]
            found, rank = self.ranked(symbols[at], symbols[after[at]])
            at, found = at[rank == turn], found[rank == turn]
            if not len(at):
                continue
            at = at[alternating(np.r_[False, after[at[:-1]] == at[1:]])]
            symbols[at] = self.made[found[0]]
            gone = after[at]
            symbols[gone] = -1
            after[at] = after[gone]
            behind = after[at][after[at] < n]
            before[behind] = at[after[at] < n]
            look(np.unique(np.r_[before[at][before[at] >= 0], at]))
        alive = np.flatnonzero(symbols >= 0)
        kept = symbols[alive].astype("<u4")
        bounds = np.searchsorted(alive, np.r_[0, ends])
        return [kept[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]

    @functools.cached_property
    def table(self) -> pa.LargeBinaryArray:
        return pa.array(self.token_bytes, pa.large_binary())

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the rows of a flat id array, what isn't UTF-8 replaced."""
        taken = self.table.take(pa.array(ids.astype(np.int64)))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(taken) + 1][bounds] if len(taken) else np.zeros(len(bounds), np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        rows = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(raw))
        try:
            rows.validate(full=True)
        except pa.ArrowInvalid:
            cells = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            rows = pa.array(cells, pa.large_string())
        return rows


def alternating(follows: np.ndarray) -> np.ndarray:
    """Of overlapping equal pairs the first, third, ... merge: which stay, where ``follows`` says that one overlaps the
    one before."""
    k = np.arange(len(follows))
    return (k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0


def every_other(at: np.ndarray) -> np.ndarray:
    return at[alternating(np.r_[False, at[1:] == at[:-1] + 1][: len(at)])]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of whole texts through a cache of pieces. ``library``: new pieces go to the ``tokenizers`` library,
    else to the merge rounds. Pieces are encoded apart from each other, so their ids don't depend on the text around."""

    def __init__(self, path: str, library: bool = False):
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.path = path
        if library:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            added = self.library.get_added_tokens_decoder()
            self.special = next((t.content for t in added.values()), "").encode()
            # A plain added token parts what is around it.
            self.parting = next((i for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None) if len(added) == 1 else None
        else:
            self.library = None
            self.special = next(iter(vocabulary(path).special), "").encode()

    def _learn(self, new: list[bytes]) -> None:
        if self.library is not None:
            if self.parting is not None:
                own = [p for p in new if p == self.special]
                self.known.update((p, np.array([self.parting], "<u4").tobytes()) for p in own)
                new = [p for p in new if p != self.special] if own else new
                for k in range(0, len(new), JOINED):
                    self._learn_joined(new[k : k + JOINED])
                return
            made = self.library.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
            self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, made, strict=True))
            return
        vocab = vocabulary(self.path)
        own = {word.encode(): np.array([i], "<u4").tobytes() for word, i in vocab.special.items()}
        self.known.update((p, own[p]) for p in new if p in own)
        new = [p for p in new if p not in own]
        self.known.update((p, x.tobytes()) for p, x in zip(new, vocab.merge(new), strict=True))

    def _learn_joined(self, new: list[bytes]) -> None:
        """Pieces as one text, the special token between them: the library splits there first, so each is encoded as if
        alone, and one encoding is made and not one a piece."""
        [made] = self.library.encode_batch_fast([self.special.join(new).decode()], add_special_tokens=False)
        ids = np.array(made.ids, "<u4")
        at = np.flatnonzero(ids == self.parting)
        starts, stops, data = 4 * np.r_[0, at + 1], 4 * np.r_[at, len(ids)], ids.tobytes()
        self.known.update((p, data[a:b]) for p, a, b in zip(new, starts.tolist(), stops.tolist(), strict=True))

    def _window(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one stretch, and how many of them come before each of ``breaks``."""
        starts = split_pieces(raw, np.r_[breaks, len(raw)], self.special)
        cut = np.r_[starts, len(raw)].astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {}
        cells = list(map(self.known.get, distinct))
        if new := [p for p, cell in zip(distinct, cells, strict=True) if cell is None]:
            self.known.update((p, self.older[p]) for p in new if p in self.older)
            self._learn([p for p in new if p not in self.older])
            cells = list(map(self.known.__getitem__, distinct))
        size = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
        flat, first = np.frombuffer(b"".join(cells), "<u4"), np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.r_[0, ends][np.searchsorted(starts, breaks)]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the n+1 bounds of the rows in it; a null row has none."""
        raw, offsets = text_buffer(column)
        parts, bounds, total = [np.zeros(0, "<u4")], np.zeros(len(offsets), np.int64), 0
        for a, b in windows(raw, offsets, CHUNK_BYTES, self.special):
            rows = slice(*np.searchsorted(offsets, [a, b]))
            ids, at = self._window(raw[a:b], offsets[rows] - a)
            bounds[rows] = total + at
            total += len(ids)
            parts.append(ids)
        bounds[offsets == len(raw)] = total
        return np.concatenate(parts), bounds


@functools.lru_cache(2)
def encoder(path: str, library: bool) -> Encoder:
    """One per worker process."""
    return Encoder(path, library)
