"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is a path over pieces. Unigram models weigh a path by the sum of its piece
scores. BPE models are put as paths too: a sequence of pieces is the encoding of its text if
and only if every piece encodes to itself and every two neighbours encode to themselves as a
pair, so the weight is 0 for such neighbours and minus infinity otherwise, and one path is left.
Whether two pieces may stand beside each other is told by undoing their merges, latest first:
they may not if on the way a merge across the border would have come before the one undone.

Where no piece of the vocabulary can cross a place (before a space mark that follows another
character) every path passes it. The units between such places have lattices of their own;
the lattices of all units of a batch that were not met before are solved together, place by place, in arrays.

Texts longer than ``CHUNK`` characters are cut into chunks at fixed places. The state at a cut
is the piece that covers or ends at it. A chunk computes the transfer matrix of best weights
from each state at its left cut to each state at its right cut; matrices are combined
associatively, ``FAN`` neighbours a task and level, so no task sees all chunks of a giant text. Going down
the same tree gives the states at all cuts, and then each chunk traces its own path back.
Between its first and last free place a chunk's path does not depend on states. Texts are moved once,
to the task that traces their chunk; matrices, states and tokens are moved beside them. The tokens of one text
meet in one task, in order and as a stream, since its row and its digest need them so.

Identity normalisers with byte fallback are supported. Null and empty texts have no tokens.
Repeated rows give one row each. Empty tables give no rows. Extra columns are ignored. A
literal U+2581 is decoded as a space, as in the library; such texts are not lossless.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import materialize, partitions_for, row_key, sliced, small_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 8192
#: Chunks, or products of chunks, that one task combines.
FAN = 64
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Units kept with their tokens by a Python worker, and characters of the longest one kept.
KEPT_UNITS, KEPT_LENGTH = 300_000, 64
#: Characters whose lattices are solved at once.
SLAB = 1 << 18
#: Never formed by a merge; never merged.
SINGLE, NO_MERGE = -1, np.int64(1 << 40)
#: Model types and piece types of the public model format.
UNIGRAM, BPE = 1, 2
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
NEVER = float("-inf")
START = ("", 0)


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Numbers:
    """A map from non-negative 64-bit keys to values, looked up for arrays: open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, place = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]  # of those that meet in a place one stays
            stays = left[self.keys[place[left]] == keys[left]]
            self.values[place[stays]] = values[stays]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        place = self.place(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.values[place], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[place[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[place[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Vocabulary:
    """Pieces of a model file and their lattice."""

    def __init__(self, model: bytes):
        self.kind, fallback, self.dummy = UNIGRAM, False, True
        pieces = []
        for number, value in fields(model):
            if number == 1:
                got = dict(fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)))
            elif number == 2:
                got = dict(fields(value))
                self.kind, fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                got = dict(fields(value))
                self.dummy = bool(got.get(3, 1))
                if got.get(2) or got.get(4, 1) or not got.get(5, 1):
                    raise ValueError("only identity normalisers that keep all spaces are supported")
        if not fallback or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with byte fallback are supported")
        self.names = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)}
        self.scores = {p: s for p, s, t in pieces if t in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - 10
        #: no piece crosses the place before a space mark that follows another character
        self.free = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.alone = functools.lru_cache(50_000)(self.encodes_itself)
        self.fits = functools.lru_cache(50_000)(self.neighbours)
        self.tables()
        texts = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        self.text_sizes = np.array([len(t) for t in texts])
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.kept: dict[str, bytes] = {}

    def tables(self) -> None:
        """Arrays of the lattice: a trie of the pieces, their merges, and the merge that forms each one."""
        names = sorted(self.ids, key=len)
        index = {p: i for i, p in enumerate(names)}
        self.piece_ids = np.array([self.ids[p] for p in names], np.int32)
        self.weights = np.array([self.weight(p) for p in names])
        self.rank = np.unique(np.array([-self.scores[p] for p in names]), return_inverse=True)[1].astype(np.int64)
        sizes = np.array([len(p) for p in names])
        self.rank[sizes == 1] = SINGLE
        ways = [(index[p[:i]] * len(names) + index[p[i:]], j) for j, p in enumerate(names) for i in range(1, len(p)) if p[:i] in index and p[i:] in index]
        pairs, made = np.array([w for w, _ in ways], np.int64), np.array([j for _, j in ways], np.int64)
        self.merges = dict(ways)
        self.over = Numbers(pairs, self.rank[made])
        self.left_part, self.right_part = np.full(len(names), -1), np.full(len(names), -1)
        #: every piece is formed by merges that get no better on the way, from characters that are pieces
        self.regular = self.kind == UNIGRAM or all(c in index for p in names for c in p)
        if self.kind == BPE and self.regular:
            left, right = pairs // len(names), pairs % len(names)
            for size in range(2, self.longest + 1):
                at = np.flatnonzero(sizes[made] == size)
                at = at[(self.formed(left[at])) & (self.formed(right[at]))]
                at = at[self.neighbours_all(left[at], right[at], apart=True)]
                self.left_part[made[at]], self.right_part[made[at]] = left[at], right[at]
            several = self.left_part >= 0
            worst = np.maximum(self.rank[self.left_part[several]], self.rank[self.right_part[several]])
            self.regular = bool((self.rank[several] >= worst).all())
        self.piece_at = index
        valid = self.formed(np.arange(len(names))) if self.regular else np.array([self.alone(p) for p in names])
        self.letters = np.array(sorted({ord(c) for p in names for c in p}), np.int64)
        self.letter_of = np.zeros(int(self.letters[-1]) + 2, np.int64)
        self.letter_of[self.letters] = np.arange(1, len(self.letters) + 1)
        place = {chr(c): i + 1 for i, c in enumerate(self.letters.tolist())}
        trie: dict[int, int] = {}
        ends = {}
        for j, p in enumerate(names):
            node = 0
            for c in p:
                node = trie.setdefault(node * (len(place) + 1) + place[c], len(trie) + 1)
            if valid[j]:
                ends[node] = j
        self.trie = Numbers(np.array(list(trie), np.int64), np.array(list(trie.values()), np.int64))
        self.trie_piece = np.full(len(trie) + 1, -1)
        self.trie_piece[list(ends)] = list(ends.values())

    def formed(self, pieces: np.ndarray) -> np.ndarray:
        """Whether merges form the pieces."""
        return (self.rank[pieces] == SINGLE) | (self.left_part[pieces] >= 0) | (self.kind == UNIGRAM)

    def neighbours_all(self, left: np.ndarray, right: np.ndarray, apart: bool = False) -> np.ndarray:
        """:meth:`neighbours` of many pairs of piece numbers; ``apart``: but for the merge of the two themselves."""
        out = np.ones(len(left), bool)
        if self.kind == UNIGRAM:
            return out
        on, before = np.arange(len(left)), np.full(len(left), NO_MERGE)
        while len(on):
            over = self.over.get(left * len(self.rank) + right)
            stop = (over >= 0) & (over < before) & (not apart)
            out[on[stop]] = False
            apart = False
            a, b = self.rank[left], self.rank[right]
            go = ~stop & ((a != SINGLE) | (b != SINGLE))
            on, left, right, a, b = on[go], left[go], right[go], a[go], b[go]
            undo = a > b  # of equals the left one was formed first
            before = np.where(undo, a, b + 1)
            left, right = np.where(undo, self.right_part[left], left), np.where(undo, right, self.left_part[right])
        return out

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, where = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, where = score, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def encodes_itself(self, piece: str) -> bool:
        if len(piece) == 1 or self.kind == UNIGRAM:
            return True
        return bool(self.formed(np.array([self.piece_at[piece]]))[0]) if self.regular else self.merged(piece) == [piece]

    def neighbours(self, left: str, right: str) -> bool:
        if self.kind == UNIGRAM or not left:
            return True
        if not self.regular:
            return self.merged(left + right) == [left, right]
        if left not in self.piece_at or right not in self.piece_at:
            return True
        x, y, before = self.piece_at[left], self.piece_at[right], NO_MERGE
        while True:
            over = self.merges.get(x * len(self.rank) + y)
            if over is not None and self.rank[over] < before:
                return False
            a, b = self.rank[x], self.rank[y]
            if a == SINGLE and b == SINGLE:
                return True
            if a > b:
                before, x = a, self.right_part[x]
            else:
                before, y = b + 1, self.left_part[y]

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces at a place; a character that is no piece stands for itself."""
        found = [text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1) if text[at : at + n] in self.ids]
        if text[at] not in self.ids:
            found.append(text[at])
        return [p for p in found if self.alone(p)]

    def weight(self, piece: str) -> float:
        return 0.0 if self.kind == BPE else self.scores.get(piece, self.unknown)

    def to_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.bytes[b] for b in p.encode()]
        return out

    def marked(self, text: str) -> str:
        """The text as the lattice sees it."""
        return ((" " if self.dummy else "") + text).replace(" ", SPACE) if text else ""

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of tokens, space marks as spaces, with the leading mark; and the number of bytes up to each token's end."""
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b"", ends
        return self.texts[np.repeat(self.text_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes(), ends

    def solve(self, units: list[str]) -> list[bytes]:
        """Tokens of each unit, as 32-bit integers: the best path of every unit's lattice, place by place for all of them."""
        if not self.regular:
            return [np.array(self.to_ids(unlinked(max((v for (_, over), v in self.run(u, START, len(u)).items() if over == 0), key=lambda v: v[0])[1])), np.int32).tobytes() for u in units]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        letters = self.letter_of[np.minimum(points, len(self.letter_of) - 1)]
        # all pieces at all places
        start, node, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
        for size in range(1, self.longest + 1):
            inside = start + size <= end[start]
            start, node = start[inside], node[inside]
            node = self.trie.get(node * (len(self.letters) + 1) + letters[start + size - 1])
            there = node >= 0
            start, node = start[there], node[there]
            piece = self.trie_piece[node]
            hit = piece >= 0
            found.append((start[hit], np.full(int(hit.sum()), size), piece[hit]))
            if size == 1:  # a character that is no piece stands for itself
                lone = np.setdiff1d(np.arange(len(points)), start[hit], assume_unique=True)
                found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
        start, size, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        until = start + size - begin[start]
        order = np.lexsort((start, until))
        start, size, piece, until = start[order], size[order], piece[order], until[order]
        bounds = np.append(np.flatnonzero(np.diff(until, prepend=0)), len(until))
        best, last, step = np.full(len(points), NEVER), np.full(len(points), -1), np.zeros(len(points), np.int64)
        for low, high in itertools.pairwise(bounds.tolist()):
            s, n, p = start[low:high], size[low:high], piece[low:high]
            first = s == begin[s]
            before = np.where(first, 0.0, best[s - 1])
            can = before > NEVER
            if self.kind == BPE:
                left = last[s - 1]
                ask = np.flatnonzero(can & ~first & (left >= 0) & (p >= 0))
                can[ask] = self.neighbours_all(left[ask], p[ask])
                total = before[can]
            else:
                total = (before + np.where(p >= 0, self.weights[p], self.unknown))[can]
            s, n, p = s[can], n[can], p[can]
            stop = s + n - 1
            if self.kind == UNIGRAM:  # the best of each place, of equals the longest
                order = np.lexsort((s, -total, stop))
                order = order[np.diff(stop[order], prepend=-1) > 0]
                s, n, p, stop, total = s[order], n[order], p[order], stop[order], total[order]
            best[stop], last[stop], step[stop] = total, p, n
        ending, at, low = np.zeros(len(points), bool), ends - 1, ends - sizes
        while len(at):
            ending[at] = True
            at = at - step[at]
            go = at >= low
            at, low = at[go], low[go]
        where = np.flatnonzero(ending)
        pieces, unit = last[where], np.repeat(np.arange(len(units)), sizes)[where]
        ids, times = self.piece_ids[pieces], np.ones(len(pieces), np.int64)
        unknown = np.flatnonzero(pieces < 0)
        raw = [chr(points[where[i]]).encode() for i in unknown]
        times[unknown] = [len(r) for r in raw]
        if len(unknown):
            ids = np.repeat(ids, times)
            for i, r in zip((np.cumsum(times) - times)[unknown].tolist(), raw, strict=True):
                ids[i : i + len(r)] = [self.bytes[b] for b in r]
        data = ids.astype(np.int32).tobytes()
        stops = 4 * np.cumsum(np.bincount(unit, weights=times, minlength=len(units))).astype(np.int64)
        return [data[a:b] for a, b in itertools.pairwise([0, *stops.tolist()])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Tokens of texts as the lattice sees them, which begin and end at free places."""
        cut = [UNIT.findall(t) if self.free else [t] * bool(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.kept)
        if len(self.kept) + len(new) > KEPT_UNITS:
            self.kept.clear()
            new = every
        slab, size = [], 0
        for unit in new:
            slab.append(unit)
            size += len(unit)
            if size >= SLAB:
                self.kept.update(zip(slab, self.solve(slab), strict=True))
                slab, size = [], 0
        if slab:
            self.kept.update(zip(slab, self.solve(slab), strict=True))
        out = [b"".join(map(self.kept.__getitem__, units)) for units in cut]
        for unit in new:
            if len(unit) > KEPT_LENGTH:
                del self.kept[unit]
        return out

    def free_places(self, text: str, before: str) -> tuple[int, int] | None:
        """First and last place of ``text`` that no piece crosses; ``before``: what stands before it."""
        if not self.free:
            return None
        whole = before[-1:] + text
        shift = len(whole) - len(text)
        first = next((i for i in range(max(1, shift), len(whole)) if whole[i] == SPACE and whole[i - 1] != SPACE), None)
        if not before and text[:1] == SPACE:
            first = 0
        if first is None:
            return None
        last = next((i for i in range(len(whole) - 1, max(0, shift - 1), -1) if whole[i] == SPACE and whole[i - 1] != SPACE), first)
        return max(0, first - shift), max(0, last - shift)

    def states(self, before: str, after: str) -> list[tuple[str, int]]:
        """States at a cut: (piece, characters of it after the cut)."""
        out = []
        both = before + after
        cut = len(before)
        for start in range(max(0, cut - self.longest), cut):
            out += [(p, start + len(p) - cut) for p in self.starting(both, start) if start + len(p) >= cut]
        return out

    def run(self, text: str, state: tuple[str, int], stop: int) -> dict[tuple[str, int], tuple[float, list]]:
        """Best paths from a state before ``text``: to every state at place ``stop``, as (weight, linked pieces)."""
        piece, over = state
        at: dict[int, dict[str, tuple[float, tuple | None]]] = {over: {piece: (0.0, None)}}
        done: dict[tuple[str, int], tuple[float, tuple | None]] = {}
        for i in range(over, stop + 1):
            for left, (weight, path) in at.pop(i, {}).items():
                if i >= stop:
                    key = (left, 0)
                    if key not in done or weight > done[key][0]:
                        done[key] = (weight, path)
                    continue
                for p in self.starting(text, i):
                    if not self.fits(left, p):
                        continue
                    new = (weight + self.weight(p), (path, p))
                    end = i + len(p)
                    key = (p, end - stop)
                    held = done if end > stop else at.setdefault(end, {})
                    name = key if end > stop else p
                    if name not in held or new[0] > held[name][0]:
                        held[name] = new
        if over > stop:
            done[(piece, over - stop)] = (0.0, None)
        return done

    def weights_through(self, text: str, incoming: list[tuple[str, int]], stop: int) -> dict:
        """{state before ``text``: {state at place ``stop``: best weight}}, in one walk for all of them."""
        at: dict[int, dict[str, dict]] = {}
        done: dict = {s: {(s[0], s[1] - stop): 0.0} for s in incoming if s[1] > stop}
        for s in incoming:
            if s[1] <= stop:
                at.setdefault(s[1], {}).setdefault(s[0], {})[s] = 0.0
        for i in range(stop):
            for left, row in at.pop(i, {}).items():
                for p in self.starting(text, i):
                    if not self.fits(left, p):
                        continue
                    weight, end = self.weight(p), i + len(p)
                    if end > stop:
                        for s, w in row.items():
                            held = done.setdefault(s, {})
                            held[p, end - stop] = max(held.get((p, end - stop), NEVER), w + weight)
                    else:
                        held = at.setdefault(end, {}).setdefault(p, {})
                        for s, w in row.items():
                            held[s] = max(held.get(s, NEVER), w + weight)
        for left, row in at.get(stop, {}).items():
            for s, w in row.items():
                held = done.setdefault(s, {})
                held[left, 0] = max(held.get((left, 0), NEVER), w)
        return done


def unlinked(path) -> list[str]:
    out = []
    while path:
        path, piece = path
        out.append(piece)
    return out[::-1]


def compose(left: dict, right: dict) -> dict:
    """Max-plus product of transfer matrices {in: {out: weight}}."""
    out: dict = {}
    for a, row in left.items():
        best: dict = {}
        for m, w in row.items():
            for b, v in right.get(m, {}).items():
                if w + v > best.get(b, (NEVER, None))[0]:
                    best[b] = (w + v, m)
        if best:
            out[a] = {b: w for b, (w, _) in best.items()}
    return out


def through(left: dict, right: dict, a, b):
    """The state between two matrices on the best way from a to b."""
    return max((m for m in left[a] if b in right.get(m, {})), key=lambda m: left[a][m] + right[m][b])


def products(matrices: list[dict]) -> list[list[dict]]:
    """A tree of products of neighbours; the last level has the product of all."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([compose(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return levels


def cut_states(matrices: list[dict], ends: tuple | None = None) -> list:
    """(left, right) states of all matrices; ``ends``: those of their product, by default its best ones."""
    levels = products(matrices)
    if ends is None:
        (top,) = levels[-1]
        ends = max(((a, b) for a, row in top.items() for b in row), key=lambda e: top[e[0]][e[1]])
    ways = [ends]
    for level in reversed(levels[:-1]):
        down = []
        for i, (a, b) in enumerate(ways):
            if 2 * i + 1 < len(level):
                m = through(level[2 * i], level[2 * i + 1], a, b)
                down += [(a, m), (m, b)]
            else:
                down.append((a, b))
        ways = down
    return ways


class Chunk:
    """A chunk with what stands around it: head, free stretch and tail."""

    def __init__(self, vocab: Vocabulary, text: str, before: str, after: str):
        self.vocab, self.text, self.before, self.after = vocab, text, before, after
        self.places = vocab.free_places(text, before)

    def middle_text(self) -> str:
        """The stretch between free places."""
        if self.places is None:
            return ""
        first, last = self.places
        return self.text[first : last if self.after else len(self.text)]

    def incoming(self) -> list[tuple[str, int]]:
        return self.vocab.states(self.before, self.text + self.after) if self.before else [START]

    def tail(self) -> dict:
        """Best paths from the last free place to the states at the right cut."""
        last = self.places[1]
        return self.vocab.run(self.text[last:] + self.after, START, len(self.text) - last)

    def head(self, state) -> tuple[float, tuple | None] | None:
        """Best path from a state at the left cut to the first free place."""
        first = self.places[0]
        if state[1] > first:
            return None
        ends = [v for (_, over), v in self.vocab.run(self.text[:first], state, first).items() if over == 0]
        return max(ends, key=lambda v: v[0]) if ends else None

    def matrix(self) -> dict:
        """{state at the left cut: {state at the right cut: weight}}."""
        if self.places is None:
            found = self.vocab.weights_through(self.text + self.after, self.incoming(), len(self.text))
        else:
            row = {t: w for t, (w, _) in self.tail().items()} if self.after else {START: 0.0}
            heads = {s: self.head(s) if self.before else (0.0, None) for s in self.incoming()}
            found = {s: {t: h[0] + w for t, w in row.items()} for s, h in heads.items() if h}
        if not self.after and self.places is None:
            found = {s: {START: max(w for (_, over), w in row.items() if over == 0)} for s, row in found.items() if any(over == 0 for _, over in row)}
        return {s: row for s, row in found.items() if row}

    def trace(self, left, right) -> tuple[list[int], list[int]]:
        """Tokens that start in the chunk before and after its free stretch, given the states at its cuts."""
        vocab = self.vocab
        if self.places is None:
            ends = vocab.run(self.text + self.after, left, len(self.text))
            if not self.after:
                ends = {START: max((v for (_, over), v in ends.items() if over == 0), key=lambda v: v[0])}
            return vocab.to_ids(unlinked(ends[right][1])), []
        first = vocab.to_ids(unlinked(self.head(left)[1])) if self.before else []
        last = vocab.to_ids(unlinked(self.tail()[right][1])) if self.after else []
        return first, last


@functools.lru_cache(2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def chunks_of(vocab: Vocabulary, text: str, chunk: int):
    """(number, chunks of the text, text, what stands before, after) of each chunk."""
    n = -(-len(text) // chunk)
    for i in range(n):
        at, end = i * chunk, min(len(text), (i + 1) * chunk)
        yield i, n, text[at:end], text[max(0, at - vocab.longest) : at], text[end : end + vocab.longest]


KEYS = ["_k1", "_k2"]
PIECE_SCHEMA = "_k1 long, _k2 long, doc_id long, piece long, pieces long, text string, before string, after string"
MATRIX_SCHEMA = "_k1 long, _k2 long, piece long, matrix string"
CHOSEN_SCHEMA = "_k1 long, _k2 long, piece long, left_piece string, left_over int, right_piece string, right_over int"
TOKEN_SCHEMA = "_k1 long, _k2 long, doc_id long, piece long, pieces long, tokens binary"
RESULT_SCHEMA = "_k1 long, _k2 long, doc_id long, n_tokens long, token_sha256 string, decoded_sha256 string, tokens array<int>, decoded string"
#: Bytes of text that a Python worker turns into rows at once.
SLICE = 1 << 20


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    named = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, named, strict=True)], names=[n for n, _ in named])


def in_slices(rows, size):
    """Lists of rows with about SLICE in all by ``size``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= SLICE:
            yield held
            held, total = [], 0
    if held:
        yield held


def rows_of(batches, column: str):
    """Rows of Arrow batches as tuples, few at a time."""
    for batch in sliced(batches, column, SLICE):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def to_text(matrix: dict) -> str:
    return json.dumps([[*a, [[*b, w] for b, w in row.items()]] for a, row in matrix.items()])


def from_text(text: str) -> dict:
    return {(a, over): {(b, past): w for b, past, w in row} for a, over, row in json.loads(text)}


def shrunk(ids: bytes, vocab: Vocabulary) -> bytes:
    """Tokens in the narrowest integers that hold the vocabulary."""
    return ids if len(vocab.names) > 1 << 16 else np.frombuffer(ids, np.int32).astype(np.uint16).tobytes()


def widened(data: bytes, vocab: Vocabulary) -> np.ndarray:
    return np.frombuffer(data, np.int32) if len(vocab.names) > 1 << 16 else np.frombuffer(data, np.uint16).astype(np.int32)


def encode_short(texts: DataFrame, model: bytes, with_text: bool) -> DataFrame:
    """Texts of one chunk: encoded, decoded from the tokens and put into rows in one pass."""

    def work(batches):
        vocab = vocabulary(model)
        for batch in sliced(batches, "text", SLICE):
            made = vocab.encode([vocab.marked(t or "") for t in batch.column("text").to_pylist()])
            ids = np.frombuffer(b"".join(made), np.int32)
            text, ends = vocab.decode(ids)
            stops = np.cumsum([len(m) // 4 for m in made])
            cuts = [0, *np.append(0, ends)[stops].tolist()]
            rows = []
            for k1, k2, doc_id, tokens, a, b in zip(*(batch.column(c).to_pylist() for c in ("_k1", "_k2", "doc_id")), made, cuts, cuts[1:], strict=False):
                decoded = text[a + (vocab.dummy and b > a) : b]
                whole = (np.frombuffer(tokens, np.int32), decoded.decode()) if with_text else (None, None)
                rows.append((k1, k2, doc_id, len(tokens) // 4, hashlib.sha256(tokens).hexdigest(), hashlib.sha256(decoded).hexdigest(), *whole))
            yield batch_of(RESULT_SCHEMA, rows)

    return texts.mapInArrow(work, RESULT_SCHEMA)


def states_at_cuts(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """CHOSEN_SCHEMA: the states at both cuts of every chunk. Repeated rows repeat their matrices, which changes nothing."""

    def by_place(table) -> dict:
        return {i: from_text(m) for i, m in sorted(zip(table["piece"].to_pylist(), table["matrix"].to_pylist(), strict=True))}

    def product(key, table):
        (whole,) = products(list(by_place(table).values()))[-1]
        return pa.Table.from_batches([batch_of(MATRIX_SCHEMA, [(*(k.as_py() for k in key), to_text(whole))])])

    def chosen(key, places, ends):
        return pa.Table.from_batches([batch_of(CHOSEN_SCHEMA, [(key[0].as_py(), key[1].as_py(), i, *a, *b) for i, (a, b) in zip(places, cut_states(list(places.values()), ends), strict=True)])])

    def choose(key, table):
        return chosen(key, by_place(table), None)

    def choose_below(key, below, above):
        (a, over, b, past), *_ = zip(*(above[c].to_pylist() for c in CHOSEN_SCHEMA.replace(" string", "").replace(" int", "").split(", ")[3:]), strict=True)
        return chosen(key, by_place(below), ((a, over), (b, past)))

    # small rows, much work: a number is given, so that they are not put together
    tasks = partitions_for(matrices)
    above = F.floor(F.col("piece") / fan).cast("long").alias("above")
    levels = [matrices]
    width = (matrices.agg(F.max("piece")).first()[0] or 0) + 1
    while width > fan:
        width = -(-width // fan)
        dealt = levels[-1].withColumn("above", above).repartition(tasks, *KEYS, "above")
        levels.append(materialize(dealt.groupBy(*KEYS, "above").applyInArrow(product, MATRIX_SCHEMA), "products"))
    states = levels[-1].repartition(tasks, *KEYS).groupBy(*KEYS).applyInArrow(choose, CHOSEN_SCHEMA)
    for level in levels[-2::-1]:
        below = level.withColumn("above", above).groupBy(*KEYS, "above")
        states = below.cogroup(states.withColumn("above", F.col("piece")).groupBy(*KEYS, "above")).applyInArrow(choose_below, CHOSEN_SCHEMA)
    return materialize(states, "cut-states")


def encode_long(texts: DataFrame, model: bytes, chunk: int, fan: int) -> DataFrame:
    """TOKEN_SCHEMA of texts of several chunks: matrices, their products, and the chunks traced back."""

    def matrices(batches):
        vocab = vocabulary(model)
        rows = ((k1, k2, i, to_text(Chunk(vocab, *parts).matrix())) for k1, k2, _, text in rows_of(batches, "text") for i, _, *parts in chunks_of(vocab, vocab.marked(text), chunk))
        for held in in_slices(rows, lambda r: len(r[3])):
            yield batch_of(MATRIX_SCHEMA, held)

    def cut(batches):
        vocab = vocabulary(model)
        rows = ((k1, k2, doc_id, *parts) for k1, k2, doc_id, text in rows_of(batches, "text") for parts in chunks_of(vocab, vocab.marked(text), chunk))
        for held in in_slices(rows, lambda r: len(r[5])):
            yield batch_of(PIECE_SCHEMA, held)

    def trace(batches):
        vocab = vocabulary(model)
        for batch in sliced(batches, "text", SLICE):
            rows = batch.to_pylist()
            chunks = [Chunk(vocab, r["text"], r["before"], r["after"]) for r in rows]
            out = []
            for r, c, middle in zip(rows, chunks, vocab.encode([c.middle_text() for c in chunks]), strict=True):
                first, last = c.trace((r["left_piece"], r["left_over"]), (r["right_piece"], r["right_over"]))
                tokens = np.array(first, np.int32).tobytes() + middle + np.array(last, np.int32).tobytes()
                out.append((*(r[k] for k in ("_k1", "_k2", "doc_id", "piece", "pieces")), shrunk(tokens, vocab)))
            yield batch_of(TOKEN_SCHEMA, out)

    found = materialize(texts.mapInArrow(matrices, MATRIX_SCHEMA), "matrices")
    states = states_at_cuts(found, fan)
    # the one move of texts: the chunks of a giant one are traced by all tasks, however small the states' table is
    dealt = texts.mapInArrow(cut, PIECE_SCHEMA).repartition(partitions_for(texts), *KEYS, "piece")
    return dealt.join(states, [*KEYS, "piece"]).mapInArrow(trace, TOKEN_SCHEMA)


def joined_in_order(batches, model: bytes, with_text: bool):
    """Rows of whole texts from their chunks' tokens, sorted by text and place; a stream, but for texts that are asked for."""
    vocab = vocabulary(model)
    key = None
    for held in in_slices(rows_of(batches, "tokens"), lambda r: len(r[5])):
        out = []
        for k1, k2, doc_id, piece, pieces, data in held:
            if (k1, k2) != key:
                key, copies, done = (k1, k2), 0, -1
                n, tokens, decoded, whole, parts = 0, hashlib.sha256(), hashlib.sha256(), [], []
            copies += piece == 0
            if piece != done:  # repeated rows have the same chunks: one copy of each counts
                done = piece
                ids = widened(data, vocab)
                text, _ = vocab.decode(ids)
                text = text[1:] if vocab.dummy and piece == 0 else text
                n += len(ids)
                tokens.update(ids.tobytes())
                decoded.update(text)
                if with_text:
                    whole.append(ids)
                    parts.append(text)
            if piece == pieces - 1:
                copies -= 1
                own = (np.concatenate(whole), b"".join(parts).decode()) if with_text else (None, None)
                out.append((k1, k2, doc_id, n, tokens.hexdigest(), decoded.hexdigest(), *own))
        yield batch_of(RESULT_SCHEMA, out)


def encode(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_text: bool = True, fan: int = FAN) -> DataFrame:
    """One row for each row of ``docs``: RESULT_SCHEMA; token_sha256 is taken over little-endian 32-bit ids.

    The decoded text comes from the tokens alone. With ``with_text`` false, tokens and decoded
    are null and only their digests are there.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    if len(model) > 64 << 20:
        raise ValueError("model file of more than 64 MB")
    small_batches(docs.sparkSession)
    texts = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_short = F.coalesce(F.length("text"), F.lit(0)) + 1 <= chunk
    chunks = encode_long(texts.filter(~is_short), model, chunk, fan)
    in_order = chunks.repartition(partitions_for(docs), *KEYS).sortWithinPartitions(*KEYS, "piece")
    long_texts = in_order.mapInArrow(lambda batches: joined_in_order(batches, model, with_text), RESULT_SCHEMA)
    return encode_short(texts.filter(is_short), model, with_text).unionByName(long_texts)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, with_text=False)
    return out.select("doc_id", "n_tokens", "token_sha256", "decoded_sha256")
