"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (dummy
prefix, spaces to the space symbol), the lexicon of pieces, and the byte
fallback for characters no piece holds. An input is composed with them on the
fly and its tropical-semiring shortest path is the encoding.

Arc weights follow the model. A unigram model gives a piece its negated log
probability. A BPE model has no piece weights that could be added up: its
result is the one sequence in which no two neighbours would have been merged
differently. There the lexicon is composed with an acceptor of neighbouring
pieces whose arcs weigh 0 if merging the pair's characters gives that very
pair, and infinity otherwise; exactly one path has a finite weight, and it is
the BPE encoding.

The model file's path is a parameter; its bytes travel with the task. Only
models without a character map in the normaliser are supported (others
raise).
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import tokens as K
from tillroll.llm.common import bounded, field, handed_on, schema, slices, worker_model

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHED_BYTES = 48 << 20  # paths kept per worker process and generation, with the objects around them
CACHED_LENGTH = 48
LOCKSTEP = 40_000  # segments composed together
TEXT_BYTES = 1 << 20  # text handled at once


def _fields(buf: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, buf[at:at + n]
            at += n


class Transducer:
    """Normaliser, lexicon and byte fallback of one model."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True, squeeze: bool = False):
        self.pieces, self.bpe, self.dummy_prefix, self.squeeze = pieces, bpe, dummy_prefix, squeeze
        self.arcs = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER) and p}
        self.score = [s for _, s, _ in pieces]
        self.longest = max(map(len, self.arcs), default=1)
        sizes: dict[str, set[int]] = {}  # lengths of the pieces that end in two given characters
        for p in self.arcs:
            if len(p) > 1:
                sizes.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: sorted(v, reverse=True) for k, v in sizes.items()}
        self.unk = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        byte = {p: i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if byte else None
        self.unk_weight = 10.0 - min((s for _, s, t in pieces if t == NORMAL), default=0.0)
        self.surface = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN
            else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        # A piece never spans these points, so an input falls apart there.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.arcs)
        alone = [c for c in "\n\t\r" if not any(c in p and p != c for p in self.arcs)]
        stop = re.escape("".join(alone))
        self.cut = None if inner else re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" + (f"|[{stop}]" if alone else ""))
        self.cache = _Cache(self)
        self.lattice: Lattice | None = None
        self.spelling: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple[str, str] | None] = {}
        ranks = {s: r for r, s in enumerate(sorted(set(self.score), reverse=True))}
        self.order = [ranks[s] for s in self.score]

    @classmethod
    def load(cls, blob: bytes) -> "Transducer":
        pieces, bpe, dummy, squeeze = [], False, True, True
        for n, v in _fields(blob):
            if n == 1:
                d = dict(_fields(v))
                pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif n == 2:
                bpe = dict(_fields(v)).get(3, 1) == 2
            elif n == 3:
                d = dict(_fields(v))
                dummy, squeeze = bool(d.get(3, 1)), bool(d.get(4, 1))
                if d.get(2):
                    raise ValueError("models with a character map in their normaliser are not supported")
        return cls(pieces, bpe, dummy, squeeze)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    # -- acceptor of neighbours (BPE) -----------------------------------------

    def merged(self, s: str, cuts: list[int] | None = None) -> list[str]:
        """Characters of a short string after all merges, best score first, leftmost on ties.

        ``cuts`` receives, merge by merge, where in the string the two symbols met.
        """
        sym = list(s)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(sym)
            if 0 <= i and j < len(sym):
                k = self.arcs.get(sym[i] + sym[j])
                if k is not None:
                    heapq.heappush(heap, (-self.score[k], i, sym[i] + sym[j]))

        for i in range(len(sym)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not sym[i] or j >= len(sym) or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            if cuts is not None:
                cuts.append(j)
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in sym if x]

    def halves(self, k: int) -> tuple[str, str] | None:
        """The two symbols whose merge made a piece; None for a character."""
        got = self.made.get(k, False)
        if got is False:
            p, cuts = self.pieces[k][0], []  # type: ignore[var-annotated]
            got = (p[:cuts[-1]], p[cuts[-1]:]) if self.merged(p, cuts) == [p] and cuts else None
            self.made[k] = got
        return got

    def joins(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a in a BPE encoding.

        The merges of both are undone, latest first: if the symbols then at
        the seam form a piece that merges before the merge just undone, the
        pair would have grown together across the seam.
        """
        got = self.pairs.get((a, b))
        if got is None:
            x, y = self.pieces[a][0], self.pieces[b][0]
            if not x.strip(SPACE) or not y.strip(SPACE):  # runs of the space symbol have equal scores
                got = self.merged(x + y) == [x, y]
            else:
                got = self._seam(x, y)
            if len(self.pairs) >= 200_000:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def _seam(self, x: str, y: str) -> bool:
        arcs, order, bar = self.arcs, self.order, math.inf
        while True:
            both = arcs.get(x + y)
            if both is not None and order[both] < bar:
                return False
            kx, ky = arcs.get(x), arcs.get(y)
            hx = self.halves(kx) if kx is not None else None
            hy = self.halves(ky) if ky is not None else None
            if hx is None and hy is None:
                return True
            if hy is None or (hx is not None and order[kx] > order[ky]):
                bar, x = order[kx], hx[1]  # at equal rank the merge on the left comes first
            else:
                bar, y = order[ky] + 0.5, hy[0]

    # -- composition and shortest path -----------------------------------------

    def shortest(self, s: str) -> bytes:
        """Output labels (as int32 bytes) of the shortest path of a normalised string.

        The lattice's states are the positions, with the last piece where the
        acceptor of neighbours needs it. An arc outside the lexicon is one
        character, by byte fallback or as an unknown.
        """
        last, width = (self._bpe if self.bpe else self._unigram)(s)
        out = array("i")
        i = len(s)
        while i:
            j = i - width[i]
            if last[i] >= 0:
                out.append(last[i])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(s[j:i].encode()))
            elif not (out and out[-1] == self.unk):  # a run of unknown characters is one label
                out.append(self.unk)
            i = j
        out.reverse()
        return out.tobytes()

    def _unigram(self, s: str) -> tuple[array, array]:
        """Last piece and its length at every position."""
        n = len(s)
        dist, last, width = array("d", [math.inf]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        dist[0] = 0.0
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                k = self.arcs.get(s[j:i], -2)
                if k < 0 and i - j > 1:
                    continue
                w = dist[j] + (self.unk_weight if k < 0 else -self.score[k])
                if w < dist[i]:
                    dist[i], last[i], width[i] = w, k, i - j
        return last, width

    def _bpe(self, s: str) -> tuple[array, array]:
        """Weights are 0 or infinite and a prefix has one encoding: each
        position keeps the one last piece that a finite path can have there."""
        last, width = array("i", [-1]) * (len(s) + 1), array("i", [0]) * (len(s) + 1)
        arcs, lengths, pairs, joins = self.arcs.get, self.lengths.get, self.pairs.get, self.joins
        for i in range(1, len(s) + 1):
            for size in lengths(s[i - 2:i], ()) if i > 1 else ():
                j = i - size
                if j < 0:
                    continue
                k = arcs(s[j:i])
                if k is None:
                    continue
                before = last[j]
                if before >= 0:
                    ok = pairs((before, k))
                    if not (joins(before, k) if ok is None else ok):
                        continue
                last[i], width[i] = k, size
                break
            else:
                last[i], width[i] = arcs(s[i - 1], -2), 1
        return last, width

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of many texts."""
        return [None if p is None else np.frombuffer(p, np.int32).tolist() for p in self.paths(texts)]

    def paths(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids (as int32 bytes) of many texts; the segments none of them had before are composed together."""
        normal = [None if t is None else self.normalise(t) for t in texts]
        parts = [None if s is None else [s] if self.cut is None else self.cut.findall(s) for s in normal]
        if self.bpe and self.cut is not None:
            self.cache.turn()
            fresh = set().union(*(p for p in parts if p))
            fresh.difference_update(self.cache)
            self.cache.recall(fresh)
            fresh = [s for s in fresh if len(s) <= CACHED_LENGTH and SPACE * 2 not in s]
            if len(fresh) >= 64:
                self.lattice = self.lattice or Lattice(self)
                for k in range(0, len(fresh), LOCKSTEP):
                    self.cache.learn(*self.lattice.shortest_all(fresh[k:k + LOCKSTEP]))
        else:
            self.cache.turn()
        get = self.cache.__getitem__
        return [None if p is None else b"".join(map(get, p)) for p in parts]

    def surfaces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids after one another, and the offset of every id (the transducer run backwards)."""
        if self.spelling is None:
            size = np.array([len(x) for x in self.surface])
            self.spelling = np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(size) - size, size
        flat, begin, size = self.spelling
        each = size[ids]
        off = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(begin[ids] - off[:-1], each) + np.arange(off[-1])], off

    def decode_all(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """UTF-8 texts of many sequences, one after another in ``ids`` and cut at ``cut``."""
        raw, off = self.surfaces(ids)
        raw, off = raw.tobytes(), off[cut].tolist()
        return [self._text(raw[a:b]) for a, b in zip(off, off[1:])]

    def _text(self, raw: bytes) -> bytes:
        if self.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        ids = np.asarray(ids, np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].decode()


class Lattice:
    """The BPE composition for many segments in lockstep, as table look-ups.

    Symbols are the pieces and the characters that occur in pieces. One hash
    table knows the lexicon's arcs by the hash of their characters, one the
    piece that two neighbouring symbols form, one the symbols a piece was
    merged from. Segments with a character outside the lexicon, which need the
    byte fallback, are left to the general path.
    """

    def __init__(self, t: Transducer):
        pieces = sorted(t.arcs, key=t.arcs.__getitem__)
        self.known = {c for c in pieces if len(c) == 1}
        chars = sorted({c for p in pieces for c in p} - self.known)
        self.names = pieces + chars
        number = {p: i for i, p in enumerate(self.names)}
        self.ids = np.array([t.arcs[p] for p in pieces] + [-1] * len(chars), np.int64)
        self.rank = np.array([2 * t.order[t.arcs[p]] for p in pieces] + [0] * len(chars), np.int64)
        self.left, self.right = np.full(len(self.names), -1), np.full(len(self.names), -1)
        pairs: dict[int, int] = {}
        for p, i in number.items():
            if len(p) == 1:
                continue
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
            h = t.halves(t.arcs[p])
            if h is not None and h[0] in number and h[1] in number:
                self.left[i], self.right[i] = number[h[0]], number[h[1]]
        self.pairs = _Table(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        point = np.array([ord(c) for p in self.names for c in p], np.int64)
        size = np.array([len(p) for p in self.names])
        off = np.cumsum(size) - size
        self.arcs = _Table(self._hash(self._sums(point), off, off + size), np.arange(len(self.names)))
        self.longest = int(size[:len(pieces)].max())
        # lengths of the arcs that end in two given characters, as a set of bits
        ends: dict[int, int] = {}
        for p in pieces:
            if len(p) > 1:
                key = ord(p[-2]) << 21 | ord(p[-1])
                ends[key] = ends.get(key, 0) | 1 << min(len(p), 62)
        self.ends = _Table(np.fromiter(ends, np.uint64, len(ends)), np.fromiter(ends.values(), np.int64, len(ends)))

    @staticmethod
    def _sums(point: np.ndarray) -> np.ndarray:
        out = np.zeros(len(point) + 1, np.uint64)
        np.cumsum(K.mix(point.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * K.powers(len(point))[0][:len(point)], out=out[1:])
        return out

    @staticmethod
    def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.span_hashes(sums, a, b)

    def _may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether symbol y may follow symbol x (undoing merges, latest first)."""
        ok = np.ones(len(x), bool)
        bar = np.full(len(x), 1 << 60)
        at = np.arange(len(x))
        while len(at):
            both = self.pairs.get((x.astype(np.uint64) << np.uint64(20)) | y.astype(np.uint64))
            clash = (both >= 0) & (self.rank[both] < bar)
            ok[at[clash]] = False
            hx, hy = self.right[x] >= 0, self.left[y] >= 0
            on = ~clash & (hx | hy)
            at, x, y, hx, hy = at[on], x[on], y[on], hx[on], hy[on]
            undo_x = hx & (~hy | (self.rank[x] > self.rank[y]))  # at equal rank the merge on the left comes first
            bar = np.where(undo_x, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def shortest_all(self, segments: list[str]) -> tuple[list[str], list[bytes]]:
        """The segments of known characters, and their paths."""
        segments = sorted((s for s in segments if self.known.issuperset(s)), key=len)
        if not segments:
            return [], []
        point = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(s) for s in segments])
        begin = np.cumsum(size) - size
        sums = self._sums(point)
        # Arcs by their length, sorted by where in the segment they end.
        where = np.arange(len(point)) - np.repeat(begin, size) + 1
        pair = (point.astype(np.uint64) << np.uint64(21))[:-1] | point.astype(np.uint64)[1:]
        fits = np.concatenate([[0], np.maximum(self.ends.get(pair), 0)]) | 2
        arcs = []
        for n in range(1, min(self.longest, int(size[-1])) + 1):
            e = np.flatnonzero((where >= n) & (fits >> min(n, 62) & 1 == 1)) + 1
            k = self.arcs.get(self._hash(sums, e - n, e))
            hit = (k >= 0) & (self.ids[k] >= 0)
            e, k = e[hit], k[hit]
            order = np.argsort(where[e - 1], kind="stable")
            e, k = e[order], k[order]
            arcs.append((e, k, np.searchsorted(where[e - 1], np.arange(1, int(size[-1]) + 2))))
        last = np.full(len(point) + 1, -1)  # last symbol of the path to each place; place 0 of a segment is no place here
        width = np.zeros(len(point) + 1, np.int64)
        for i in range(1, int(size[-1]) + 1):
            for n in range(len(arcs), 0, -1):
                e, k, cut = arcs[n - 1]
                if n > i:
                    continue
                e, k = e[cut[i - 1]:cut[i]], k[cut[i - 1]:cut[i]]
                todo = width[e] == 0
                e, k = e[todo], k[todo]
                if not len(e):
                    continue
                if n < i:
                    good = self._may_follow(last[e - n], k)
                    e, k = e[good], k[good]
                last[e], width[e] = k, n
        # Walk back from the ends, all segments at once.
        place, owner, ids, home = begin + size, np.arange(len(size)), [], []
        while len(place):
            ids.append(self.ids[last[place]])
            home.append(owner)
            place = place - width[place]
            on = place > begin[owner]
            place, owner = place[on], owner[on]
        ids, home = np.concatenate(ids[::-1]), np.concatenate(home[::-1])
        order = np.argsort(home, kind="stable")
        flat = ids[order].astype(np.int32).tobytes()
        cut = (4 * np.searchsorted(home[order], np.arange(len(size) + 1))).tolist()
        return segments, [flat[a:b] for a, b in zip(cut, cut[1:])]


class _Table:
    """Hash table of unsigned keys to small numbers; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) - 1).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        self.probes = 0
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # one probe further for all that found their place taken
            self.probes += 1
            free = self.values[slot[left]] < 0
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.setdiff1d(left, first)
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] >= 0)]
        return out


class _Cache(dict):
    """Shortest paths of the segments met before, in two generations of bounded bytes."""

    def __init__(self, t: Transducer):
        super().__init__()
        self.t, self.old, self.held = t, {}, 0

    def turn(self) -> None:
        """Between texts: the younger generation becomes the older one when it has grown past its bound."""
        if self.held > CACHED_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0

    def learn(self, segments: list[str], paths: list[bytes]) -> None:
        self.held += 2 * sum(map(len, segments)) + sum(map(len, paths)) + 220 * len(segments)
        self.update(zip(segments, paths))

    def recall(self, segments: set[str]) -> None:
        """Take those of the segments that the older generation knows into the younger, and out of the set."""
        known = segments & self.old.keys()
        if known:
            self.learn(list(known), [self.old[s] for s in known])
            segments -= known

    def __missing__(self, s: str) -> bytes:
        got = self.old.get(s) or self.t.shortest(s)
        if len(s) <= CACHED_LENGTH:
            self.learn([s], [got])
        return got


def transducer(blob: bytes) -> Transducer:
    return worker_model(hashlib.sha256(blob).hexdigest(), lambda: Transducer.load(blob))


def _blob(model: str) -> bytes:
    with open(model, "rb") as f:  # a vocabulary file of the installation, read on the driver
        return f.read()


def _encoded(t: Transducer, col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids of a text column after one another, the texts' offsets among them, and the list array."""
    lists = t.paths(col.to_pylist())
    off = np.concatenate([[0], np.cumsum([len(x) // 4 if x else 0 for x in lists])]).astype(np.int32)
    flat = np.frombuffer(b"".join(x for x in lists if x), np.int32)
    return flat, off, pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=pa.array([x is None for x in lists], pa.bool_()))


def encode(docs: DataFrame, model: str = MODEL, columns: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``columns`` of docs (default: all) plus ``ids``, array of int.

    Null texts have null ids, empty ones an empty array; whole texts are
    encoded, one row per row. A column of docs called ``ids`` is handed on as ``in_ids``.
    """
    blob = _blob(model)
    keep = columns or docs.columns
    as_ = handed_on(keep, ["ids"])
    names = list(dict.fromkeys([*keep, text_col]))
    out = schema(*[field(docs, c, a) for c, a in zip(keep, as_)], T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        t = transducer(blob)
        for batch in slices(batches, text_col, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [_encoded(t, batch.column(text_col))[2]], names=out.names)

    return bounded(docs).select(*names).mapInArrow(run, out)


def decode(encoded: DataFrame, model: str = MODEL, columns: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """``columns`` (default: all) plus ``decoded``; null ids give null. A column
    already called ``decoded`` is handed on as ``in_decoded``."""
    blob = _blob(model)
    keep = columns or encoded.columns
    as_ = handed_on(keep, ["decoded"])
    names = list(dict.fromkeys([*keep, ids_col]))
    out = schema(*[field(encoded, c, a) for c, a in zip(keep, as_)], T.StructField("decoded", T.StringType()))

    def run(batches):
        t = transducer(blob)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                col = part.column(ids_col)
                lists = [x or [] for x in col.to_pylist()]
                cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                texts = t.decode_all(np.fromiter(chain.from_iterable(lists), np.int64, int(cut[-1])), cut)
                texts = [x.decode() if ok else None for x, ok in zip(texts, col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(texts, pa.string())], names=out.names)

    return encoded.select(*names).mapInArrow(run, out)


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives it back.

    The space symbol itself decodes to a space; ``round_trip`` allows for it.
    Both directions run in one pass, so a task has one Python process.
    """
    blob = _blob(model)
    out = schema(field(docs, "doc_id"), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                 T.StructField("round_trip", T.BooleanType()))
    space = SPACE.encode()

    def run(batches):
        t = transducer(blob)
        for batch in slices(batches, "text", TEXT_BYTES):
            flat, off, ids = _encoded(t, batch.column("text"))
            texts = batch.column("text").cast(pa.large_binary())
            back = [x.as_py() is None or x.as_py().replace(space, b" ") == d for x, d in zip(texts, t.decode_all(flat, off))]
            n = pa.array(np.diff(off).astype(np.int64), mask=np.asarray(ids.is_null()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, ids, pa.array(back, pa.bool_())], names=out.names)

    return bounded(docs).select("doc_id", "text").mapInArrow(run, out)
