"""SentencePiece model files, chunks that no piece crosses, and relaxation over piece occurrences."""

from __future__ import annotations

import heapq
import re

import numpy as np

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(field, value) pairs of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[i : i + n]
            i += n


class Pieces:
    """The vocabulary of a model file; identity normalisation that keeps white space is what is supported."""

    def __init__(self, data: bytes):
        self.text: list[str] = []
        score, kind, trainer, normaliser = [], [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.text.append(own.get(1, b"").decode())
                score.append(np.frombuffer(own.get(2, b"\0\0\0\0"), np.float32)[0])
                kind.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(1, b"") not in (b"identity", b"") or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only identity normalisation without white space removal is supported")
        self.score, self.kind = np.array(score, np.float64), np.array(kind)
        if (self.kind == USER).any() or (self.kind == UNUSED).any():
            raise ValueError("user-defined and unused pieces are not supported")
        self.method = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.normal = np.flatnonzero(self.kind == NORMAL)
        self.length = np.array([len(t) for t in self.text])
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        self.unknown_score = float(self.score[self.normal].min()) - 10.0
        self.single = {self.text[i]: int(i) for i in self.normal if self.length[i] == 1}
        self.byte = {int(self.text[i][1:-1], 16): int(i) for i in np.flatnonzero(self.kind == BYTE)}
        self.cuttable = all(re.fullmatch(f"{MARK}*[^{MARK}]*", self.text[i]) for i in self.normal)
        self.bytes = [bytes([int(t[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else t.replace(MARK, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]

    def chunks(self, text: str) -> list[str]:
        """Keys of the parts of a text that no piece crosses; ``chunk_text`` gives a key's marked text."""
        if not text:
            return []
        if self.dummy_prefix and self.cuttable and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text and "\0" not in text:
            return text.split(" ")
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.cuttable else [marked]
        return [p[1:] if p[0] == MARK and p[1:2] != "\0" else "\0" + p for p in parts]

    def fallback(self, char: str) -> list[int]:
        """Pieces of a character outside the vocabulary."""
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


def chunk_text(key: str) -> str:
    return key[1:] if key[:1] == "\0" else MARK + key


class Lattice:
    """Chunks laid out one after the other with a gap of one node, so node i of a chunk is its offset + i."""

    def __init__(self, chunks: list[str]):
        self.chunks = chunks
        self.joined = "\0".join(chunks) + "\0"
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(c) for c in chunks], np.int64)
        self.last = np.cumsum(sizes + 1) - 1
        self.first = self.last - sizes
        self.of = np.repeat(np.arange(len(chunks)), sizes + 1)

    def unknown(self, pieces: Pieces) -> np.ndarray:
        """Nodes whose character is no piece."""
        known = np.zeros(0x110000, bool)
        known[[ord(c) for c in pieces.single]] = True
        out = ~known[self.points]
        out[self.last] = False
        return np.flatnonzero(out)


def _waves(lattice: Lattice, pieces: Pieces, start: np.ndarray, piece: np.ndarray, best: np.ndarray):
    """Relax ``best`` by total score; of equal ones into a node, that whose last piece starts first. Yields settled nodes, starts and last pieces."""
    odd = lattice.unknown(pieces)
    end = np.concatenate([start + pieces.length[piece], odd + 1])
    score = np.concatenate([pieces.score[piece], np.full(len(odd), pieces.unknown_score)])
    start, piece = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), -1)])
    wave = end - lattice.first[lattice.of[start]]
    order = np.lexsort((start, end, wave))
    start, end, score, piece, wave = (x[order] for x in (start, end, score, piece, wave))
    cuts = np.r_[0, np.flatnonzero(np.diff(wave)) + 1, len(wave)] if len(wave) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        total = best[start[a:b]] + score[a:b]
        own = np.flatnonzero(np.r_[True, end[a + 1 : b] != end[a : b - 1]])
        top = np.maximum.reduceat(total, own)
        hit = np.flatnonzero(total == np.repeat(top, np.diff(np.r_[own, b - a])))
        hit = hit[np.r_[True, end[a + hit[1:]] != end[a + hit[:-1]]]]
        node = end[a + hit]
        best[node] = total[hit]
        yield node, start[a + hit], piece[a + hit]


def relax_unigram(lattice: Lattice, pieces: Pieces, start: np.ndarray, piece: np.ndarray):
    """Best paths by total score.

    Returns the score and, for each node, the last piece (-1: a character outside the vocabulary) and its start.
    """
    best = np.zeros(len(lattice.points))
    back, by = np.full(len(best), -1, np.int64), np.full(len(best), -1, np.int64)
    for node, a, p in _waves(lattice, pieces, start, piece, best):
        back[node], by[node] = a, p
    return best, by, back


def count_unigram(lattice: Lattice, pieces: Pieces, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """For each node the number of pieces of its best path, carried beside the score; no path is kept."""
    best, count = np.zeros(len(lattice.points)), np.zeros(len(lattice.points), np.int64)
    for node, a, p in _waves(lattice, pieces, start, piece, best):
        width = np.ones(len(node), np.int64)
        if pieces.byte_fallback:
            c = lattice.points[a]
            width += (p == -1) * (0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        count[node] = count[a] + width
    return count


def relax_bpe(lattice: Lattice, pieces: Pieces, start: np.ndarray, piece: np.ndarray, long: int = 256) -> np.ndarray:
    """Merges in order of score, the leftmost first on a tie; edges come in order of position. Each round joins, in every chunk, the best edge that two
    neighbouring symbols fill. Chunks of over ``long`` characters take the same steps from a heap.

    Returns, for each node, the end of the symbol that begins there, or -1.
    """
    n = len(lattice.points)
    nxt = np.arange(1, n + 1)
    nxt[lattice.last] = -1
    inner = np.ones(n, bool)
    inner[lattice.last] = False
    end = start + pieces.length[piece]
    multi = pieces.length[piece] > 1
    start, end, score = start[multi], end[multi], pieces.score[piece[multi]]
    of = lattice.of[start]
    big = (lattice.last - lattice.first)[of] > long
    for c in np.unique(of[big]):
        own = big & (of == c)
        _merge_long(nxt, start[own], end[own], score[own])
    rank = np.unique(-pieces.score, return_inverse=True)[1][piece[multi]]
    order = np.argsort(of * (len(pieces.score) + 1) + rank, kind="stable")
    order = order[~big[order]]
    start, end, of = start[order], end[order], of[order]
    while len(start):
        mid = nxt[start]
        live = (mid < end) & (nxt[mid] == end)
        at = np.flatnonzero(live)
        if not len(at):
            break
        at = at[np.r_[True, of[at[1:]] != of[at[:-1]]]]
        nxt[start[at]] = end[at]
        nxt[mid[at]] = -1
        active = np.zeros(len(lattice.chunks), bool)
        active[of[at]] = True
        keep = active[of] & (nxt[start] != -1) & ((nxt[end] != -1) | ~inner[end])
        start, end, of = start[keep], end[keep], of[keep]
    return nxt


def _merge_long(nxt: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> None:
    edges = {(s, e): v for s, e, v in zip(start.tolist(), end.tolist(), score.tolist(), strict=True)}
    before: dict[int, int] = {}
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        m = int(nxt[a])
        e = int(nxt[m]) if m >= 0 else -1
        if e > m >= 0 and (a, e) in edges:
            heapq.heappush(heap, (-edges[a, e], a, m, e))

    first = min(s for s, _ in edges)
    at = first
    while at >= 0 and nxt[at] >= 0:
        before[int(nxt[at])] = at
        offer(at)
        at = int(nxt[at])
    while heap:
        _, a, m, e = heapq.heappop(heap)
        if nxt[a] == m and nxt[m] == e:
            nxt[a], nxt[m] = e, -1
            before[e] = a
            if a in before:
                offer(before[a])
            offer(a)
