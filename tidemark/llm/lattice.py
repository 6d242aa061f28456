"""Subword lattices: marginal probability of words over all their segmentations."""

from __future__ import annotations

import numpy as np

#: Probability kept for spelling by single bytes, so that any word is possible.
BYTE_MASS = 1e-3
#: Words of one batch of the recursion, times their length.
CELLS = 400_000
_MARK = "▁"
_MUL = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 18
_NEVER = -1e30


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of an existing vocabulary and their log probabilities.

    A unigram vocabulary's scores are log probabilities and are taken as they are
    (made to sum to one). If the scores are whole numbers, they are the (negative)
    ranks of a vocabulary of merges, and the probability is that of Zipf's law, 1 / (rank + 10). The mark of a word's start
    becomes a blank. Control pieces, byte pieces and pieces with a mark elsewhere
    are left out.
    """
    import sentencepiece

    v = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(v.get_piece_size()):
        p = v.id_to_piece(i)
        if v.is_control(i) or v.is_unknown(i) or v.is_byte(i) or v.is_unused(i):
            continue
        if _MARK in p[1:] or p == "" or v.get_score(i) < -1e8:
            continue
        pieces.append((" " + p[1:] if p[0] == _MARK else p).encode())
        scores.append(v.get_score(i))
    s = np.array(scores)
    if (s == np.round(s)).all():  # ranks
        s = -np.log(10.0 - s)
    s -= np.log(np.exp(s - s.max()).sum()) + s.max()
    return pieces, s + np.log1p(-BYTE_MASS)


class Lattice:
    """Pieces with log probabilities, found in many words at once.

    A word of n bytes is a blank and the word; an arc spans the bytes of a piece, or
    one byte by itself. The forward recursion adds, in logarithms, over all arcs that
    end at a place: its last value is the word's marginal log probability.
    """

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = np.append(logp, _NEVER)  # the last stands for "no piece"
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        h = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        slot = (h * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(slot[order], slot[order])
        depth = int(rank.max(initial=0)) + 1
        self.keys = np.zeros((depth, 1 << _BITS), dtype=np.uint64)
        self.index = np.full((depth, 1 << _BITS), self.n, dtype=np.int32)
        self.keys[rank, slot[order]] = h[order]
        self.index[rank, slot[order]] = order

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = len(piece)
        for b in piece:
            h = (h * 0x100000001B3 + b + 1) % 2**64
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = (h * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)
        out = np.full(h.shape, self.n, dtype=np.int32)
        for keys, index in zip(self.keys, self.index, strict=True):
            got = keys[slot] == h
            out[got] = index[slot[got]]
        return out

    def _arcs(self, w: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece that starts at each byte of each word."""
        b, n = w.shape
        out = []
        h = np.zeros((b, n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, min(n, self.longest) + 1):
                # the hash starts from the length: rebuild it by its linear part
                h = h[:, : n - size + 1] * _MUL + w[:, size - 1 :] + np.uint64(1)
                start = np.uint64(size * pow(0x100000001B3, size, 2**64) % 2**64)
                out.append(self._find(h + start))
        return out

    def _forward(self, arcs, b: int, n: int, reverse: bool = False) -> np.ndarray:
        a = np.full((b, n + 1), _NEVER)
        a[:, n if reverse else 0] = 0.0
        byte = np.log(BYTE_MASS / 256)
        for j in range(n - 1, -1, -1) if reverse else range(1, n + 1):
            terms = []
            for size, found in enumerate(arcs, 1):
                i = j if reverse else j - size
                if i < 0 or i + size > n:
                    break
                p = self.logp[found[:, i]]
                if size == 1:
                    p = np.logaddexp(p, byte)
                terms.append(a[:, i + size if reverse else i] + p)
            t = np.stack(terms, 1)
            m = t.max(1)
            a[:, j] = m + np.log(np.exp(t - m[:, None]).sum(1))
        return a

    def _batches(self, words: list[bytes]):
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        cut = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cut):
            if not len(same):
                continue
            n = int(lengths[same[0]])
            for lo in range(0, len(same), max(1, CELLS // n)):
                at = same[lo : lo + max(1, CELLS // n)]
                raw = np.frombuffer(b"".join(b" " + words[i] for i in at), dtype=np.uint8)
                yield at, raw.reshape(len(at), n).astype(np.uint64), n

    def log_prob(self, words: list[bytes], whole: np.ndarray | None = None, spelt: float = 0.0) -> np.ndarray:
        """Natural logarithm of each word's marginal probability.

        ``whole`` gives each word's lattice one more arc, from its start to its end,
        with this logarithm; paths of pieces then begin with an arc of ``spelt``.
        """
        out = np.zeros(len(words))
        for at, w, n in self._batches(words):
            out[at] = self._forward(self._arcs(w), len(at), n)[:, n]
        return out if whole is None else np.logaddexp(whole, spelt + out)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``counts`` occurrences of the words."""
        out = np.zeros(self.n + 1)
        for at, w, n in self._batches(words):
            arcs = self._arcs(w)
            a = self._forward(arcs, len(at), n)
            z = self._forward(arcs, len(at), n, reverse=True)
            for size, found in enumerate(arcs, 1):
                x = a[:, : n - size + 1] + z[:, size:] + self.logp[found] - a[:, n :]
                x = np.exp(np.minimum(x, 0.0)) * counts[at][:, None]
                out += np.bincount(found.ravel(), weights=x.ravel(), minlength=self.n + 1)
        return out[: self.n]
