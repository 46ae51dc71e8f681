"""Marginal probability of words over all segmentations into subword pieces.

The vocabulary's pieces form a byte trie.  Words (with the word mark in front)
are laid end to end; all piece starts walk the trie together, one byte a step,
and the arcs found feed a log-space forward recursion that advances by the
offset of the arcs' start in their word, over all words at once.
"""

from __future__ import annotations

import numpy as np

#: The word mark U+2581, which pieces carry at a word's start, as one byte that words can't contain.
MARK = 0x20


class Vocabulary:
    """Pieces of an existing tokenizer with the scores it comes with.

    A unigram model's scores are log-probabilities.  A BPE model's are negative
    ranks; those become weights 1 / (rank + 2.7) (Zipf-Mandelbrot).  Every byte
    has a piece, so each word has a segmentation.
    """

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = np.asarray(log_p, float)
        self._build(pieces)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, bytes_at = [], [], {}
        for i in range(model.vocab_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_at[int(piece[3:5], 16)] = model.get_score(i)
                continue
            pieces.append(piece.replace("▁", chr(MARK)).encode())
            scores.append(model.get_score(i))
        scores = np.array(scores)
        known = {p: k for k, p in enumerate(pieces)}
        rare = scores.min() - 1
        for b in range(256):
            if bytes([b]) not in known:
                pieces.append(bytes([b]))
                scores = np.append(scores, rare)
        if rare < -500:
            weight = 1 / (2.7 - scores)
        else:
            weight = np.exp(scores)
        return cls(pieces, np.log(weight / weight.sum()))

    def _build(self, pieces: list[bytes]) -> None:
        child: dict[int, int] = {}
        nodes = 1
        final = []
        for p in pieces:
            node = 0
            for b in p:
                key = node << 8 | b
                if key not in child:
                    child[key] = nodes
                    nodes += 1
                node = child[key]
            final.append(node)
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[final] = np.arange(len(pieces), dtype=np.int32)
        self.bits = max(10, (4 * len(child)).bit_length())
        size = 1 << self.bits
        keys = np.fromiter(child, np.int64, len(child))
        values = np.fromiter(child.values(), np.int32, len(child))
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_value = np.zeros(size, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # linear probing, all keys at once
            free = self.slot_key[at[left]] == -1
            first = np.unique(at[left][free], return_index=True)[1]
            put = left[free][first]
            self.slot_key[at[put]], self.slot_value[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each node by each byte, -1 where there is none."""
        keys = nodes.astype(np.int64) << 8 | byte
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.slot_key[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.slot_value[at[todo[same]]]
            todo = todo[~same & (held != -1)]
            at[todo] = (at[todo] + 1) & (len(self.slot_key) - 1)
        return out

    def arcs(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece found inside a word, and each start's offset in its word.

        text: bytes of marked words end to end; starts: where each word begins, and the end.
        """
        n = len(text)
        lengths = np.diff(starts)
        word_end = np.repeat(starts[1:], lengths)
        offset = np.arange(n) - np.repeat(starts[:-1], lengths)
        at, nodes, depth = np.arange(n), np.zeros(n, np.int32), 0
        found_start, found_end, found_piece = [], [], []
        while len(at):
            inside = at + depth < word_end[at]
            at, nodes = at[inside], nodes[inside]
            nodes = self._step(nodes, text[at + depth])
            alive = nodes >= 0
            at, nodes = at[alive], nodes[alive]
            depth += 1
            piece = self.piece[nodes]
            hit = piece >= 0
            found_start.append(at[hit])
            found_end.append(at[hit] + depth)
            found_piece.append(piece[hit])
        s = np.concatenate(found_start) if found_start else np.zeros(0, np.int64)
        e = np.concatenate(found_end) if found_end else s
        p = np.concatenate(found_piece) if found_piece else np.zeros(0, np.int32)
        return s, e, p, offset[s] if n else s

    def marginals(self, words: np.ndarray, lengths: np.ndarray, log_p: np.ndarray | None = None, counts: np.ndarray | None = None, limit: int = 1 << 16):
        """Natural log of each word's probability, summed over all segmentations.

        words: the words' bytes end to end without marks.  With counts, also the
        expected number of uses of each piece.
        """
        log_p = self.log_p if log_p is None else log_p
        out = np.zeros(len(lengths))
        expected = np.zeros(len(self.log_p)) if counts is not None else None
        ends = np.cumsum(lengths)
        lo = 0
        while lo < len(lengths):
            base = ends[lo] - lengths[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            size = lengths[lo:hi] + 1
            starts = np.concatenate([[0], np.cumsum(size)])
            text = np.full(starts[-1], MARK, np.uint8)
            inner = np.ones(starts[-1], bool)
            inner[starts[:-1]] = False
            text[inner] = words[base : ends[hi - 1]]
            s, e, p, off = self.arcs(text, starts)
            order = np.argsort(off, kind="stable")
            s, e, p, off = s[order], e[order], p[order], off[order]
            # a word's end and the next word's start are two states
            word = np.searchsorted(starts, s, side="right") - 1
            s, e, lp = s + word, e + word, log_p[p]
            first, last = starts[:-1] + np.arange(len(size)), starts[1:] + np.arange(len(size))
            alpha = np.full(starts[-1] + len(size), -np.inf)
            alpha[first] = 0.0
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(off)) + 1, [len(off)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                alpha[e[a:b]] = np.logaddexp(alpha[e[a:b]], alpha[s[a:b]] + lp[a:b])
            out[lo:hi] = alpha[last]
            if counts is not None:
                beta = np.full(len(alpha), -np.inf)
                beta[last] = 0.0
                back = np.argsort(e - first[word], kind="stable")[::-1]
                key = (e - first[word])[back]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    x = back[a:b]
                    beta[s[x]] = np.logaddexp(beta[s[x]], lp[x] + beta[e[x]])
                use = np.exp(alpha[s] + lp + beta[e] - alpha[last][word]) * counts[lo:hi][word]
                expected += np.bincount(p, weights=use, minlength=len(expected))
            lo = hi
        return out if counts is None else (out, expected)
