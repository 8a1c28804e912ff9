"""Token ids of whole texts inside a task, as packed 16-bit numbers: texts are cut by array operations, words are encoded once."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters that are cut at a time; a longer text is cut alone.
CHUNK = 1 << 20
#: Most words that an encoder remembers, and characters beyond which a word is not remembered.
REMEMBERED, LONG = 400_000, 64
#: Characters that are cut at a time where ids are only counted, and bits of a place in the table of counts.
COUNTED, PLACE_BITS = 1 << 17, 20
#: Tables of 2 to these numbers of powers are kept by a worker.
KEPT_BITS = (17, 20)
#: White space as the pattern of the vocabulary has it (fixed values).
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What follows an apostrophe in a word of its own (fixed values).
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_P = 0x9E3779B97F4A7C15
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    of = {"L": _LETTER, "N": _DIGIT}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(SPACES)] = _SPACE
    return out


def _tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(1 << bits, _P, np.uint64), np.full(1 << bits, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, out=up), np.cumprod(down, out=down)


_kept_tables = cache(_tables)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a number and of its inverse, or more. A worker keeps no tables but those of usual chunks."""
    bits = (max(n, 1) - 1).bit_length()
    kept = next((k for k in KEPT_BITS if bits <= k), None)
    return _tables(bits) if kept is None else _kept_tables(kept)


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin in texts laid end to end. cp: code points; first: True where a text begins."""
    kind = _classes()[cp]
    turn = first.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    space, blank = kind == _SPACE, cp == 0x20
    # The last space before a word: a blank goes with that word, any other white space stands alone.
    last = space.copy()
    last[:-1] &= turn[1:] & ~first[1:]
    last[-1:] = False
    carried = np.zeros(len(cp), bool)
    carried[1:] = blank[:-1] & last[:-1]
    start = (turn & ~(carried & ~first)) | last
    at = np.flatnonzero((cp == 0x27) & start)
    if len(at):
        padded = np.r_[cp, np.zeros(3, cp.dtype)]
        more, bound = np.r_[kind, np.full(3, _SPACE, np.uint8)], np.r_[first, True, True, True]
        for letters in CONTRACTIONS:
            hit = at
            for k, c in enumerate(letters, 1):
                hit = hit[(padded[hit + k] == ord(c)) & ~bound[hit + k]]
            if len(hit):
                start[hit + 1] = False
                end = hit + 1 + len(letters)
                end = end[(more[end] == _LETTER) & ~bound[end]]
                start[end] = True
                at = np.setdiff1d(at, hit, assume_unique=True)
    return start


class Encoder:
    """Ids of texts as little-endian 16-bit numbers; a special token's own text is ordinary text here."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        assert len(known) < 1 << 16
        self.of = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.stop = known[b"\n"]
        self.known = self.n_ids = None
        self._forget()

    def _forget(self) -> None:
        """Words met so far: their hashes in order, and where the ids of each lie in the pool."""
        self.hashes, self.at, self.sizes, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _distinct(self, words: list[str], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. blank: which words are white space.

        The others go through the library in one call, a line each: a line end never lies in such a word and
        joins none of its neighbours, so its id parts them again.
        """
        lines = [w for w, b in zip(words, blank.tolist(), strict=True) if not b]
        ids = np.array(self.of.encode_ordinary("\n".join(lines)), np.uint16)
        parts = np.flatnonzero(ids == self.stop)
        sizes, blanks = np.zeros(len(words), np.int64), [self.of.encode_ordinary(words[k]) for k in np.flatnonzero(blank)]
        if lines:
            sizes[~blank] = np.diff(np.r_[-1, parts, len(ids)]) - 1
        sizes[blank] = [len(x) for x in blanks]
        out = np.zeros(sizes.sum(), np.uint16)
        of_blank = np.repeat(blank, sizes)
        out[~of_blank] = ids[ids != self.stop]
        out[of_blank] = np.array([i for x in blanks for i in x], np.uint16)
        return out, sizes

    def _cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts end to end; their code points; where words begin and stop and their hashes; where each text's words end."""
        whole = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        first = np.zeros(len(cp), bool)
        first[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(word_starts(cp, first))
        stop = np.r_[begin[1:], len(cp)]
        with np.errstate(over="ignore"):
            up, down = powers(len(cp))
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum((cp + np.uint64(1)) * up[: len(cp)], out=total[1:])
            h = (total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
        return whole, cp, begin, stop, h, np.searchsorted(begin, ends, "left")

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids; where in it the ids of each distinct word lie and how many it has; the distinct word at each place; where each text's places end."""
        whole, cp, begin, stop, h, ends = self._cut(texts)
        long = np.flatnonzero(stop - begin > LONG)
        h[long] = np.arange(len(long), dtype=np.uint64)  # long words are told apart by place, not by hash
        h, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        known = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        is_long = stop[at] - begin[at] > LONG
        new = (self.hashes[known] != h) | is_long if len(self.hashes) else np.ones(len(h), bool)
        words = [whole[b:e] for b, e in zip(begin[at[new]].tolist(), stop[at[new]].tolist(), strict=True)]
        ids, n = self._distinct(words, _classes()[cp[stop[at[new]] - 1]] == _SPACE)
        where, sizes = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        where[~new], sizes[~new] = self.at[known[~new]], self.sizes[known[~new]]
        where[new], sizes[new] = len(self.pool) + np.cumsum(n) - n, n
        self.pool = np.r_[self.pool, ids]
        kept = new & ~is_long
        order = np.argsort(np.r_[self.hashes, h[kept]], kind="stable")
        self.hashes, self.at, self.sizes = (np.r_[a, b[kept]][order] for a, b in ((self.hashes, h), (self.at, where), (self.sizes, sizes)))
        return self.pool, where, sizes, inverse, ends

    def _counts(self, whole: str, cp: np.ndarray, begin: np.ndarray, stop: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many ids each word has.

        Words met before have two places in a table of fixed size, by the upper and by the lower bits of their hash;
        later words take the places of earlier ones. Long words are never looked up.
        """
        if self.known is None:
            self.known, self.n_ids = np.zeros(1 << PLACE_BITS, np.uint64), np.zeros(1 << PLACE_BITS, np.uint16)
            self.known[0] = ~np.uint64(0)  # the hash 0 is looked up here alone, and is no word's yet
        upper, lower = (h >> np.uint64(64 - PLACE_BITS)).astype(np.int64), (h & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        out, is_long = self.n_ids[upper].astype(np.int64), stop - begin > LONG
        missed = np.flatnonzero((self.known[upper] != h) | is_long)
        out[missed] = self.n_ids[lower[missed]]
        missed = missed[(self.known[lower[missed]] != h[missed]) | is_long[missed]]
        if len(missed):
            h = h.copy()
            h[is_long] = np.arange(is_long.sum(), dtype=np.uint64)  # long words are told apart by place, not by hash
            of, at, inverse = np.unique(h[missed], return_index=True, return_inverse=True)
            new = missed[at]
            words = [whole[b:e] for b, e in zip(begin[new].tolist(), stop[new].tolist(), strict=True)]
            n = self._distinct(words, _classes()[cp[stop[new] - 1]] == _SPACE)[1]
            out[missed] = n[inverse]
            place = np.where(self.known[upper[new]] == 0, upper[new], lower[new])
            place, one = np.unique(np.where(is_long[new], -1, place), return_index=True)
            one = one[place >= 0]
            self.known[place[place >= 0]], self.n_ids[place[place >= 0]] = of[one], n[one]
        return out

    def _chunks(self, texts: list[str | None], most: int = CHUNK) -> Iterator[list[str]]:
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= most):
                size += len(texts[stop] or "")
                stop += 1
            yield [t or "" for t in texts[at:stop]]
            at = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text has no ids."""
        out: list[bytes] = []
        for chunk in self._chunks(texts):
            ids, where, n, places, ends = self._words(chunk)
            begin, sizes = where[places], n[places]
            after = np.cumsum(sizes)
            flat = ids[np.arange(sizes.sum()) + np.repeat(begin - (after - sizes), sizes)].astype("<u2").tobytes()
            stops = [0, *(2 * np.r_[0, after][ends]).tolist()]
            out += [flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Numbers of ids of texts."""
        out: list[int] = []
        for chunk in self._chunks(texts, COUNTED):
            *words, ends = self._cut(chunk)
            out += np.diff(np.r_[0, np.r_[0, np.cumsum(self._counts(*words))][ends]]).tolist()
        return out


@cache
def counter(path: str) -> Encoder:
    """The one encoder of a worker that only counts: what it keeps is bounded by the vocabulary and the table of counts."""
    return Encoder(path)
