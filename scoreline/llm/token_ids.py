"""Token ids of whole texts by a public tokenizer, with repeated words encoded once.

The vocabulary drops white space and its pre-tokenizer never joins words across it, so a text's
ids are those of its words in turn. `Encoder` keeps the ids of words seen so far in a bounded
dictionary and sends only new ones through the tokenizers library, many in one call.
"""

from __future__ import annotations

import os
from array import array
from functools import cache

import numpy as np

#: Words kept by a worker; beyond that the dictionary starts anew, so memory stays bounded.
KEPT_WORDS = 300_000
#: Stands between words in a call; it is one token by itself, and words that hold it go alone.
MARK = "\x01"
SPECIAL = "<|"


class Encoder:
    """Encodes texts with one tokenizer; equal to its own encoding without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.last: dict[str, bool] = {}
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        mark = self._plain(MARK)
        probe = self._plain(f"a {MARK} b.\tA\nb .")
        #: Whether words can be encoded apart: white space leaves no trace and the mark is one id.
        self.apart = len(mark) == 1 and probe.tolist() == [*self._plain("a"), *mark, *self._plain("b."), *self._plain("A"), *self._plain("b"), *self._plain(".")]
        #: Latin letters as the model sees them: normalised and mapped to the alphabet of bytes. A word
        #: of these alone is one piece to the pre-tokenizer and can go straight to the model.
        self.letters = {}
        for c in map(chr, range(256)):
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c)) if c.isalpha() else ()
            if len(pieces) == 1:
                self.letters[ord(c)] = pieces[0][0]
        self.direct = all([t.id for t in self.tokenizer.model.tokenize(w.translate(self.letters))] == self._plain(w).tolist() for w in ("a", "The", "zyxwvutsrqponmlkjihgfedcba", "QuIcKlY", "\xc9t\xe9", "Stra\xdfen\xe4\xd1"))
        self.mark = int(mark[0]) if len(mark) else -1
        self._ends()

    def _ends(self) -> None:
        self.cores.update((c, self._plain(c).tobytes()) for c in ",.")

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _ends_in_letter(self, c: str) -> bool:
        """Whether the letter c still ends in a letter when normalised: some become one with a combining
        mark (U+0130, Hebrew and Indic presentation forms), which a stop after it joins in one piece."""
        found = self.last.get(c)
        if found is None:
            found = self.last[c] = self.tokenizer.normalizer.normalize_str(c)[-1:].isalpha()
        return found

    def _learn(self, new: set[str]) -> None:
        words, pieces, cores, letters, model = self.words, self.pieces, self.cores, self.letters, self.tokenizer.model.tokenize
        later, kind = [], self.kind
        for w in new:
            end = w[-1]
            if end == "." or end == ",":
                core, stop = w[:-1], cores.get(end, b"")
            else:
                core, stop = w, b""
            if self.direct and core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                # kept by what the model sees, so capitals don't count twice
                piece = core.translate(letters)
                found = pieces.get(piece)
                if found is None:
                    found = pieces[piece] = array(kind, [t.id for t in model(piece)]).tobytes()
                words[w] = found + stop if stop else found
            elif MARK in w or SPECIAL in w:
                words[w] = self._plain(w).tobytes()
            else:
                later.append(w)
        if not later:
            return
        cut = [w[:-1] if w[-1] in ",." and w[:-1].isalpha() and self._ends_in_letter(w[-2]) else w for w in later]
        plain = [*{c for c in cut if c not in cores}]
        runs = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([f" {MARK} ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark).tolist()
            raw, k = ids.tobytes(), self.dtype.itemsize
            for c, s, e in zip(run, [0, *(x + 1 for x in cuts)], [*cuts, len(ids)], strict=True):
                cores[c] = raw[s * k : e * k]
        for w, c in zip(later, cut, strict=True):
            words[w] = cores[c] if w is c or w == c else cores[c] + cores[w[-1]]

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """For each text (null: empty) its ids and then the id `end`, as bytes of self.dtype."""
        stop = np.array([end], self.dtype).tobytes()
        if not self.apart:
            return [self._plain(t or "").tobytes() + stop for t in texts]
        # str.split also parts words at these four control characters, which are no white space to the tokenizer
        odd = {i for i, t in enumerate(texts) if t and any(c in t for c in "\x1c\x1d\x1e\x1f")}
        split = [(t or "").split() if i not in odd else [] for i, t in enumerate(texts)]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        if len(self.cores) > KEPT_WORDS:
            self.cores.clear()
            self._ends()
        if len(self.pieces) > KEPT_WORDS:
            self.pieces.clear()
        if new := set().union(*split).difference(self.words):
            self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) + stop if i not in odd else self._plain(texts[i]).tobytes() + stop for i, words in enumerate(split)]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary file."""
    return Encoder(path)
