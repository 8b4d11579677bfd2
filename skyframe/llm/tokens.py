"""Token ids of whole texts, by the tokenizers library, as bytes of little-endian unsigned 32-bit integers.

The vocabulary word_bpe_49k.json drops white space and lower-cases before it merges, so that a text's ids are those of its
white-space separated chunks, one after the other. Chunks recur, so each task keeps the ids of those it has met, in a table of
bounded size, and asks the library only for new ones.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

U32 = np.dtype("<u4")
VOCABULARY = "word_bpe_49k.json"
_ENDS = b"""!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"""  # ASCII punctuation but the apostrophe, which may begin a contraction
_shared: dict[str, ChunkEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file is installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ChunkEncoder:
    """Encodes texts chunk by chunk. limit: the most chunks that it remembers."""

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        if "a</w>" not in self.tokenizer.get_vocab():
            raise ValueError(f"{path}: only vocabularies of lower-cased words that end in </w> are supported")
        self.merges = Tokenizer(self.tokenizer.model)
        #: Whether an id ends a word.
        self.last = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.letters = byte_alphabet()

    def __call__(self, text: bytes) -> bytes:
        """The ids of a whole UTF-8 text, 4 bytes each."""
        if b"<|" in text:  # may hold special tokens, whose case and surroundings count
            return self._whole(text.decode())
        words = text.lower().split()  # lower-cases A-Z only; the library does the other letters
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            if len(self.known) > self.limit:
                self.known = {}
            self._learn({w for w in words if w not in self.known})
        return b"".join([self.known[w] for w in words])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, U32).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, pieces, tailed = self.known, {}, []
        for w in new:
            k = w.rstrip(_ENDS)
            stem = k.decode()
            if not (stem.isalpha() and (stem.isascii() or (stem == stem.lower() and unicodedata.is_normalized("NFC", stem)))):
                known[w] = self._whole(w.decode())
                continue
            if k not in known:  # letters alone are one pre-token, which the merges see as it is
                pieces[k] = stem if stem.isascii() else "".join([self.letters[b] for b in k])
            if len(k) < len(w):  # a run of punctuation is a pre-token of its own
                tailed.append((w, k, w[len(k) :]))
        if pieces:
            found = self.merges.encode_batch_fast([list(pieces.values())], is_pretokenized=True, add_special_tokens=False)[0]
            ids, at = np.array(found.ids, U32), 0
            raw = ids.tobytes()
            for k, end in zip(pieces, (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), strict=True):
                known[k] = raw[at:end]
                at = end
        for w, k, tail in tailed:
            if tail not in known:
                known[tail] = self._whole(tail.decode())
            known[w] = known[k] + known[tail]


def encoder(path: str | None = None) -> ChunkEncoder:
    """The encoder of this Python worker; without a path, of the file installed on this machine."""
    key = path or ""
    if key not in _shared:
        _shared[key] = ChunkEncoder(path or vocabulary_path())
    return _shared[key]
