"""Token ids of whole texts by a word-level BPE file of the tokenizers library.

The tokenizer drops white space and never joins across it, so the ids of a text are the ids of
its white-space-separated chunks in order. Chunks repeat, so each worker keeps the ids of those
it has met, up to ``CACHE`` of them (or as many as the caller says), and sends only new ones to the library.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np

from .common import held

#: Chunks whose ids a worker keeps.
CACHE = 300_000
#: Lower-case letters up to U+024F, all of category L: what the splitter keeps whole. Other scripts, numbers and signs go to the library.
LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u024f]+")
PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u024f]+[.,]")
SEPARATORS = re.compile(r"[\x1c-\x1f]")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on."""
    rest = iter(range(256, 512))
    return {b: chr(b if 33 <= b < 127 or 161 <= b < 256 and b != 173 else next(rest)) for b in range(256)}


BYTE_CHARS = _byte_chars()


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > 99 else struct.pack(f"<{len(ids)}I", *ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str, most: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most, self.cache = most, {}
        #: Heads of the added tokens, in any case that lowering could turn into one of them.
        self.added = {t.content[:1] + t.content[1:2] for t in self.tok.get_added_tokens_decoder().values()}
        #: By one letter run and one point or comma, ids are those of the two apart, if the file splits there.
        self.ends = {c: pack(self._ids(c)) for c in ".,"}
        self.splits = all(self._ids(f"ab{c}") == self._ids("ab") + self._ids(c) for c in ".,")

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case letter run in NFC: the normaliser and splitter leave it whole, so only the library's BPE runs."""
        return pack([t.id for t in self.tok.model.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARS))])

    def _learn(self, chunks: set[str], plain: bool) -> None:
        """plain: the chunks come from a lower-case text in NFC."""
        cache = self.cache
        if len(cache) + len(chunks) > self.most:
            cache.clear()
        rest = []
        for w in chunks:
            if plain and LETTERS.fullmatch(w):
                cache[w] = self._word(w)
            elif plain and self.splits and PLAIN.fullmatch(w):
                core = w[:-1]
                ids = cache.get(core)
                if ids is None:
                    ids = cache[core] = self._word(core)
                cache[w] = ids + self.ends[w[-1]]
            else:
                rest.append(w)
        if rest:
            for i in range(0, len(rest), 4096):  # an encoding takes far more memory than its ids
                some = rest[i : i + 4096]
                for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    cache[w] = pack(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            # Lower case first, where that can't change what the tokenizer makes of it: its added tokens are matched before it lowers.
            own = any(t in text for t in self.added)
            plain = not own and text.isascii()
            if plain:
                text = text.lower()
            elif not own and "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
                low = text.lower()
                if len(low) == len(text) and unicodedata.is_normalized("NFC", low):
                    plain, text = True, low
            # Python also splits at 1C to 1F, which the tokenizer takes for signs.
            words = text.split() if not SEPARATORS.search(text) else re.split(r"[ \t\n\r\x0b\x0c]+", text)
            ids = list(map(self.cache.get, words))
            if None in ids:
                self._learn({w for w, x in zip(words, ids, strict=True) if x is None}, plain)
                ids = [x if x is not None else self.cache[w] for w, x in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
        return out


def encoder(path: str, most: int = CACHE) -> Encoder:
    return held(("encoder", path, most), lambda: Encoder(path, most))
