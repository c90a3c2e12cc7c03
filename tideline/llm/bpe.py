"""Ids of whole texts by the library `tokenizers`, with words kept for reuse."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import islice

import numpy as np

#: words kept by a worker in each of two generations, the longest of them, words given to the library at once
_KEPT, _KEPT_CHARS, _AT_ONCE = 600_000, 40, 64
#: what str.isspace() takes, without space and line feed
_WHITE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: a space or line feed between two other characters
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """encode(texts) gives each text's ids, little-endian and unsigned, of `width` bytes each.

    The pattern of byte-level BPE starts a new word at every space or line feed that stands alone between two other characters, so
    a text may be cut there: words are encoded once and looked up after that. Longer white space stays inside a word. Texts with
    an added token of the vocabulary go through the library whole. All texts get the ids that the library gives with
    add_special_tokens=False.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # of ids that begin with a space or line feed
        self.starts[[i for t, i in vocabulary.items() if t[:1] in ("Ġ", "Ċ")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before: words that occur again move on

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _splits(self, text: str) -> list[str] | None:
        """The first word and the others, without their space or with their line feed; None if the text has to stay whole."""
        if not text or any(t in text for t in self.added):
            return None
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n\n" in text or "\n " in text or any(c in text for c in _WHITE):
            head, *rest = _CUT.split(text)
            return [head, *(w[1:] if w[0] == " " else w for w in rest)]
        return text.replace("\n", " \n").split(" ")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new words: many of them as one text, cut again where ids begin with the space or line feed before a word."""
        found: dict[str, bytes] = {}
        plain = [w for w in new if " " not in w and "\n" not in w[1:]]
        for words in _parts(plain, _AT_ONCE):
            ids = np.array(self.library.encode_batch_fast(["".join([w if w[0] == "\n" else " " + w for w in words])], add_special_tokens=False)[0].ids, self.kind)
            at, whole = (np.flatnonzero(self.starts[ids]) * self.width).tolist(), ids.tobytes()
            at.append(len(whole))
            found.update(zip(words, [whole[a:b] for a, b in zip(at, islice(at, 1, None))], strict=True))
        if len(plain) < len(new):
            for words in _parts([w for w in new if " " in w or "\n" in w[1:]], _AT_ONCE):
                found.update(zip(words, self._library([w if w[0] == "\n" else " " + w for w in words]), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > _KEPT:
            self.words, self.older = {}, self.words
        cut = [self._splits(t) for t in texts]
        heads = self._heads([words.pop(0) if words else None for words in cut])
        found = [list(map(self.words.get, words)) if words else [] for words in cut]
        gaps = [[k for k, ids in enumerate(known) if ids is None] for known in found]
        missed = {words[k] for words, at in zip(cut, gaps, strict=True) for k in at}
        new = {w: self.older[w] for w in missed if w in self.older}
        new.update(self._learn([w for w in missed if w not in new]))
        self.words.update(new if not new or max(map(len, new)) <= _KEPT_CHARS else {w: ids for w, ids in new.items() if len(w) <= _KEPT_CHARS})
        out = []
        for text, head, words, known, at in zip(texts, heads, cut, found, gaps, strict=True):
            for k in at:
                known[k] = new[words[k]]
            out.append(self._library([text])[0] if head is None else head + b"".join(known))
        return out

    def _heads(self, words: list[str | None]) -> list[bytes | None]:
        known = sorted({w for w in words if w is not None})
        ids = dict(zip(known, self._library(known), strict=True))
        return [ids.get(w) for w in words]


def _parts(items: list, n: int) -> Iterable[list]:
    for at in range(0, len(items), n):
        yield items[at : at + n]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The encoder of a vocabulary; a worker keeps it, with its words, from task to task."""
    path = path or vocabulary_file()
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
