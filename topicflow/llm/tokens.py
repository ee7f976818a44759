"""Token ids of whole texts, with every distinct chunk of text encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core already

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
CACHED_CHUNKS = 1_000_000
"""Chunks of each kind, with and without a space before, that a worker process remembers (about 200 MB)."""
LONG_CHUNK = 200
"""Characters from which a chunk is encoded but not remembered."""
# White space as the tokenizer's own pattern understands it (Unicode property White_Space): fixed values.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The pattern that cuts a text where the tokenizer's own pattern always cuts: before a word with its one leading space.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# White space other than the space and the line feed, rarest in most texts.
_RARE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, the same as encoding each text as a whole.

    A byte-level vocabulary splits text into words before it merges bytes, and never merges across these splits, so
    the ids of a text are the ids of its chunks in a row.  Strings of added tokens, special ones too, are taken out first, as the tokenizer does.
    """

    def __init__(self, vocabulary: str):
        self._tokenizer = Tokenizer.from_file(vocabulary)
        added = self._tokenizer.get_added_tokens_decoder()
        self._added = {t.content: array("I", [number]).tobytes() for number, t in added.items()}
        # the longest first, as the tokenizer takes the longest that begins at a place
        longest = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        # tokens that take in spaces around them or look at what is next to them: only the tokenizer can tell where they are
        self._plain = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        self._caches: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        # byte-level vocabularies write every byte as a visible character: the printable ones as they are, the others
        # in order from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self._visible = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self._marks = {m: array("I", self._tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,!?;:"}

    def _learn(self, missing: dict[str, set[str]]) -> dict[str, dict[str, bytes]]:
        """Ids of chunks that are not remembered, by the text before them; they are remembered while there is room.

        The chunks met first stay, and those are the frequent ones.
        """
        learned: dict[str, dict[str, bytes]] = {}
        tokenize = self._tokenizer.model.tokenize
        for lead, chunks in missing.items():
            found, other = {}, []
            for chunk in chunks:
                # letters alone are one word, which goes to the merges directly, and one mark after them is another
                mark = self._marks.get(chunk[-1:])
                core = chunk if mark is None else chunk[:-1]
                if core.isalpha() and len(core) <= LONG_CHUNK:
                    written = (lead + core).encode("utf-8", "surrogatepass").decode("latin-1").translate(self._visible)
                    ids = array("I", [t.id for t in tokenize(written)]).tobytes()
                    found[chunk] = ids if mark is None else ids + mark
                else:
                    other.append(chunk)
            for chunk, encoded in zip(other, self._tokenizer.encode_batch_fast([lead + c for c in other], add_special_tokens=False)):
                found[chunk] = array("I", encoded.ids).tobytes()
            cache = self._caches[lead]
            if len(cache) + len(found) <= CACHED_CHUNKS:
                cache.update((c, i) for c, i in found.items() if len(c) <= LONG_CHUNK)
            learned[lead] = found
        return learned

    def ends_sentence(self) -> np.ndarray:
        """By id, whether its characters end a sentence or a line."""
        vocabulary = self._tokenizer.get_vocab()
        found = np.zeros(max(vocabulary.values()) + 1, bool)
        for written, number in vocabulary.items():
            found[number] = written.endswith((".", "!", "?", self._visible[10]))
        return found

    @staticmethod
    def _chunked(text: str) -> list[tuple[str, list[str]]]:
        """The chunks of a text in order, with the text that goes before each."""
        # (searching for one string after the other is faster than a pattern with all of them)
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n " in text or "\n\n" in text or any(c in text for c in _RARE):
            return [("", _CHUNK.findall(text))]
        # single spaces between words and single line feeds between lines: the split by built-in methods is the same
        parts: list[tuple[str, list[str]]] = []
        for line in text.split("\n"):
            first, *others = line.split(" ")
            parts += [("", ["\n", first] if parts else [first]), (" ", others)]
        return parts

    def _pieces(self, text: str) -> list[tuple[str | None, list[str] | bytes]]:
        """The chunks of a text as from `_chunked`; where an added token is, None and ids."""
        if not any(mark in text for mark in self._added):
            return self._chunked(text)
        if not self._plain:
            return [(None, array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes())]
        pieces: list[tuple[str | None, list[str] | bytes]] = []
        for k, part in enumerate(self._split.split(text)):
            if k % 2:
                pieces.append((None, self._added[part]))
            elif part:
                pieces += self._chunked(part)
        return pieces

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of the whole texts (none for null), four bytes each."""
        caches = self._caches
        missing: dict[str, set[str]] = {}
        found: list[list] = []
        for text in texts:
            parts: list = []
            for lead, chunks in self._pieces(text) if text else ():
                if lead is None:
                    parts.append(chunks)
                    continue
                ids = list(map(caches[lead].get, chunks))
                try:
                    parts.append(b"".join(ids))
                except TypeError:  # a chunk that is not known
                    parts.append((lead, chunks, ids))
                    missing.setdefault(lead, set()).update([c for c, i in zip(chunks, ids) if i is None])
            found.append(parts)
        learned = self._learn(missing)
        out = []
        for parts in found:
            for k, part in enumerate(parts):
                if type(part) is tuple:
                    lead, chunks, ids = part
                    own = learned[lead]
                    parts[k] = b"".join([own[c] if i is None else i for c, i in zip(chunks, ids)])
            out.append(b"".join(parts))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder of this vocabulary, which outlives a task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode_column(texts: list[str | None], vocabulary: str, batch: int = 64) -> Iterator[bytes]:
    """Ids of the texts in order, a few texts at a time, so that memory follows the longest of them."""
    own = encoder(vocabulary)
    for start in range(0, len(texts), batch):
        yield from own.encode(texts[start : start + batch])


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt out by ranges of doc_id and sorted in each; nulls last, equal ids by their text."""
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_last(), tie.asc()]
    return docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
