"""Byte-pair encoding of whole texts, with the halves of long unsplit pieces encoded apart and joined again."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from topicflow.session import materialize

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core already

DEFAULT_VOCABULARY = "word_bpe_49k.json"
LONG = 4096
"""Symbols from which an unsplit piece of text is encoded in parts."""
LEAF = 1024
"""Most symbols of a part."""
FAN_IN = 16
"""Neighbouring parts that one task joins, in pairs; their results are joined in the next round."""
FIRST_WINDOW = 4
"""Tokens on each side of a join that are encoded again at first."""
CACHED_CHUNKS = 1_000_000
"""Chunks between white space that a worker process remembers."""
LONG_CHUNK = 200
"""Bytes from which a chunk is encoded but not remembered."""
ROWS = 64
"""Texts that are encoded together, so that memory follows the longest of them."""
_SLICE = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


class WordEncoder:
    """Ids of texts, as encoding each text as a whole, for vocabularies whose pre-tokenizer drops white space.

    White space ends every piece that is merged, and neither normalizing nor an added token reaches over it, so the ids of
    a text are those of its chunks between ASCII white space in a row.
    """

    def __init__(self, vocabulary: str):
        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        added = self._tokenizer.get_added_tokens_decoder().values()
        blank = " \t\n\x0b\f\r"
        dropped = self._tokenizer.pre_tokenizer and not self._tokenizer.pre_tokenizer.pre_tokenize_str(blank)
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or set(t.content) & set(blank) for t in added)
        if model["type"] != "BPE" or not dropped or not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("the vocabulary must be a plain BPE whose pre-tokenizer drops white space")
        self._suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._ending = self._tokenizer.model
        # for a part that is not the end of its piece, the same merges without the mark of an end
        self._inner = models.BPE(vocab=model["vocab"], merges=merges)
        self._symbols = np.full(self._tokenizer.get_vocab_size(), "", object)
        for symbol, number in self._tokenizer.get_vocab().items():
            self._symbols[number] = symbol
        self._added = sorted((t.content for t in added), key=len, reverse=True)
        self._cache: dict[bytes, bytes] = {}
        # byte-level vocabularies write every byte as a visible character: printable ones as they are, others from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self._visible = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in visible)}
        marks = {m: array("I", self._tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,!?;:"}
        self._marks = marks if self._plain_words() else None

    def _plain_words(self) -> bool:
        """Whether a word of Latin letters goes to the merges as its lower-case bytes and a mark after it apart."""
        probe = self._tokenizer.normalizer.normalize_str("ÉaZ,") if self._tokenizer.normalizer else ""
        found = [p for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        return found == [self._bytes("éaz"), ","]

    def _bytes(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self._visible)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of the whole texts in UTF-8 as little-endian unsigned 32-bit integers."""
        cache = self._cache
        out = []
        for text in texts:
            parts = []
            for chunks in _chunks(text):
                ids = list(map(cache.get, chunks))
                missing = list({c for c, i in zip(chunks, ids) if i is None})
                if missing:
                    found = self._learn(missing)
                    ids = [found[c] if i is None else i for c, i in zip(chunks, ids)]
                parts.append(b"".join(ids))
            out.append(b"".join(parts))
        return out

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        found, other = {}, []
        tokenize = self._ending.tokenize
        for chunk in chunks:
            word = chunk.decode("utf-8", "replace")
            mark = self._marks.get(word[-1], b"") if self._marks else b""
            lower = (word[:-1] if mark else word).lower()
            # letters that normalizing leaves alone, but for their case
            if self._marks and len(word) <= LONG_CHUNK and lower.isalpha() and max(word) < "\u0250" and len(lower) + bool(mark) == len(word):
                found[chunk] = array("I", [t.id for t in tokenize(self._bytes(lower))]).tobytes() + mark
            else:
                other.append(chunk)
        encoded = self._tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in other], add_special_tokens=False)
        found.update((c, array("I", e.ids).tobytes()) for c, e in zip(other, encoded))
        if len(self._cache) + len(found) <= CACHED_CHUNKS:
            self._cache.update((c, i) for c, i in found.items() if len(c) <= LONG_CHUNK)
        return found

    def pieces(self, text: bytes) -> Iterator[bytes | str]:
        """The text in order: ids of what lies between long unsplit pieces, and the symbols of each of those."""
        ids: list[bytes] = []
        for chunks in _chunks(text):
            for chunk in chunks:
                if len(chunk) <= LONG:
                    ids += self.encode([chunk])
                    continue
                for part in _split_at(chunk.decode("utf-8", "replace"), self._added):
                    if part in self._added:
                        ids.append(array("I", [self._tokenizer.token_to_id(part)]).tobytes())
                        continue
                    written = self._tokenizer.normalizer.normalize_str(part) if self._tokenizer.normalizer else part
                    for piece, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(written):
                        if len(piece) <= LONG:
                            ids.append(self.merged(piece, True).tobytes())
                            continue
                        yield b"".join(ids)
                        ids = []
                        yield piece
        yield b"".join(ids)

    def merged(self, symbols: str, ends: bool) -> np.ndarray:
        """Ids of a run of symbols; `ends` tells whether its piece ends there."""
        model = self._ending if ends else self._inner
        return np.fromiter((t.id for t in model.tokenize(symbols)), "<u4")

    def _written(self, ids: np.ndarray, ends: bool) -> str:
        symbols = "".join(self._symbols[ids].tolist())
        return symbols.removesuffix(self._suffix) if ends else symbols

    def joined(self, left: np.ndarray, right: np.ndarray, ends: bool) -> np.ndarray:
        """Ids of the text of `left` and `right`, which are the ids of neighbouring parts of a piece.

        Merges are made by rank, then place, so a row of tokens is the encoding of its text if and only if every two
        neighbours in it are that of theirs: as long as no merge crosses their border, what happens between two borders
        is what happens there alone.  The window around the join is encoded anew, and grows until its first and last
        tokens are those that stood there before (or it has reached the part's end); then all neighbours are such pairs,
        within the window as it is an encoding, at its ends and beyond as they were neighbours in a part.
        """
        take = FIRST_WINDOW
        while True:
            first, last = max(0, len(left) - take), min(len(right), take)
            at_end = last == len(right)
            text = self._written(left[first:], False) + self._written(right[:last], ends and at_end)
            window = self.merged(text, ends and at_end)
            if (not first or window[0] == left[first]) and (at_end or window[-1] == right[last - 1]):
                return np.concatenate([left[:first], window, right[last:]])
            take *= 2

    def concatenated(self, parts: list[np.ndarray], ends: bool) -> np.ndarray:
        """Neighbouring parts of a piece, joined in pairs until one is left."""
        while len(parts) > 1:
            paired = [self.joined(parts[k], parts[k + 1], ends and k + 2 == len(parts)) for k in range(0, len(parts) - 1, 2)]
            parts = paired + parts[2 * len(paired) :]
        return parts[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text the tokenizer gives for the ids, special ones included."""
        if self._tokenizer.decoder is None:  # tokens as they are, a space between them
            return " ".join(self._symbols[ids].tolist())
        return self._tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def _chunks(text: bytes) -> Iterator[list[bytes]]:
    """What stands between ASCII white space, about a megabyte of text at a time."""
    start = 0
    while len(text) - start > _SLICE:
        cut = text.find(b" ", start + _SLICE)
        if cut < 0:
            break
        yield text[start:cut].split()
        start = cut
    yield text[start:].split() if start else text.split()


def _split_at(text: str, marks: list[str]) -> list[str]:
    """The text cut before and after each mark; of marks that begin at one place the longest counts."""
    parts, start, at = [], 0, 0
    places = {m: text.find(m) for m in marks}
    while any(p >= 0 for p in places.values()):
        at = min(p for p in places.values() if p >= 0)
        mark = next(m for m in marks if places[m] == at)
        parts += [text[start:at], mark]
        start = at + len(mark)
        places = {m: p if p >= start or p < 0 else text.find(m, start) for m, p in places.items()}
    return [p for p in [*parts, text[start:]] if p]


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder of this vocabulary, which outlives a task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def _ids(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_py() or b"", "<u4")


def _plain(docs: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                rows = batch.slice(start, ROWS)
                ids = own.encode(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _in_parts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Texts with long unsplit pieces: the pieces are cut into halves, quarters and so on, which are dealt out and joined."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        names = ["row", "doc_id", "place", "part", "parts", "ids", "symbols"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for k in range(len(batch)):
                row, doc_id = batch.column("row")[k].as_py(), batch.column("doc_id")[k].as_py()
                for place, piece in enumerate(own.pieces(batch.column("text")[k].as_py())):
                    if isinstance(piece, bytes):
                        found = [(row, doc_id, place, 0, 1, piece, None)]
                    else:
                        parts = 1 << (-(-len(piece) // LEAF) - 1).bit_length()
                        found = [(row, doc_id, place, p, parts, None, piece[p * len(piece) // parts : (p + 1) * len(piece) // parts]) for p in range(parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), kinds)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            rows = zip(batch.column("symbols").to_pylist(), batch.column("part").to_pylist(), batch.column("parts").to_pylist())
            ids = pa.array([own.merged(s, p + 1 == n).tobytes() for s, p, n in rows], pa.binary())
            at = batch.schema.get_field_index("ids")
            yield batch.set_column(at, batch.schema.field(at), ids).drop_columns("symbols")

    def concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            rows = zip(batch.column("found").to_pylist(), batch.column("part").to_pylist(), batch.column("parts").to_pylist())
            ids = [own.concatenated([np.frombuffer(x["ids"], "<u4") for x in found], p + 1 == n).tobytes() for found, p, n in rows]
            at = batch.schema.get_field_index("found")
            yield batch.set_column(at, pa.field("ids", pa.binary()), pa.array(ids, pa.binary()))

    key = "row long, doc_id long, place long, part long, parts long"
    # rows are told apart by a number of their own, which a written table keeps
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    pieces = materialize(docs.mapInArrow(cut, f"{key}, ids binary, symbols string"), "pieces")
    whole = pieces.filter("symbols IS NULL").select("row", "doc_id", "place", "ids")
    parts = pieces.filter("symbols IS NOT NULL").repartition("row", "place", "part").mapInArrow(merge, f"{key}, ids binary")
    most = pieces.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        most = -(-most // FAN_IN)
        upper = parts.withColumn("_part", F.floor(F.col("part") / FAN_IN)).withColumn("_parts", F.ceil(F.col("parts") / FAN_IN))
        found = F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("found")
        upper = upper.groupBy("row", "doc_id", "place", F.col("_part").alias("part"), F.col("_parts").alias("parts")).agg(found)
        parts = upper.mapInArrow(concatenate, f"{key}, ids binary")
    placed = whole.unionByName(parts.select("row", "doc_id", "place", "ids"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "ids")))
    ids = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x.ids)), ""))
    return placed.groupBy("row", "doc_id").agg(ids.alias("ids")).select("doc_id", "ids")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of `docs`: ids of the whole text as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library without added special tokens, truncation and padding.  Texts are encoded
    where they lie.  A text with an unsplit piece (a run without a place where the pre-tokenizer cuts) of `LONG` symbols
    or more is taken apart: the piece is halved until its parts have at most `LEAF` symbols, parts are encoded in parallel
    and joined in pairs, at most `FAN_IN` of them in a task, with windows that grow until both sides agree.

    A null or empty text, or one of white space alone, has no ids.  Rows without doc_id and rows that repeat another are
    rows like others; strings of added tokens become their ids.  Other columns are not read.  No rows give no rows.
    """
    name = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # runs are cut only between letters, digits and other marks; a run the test misses is encoded in one part
    run = f"[\\p{{L}}\\p{{M}}]{{{LONG},}}|[^\\s\\p{{L}}\\p{{N}}]{{{LONG},}}"
    long = (F.length("text") >= LONG) & F.col("text").rlike(run)
    data = F.col("text").cast("binary").alias("text")
    in_parts = rows.filter(long).select("doc_id", data)
    return _plain(rows.filter(~long).select("doc_id", data), name).unionByName(_in_parts(in_parts, name))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text) for every row (doc_id, ids): what the tokenizers library decodes, special tokens included.

    Null ids count as none and give an empty text.
    """
    name = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                rows = batch.slice(start, ROWS)
                column = rows.column("ids")
                texts = pa.array([own.decode(_ids(column, k)) for k in range(len(rows))], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), column, texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
