"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words (pre-tokens) of a batch that were not met before go into one flat array of symbols. In
each round the ranks of all adjacent pairs are found by binary search over the sorted pair keys,
and every word merges its lowest-ranked pair, wherever it occurs in the word, until no word has a
pair left. Ids of met words are remembered per task, up to a fixed number of words.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from floodlens.llm.words import row_pieces, text_bytes

#: Pre-token pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 500_000
_TOP = np.int64(1 << 62)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1),
             *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """A byte string for every id, written out for many ids at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def write(self, ids: np.ndarray, begins: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of all ids in a row, and where row ids[begins[i]:begins[i + 1]] begins."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[source].tobytes(), ends[begins].tolist()


class Vocabulary:
    """A byte-level BPE vocabulary file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters, ids = byte_letters(), described["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)[order]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        bytes_of = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.spelling = Spelling([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)])
        self.splitter = (regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
                         if self.special else None)
        self.words = regex.compile(PATTERN)

    def pieces(self, text: str) -> list[str]:
        """Special tokens and pre-tokens of a text, in order."""
        if self.splitter is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.splitter.split(text)):
            out.extend([part] if i % 2 else self.words.findall(part))
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and where each word begins (one more at the end)."""
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            keys = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = (self.keys[at] == keys) & (word[:-1] == word[1:])
            rank = np.append(np.where(found, self.ranks[at], _TOP), _TOP)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(begins, len(word)))
            lowest = np.minimum.reduceat(rank, begins)
            # Words without a pair are finished and leave the array.
            live = np.repeat(lowest < _TOP, lengths)
            if not live.all():
                done.append((word[~live], symbols[~live]))
                symbols, word, rank = symbols[live], word[live], rank[live]
                at = np.append(at, 0)[live]
                lengths, lowest = lengths[lowest < _TOP], lowest[lowest < _TOP]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == np.repeat(lowest, lengths)
            # Of hits in a row (such as in "aaaa") every second one overlaps the one before it.
            places = np.flatnonzero(hit)
            run = np.append(True, np.diff(places) != 1)
            in_run = np.arange(len(places)) - np.maximum.accumulate(
                np.where(run, np.arange(len(places)), 0))
            places = places[in_run % 2 == 0]
            symbols[places] = self.merged[at[places]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[places + 1] = False
            symbols, word = symbols[stay], word[stay]
        done.append((word, symbols))
        word = np.concatenate([w for w, _ in done])
        ids = np.concatenate([s for _, s in done])[np.argsort(word, kind="stable")]
        counts = np.bincount(word, minlength=len(words))
        return ids, np.concatenate([[0], np.cumsum(counts)])


    def units(self, text: str) -> list[str]:
        """Parts of a text that can be encoded one by one: few different ones, so that most are met
        again. Where all white space is single blanks and line ends, a unit is a blank with the
        run of characters behind it, or a line end; else it is a pre-token."""
        plain = text.replace("\n", " ")
        if "\0" in text or " ".join(text.split()) != plain or any(s in text for s in self.special):
            return self.pieces(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if text else []


class Codec:
    """Encodes and decodes texts, remembering the ids of their units."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.vocabulary = vocabulary
        self.remembered = remembered
        self.ids: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> None:
        """Encode all units that are not remembered, in one batch."""
        new = units.difference(self.ids)
        if len(self.ids) + len(new) > self.remembered:
            self.ids.clear()
            new = units
        special = self.vocabulary.special
        self.ids.update({u: np.array([special[u]], "<u4").tobytes() for u in new if u in special})
        # A run of letters, with a blank or not, is one pre-token; the rest is taken apart.
        words = {u for u in new if u.isalpha() or (u[0] == " " and u[1:].isalpha())}
        findall = self.vocabulary.words.findall
        apart = {u: findall(u) for u in new - words if u not in special}
        words = list(words.union(*apart.values()))
        if words:
            ids, begins = self.vocabulary.merge([w.encode() for w in words])
            flat, ends = ids.astype("<u4").tobytes(), (begins * 4).tolist()
            self.ids.update(zip(words, map(flat.__getitem__, map(slice, ends, ends[1:]))))
        self.ids.update({u: b"".join(map(self.ids.__getitem__, of_unit))
                         for u, of_unit in apart.items()})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        units = [self.vocabulary.units(text) for text in texts]
        self.learn(set().union(*units))
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, of_text)), dtype="<u4")
                for of_text in units]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> list[str]:
        """The texts of rows ids[begins[i]:begins[i + 1]]; bytes that are no UTF-8 become
        replacement characters."""
        data, at = self.vocabulary.spelling.write(ids, begins)
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(at, at[1:])]


Batches = Iterator[pa.RecordBatch]


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and where each row begins; null ids count as none."""
    column = batch.column("ids")
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return (column.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))


def _encoded(batches: Batches, codec: Codec) -> Batches:
    for batch in batches:
        for part, _, _ in row_pieces(batch, "text", 2 << 20):
            arrays = codec.encode([t or "" for t in part.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                           pa.array(np.concatenate(arrays).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids],
                                             names=["doc_id", "ids"])


def _decoded(batches: Batches, codec: Codec) -> Batches:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = codec.decode(*_ids_of(part))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())],
                names=["doc_id", "ids", "decoded"])


def _digested(batches: Batches, codec: Codec) -> Batches:
    numerals = Spelling([b"%d," % i for i in range(len(codec.vocabulary.spelling.sizes))])
    for batch in batches:
        ids, begins = _ids_of(batch)
        data, at = numerals.write(ids, begins)
        of_ids = [hashlib.sha256(data[a:max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]
        texts, at = text_bytes(batch.column("decoded"))
        texts, at = texts.tobytes(), at.tolist()
        of_text = [hashlib.sha256(texts[a:b]).hexdigest() for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(begins)), pa.array(of_ids),
             pa.array(of_text)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row; a null text counts as empty and has no ids.

    Repeated rows stay repeated, a null id passes through, other columns play no part. The
    vocabulary file must be readable at `vocabulary_path` on every worker.
    """

    def run(batches: Batches) -> Batches:
        return _encoded(batches, Codec(Vocabulary(vocabulary_path)))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids and decoded (text) of every row of ids; null ids count as none."""

    def run(batches: Batches) -> Batches:
        return _decoded(batches, Codec(Vocabulary(vocabulary_path)))

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, and SHA-256 of the comma-joined
    decimal ids and of the decoded text. Rows as in `encode`."""

    def run(batches: Batches) -> Batches:
        codec = Codec(Vocabulary(vocabulary_path))
        return _digested(_decoded(_encoded(batches, codec), codec), codec)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
