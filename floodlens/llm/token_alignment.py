"""Cross-tokenizer alignment: which tokens of a byte-level BPE vocabulary (A) and of a piece model
with byte fallback (B) cover the same bytes of a text.

Both tokenizers report where their tokens end: A in characters, B in bytes (the spans of the
proto; the installed release has given up the immutable form). These spans are the coarse cuts. Inside a character that several tokens share, and for byte-fallback tokens, the cuts
are refined with the lengths of the decoded bytes. Places where a token of either side ends cut
the tokens into groups, and all A-B token pairs of a group are linked.

A text is taken apart where a blank or line end follows another character, and where punctuation
follows a letter; no token of either vocabulary crosses such a place (checked when the files are
loaded). The parts, called units, are few and come again, so each is aligned once per task, in
batches, and remembered up to a fixed number. A batch is encoded in blocks of many units.

A pair of ids counts the documents that hold it linked. Tasks send one row per pair and chunk of
texts; the counts return to the chunks by a join, so no table of all pairs is in one place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from floodlens.llm.bpe import Spelling, byte_letters
from floodlens.llm.words import row_pieces
from floodlens.session import staged

REMEMBERED = 400_000        # units a task remembers
BLOCK = 500                 # units encoded as one string
CHUNK_BYTES = 12 << 20      # text whose pairs are counted together
WIDE_GROUP = 1 << 12        # links of a group above which ids are counted before they are paired
_MARK = r"[!-/:-@\[-`{-~]"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: A unit begins with a blank or line end behind another character, or a mark behind a letter.
UNIT = re.compile(rf"(?:[ \n]\s*|{_MARK})"
                  rf"(?:[^\s!-/:-@\[-`{{-~]++|(?<!{_LETTER}){_MARK}|[^\S \n]\s*+)*+")
_CROSSING = re.compile(rf"[^ ][ \n]|.\n|{_LETTER}{_MARK}")
#: A known character in front of a unit, so that the piece model adds its blank there.
LEAD = "a"

COLUMNS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")


class ByteTokens:
    """Vocabulary A: ids, character offsets and bytes of its tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        self.codec = Tokenizer.from_file(path)
        self.codec.encode_special_tokens = True
        self.codec.no_truncation()
        self.codec.no_padding()
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            ids = json.load(file)["model"]["vocab"]
        bytes_of = {i: bytes(letters[c] for c in token) if all(c in letters for c in token)
                    else token.encode() for token, i in ids.items()}
        self.spelling = Spelling([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)])

    def encode(self, blocks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and character ends of the tokens of all strings, and how many each has."""
        found = self.codec.encode_batch(blocks, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], dtype=np.int64)
        ends = np.array([end for e in found for _, end in e.offsets], dtype=np.int64)
        return ids, ends, np.array([len(e) for e in found], dtype=np.int64)


class PieceTokens:
    """Model B: ids, byte spans and bytes of its pieces."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                spelled.append(b"")
            else:
                text = piece.replace("▁", " ")
                if _CROSSING.search(text):
                    raise ValueError(f"piece {piece!r} crosses a place where texts are cut")
                spelled.append(text.encode())
        self.spelling = Spelling(spelled)
        lead = self.model.encode(LEAD)
        if len(lead) != 1 or spelled[lead[0]] != f" {LEAD}".encode():
            raise ValueError(f"{LEAD!r} is not a piece of its own")

    def encode(self, blocks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte ends of the pieces of all strings, and how many each has."""
        ids: list[int] = []
        ends: list[int] = []
        counts = []
        for found in self.model.encode([LEAD + block for block in blocks], return_type="proto",
                                       num_threads=1):
            pieces = found.pieces[1:]
            ids.extend([p.id for p in pieces])
            ends.extend([p.end for p in pieces])
            counts.append(len(pieces))
        return (np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64) - len(LEAD),
                np.array(counts, dtype=np.int64))


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def refined_ends(span_ends: np.ndarray, lengths: np.ndarray, unit: np.ndarray, base: np.ndarray
                 ) -> np.ndarray:
    """Byte end of every token. A span's end stands where the decoded bytes since the beginning of
    the unit reach exactly to it; where spans are ragged (tokens that share a character, byte
    fallback), the place that the decoded bytes reach is the end."""
    reach = np.cumsum(lengths)
    counts = np.bincount(unit, minlength=len(base) - 1)
    before = np.append(0, reach)[_begins(counts)[:-1]]
    reach += np.repeat(base[:-1] - before, counts)
    return np.where(span_ends == reach, span_ends, reach)


def _byte_ends(blocks: list[str], char_ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ends in bytes for ends in characters."""
    flat = np.frombuffer("".join(blocks).encode(), dtype=np.uint8)
    starts = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))  # of each character
    chars = _begins(np.array([len(b) for b in blocks], dtype=np.int64))[:-1]
    return starts[np.repeat(chars, counts) + char_ends] - np.repeat(starts[chars], counts)


def blocks_of(units: list[str]) -> tuple[list[str], list[str]]:
    """The units in the order in which they are encoded, and the strings that are encoded. Units
    that begin with white space can follow any that end with something else."""
    joined = [u for u in units if u[0] in " \n" and not u[-1].isspace()]
    alone = [u for u in units if not (u[0] in " \n" and not u[-1].isspace())]
    return joined + alone, ["".join(joined[i:i + BLOCK])
                            for i in range(0, len(joined), BLOCK)] + alone


class Aligned:
    """Units aligned so far, in flat arrays; a unit is known by its number."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED) -> None:
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.width = len(self.b.spelling.sizes)  # a pair of ids is a * width + b
        # Every id as a numeral, followed by a comma, or by what ends its side of a group.
        ids = max(len(self.a.spelling.sizes), self.width)
        self.numerals = Spelling([b"%d%c" % (i, c) for i in range(ids) for c in b",|;"])
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sizes = np.empty((0, 5), dtype=np.int64)   # n_a, n_b, n_groups, n_links, whole
        self.pairs = [np.empty(0, dtype=np.int64)] * 2  # distinct pairs of all units, and times
        self.begins = np.zeros(1, dtype=np.int64)

    def learn(self, units: set[str]) -> None:
        """Align all units that are not remembered, in one batch."""
        new = units.difference(self.number)
        if len(self.number) + len(new) > self.remembered:
            self.forget()
            new = units
        if new:
            self._add(list(new))

    def _add(self, units: list[str]) -> None:
        units, blocks = blocks_of(units)
        raw = [u.encode() for u in units]
        base = _begins(np.array([len(r) for r in raw], dtype=np.int64))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        block_base = _begins(np.array([len(b.encode()) for b in blocks], dtype=np.int64))[:-1]
        whole = np.ones(len(units), dtype=bool)
        sides = []
        for side in (self.a, self.b):
            ids, ends, counts = side.encode(blocks)
            if side is self.a:
                ends = _byte_ends(blocks, ends, counts)
            ends += np.repeat(block_base, counts)
            unit = np.searchsorted(base, ends, "left") - 1  # its first character has one token
            ends = refined_ends(ends, side.spelling.sizes[ids], unit, base)
            whole &= self._given_back(side, ids, unit, base, flat)
            sides.append((ids, ends, unit))
        keep_a, keep_b = (whole[unit] for _, _, unit in sides)
        ids_a, at_a, unit_a = (x[keep_a] for x in sides[0])
        ids_b, at_b, unit_b = (x[keep_b] for x in sides[1])
        cuts = at_a[at_b[np.minimum(np.searchsorted(at_b, at_a), len(at_b) - 1)] == at_a] \
            if len(at_b) else at_a[:0]
        group_a, group_b = np.searchsorted(cuts, at_a), np.searchsorted(cuts, at_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b,
                                                                            minlength=len(cuts))
        unit_of = np.searchsorted(base, cuts, "left") - 1  # the unit that a cut lies in or ends
        count = lambda of, weights=None: np.bincount(
            of, weights, len(units)).astype(np.int64)
        sizes = np.stack([count(unit_a), count(unit_b), count(unit_of),
                          count(unit_of, in_a * in_b), whole.astype(np.int64)], axis=1)
        self._describe(ids_a, group_a, ids_b, group_b, in_a, in_b, unit_of, len(units))
        pair_unit, pair, times = self._pairs(ids_a, group_a, ids_b, in_a, in_b, unit_of)
        known = len(self.number)
        self.number.update(zip(units, range(known, known + len(units))))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pairs = [np.concatenate(x) for x in zip(self.pairs, (pair, times))]
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(
            np.bincount(pair_unit, minlength=len(units)))])

    @staticmethod
    def _given_back(side: ByteTokens | PieceTokens, ids: np.ndarray, unit: np.ndarray,
                    base: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Of every unit, whether its tokens decode to its bytes."""
        counts = np.bincount(unit, minlength=len(base) - 1)
        begins = _begins(counts)
        size = _begins(side.spelling.sizes[ids])[begins]
        good = (counts > 0) & (np.diff(size) == np.diff(base))
        if size[-1] == len(flat) and good.all():
            decoded = np.frombuffer(side.spelling.write(ids, begins)[0], dtype=np.uint8)
            return np.add.reduceat(decoded != flat, base[:-1]) == 0 if len(flat) else good
        data, at = side.spelling.write(ids, begins)
        raw = flat.tobytes()
        return good & np.array([data[x:y] == raw[v:w] for x, y, v, w in zip(
            at, at[1:], base.tolist(), base[1:].tolist())])

    def _describe(self, ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray,
                  group_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, unit_of: np.ndarray,
                  units: int) -> None:
        """Add `a1,a2|b1;` of every group, joined by unit."""
        last_a = np.append(group_a[1:] != group_a[:-1], True)[:len(group_a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[:len(group_b)]
        codes = np.concatenate([ids_a * 3 + last_a, ids_b * 3 + 2 * last_b])
        # Tokens of A go before those of B in each group.
        first = _begins(in_a + in_b)
        place_a = first[group_a] + np.arange(len(ids_a)) - _begins(in_a)[group_a]
        place_b = first[group_b] + in_a[group_b] + np.arange(len(ids_b)) - _begins(in_b)[group_b]
        ordered = np.empty(len(codes), dtype=np.int64)
        ordered[np.concatenate([place_a, place_b])] = codes
        tokens = np.bincount(unit_of, in_a + in_b, units).astype(np.int64)
        data, at = self.numerals.write(ordered, _begins(tokens))
        self.groups.extend(data[x:y] for x, y in zip(at, at[1:]))

    def _pairs(self, ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray,
               in_b: np.ndarray, unit_of: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, times) of all links, sorted by unit and pair."""
        first_a, first_b = _begins(in_a), _begins(in_b)
        wide = in_a * in_b > WIDE_GROUP
        usual = ~wide[group_a]
        each = in_b[group_a][usual]
        row = np.repeat(np.arange(len(each)), each)
        b_at = first_b[group_a][usual][row] + np.arange(len(row)) - _begins(each)[row]
        unit = [unit_of[group_a][usual][row]]
        pair = [ids_a[usual][row] * self.width + ids_b[b_at]]
        times = [np.ones(len(row), dtype=np.int64)]
        for g in np.flatnonzero(wide):  # such as a long run that the two sides cut apart nowhere
            a, n = np.unique(ids_a[first_a[g]:first_a[g + 1]], return_counts=True)
            b, m = np.unique(ids_b[first_b[g]:first_b[g + 1]], return_counts=True)
            pair.append((a[:, None] * self.width + b).ravel())
            times.append((n[:, None] * m).ravel())
            unit.append(np.full(len(a) * len(b), unit_of[g]))
        return _summed(np.concatenate(unit), np.concatenate(pair), np.concatenate(times),
                       self.width * len(self.a.spelling.sizes))


def _summed(major: np.ndarray, minor: np.ndarray, times: np.ndarray | None, width: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (major, minor), sorted, with the sum of their times (of ones, if there are none);
    minor is below `width`."""
    keys = major * width + minor
    if times is None:
        keys, times = np.unique(keys, return_counts=True)
    elif len(keys):
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, times = keys[new], np.add.reduceat(times[order], new)
    return keys // width, keys % width, times


def align_texts(known: Aligned, texts: list[str | None]
                ) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text: n_a, n_b, n_groups and n_links, the digest of its groups, and (text number,
    pair, times) of all its links. A text that one side does not give back byte by byte has no
    tokens."""
    units = [UNIT.findall(" " + text) if text else [] for text in texts]
    known.learn(set().union(*units))
    counts = np.array([len(u) for u in units], dtype=np.int64)
    of_unit = np.fromiter(map(known.number.__getitem__, chain.from_iterable(units)), np.int64,
                          counts.sum())
    row = np.repeat(np.arange(len(texts)), counts)
    broken = np.bincount(row, known.sizes[of_unit, 4] == 0, len(texts)) > 0
    sizes = np.stack([np.bincount(row, known.sizes[of_unit, k], len(texts)).astype(np.int64)
                      for k in range(4)], axis=1)
    sizes[broken] = 0
    digests = []
    at = _begins(counts).tolist()
    for i in range(len(texts)):
        if broken[i] or at[i] == at[i + 1]:
            digests.append("")
            continue
        groups = b"".join(map(known.groups.__getitem__, of_unit[at[i]:at[i + 1]].tolist()))
        digests.append(hashlib.sha256(groups[:-1]).hexdigest())
    keep = ~broken[row]
    row, unit, times = _summed(row[keep], of_unit[keep], None, len(known.number) + 1)
    each = (known.begins[1:] - known.begins[:-1])[unit]
    of = np.repeat(np.arange(len(unit)), each)
    place = known.begins[unit][of] + np.arange(len(of)) - _begins(each)[of]
    return sizes, digests, _summed(row[of], known.pairs[0][place],
                                   known.pairs[1][place] * times[of],
                                   known.width * len(known.a.spelling.sizes))


_STORED = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
    ("place", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64())])
_STORED_DDL = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
               "groups_sha256 string, places array<int>, times array<long>, place int, "
               "pair long, docs long")


class _Chunk:
    """Texts whose pairs are numbered and counted together."""

    def __init__(self) -> None:
        self.bytes = 0
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.digests: list[str] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, size: int, found: tuple) -> None:
        sizes, digests, (row, pair, times) = found
        self.links.append((row + len(self.digests), pair, times))
        self.bytes += size
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.digests.extend(digests)

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The texts with numbers instead of pairs, and then the pairs."""
        row, pair, times = (np.concatenate(x) for x in zip(*self.links))
        distinct, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
        n = len(self.digests)
        offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        sizes = np.concatenate(self.sizes)
        for batch in pa.Table.from_arrays(
                [pa.array(np.full(n, chunk)), pa.concat_arrays(self.ids),
                 *[pa.array(sizes[:, k]) for k in range(4)], pa.array(self.digests, pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(times)),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                schema=_STORED).to_batches(1024):
            yield batch
        m = len(distinct)
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, chunk)), *[pa.nulls(m, f.type) for f in list(_STORED)[1:9]],
                 pa.array(np.arange(m, dtype=np.int32)), pa.array(distinct), pa.array(docs)],
                schema=_STORED)


def _stored(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """Rows of texts and rows of pairs (place is not null), by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = Aligned(a_path, b_path), _Chunk()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, data, _ in row_pieces(batch, "text", 2 << 20):
                chunk.add(part.column("doc_id"), len(data),
                          align_texts(known, part.column("text").to_pylist()))
                if chunk.bytes >= chunk_bytes:
                    yield from chunk.rows(number)
                    chunk, number = _Chunk(), number + 1
        if chunk.digests:
            yield from chunk.rows(number)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _STORED_DDL)


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) from (pair, docs): documents that hold the pair, and whether no pair of
    the same A id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    a = F.expr(f"pair div {width}")
    most = F.max("count").over(Window.partitionBy(a))  # at most one row per id of B
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_a and n_b (tokens), n_groups, n_links,
    n_best (links whose pair is, of all pairs of its A id, in the most documents; ties too),
    count_sum (documents that hold the pair, over links), groups_sha256.

    Null and empty texts, and texts that either side does not give back byte by byte behind a
    blank, have zeros and an empty digest. Repeated rows are documents of their own, a null id
    passes through, other columns play no part, and an empty table gives an empty result. The two
    vocabulary files must be readable at their paths on every worker.
    """
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    stored = staged(_stored(docs, a_path, b_path, chunk_bytes), "aligned")
    places = stored.where("place is not null").select("chunk", "place", "pair", "docs")
    counted = (places.selectExpr("chunk as of_chunk", "place", "pair")
               .join(pair_counts(places, width), "pair")
               .select("of_chunk", "place", "count", "best"))
    texts = stored.where("place is null").select(
        "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "places", "times",
        "groups_sha256")

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("place").to_numpy())
        count = counts.column("count").to_numpy()[order]
        best = counts.column("best").to_numpy()[order].astype(np.int64)
        sums = []
        for batch in rows.to_batches():
            lists, times = batch.column("places"), batch.column("times").flatten().to_numpy()
            place = lists.flatten().to_numpy()
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums.append([np.diff(np.append(0, np.cumsum(v[place] * times))[at])
                         for v in (best, count)])
        n_best, count_sum = (np.concatenate(s) if sums else np.empty(0, np.int64)
                             for s in (zip(*sums) if sums else ((), ())))
        return pa.table({name: rows.column(name) for name in (
            "doc_id", "n_a", "n_b", "n_groups", "n_links")} | {
            "n_best": n_best, "count_sum": count_sum,
            "groups_sha256": rows.column("groups_sha256")})

    chunks = max(1, texts.select("chunk").distinct().count())  # about one to a task at any size
    return (texts.repartition(chunks, "chunk").groupBy("chunk")
            .cogroup(counted.repartition(chunks, "of_chunk").groupBy("of_chunk"))
            .applyInArrow(run, COLUMNS))
