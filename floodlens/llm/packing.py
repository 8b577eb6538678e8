"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Documents are tokenized where they are read; only lengths travel. Pieces are dealt evenly to
blocks of bounded size and each block is packed by bin completion: depth-first branch and bound
that fills one sequence at a time around the largest piece left, tries the undominated fillings
with the least waste first, and gives a branch up once its waste rules out improving on the best
packing so far. That incumbent starts as the best-fit-decreasing packing; a block ends early when
the incumbent meets a lower bound. Sequences a block leaves badly filled are opened again and
packed together with those of other blocks, until one block is left.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.words import row_pieces
from floodlens.session import staged

CAPACITY = 4096
END_ID = 1
BLOCK = 8192
WIDTH = 6          # fillings tried for one sequence
BACKTRACKS = 200   # fillings tried beyond the first, per block
OPEN_BELOW = 0.98  # sequences filled less are packed again with those of other blocks
REMEMBERED = 1_000_000


# Tokenizing -----------------------------------------------------------------------------------

class WordTokenizer:
    """Ids of texts by a tokenizer that treats the parts between ASCII white space one by one.

    Such a tokenizer drops white space before it looks at words, so the ids of a text are those
    of its words in order. The first `remembered` words met are kept; others are encoded again.
    Plain words are encoded many at a time and told apart by the tokens that end a pre-token.
    """

    WORD_END = "</w>"
    PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+([.,!?]?)")

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self.ids: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, ends, other = [], [], []
        for word in words:
            text = word.decode()
            match = self.PLAIN.fullmatch(text)
            if match:
                plain.append(text)
                ends.append(2 if match[1] else 1)  # a closing mark is a pre-token of its own
            else:
                other.append(text)
        out = {}
        for at in range(0, len(plain), 2048):
            part = plain[at:at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast(
                [" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
            last = np.append(0, np.cumsum(ends[at:at + 2048]))
            if len(cuts) - 1 != last[-1]:
                other.extend(part)
                continue
            flat, cuts = ids.tobytes(), (cuts[last] * 4).tolist()
            out.update({w.encode(): flat[a:b] for w, a, b in zip(part, cuts, cuts[1:])})
        for at in range(0, len(other), 2048):
            part = other[at:at + 2048]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            out.update({w.encode(): np.array(e.ids, "<u4").tobytes()
                        for w, e in zip(part, encoded)})
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [text.split() for text in texts]
        needed = set().union(*words)
        new = self._encode_words(list(needed.difference(self.ids)))
        if len(self.ids) + len(new) <= self.remembered:
            self.ids.update(new)
            known = self.ids
        else:
            known = new | {word: self.ids[word] for word in needed.intersection(self.ids)}
        return [np.frombuffer(b"".join(map(known.__getitem__, of_text)), "<u4")
                for of_text in words]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer per worker process, so that tasks after the first find its words known."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length, ids_crc32, and ids if asked for.

    A document is its ids followed by `end_id`; one of more than `capacity` ids is cut, and its
    last piece may be shorter. A null text counts as empty and gives the end alone; repeated rows
    give their pieces again; a null id passes through.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text", 2 << 20):
                flat, at = data.tobytes(), offsets.tolist()
                texts = [flat[a:b] for a, b in zip(at, at[1:])]
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(),
                                       tokenizer.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for number, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start:start + capacity]
                        rows.append((doc_id, number, start, len(cut), zlib.crc32(cut.tobytes()))
                                    + (cut.astype(np.int32),) * with_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), kind) for c, kind in zip(zip(*rows), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                        pa.list_(pa.int32())))], names=names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, schema + ", ids array<int>" * with_ids)


# Packing one block ----------------------------------------------------------------------------

def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for a limit a, pieces above capacity - a share with none
    of those from a up, and pieces above half share with no other such piece."""
    lengths = np.sort(lengths)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    best = math.ceil(sums[-1] / capacity)
    half = np.searchsorted(lengths, capacity // 2, "right")
    for a in np.unique(lengths[lengths <= capacity // 2]):
        low, high = np.searchsorted(lengths, a), np.searchsorted(lengths, capacity - a, "right")
        alone, middle = len(lengths) - high, max(high - half, 0)
        room = middle * capacity - (sums[high] - sums[min(half, high)])
        rest = max(0, (sums[min(half, high)] - sums[low]) - room)
        best = max(best, alone + middle + math.ceil(rest / capacity))
    return int(best)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest sequence that still takes it."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room r
    out = []
    for length in sorted(lengths, reverse=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, target = capacity, []
            out.append(target)
        target.append(length)
        by_room[room - length].append(target)
        rooms |= 1 << (room - length)
    return out


def fillings(sizes: np.ndarray, counts: np.ndarray, room: int, width: int
             ) -> list[tuple[int, ...]]:
    """Undominated sets of up to three lengths for `room`, the least waste first.

    `sizes` are the distinct lengths in ascending order, `counts` how many are left. A set is
    dominated if another one has at least as large a length for each of its lengths, so a set
    must use the largest last length that fits and leave no room for a larger single length.
    """
    left = sizes[counts > 0]
    left = left[:np.searchsorted(left, room, "right")]
    if not len(left):
        return [()]
    many = dict(zip(sizes.tolist(), counts.tolist()))
    single = int(left[-1])
    found = {(single,)}
    if single < room:
        partner = np.searchsorted(left, np.minimum(left, room - left), "right") - 1
        first = np.flatnonzero(partner >= 0)
        totals = left[first] + left[partner[first]]
        for i in first[np.argsort(-totals, kind="stable")[:2 * width]]:
            found.add((int(left[i]), int(left[partner[i]])))
        best = max(sum(f) for f in found if all(f.count(x) <= many[x] for x in f))
        if best < room:  # a third length for the largest first ones
            for a in left[::-1][:width].tolist():
                rest = left[left <= a]
                limit = room - a
                pair = np.searchsorted(rest, np.minimum(rest, limit - rest), "right") - 1
                ok = np.flatnonzero((pair >= 0) & (rest <= limit))
                if len(ok):
                    i = ok[np.argmax(rest[ok] + rest[pair[ok]])]
                    found.add(tuple(sorted((a, int(rest[i]), int(rest[pair[i]])), reverse=True)))
    possible = [f for f in found if all(f.count(x) <= many[x] for x in f)
                and (len(f) == 1 or sum(f) > single)]
    return sorted(possible, key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))[:width]


def complete_bins(lengths: list[int], capacity: int, most: int, width: int = WIDTH,
                  backtracks: int = BACKTRACKS) -> list[list[int]] | None:
    """A packing into at most `most` sequences by bin completion, or None if none was found within
    `backtracks` second choices. A branch ends when its waste exceeds what `most` allows."""
    values, numbers = np.unique(lengths, return_counts=True)
    numbers = numbers.copy()
    spare = most * capacity - int(sum(lengths))
    if spare < 0:
        return None
    done: list[list[int]] = []
    choices: list[list[tuple[int, ...]]] = []  # untried fillings of each sequence in `done`
    wasted = 0

    def shift(items: list[int], by: int) -> None:
        for item in items:
            numbers[np.searchsorted(values, item)] += by

    while True:
        top = np.flatnonzero(numbers)
        if not len(top):
            return done
        largest = int(values[top[-1]])
        numbers[top[-1]] -= 1
        options = _fill(values, numbers, capacity - largest, width)
        numbers[top[-1]] += 1
        options = [[largest, *o] for o in options]
        while True:
            options = [o for o in options if wasted + capacity - sum(o) <= spare]
            if options:
                break
            if not done or backtracks == 0:
                return None
            backtracks -= 1
            last = done.pop()
            shift(last, 1)
            wasted -= capacity - sum(last)
            options = choices.pop()
        chosen = options[0]
        shift(chosen, -1)
        wasted += capacity - sum(chosen)
        done.append(chosen)
        choices.append(options[1:])


def _fill(values: np.ndarray, numbers: np.ndarray, room: int, width: int
          ) -> list[tuple[int, ...]]:
    """Fillings of a room; a best filling that leaves room for more is filled on."""
    out = []
    for filling in fillings(values, numbers, room, width):
        taken = list(filling)
        for x in taken:
            numbers[np.searchsorted(values, x)] -= 1
        left = room - sum(taken)
        while taken:
            fitting = np.flatnonzero(numbers[:np.searchsorted(values, left, "right")])
            if not len(fitting):
                break
            more = fillings(values, numbers, left, 1)[0]
            for x in more:
                numbers[np.searchsorted(values, x)] -= 1
            taken.extend(more)
            left -= sum(more)
        for x in taken:
            numbers[np.searchsorted(values, x)] += 1
        out.append(tuple(taken))
    return sorted(set(out), key=lambda f: (-sum(f), len(f), f))


def pack_lengths(lengths: np.ndarray, capacity: int, width: int = WIDTH,
                 backtracks: int = BACKTRACKS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length."""
    packed = best_fit(lengths.tolist(), capacity)
    least = lower_bound(lengths, capacity)
    while len(packed) > least:
        # Sequences filled to the last place stay; the rest is searched for one sequence less.
        full = [s for s in packed if sum(s) == capacity]
        rest = [x for s in packed if sum(s) < capacity for x in s]
        better = complete_bins(rest, capacity, len(packed) - len(full) - 1, width, backtracks)
        if better is None:
            break
        packed = full + better
    order = np.argsort(-lengths, kind="stable")  # equal lengths are interchangeable
    slots = [(x, number, at) for number, s in enumerate(packed)
             for x, at in zip(s, np.cumsum([0, *s[:-1]]).tolist())]
    slots.sort(key=lambda slot: -slot[0])
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sequence[order] = [number for _, number, _ in slots]
    offset[order] = [at for _, _, at in slots]
    return sequence, offset


# Packing everything ---------------------------------------------------------------------------

def _packed(items: DataFrame, blocks: int, level: int, capacity: int, open_below: float
            ) -> DataFrame:
    """Each of `blocks` blocks of items packed on its own; `_open` marks badly filled sequences."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_item")
        lengths = table.column("length").to_numpy()
        sequence, offset = pack_lengths(lengths, capacity)
        filled = np.bincount(sequence, lengths)[sequence]
        number = (level << 56) + (table.column("_block")[0].as_py() << 24)
        return pa.table({
            "_item": table.column("_item"), "length": table.column("length"),
            "sequence_id": pa.array(number + sequence), "offset": pa.array(offset),
            "_open": pa.array(filled < open_below * capacity)})

    dealt = items.select("_item", "length",
                         F.pmod(F.xxhash64("_item"), F.lit(blocks)).alias("_block"))
    # As many tasks as blocks: blocks are few bytes and much work, so their size must not join them.
    return dealt.repartition(blocks, "_block").groupBy("_block").applyInArrow(
        run, "_item long, length long, sequence_id long, offset long, _open boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK,
         open_below: float = OPEN_BELOW) -> DataFrame:
    """`items` with sequence_id and offset; `length` (1 to capacity) says how much each takes.

    Every row is one item, repeated rows too; an empty table gives an empty result. Offsets of a
    sequence have no gaps.
    """
    kept = staged(items.withColumn("_item", F.monotonically_increasing_id()), "packing-items")
    left, count, level = kept, kept.count(), 0
    closed = []
    while count:
        blocks = math.ceil(count / block)
        placed = staged(_packed(left, blocks, level, capacity, open_below),
                        f"packing-level-{level}")
        again = placed.where("_open").count() if blocks > 1 else 0
        if again * 2 > count:  # few pieces fit together anywhere; another round changes nothing
            again = 0
        closed.append(placed.where("not _open") if again else placed)
        left, count, level = placed.where("_open"), again, level + 1
    if not closed:
        return kept.select("*", F.lit(0).cast("long").alias("sequence_id"),
                           F.lit(0).cast("long").alias("offset")).drop("_item")
    places = reduce(DataFrame.unionByName, closed).select("_item", "sequence_id", "offset")
    return kept.join(places, "_item").drop("_item")
