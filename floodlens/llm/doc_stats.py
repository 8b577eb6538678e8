"""Statistics of whole texts: one row of numbers per document, computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from floodlens.llm.words import _byte_value, _is_space, mix, row_pieces, span_hashes, words_of

SYMBOLS = b"#*$%&|<>"
ENDINGS = b".!?"

#: Counts of a text. Code points, not bytes, unless the name says so.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
          "n_lines", "n_upper", "n_digits", "n_marks", "n_wide", "n_distinct", "n_ended_lines",
          "n_long_words", "n_capital_words", "n_exclaims", "n_endings", "n_short_lines")

_kinds = np.zeros((256, 8), dtype=bool)
_kinds[list(SYMBOLS), 0] = True
_kinds[65:91, 1] = True
_kinds[48:58, 2] = True
_kinds[[b for b in range(33, 127) if not chr(b).isalnum()], 3] = True
_kinds[192:, 4] = True
_kinds[ord("!"), 5] = True
_kinds[list(ENDINGS), 6] = True
_columns = {"n_symbols": 0, "n_upper": 1, "n_digits": 2, "n_marks": 3, "n_wide": 4,
            "n_exclaims": 5, "n_endings": 6}


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and of those all but one of each value."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    any_of = later.copy()
    any_of[order[:-1][same]] = True
    return any_of, later


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of the rows data[offsets[i]:offsets[i + 1]]."""
    rows = len(offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[offsets])

    words = words_of(data, offsets)
    row = words.row_of()
    lead = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(words.first), "n_chars": per_row(lead),
           "word_chars": per_row(lead & ~_is_space[data])}
    for name, kind in _columns.items():
        out[name] = per_row(_kinds[data, kind])

    # Lines with a word: from each row's start or the byte after a \n.
    breaks = np.flatnonzero(data == 10)
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.union1d(filled, breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    broken = data[ends - 1] == 10 if len(ends) else np.empty(0, bool)
    ends = ends - broken
    holds = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[holds], ends[holds]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    line_keys = mix(span_hashes(_byte_value[data], starts, ends)
                    ^ mix(line_row.astype(np.uint64)))
    count = lambda rows_of, flags=None: np.bincount(rows_of, flags, minlength=rows).astype(np.int64)
    out["n_lines"] = count(line_row)
    out["n_dup_lines"] = count(line_row, _repeats(line_keys)[1])
    last_word = np.searchsorted(words.starts, ends) - 1
    closing = data[words.ends[last_word] - 1] if len(ends) else np.empty(0, np.uint8)
    out["n_ended_lines"] = count(line_row, _kinds[closing, 6])
    out["n_short_lines"] = count(line_row, ends - starts < 30)

    # Words within 3-word windows that the text has twice or more.
    whole = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.empty(0, np.int64)
    row_key = mix(row.astype(np.uint64))
    windows = mix(span_hashes(words.hashes, whole, whole + 3) ^ row_key[whole])
    again = whole[_repeats(windows)[0]]
    covered = np.zeros(len(row), dtype=bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = count(row, covered)

    out["n_distinct"] = out["n_words"] - count(row, _repeats(mix(words.hashes ^ row_key))[1])
    out["n_long_words"] = count(row, words.ends - words.starts > 20)
    first_upper = _kinds[data[words.starts], 1] if len(row) else np.empty(0, bool)
    out["n_capital_words"] = count(row, first_upper)
    return {name: out[name] for name in COUNTS}


def with_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",),
                names: tuple[str, ...] = COUNTS) -> DataFrame:
    """(*keep, *names) of every row of `docs`, a null text counting as empty. Other columns play
    no part; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "_text"):
                counts = count_texts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in keep], *[pa.array(counts[n]) for n in names]],
                    names=[*keep, *names])

    kinds = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep]
    schema = ", ".join([*kinds, *[f"{name} long" for name in names]])
    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(run, schema)
