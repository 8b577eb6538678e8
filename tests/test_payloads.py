"""Byte n-grams and words against brute force."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from support import rows

from floodlens.operators import ngrams

SCHEMA = ("payload binary, tcp_sport int, tcp_dport int, udp_sport int, udp_dport int")


def _payloads():
    random.seed(5)
    sizes = [0, 1, 2, 3, 4, 5, 700, 3000] * 4 + [
        ngrams.PIECE_BYTES + d for d in (-1, 0, 1, 2, 3, 4, 5, 6, ngrams.PIECE_BYTES, 40000)]
    ports = [(22, 9, None, None), (9, 80, None, None), (None, None, 53, 9), (22, 443, None, None),
             (None, None, None, None)]
    data = [(bytearray(random.choices(range(256), k=s)), *random.choice(ports)) for s in sizes]
    return data + [(None, 80, 80, None, None)]


def _brute(data, n):
    counts = Counter()
    for payload in data:
        for i in range(max(len(payload or b"") - n, 0)):
            counts[int.from_bytes(payload[i:i + n], "big")] += 1
    return counts


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_counts(spark, n):
    data = _payloads()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = dict(_brute([d[0] for d in data], n))
    found = ngrams.payload_ngrams(frame, "payload", n=n)
    assert {r.ngram: r["count"] for r in found.collect()} == want
    if n <= 2:
        every = ngrams.payload_ngrams(frame, "payload", n=n, zeros=True).collect()
        assert {r.ngram: r["count"] for r in every} == {k: want.get(k, 0) for k in range(256 ** n)}


def test_last_ngram_is_left_out(spark):
    frame = spark.createDataFrame([(bytearray(b"ab"), None, None, None, None),
                                   (bytearray(b"abc"), None, None, None, None)], SCHEMA)
    got = ngrams.payload_ngrams(frame, "payload", n=2).filter("count > 0")
    assert rows(got) == [("", ord("a") * 256 + ord("b"), 1)]


def test_small_chunks(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(ngrams, "_CHUNK_BYTES", 10)
    data = [bytes(p or b"") for p, *_ in _payloads()]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(data, pa.binary()), pa.array([True] * len(data))], names=["payload", "m"])
    (got,) = ngrams._counter(2, [""])([batch.slice(0, 20), batch.slice(20)])
    assert dict(zip(got["ngram"].to_pylist(), got["count"].to_pylist())) == dict(_brute(data, 2))


def _fed(limit, chunks):
    """What a counter of this limit gives for chunks of codes: rows in all, and their sums."""
    runs, given = ngrams.Runs(limit), []
    for chunk in chunks:
        if full := runs.add(chunk):
            given.append(full)
    given.append(runs.take())
    sums = Counter()
    for codes, counts in given:
        assert (np.diff(codes.astype(np.int64)) > 0).all()
        sums.update(dict(zip(codes.tolist(), counts.tolist())))
    return sum(len(codes) for codes, _ in given), sums


def test_a_task_gives_each_ngram_once_while_they_fit():
    rng = np.random.default_rng(1)
    chunks = [rng.integers(0, 5000, size).astype(np.uint64) for size in (900, 0, 4000, 10, 3000) * 9]
    want = Counter(np.concatenate(chunks).tolist())
    rows_given, sums = _fed(5000, chunks)
    assert rows_given == len(want) and sums == want
    rows_given, sums = _fed(500, chunks)
    assert rows_given > len(want) and sums == want


def test_memory_of_a_counter_is_bounded():
    rng = np.random.default_rng(2)
    limit = 50_000
    runs, largest = ngrams.Runs(limit), 0
    tracemalloc.start()
    for _ in range(200):
        runs.add(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
        largest = max(largest, sum(len(c) for c, _ in runs.runs))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Runs, and while two are merged their copies, order and sums.
    assert largest <= limit and peak < 8 * 16 * limit


def test_memory_does_not_grow_with_a_batch():
    """Many payloads in one batch, as text of packets or of documents comes."""
    data = np.random.default_rng(3).integers(97, 123, 24_000_000).astype(np.uint8).tobytes()
    payloads = [data[at:at + 6000] for at in range(0, len(data), 6000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(payloads, pa.binary()), pa.array([True] * len(payloads))], names=["p", "m"])
    tracemalloc.start()
    (got,) = ngrams._counter(2, [""])([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got["count"].to_pylist()) == sum(len(p) - 2 for p in payloads)
    assert peak < 48_000_000


def test_batches_do_not_grow_with_what_a_task_reads(spark):
    """Long payloads in one task, 4 and 40 MB of them."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    for payloads in (1_000, 10_000):
        frame = spark.range(0, payloads, 1, 1).selectExpr(
            "cast(repeat('0123456789abcdef', 256) as binary) as payload", "true as member")
        found = ngrams._pieces(frame, 2).mapInArrow(sizes, "size long, n long").collect()
        assert sum(r.n for r in found) >= payloads
        assert 2_000_000 < max(r.size for r in found) < 4_000_000


def test_memory_of_a_table_of_counts():
    """Next to the batch, a task holds the table and what one chunk takes."""
    data = np.random.default_rng(4).integers(97, 123, 2_500_000).astype(np.uint8).tobytes()
    payloads = [data[at:at + 250] for at in range(0, len(data), 250)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(payloads, pa.binary()), pa.array([True] * len(payloads))], names=["p", "m"])
    tracemalloc.start()
    (got,) = ngrams._counter(2, [""])([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got["count"].to_pylist()) == sum(len(p) - 2 for p in payloads)
    assert peak < 12_000_000


@pytest.mark.parametrize("n,k", [(1, 3), (3, 20), (3, 100_000), (5, 7)])
def test_top_ngrams(spark, n, k):
    rng = random.Random(n)
    data = _payloads()
    words = [bytes(rng.choices(range(256), k=6)) for _ in range(40)]
    for _ in range(300):  # some n-grams are much more frequent, and not in every task
        data.append((bytearray(b"".join(rng.choices(words, weights=range(1, 41), k=20))),
                     None, None, None, None))
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    counts = _brute([d[0] for d in data], n)
    want = sorted(((g, c) for g, c in counts.items()), key=lambda x: (-x[1], x[0]))[:k]
    assert [tuple(r) for r in ngrams.top_ngrams(frame, "payload", k, n=n).collect()] == want
    assert ngrams.top_ngrams(frame.limit(0), "payload", k, n=n).count() == 0


def test_services(spark):
    data = _payloads()
    frame = spark.createDataFrame(data, SCHEMA)
    got = ngrams.ngrams_by_service(frame, "payload")
    counts = {}
    for r in got.collect():
        counts.setdefault(r.service, {})[r.ngram] = r["count"]
    assert set(counts) == set(ngrams.SERVICES) and all(len(c) == 256 for c in counts.values())
    for service, port, side in (("ssh", 22, (1, 2)), ("https", 443, (1, 2)), ("dns", 53, (3, 4))):
        chosen = [d[0] for d in data if port in (d[side[0]], d[side[1]])]
        want = _brute(chosen, 1)
        assert {k: v for k, v in counts[service].items() if v} == dict(want)


def test_filter_without_matches(spark):
    frame = spark.createDataFrame(_payloads(), SCHEMA)
    assert ngrams.payload_ngrams(frame, "payload", "tcp:12345").count() == 0
    got = ngrams.payload_ngrams(frame, "payload", "tcp:12345", zeros=True)
    assert got.count() == 256 and got.filter("count > 0").count() == 0


def test_cube(spark):
    frame = spark.createDataFrame([("", 0x0102FF, 3), ("", 0x0706F8, 4), ("", 0x080000, 1)],
                                  "filter string, ngram long, count long")
    cells = ngrams.ngram_cube(frame)
    assert cells.count() == 32 ** 3
    assert rows(cells.where("count > 0")) == [(0, 0, 1, 1), (31, 0, 0, 7)]
    assert ngrams.ngram_cube(frame, 100).count() == 27


def test_words(spark):
    texts = ["Hello hello w0rld 9lives", "x-Y_z Kelvin", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(w.lower() for t in texts if t for w in re.findall("[a-zA-Z][a-zA-Z0-9]*", t))
    assert dict(rows(ngrams.word_count(frame, "text"))) == dict(want)
