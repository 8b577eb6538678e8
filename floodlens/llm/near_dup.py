"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

Every tree of the forest is a sorted order of the documents by a few MinHash values. Documents
with a common prefix of `SHALLOW` values are neighbours; a region of the order that holds more
than `GROUP` of them is split by longer prefixes, so dense regions are compared at a greater
depth. Inside a region short sketches tell which pairs may be alike.

Documents with equal sets are one class from the start. Candidates are confirmed in two rounds.
The first takes of each region the spanning forest of its most alike pairs, which is enough to
connect a group of copies without listing its pairs. The second takes all pairs of a region between
documents that the confirmed links have not connected, by longer sketches. So no pair that the
forest finds is lost.

Where more than `GROUP` documents agree in all `DEEP` values, the order says no more about them.
If the first round has not connected such a region, its members are compared by an exact set join:
shingles in order of their frequency, pairs by the shingles in front (`dense_pairs`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.llm.components import components
from floodlens.llm.documents import one_per_id
from floodlens.llm.words import mix, row_pieces, signed, span_hashes, text_bytes, words_of
from floodlens.session import staged

SHINGLE = 4
PERCENT = 80
TREES = 16
SHALLOW, DEEP = 3, 6
SKETCH, MARGIN = 64, 0.2            # at 80 percent a sketch is off by more than the margin
LONG_SKETCH, LONG_MARGIN = 512, 0.07  # (four standard deviations) less than once in 10^4
GROUP = 256


def _factors(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of rows: hashes, their rows (ascending), and keys that tell rows apart.

    A row with fewer words than `size` has its whole sequence as one shingle; one without words
    has none.
    """
    words = words_of(data, offsets, lower=True)
    row = words.row_of()
    counts = np.diff(words.first)
    whole = (np.flatnonzero(row[size - 1:] == row[:len(row) - size + 1])
             if len(row) >= size else np.empty(0, np.int64))
    short = np.flatnonzero((counts > 0) & (counts < size))
    starts = np.concatenate([whole, words.first[short]])
    ends = np.concatenate([whole + size, words.first[short + 1]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    hashes = span_hashes(words.hashes, starts, ends)
    row = row[starts]
    keys, index = np.unique(mix(hashes ^ mix(row.astype(np.uint64))), return_index=True)
    back = np.argsort(index)
    return hashes[index[back]], row[index[back]], keys[back]


def sign(docs: DataFrame, shingle: int = SHINGLE, trees: int = TREES, deep: int = DEEP,
         sketch_size: int = SKETCH) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, a 128-bit hash of the set (set_a, set_b), the
    signature (trees x deep MinHash values of 4 bytes) and a sketch (a byte of each of
    `sketch_size` values)."""
    factors = _factors(max(trees * deep, sketch_size))
    names = ["doc_id", "n_shingles", "set_a", "set_b", "signature", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text"):
                hashes, row, _ = shingle_sets(data, offsets, shingle)
                sizes = np.bincount(row, minlength=part.num_rows)
                held = np.flatnonzero(sizes)
                begins = np.cumsum(sizes[held]) - sizes[held]
                sums = np.zeros((2, part.num_rows), dtype=np.uint64)
                values = np.zeros((part.num_rows, len(factors)), dtype=">u4")
                if len(held):
                    for i, salt in enumerate((1, 2)):
                        sums[i, held] = np.add.reduceat(mix(hashes + np.uint64(salt)), begins)
                    for j, factor in enumerate(factors):
                        values[held, j] = np.minimum.reduceat(hashes * factor, begins) >> np.uint64(32)
                sketch = (values[:, :sketch_size] & 0xFF).astype(np.uint8)
                values = values[:, :trees * deep]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(signed(sums[0])),
                     pa.array(signed(sums[1])),
                     pa.array([v.tobytes() for v in values], pa.binary()),
                     pa.array([s.tobytes() for s in sketch], pa.binary())], names=names)

    return docs.mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary, "
             "sketch binary")


# One region of a sorted order -------------------------------------------------------------------

def _alike(sketches: np.ndarray, sizes: np.ndarray, least: float, percent: int) -> np.ndarray:
    """Estimated similarity of all pairs, 0 where it cannot reach the limit."""
    same = (sketches[:, None, :] == sketches[None, :, :]).mean(axis=2)
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    same[(same < least) | (100 * small < percent * large)] = 0
    np.fill_diagonal(same, 0)
    return same


def _spanning_pairs(alike: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a spanning forest with the greatest similarities."""
    left = np.ones(len(alike), dtype=bool)
    best, partner = np.zeros(len(alike)), np.zeros(len(alike), dtype=np.int64)
    out = []
    for _ in range(len(alike)):
        node = int(np.where(left, best, -1).argmax())
        if best[node] > 0:
            out.append((int(partner[node]), node))
        left[node] = False
        closer = alike[node] > best
        best[closer], partner[closer] = alike[node][closer], node
    return out


def _regions(shared: np.ndarray, shallow: int, deep: int, group: int
             ) -> Iterator[tuple[int, int]]:
    """Row ranges to compare; shared[i] tells how many values rows i and i + 1 have in common from
    the first. A range too large at every depth is given as overlapping parts, which is enough to
    connect copies; the set join compares the rest."""
    todo = [(0, len(shared) + 1, shallow - 1)]
    while todo:
        low, high, depth = todo.pop()
        if high - low <= group and depth >= shallow:
            yield low, high
        elif depth == deep:
            for at in range(low, max(low + 1, high - group // 2), group // 2):
                yield at, min(at + group, high)
        else:
            cuts = low + 1 + np.flatnonzero(shared[low:high - 1] <= depth)
            edges = np.concatenate([[low], cuts, [high]])
            larger = np.flatnonzero(np.diff(edges) > 1)
            todo.extend((int(edges[i]), int(edges[i + 1]), depth + 1) for i in larger)


def _keys(trees: int, deep: int) -> Column:
    """The sort key of every tree, out of `signature`."""
    width = deep * 4
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                       lambda t: F.col("signature").substr(t * width + 1, F.lit(width)))


class _DenseRuns:
    """Ids of rows that agree in tree and all values with more than `group` - 1 others, in batches
    of a sorted order."""

    def __init__(self, group: int) -> None:
        self.group = group
        self.key: tuple | None = None
        self.ids: list[np.ndarray] = []  # of the run that the next batch may go on with

    def add(self, rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Ids of the dense runs that are known to end in these rows."""
        values, tree, ids = rows["values"], rows["tree"], rows["doc_id"]
        differs = (values[1:] != values[:-1]).any(axis=1) | (tree[1:] != tree[:-1])
        edges = np.concatenate([[0], np.flatnonzero(differs) + 1, [len(ids)]])
        out = []
        if self.key != (int(tree[0]), values[0].tobytes()):
            out += self.end()
        self.ids.append(ids[:edges[1]])
        if len(edges) > 2:
            out += self.end()
            for i in np.flatnonzero(np.diff(edges[1:-1]) > self.group) + 1:
                out.append(ids[edges[i]:edges[i + 1]])
            self.ids = [ids[edges[-2]:]]
        self.key = (int(tree[-1]), values[-1].tobytes())
        return out

    def end(self) -> list[np.ndarray]:
        held, self.ids = self.ids, []
        return held if sum(map(len, held)) > self.group else []


def candidates(entries: DataFrame, percent: int = PERCENT, trees: int = TREES,
               shallow: int = SHALLOW, deep: int = DEEP, group: int = GROUP,
               margin: float = MARGIN) -> DataFrame:
    """Distinct pairs (a, b), a < b, that may be alike, of rows (doc_id, n_shingles, signature,
    sketch): the spanning pairs of every region, or, if rows have a component, all pairs of a
    region that are in different components and not both `dense`. Without components the members
    of regions too large at every depth come too, as pairs (a, a)."""
    connected = "component" in entries.columns
    least = percent / 100 - margin

    def pairs_of(rows: dict[str, np.ndarray]) -> Iterator[tuple[int, int]]:
        values, tree, ids = rows["values"], rows["tree"], rows["doc_id"]
        same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        shared = np.cumprod(same, axis=1).sum(axis=1)
        for low, high in _regions(shared, shallow, deep, group):
            component = rows["component"][low:high] if connected else None
            dense = rows["dense"][low:high] if connected else None
            if connected and ((component == component[0]).all() or dense.all()):
                continue
            alike = _alike(rows["sketch"][low:high], rows["n_shingles"][low:high], least, percent)
            if connected:
                found = np.argwhere(np.triu((alike > 0) & (component[:, None] != component)
                                            & ~(dense[:, None] & dense)))
            else:
                found = _spanning_pairs(alike)
            for i, j in found:
                a, b = int(ids[low + i]), int(ids[low + j])
                yield min(a, b), max(a, b)

    def unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {"tree": batch.column("tree").to_numpy(),
               "doc_id": batch.column("doc_id").to_numpy(),
               "n_shingles": batch.column("n_shingles").to_numpy(),
               "values": text_bytes(batch.column("key"))[0].view(">u4").reshape(-1, deep),
               "sketch": text_bytes(batch.column("sketch"))[0].reshape(batch.num_rows, -1)}
        if connected:
            out["component"] = batch.column("component").to_numpy()
            out["dense"] = batch.column("dense").to_numpy(zero_copy_only=False)
        return out

    def given(pairs: Iterator[tuple[int, int]]) -> pa.RecordBatch:
        found = np.array(sorted(set(pairs)), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(column) for column in found.T],
                                          names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members(runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for ids in runs:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids)], names=["a", "b"])

        carried: dict[str, np.ndarray] | None = None
        runs = _DenseRuns(group)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unpacked(batch)
            if not connected:
                yield from members(runs.add(rows))
            if carried is not None:
                rows = {n: np.concatenate([carried[n], rows[n]]) for n in rows}
            # What shares a prefix with the last row may go on in the next batch; of a very large
            # region only the end is carried, cut where a longer prefix ends.
            values, tree = rows["values"], rows["tree"]
            cut, upto = 0, 0
            for depth in range(shallow, deep + 1):
                differs = ((values[:-1, :depth] != values[-1, :depth]).any(axis=1)
                           | (tree[:-1] != tree[-1]))
                cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
                if len(tree) - cut <= 16 * group:
                    break
            else:
                cut, upto = max(cut, len(tree) - group // 2), len(tree)
            yield given(pairs_of({n: x[:max(cut, upto, 1)] for n, x in rows.items()}))
            carried = {n: x[cut:] for n, x in rows.items()}
        if carried is not None:
            yield given(pairs_of(carried))
        yield from members(runs.end())

    extra = ["component", "dense"] if connected else []
    ordered = (entries.select("doc_id", "n_shingles", "sketch", *extra,
                              F.posexplode(_keys(trees, deep)).alias("tree", "key"))
               .repartition("tree", F.substring("key", 1, shallow * 4))
               .sortWithinPartitions("tree", "key", "n_shingles", "doc_id"))
    return ordered.mapInArrow(run, "a long, b long").distinct()


def dense_members(entries: DataFrame, trees: int = TREES, deep: int = DEEP, group: int = GROUP
                  ) -> DataFrame:
    """doc_id of those rows (doc_id, signature, component) that are in a region too large at every
    depth and not yet connected."""
    placed = entries.select("doc_id", "component",
                            F.posexplode(_keys(trees, deep)).alias("tree", "key"))
    open_ = placed.groupBy("tree", "key").agg(
        F.count("doc_id").alias("n"), F.min("component").alias("low"),
        F.max("component").alias("high")).where((F.col("n") > group) & F.expr("low <> high"))
    return placed.join(open_, ["tree", "key"], "left_semi").select("doc_id").distinct()


def dense_pairs(texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (doc_id, text, component) in different components:
    all that are alike enough, and few others.

    With the shingles of all sets in one order, the first shingle that two sets of m and n have in
    common, at places i and j from 1, leaves at most 1 + min(m - i, n - j) in common. So alike sets
    meet at a place near the front of both, nearer in the smaller one. Rare shingles come first, and
    those of one set only are never looked up. Of the most common component of a shingle, no two
    sets meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text"):
                hashes, row, _ = shingle_sets(data, offsets, shingle)
                sizes = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column(n).to_numpy()[row]) for n in ("doc_id", "component")]
                    + [pa.array(sizes[row]), pa.array(signed(hashes))],
                    names=["doc_id", "component", "n", "shingle"])

    held = texts.select("doc_id", "component", "text").mapInArrow(
        run, "doc_id long, component long, n long, shingle long")
    common = held.groupBy("shingle").agg(F.count("n").alias("sets")).where("sets > 1")
    from_behind = Window.partitionBy("doc_id").orderBy(F.desc("sets"), F.desc("shingle"))
    front = staged(
        held.join(common, "shingle")
        .withColumn("place", F.col("n") + 1 - F.row_number().over(from_behind))
        .where(f"100 * (n - place + 1) >= {percent} * n")
        .select("shingle", "doc_id", "component", "n", "place"), "near-fronts")
    main = (front.groupBy("shingle", "component").agg(F.count("n").alias("sets"))
            .groupBy("shingle").agg(F.max_by("component", F.struct("sets", "component"))
                                    .alias("main"), F.count("sets").alias("components"))
            .where("components > 1").select("shingle", "main"))
    front = staged(front.join(main, "shingle").selectExpr(
        "shingle", "doc_id", "component", "n", "place", "component = main as of_main"),
        "near-fronts")
    least = front.where(f"{100 + percent} * (n - place + 1) >= {2 * percent} * n")

    def met(small: DataFrame, large: DataFrame) -> DataFrame:
        return small.alias("s").join(large.alias("l"), F.expr(
            "s.shingle = l.shingle and s.component <> l.component and (s.n < l.n or "
            f"s.n = l.n and s.doc_id < l.doc_id) and {100 + percent} * (1 + "
            f"least(s.n - s.place, l.n - l.place)) >= {percent} * (s.n + l.n)")).selectExpr(
            "least(s.doc_id, l.doc_id) as a", "greatest(s.doc_id, l.doc_id) as b")

    return met(least.where("not of_main"), front).unionByName(
        met(least.where("of_main"), front.where("not of_main"))).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT
            ) -> DataFrame:
    """`pairs` with `linked`: whether the full sets of both texts are alike enough."""

    def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, row, keys = shingle_sets(data, offsets, shingle)
        return row, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text_a", 2 << 20):
                row_a, keys_a = keys_of(data, offsets)
                row_b, keys_b = keys_of(*text_bytes(part.column("text_b")))
                n = part.num_rows
                both = np.bincount(row_a[np.isin(keys_a, keys_b)], minlength=n)
                either = (np.bincount(row_a, minlength=n) + np.bincount(row_b, minlength=n) - both)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"),
                     pa.array((both > 0) & (100 * both >= percent * either))],
                    names=["a", "b", "linked"])

    text = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    return (pairs.join(text("b"), "b").join(text("a"), "a")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(run, "a long, b long, linked boolean"))


def _placed(rows: DataFrame, links: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with the component (of `links`: id, component) of `key` as `name`; by a merge join,
    as components grow with the data."""
    joined = links.select(F.col("id").alias(key), F.col("component").alias("_of"))
    return rows.join(joined.hint("merge"), key, "left").withColumn(
        name, F.coalesce("_of", key)).drop("_of")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per distinct doc_id: doc_id, n_shingles, component_id (the smallest id that links reach),
    kept (doc_id = component_id).

    Links join documents whose sets of `shingle`-word shingles, A-Z lower-cased, have at least
    `percent` of their union in common. Null, empty and blank texts have empty sets and no links;
    rows with a null id take no part; of rows with the same id the one with the smallest text
    counts. Other columns play no part.
    """
    docs = one_per_id(docs)
    signed_docs = staged(sign(docs, shingle), "near-signatures")
    keys = ["n_shingles", "set_a", "set_b"]
    firsts = signed_docs.where("n_shingles > 0").groupBy(*keys).agg(
        F.min("doc_id").alias("first_id"))
    classes = staged(signed_docs.select("doc_id", *keys).join(firsts, keys, "left").select(
        "doc_id", "n_shingles", F.coalesce("first_id", "doc_id").alias("first_id")),
        "near-classes")
    own = classes.where("doc_id = first_id and n_shingles > 0").select("doc_id")
    entries = signed_docs.select("doc_id", "n_shingles", "signature", "sketch").join(
        own, "doc_id", "left_semi")

    found = staged(candidates(entries, percent), "near-pairs")
    pairs, in_dense = found.where("a <> b"), found.where("a = b").selectExpr("a as doc_id")
    involved = staged(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(),
                      "near-involved")
    texts = staged(docs.join(involved.hint("merge"), "doc_id", "left_semi"), "near-texts")

    def confirmed(some: DataFrame) -> DataFrame:
        return staged(confirm(some, texts, shingle, percent), "near-links")

    checked = confirmed(pairs)
    links = components(checked.where("linked"))
    # What no spanning pair involves has no pair at all. What is left is alike, but mostly less than
    # asked for: longer sketches tell more.
    left = _placed(sign(texts, shingle, sketch_size=LONG_SKETCH), links, "doc_id", "component")
    if in_dense.isEmpty():
        rest = candidates(left.withColumn("dense", F.lit(False)), percent, margin=LONG_MARGIN)
    else:
        members = staged(dense_members(_placed(entries.join(
            in_dense.hint("merge"), "doc_id", "left_semi"), links, "doc_id", "component")),
            "near-dense")
        left = left.join(members.withColumn("dense", F.lit(True)).hint("merge"), "doc_id", "left")
        rest = candidates(left.withColumn("dense", F.coalesce("dense", F.lit(False))), percent,
                          margin=LONG_MARGIN)
        if not members.isEmpty():
            rest = rest.unionByName(dense_pairs(_placed(texts.join(
                members.hint("merge"), "doc_id", "left_semi"), links, "doc_id", "component"),
                shingle, percent))
    rest = rest.join(checked.hint("merge"), ["a", "b"], "left_anti")
    final = components(checked.unionByName(confirmed(rest)).where("linked"))
    return classes.join(final, F.col("first_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
