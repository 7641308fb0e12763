"""N-gram Jaccard join by set-relation skipping: every link, and one component per group.

1. Every text becomes its set of word shingles (64-bit hashes). Equal sets are one class, and
   the classes are what is joined.
2. Prefix filter: two sets of Jaccard p % or more share an element among the first
   n - ceil(p n / 100) + 1 of each, in any order common to all. The order here puts
   elements last that a count sketch of all texts finds frequent, so shared passages do
   not make long lists. The sketch has a fixed size; its errors change the order, never
   the result.
3. Index lists, one per element, sorted by set size, then position. Round one verifies a list's
   neighbours and its first set: one pass, as many pairs as entries.
4. Index level skipping: round two looks only at lists that still hold two components and
   skips, in each, the blocks of one set size from the position on at which the overlap that
   is left is too small, and all sets that are already of one group. A pair that a parity
   bitmap per set (a lower bound of the symmetric difference) cannot exclude joins the
   groups of its sets: a list gives at most as many pairs as it has groups. All links lie
   within these candidate groups.
5. Answer level skipping: the sets of a candidate group meet. One set is compared in full; the
   answers of the others, their overlaps with every set of the group, follow from its answer
   and the small differences between the sets. Links are counted, and the few that connect
   a group are given, where they are found; groups of many sets are cut into parts of which
   every two meet. Deciding every pair of a group of different texts takes work by the square
   of their number, in parallel over the parts; rows that leave a task do not: they are as many
   as the sets that entered it. Copies are one set and cost nothing.

``representative_links`` lists the links themselves; their number is that of the pairs there
are. For components alone (``jaccard_components``, ``one_of_each``) step 5 only sees groups
that round one has left in several components. Long lists are split: in round one into parts
of HOT_LIST entries, in round two into parts of LIST entries of which every two meet in one
task. No text, set, link or component reaches the driver; the sketch (8 MB) does.

Defined results: null and empty texts, and texts without words, have no shingles and link
with nothing; a null doc_id is a row without component; rows of one doc_id with different
texts are one node of all their links, in any order of rows; repeated rows are one document
to others' counts; an empty table gives an empty result; ties between documents go to the
smallest doc_id; extra columns are ignored, whatever their names, and kept by ``one_of_each``.
Very long texts are taken whole, in one task each.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.llm.components import components
from linkwell.llm.filters import id_filter, may_hold
from linkwell.llm.runtime import discard, release, written
from linkwell.llm.shingles import buffers, chunks, mixed, shingle_sets

SKETCH_BITS = 21
SKETCH_PARTS = 32
HOT_LIST = 100_000  # entries by the sketch's count from which on round one splits a list
LIST = 20_000  # entries from which on round two splits a list
SEEN = 50_000  # classes a task remembers, to list copies once
PART_SETS, PART_ITEMS = 2_000, 1 << 20  # sets, and elements of them, from which on a group is split


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _key(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _bitmap(h: np.ndarray) -> bytes:
    """Parities of the set's elements by bucket; as many buckets as elements, a power of two, 64 at least."""
    width = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    at = (h >> np.uint64(24)).astype(np.int64) & (width - 1)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    la, lb = len(a), len(b)
    while la > lb:
        la //= 2
        x = (x >> 8 * la) ^ (x & ((1 << 8 * la) - 1))
    while lb > la:
        lb //= 2
        y = (y >> 8 * lb) ^ (y & ((1 << 8 * lb) - 1))
    return (x ^ y).bit_count()


def _trim() -> None:
    """Gives a worker's freed memory back to the system: workers live on between stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def _described(k: int):
    """(doc_id, text) -> per row its set's size, digest, key and bitmap; per task its sketch in parts."""
    import pyarrow as pa

    names = ["doc_id", "n", "sig", "key", "bits", "part", "counts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def work(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n, sig, bits = [], [], []
            for i, j in chunks(offsets):
                for h in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    n.append(len(h))
                    sig.append(_digest(h))
                    bits.append(_bitmap(h))
                    np.add.at(sketch, (h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
            cols = (n, sig, [_key(x) for x in sig], bits, [None] * len(n), [None] * len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=t) for c, t in zip(cols, types[1:], strict=True)]], names=names)
        if sketch.any():
            parts = [x.tobytes() for x in np.split(sketch, SKETCH_PARTS)]
            none = [None] * SKETCH_PARTS
            cols = (none, none, none, none, none, list(range(SKETCH_PARTS)), parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)
        _trim()

    return work


def _sum_parts(batches):
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(counts.as_buffer(), np.uint32)
            if part in sums:
                total = sums[part].astype(np.uint64) + x
                sums[part] = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
            else:
                sums[part] = x.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])


def _entries(k: int, percent: int, sketch):
    """(doc_id, text) -> the prefix of each row's set: element, the set's key, size, position."""
    import pyarrow as pa

    def work(batches):
        counts = np.frombuffer(sketch.value, np.uint32)
        seen: OrderedDict[bytes, None] = OrderedDict()
        for batch in batches:
            ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(1))
            token, key, size, pos, salt = [], [], [], [], []
            for i, j in chunks(offsets):
                for row, h in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k), i):
                    if not len(h) or not ids[row]:
                        continue
                    sig = _digest(h)
                    if sig in seen:
                        seen.move_to_end(sig)
                        continue
                    seen[sig] = None
                    if len(seen) > SEEN:
                        seen.popitem(last=False)
                    n, own = len(h), _key(sig)
                    length = n - (percent * n + 99) // 100 + 1
                    frequent = counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)]
                    order = np.lexsort((h, frequent))[:length]
                    parts = frequent[order].astype(np.uint64) // np.uint64(HOT_LIST) + np.uint64(1)
                    # differently for every element, so that the parts of one list meet in others
                    mine = (mixed(h[order] ^ np.uint64(own & (1 << 64) - 1)) % parts).astype(np.int32)
                    salt.append(np.where(parts > 1, mine, -1).astype(np.int32))
                    token.append(h[order].view(np.int64))
                    key.append(np.full(length, own, np.int64))
                    size.append(np.full(length, n, np.int32))
                    pos.append(np.arange(length, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (token, key, size, pos, salt)], names=["token", "key", "size", "pos", "salt"])
        _trim()

    return work


def _lists(percent: int):
    """Entries sorted by (token, salt, size, key) -> those whose list, or part of a split list,
    has another set of a size that may link, with the set before it and the first set.

    Copies of an entry, from several tasks, go. In the order of sizes the next set is the
    closest: where neither neighbour may link, none may. Of split lists all entries stay,
    for their other parts.
    """
    import pyarrow as pa

    def work(batches):
        held: list | None = None  # the entry that came last, its list's first set, whether it was given out, its salt
        for batch in batches:
            if not len(batch):
                continue
            token, key, size, pos, salt = [c.to_numpy() for c in batch.columns]
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (key[1:] != key[:-1])
            once[0] = held is None or (held[0], held[1], held[6]) != (token[0], key[0], salt[0])
            token, key, size, pos, salt = [c[once] for c in (token, key, size, pos, salt)]
            n = len(token)
            if not n:
                continue
            new = np.empty(n, bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            new[0] = held is None or held[0] != token[0] or held[6] != salt[0]
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first = np.where(start >= 0, key[np.maximum(start, 0)], held[4] if held is not None else 0)
            prev, before = np.empty(n, np.int64), np.empty(n, np.int64)
            prev[1:], before[1:] = key[:-1], size[:-1]
            prev[0], before[0] = (held[1], held[2]) if held is not None else (0, 0)
            near = ~new & (before * 100 >= size.astype(np.int64) * percent)
            out = near.copy()
            out[:-1] |= near[1:]  # of the last entry the next batch decides
            out |= salt >= 0
            cols = [x[out] for x in (token, key, size, pos)]
            more = [np.where(near[out], prev[out], key[out]), first[out]]
            if held is not None and near[0] and not held[5]:
                cols = [np.concatenate([[h], c]) for h, c in zip(held[:4], cols, strict=True)]
                more = [np.concatenate([[held[1]], more[0]]), np.concatenate([[held[4]], more[1]])]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip([*cols, *more], types, strict=True)], names=["token", "key", "size", "pos", "prev", "first"])
            held = [token[-1], key[-1], size[-1], pos[-1], first[-1], bool(out[-1]), salt[-1]]

    return work


def _bitmap_filter(percent: int):
    """(a, b, n_a, n_b, bits_a, bits_b, sig_a, sig_b, least_a, least_b) -> of the pairs that may reach the similarity."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            a, b, na, nb = [c.to_numpy() for c in batch.columns[:4]]
            # Jaccard >= p % iff the symmetric difference is at most (100 - p) / (100 + p) of the sizes' sum
            most = (100 - percent) * (na + nb) // (100 + percent)
            differ = np.array([_differ_at_least(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            keep = differ <= most
            if keep.any():
                yield batch.select(["a", "b", "sig_a", "sig_b", "least_a", "least_b"]).filter(pa.array(keep))

    return work


def _words(bits: list[bytes]) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words."""
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _across(percent: int):
    """List entries (token, cell, size, pos, component, bits), sorted by (token, cell, size, pos)
    -> pairs (u, v) of components that a pair of sets joins which may reach the similarity: at
    most as many as the cell has components."""
    import pyarrow as pa

    def joined(size, pos, comp, bits):
        """Blocks are the runs of one size; in each, positions ascend."""
        given = comp.copy()
        edges = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
        blocks = list(zip(edges[:-1], edges[1:], strict=True))
        words: dict[int, np.ndarray] = {}
        low = 0
        for at, (x0, x1) in enumerate(blocks):
            n = int(size[x0])
            while int(size[blocks[low][0]]) * 100 < percent * n:
                low += 1
            for no, (y0, y1) in enumerate(blocks[low : at + 1], low):
                m = int(size[y0])
                need = (percent * (n + m) + 99 + percent) // (100 + percent)
                most = (100 - percent) * (n + m) // (100 + percent)
                if n - int(pos[x0]) < need:  # the block's best position
                    continue
                stop = y0 + int(np.searchsorted(pos[y0:y1], m - need, "right"))
                for i in range(x0, x1):
                    if n - int(pos[i]) < need:
                        break
                    other = np.flatnonzero(comp[y0 : min(stop, i) if y0 == x0 else stop] != comp[i]) + y0
                    if len(other) > 8:  # many at once
                        if no not in words:
                            words[no] = _words(bits[y0:y1])
                        mine = _words(bits[i : i + 1])
                        width = min(mine.shape[1], words[no].shape[1])
                        for part in np.array_split(other, 1 + len(other) * words[no].shape[1] // (1 << 20)):
                            differ = np.bitwise_count(_folded(words[no][part - y0], width) ^ _folded(mine, width)).sum(axis=1)
                            for j in part[differ <= most].tolist():
                                if comp[j] != comp[i]:
                                    yield given[i], given[j]
                                    comp[comp == comp[j]] = comp[i]
                    else:
                        for j in other.tolist():
                            if comp[j] != comp[i] and _differ_at_least(bits[i], bits[j]) <= most:
                                yield given[i], given[j]
                                comp[comp == comp[j]] = comp[i]

    def work(batches):
        held: list = []
        token = None

        def done():
            if len(held) > 1:
                cols = list(zip(*held, strict=True))
                found = list(joined(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), cols[3]))
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for t, cell, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (t, cell) != token:
                    yield from done()
                    held, token = [], (t, cell)
                held.append(rest)
        yield from done()

    return work


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(sig, items): the sets of the rows of these ids, and of few others."""
    import pyarrow as pa

    needed = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(needed.value, batch.column(0).to_numpy())))
            data, offsets = buffers(batch.column(1))
            out, sig = [], []
            for i, j in chunks(offsets):
                for h in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    out.append(h.view(np.int64))
                    sig.append(_digest(h))
            lengths = np.cumsum([0, *map(len, out)]).astype(np.int32)
            values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), values)], names=["sig", "items"])
        _trim()

    return docs.where("doc_id IS NOT NULL").mapInArrow(sets, "sig binary, items array<long>")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose full sets reach the similarity, as edges (u, v), with the
    number of elements that both have (shared) and that either has (joint)."""
    spark = docs.sparkSession
    cols = ("n", "sig", "least", "bits")
    side = lambda x: classes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b", "sig_a", "sig_b", "least_a", "least_b")
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    schema = "a long, b long, sig_a binary, sig_b binary, least_a long, least_b long"
    pairs = written(pairs.mapInArrow(_bitmap_filter(percent), schema), "jaccard-pairs")
    need = pairs.select(F.col("least_a").alias("need")).unionByName(pairs.select(F.col("least_b").alias("need"))).distinct()
    found = written(_sets_of(docs, need, k), "jaccard-sets", "lz4")
    if not found.groupBy("sig").count().where("count > 1").isEmpty():  # rows given more than once
        repeated, found = found, written(found.dropDuplicates(["sig"]), "jaccard-sets-once", "lz4")
        discard(repeated)
    release(spark)
    side = lambda x: found.select(F.col("sig").alias(f"sig_{x}"), F.col("items").alias(f"items_{x}"))
    both = pairs.join(side("a"), "sig_a").join(side("b"), "sig_b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    both = both.withColumn("shared", shared).withColumn("joint", F.size("items_a") + F.size("items_b") - F.col("shared"))
    links = written(both.where(F.col("shared") * 100 >= F.col("joint") * percent).select(F.col("a").alias("u"), F.col("b").alias("v"), "shared", "joint"), "jaccard-links")
    discard(found, pairs)
    release(spark)
    return links


def _within(percent: int, listed: bool):
    """Sets (group, cell, mine, node, n, here, items, both), sorted by (group, cell, n, node) -> of the
    pairs of each cell that reach the similarity (in a cell of two parts, those across): with
    ``listed`` each one (a, b, shared, joint); else those that connect the cell's sets (a, b),
    and for each set (a) the rows ``there`` of the sets that it links with.

    With the differences x = s ^ r and y = t ^ r to one set r, s ^ t is x ^ y: what s and t share
    follows from the sets' sizes and the elements that x and y share.
    """
    import pyarrow as pa

    names = ["a", "b", "shared", "joint"] if listed else ["a", "b", "there"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] if listed else [pa.int64()] * 3

    def given(*cols):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

    def links(ids, mine, here, sets):
        ids, mine, here = np.array(ids), np.array(mine), np.array(here)
        n = np.array([len(x) for x in sets])
        apart = [np.setxor1d(x, sets[0], assume_unique=True) for x in sets]
        at = np.cumsum([0, *map(len, apart)])
        elements, place = np.unique(np.concatenate(apart), return_inverse=True)
        across = bool((mine != mine[0]).any())
        marked = np.zeros(len(elements), np.int32)
        found, held = [], 0
        root, there, edges = np.arange(len(ids)), np.zeros(len(ids), np.int64), []
        lows = np.searchsorted(n * 100, n * percent, "left")
        for i in range(1, len(n)):
            low = lows[i]
            if low >= i:
                continue
            mark = place[at[i] : at[i + 1]]
            marked[mark] = 1
            sums = np.concatenate([[0], np.cumsum(marked[place[at[low] : at[i]]])])
            marked[mark] = 0
            ends = at[low : i + 1] - at[low]
            common = sums[ends[1:]] - sums[ends[:-1]]
            differ = (at[i + 1] - at[i]) + (ends[1:] - ends[:-1]) - 2 * common
            shared = (n[i] + n[low:i] - differ) // 2
            joint = n[i] + n[low:i] - shared
            near = shared * 100 >= joint * percent
            if across:
                near &= mine[low:i] != mine[i]
            j = np.flatnonzero(near)
            if not len(j):
                continue
            if listed:
                other = ids[low + j]
                found.append((np.minimum(other, ids[i]), np.maximum(other, ids[i]), shared[j], joint[j]))
                held += len(j)
                if held > 100_000:
                    yield given(*map(np.concatenate, zip(*found, strict=True)))
                    found, held = [], 0
                continue
            there[i] += here[low + j].sum()
            there[low + j] += here[i]
            roots, one = np.unique(root[low + j], return_index=True)
            apart_yet = roots != root[i]
            if apart_yet.any():
                edges += [(int(ids[i]), int(ids[low + j[x]])) for x in one[apart_yet]]
                root[np.isin(root, roots)] = root[i]
        if found:
            yield given(*map(np.concatenate, zip(*found, strict=True)))
        if edges:
            yield given(*zip(*edges, strict=True), [None] * len(edges))
        if there.any():
            linked = np.flatnonzero(there)
            yield given(ids[linked], [None] * len(linked), there[linked])

    def work(batches):
        group, both, cell = None, False, ([], [], [], [])

        def done():
            if len(cell[0]) > 1 and (len(set(cell[1])) > 1 or not both):
                yield from links(*cell)

        for batch in batches:
            heads = zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)], strict=True)
            items, offsets = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
            for row, (of, key, mine, node, here) in enumerate(heads):
                if (of, key) != group:
                    yield from done()
                    group, both, cell = (of, key), batch.column(7)[row].as_py(), ([], [], [], [])
                if cell[0] and cell[0][-1] == node:  # rows given more than once
                    continue
                for held, x in zip(cell, (node, mine, here, items[offsets[row] : offsets[row + 1]].copy()), strict=True):
                    held.append(x)
        yield from done()
        _trim()

    return work


class _Joined:
    """What the steps leave: ``info`` of every row, ``classes`` of equal sets, ``links`` that round one
    has verified, ``nodes`` (node, component, grp): the component that round one gives a class
    and its candidate group, outside of which it has no link."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        spark = docs.sparkSession
        self.docs = docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.k, self.percent = k, percent
        rows = written(docs.mapInArrow(_described(k), "doc_id long, n long, sig binary, key long, bits binary, part int, counts binary"), "jaccard-sets-of-rows")
        parts = rows.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(_sum_parts, "part int, counts binary")
        summed = {r.part: bytes(r.counts) for r in parts.toLocalIterator()}
        empty = bytes(4 << SKETCH_BITS - SKETCH_PARTS.bit_length() + 1)
        sketch = spark.sparkContext.broadcast(b"".join(summed.get(i, empty) for i in range(SKETCH_PARTS)))

        self.info = rows.where("part IS NULL").select("doc_id", "n", "sig", "key")
        texts = rows.where("part IS NULL AND n > 0 AND doc_id IS NOT NULL").select("sig", "key", "n", "bits", "doc_id").distinct()
        classes = texts.groupBy("sig", "key", "n", "bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("here"))
        # numbers that stay, once written
        self.classes = classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")

        entries = docs.mapInArrow(_entries(k, percent, sketch), "token long, key long, size int, pos int, salt int")
        entries = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "key")
        lists = written(entries.mapInArrow(_lists(percent), "token long, key long, size int, pos int, prev long, first long"), "jaccard-lists")
        sketch.unpersist()
        release(spark)

        near = lists.select("key", F.col("prev").alias("other")).unionByName(lists.select("key", F.col("first").alias("other")))
        near = near.where("key <> other").select(F.least("key", "other").alias("x"), F.greatest("key", "other").alias("y")).distinct()
        of = lambda x, y: classes.select(F.col("key").alias(x), F.col("node").alias(y))
        near = near.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b")
        self.links = links = _verified(docs, classes, near, k, percent)

        # round two: only lists that still hold two components
        self.found = found = components(links)
        labels = classes.join(found, "node", "left").select("node", "key", "bits", "n", F.coalesce("component", "node").alias("component"))
        labels = written(labels, "jaccard-labels")
        labelled = lists.select("token", "key", "size", "pos").join(labels.select("key", "node", "component"), "key").select("token", "node", "size", "pos", "component")
        labelled = written(labelled, "jaccard-labelled")
        discard(lists)
        release(spark)
        split = labelled.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("entries"))
        split = split.where("c0 <> c1").select("token", F.ceil(F.col("entries") / LIST).alias("parts"))
        # a long list is cut into parts, and every two of them meet in a cell
        open_ = labelled.join(split, "token").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")))
        open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        open_ = open_.withColumn("cell", F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"))
        open_ = open_.join(labels.select("node", "bits"), "node")
        open_ = open_.select("token", "cell", "size", "pos", "component", "bits").repartition("token", "cell").sortWithinPartitions("token", "cell", "size", "pos")
        across = written(open_.mapInArrow(_across(percent), "u long, v long").distinct(), "jaccard-across")
        discard(labelled)
        release(spark)
        groups = components(across).select(F.col("node").alias("component"), F.col("component").alias("grp"))
        nodes = labels.select("node", "n", "component").join(groups, "component", "left")
        self.nodes = written(nodes.select("node", "n", "component", F.coalesce("grp", "component").alias("grp")), "jaccard-nodes")
        discard(across, labels)
        release(spark)

    # members() deletes the tables of all steps: it comes last
    def within(self, every: bool, listed: bool = False) -> DataFrame:
        """What ``_within`` gives of the groups of several components, and with ``every`` of all
        groups but those of two sets whose link is verified."""
        sizes = self.nodes.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"), (F.min("component") != F.max("component")).alias("several"))
        parts = F.greatest(F.ceil(F.col("sets") / PART_SETS), F.ceil(F.col("elements") / PART_ITEMS))
        many = sizes.where(F.col("several") | (F.lit(every) & (F.col("sets") > 2))).select("grp", parts.alias("parts"))
        chosen = self.nodes.select("node", "grp").join(many, "grp")
        chosen = written(chosen.join(self.classes.select("node", "n", "sig", "least", "here"), "node"), "jaccard-nodes-of-many")
        sets = _sets_of(self.docs, chosen.select("least"), self.k)
        sets = sets.join(chosen, "sig").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")))
        sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sets = sets.withColumn("cell", F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"))
        # a cell of two parts, of which one may be empty
        sets = sets.select("grp", "cell", "mine", "node", "n", "here", "items", (F.pmod("cell", "parts") != F.floor(F.col("cell") / F.col("parts"))).alias("both"))
        sets = sets.repartition("grp", "cell").sortWithinPartitions("grp", "cell", "n", "node")
        schema = "a long, b long, shared int, joint int" if listed else "a long, b long, there long"
        among = written(sets.mapInArrow(_within(self.percent, listed), schema), "jaccard-within")
        self.chosen, self.among = chosen, among
        release(self.docs.sparkSession)
        return among

    def alone(self) -> DataFrame:
        """Verified links outside of the groups that ``within`` saw: of two sets, their only one."""
        return self.links.join(self.chosen.select(F.col("node").alias("u")), "u", "left_anti")

    def members(self, edges: DataFrame, there: DataFrame | None) -> DataFrame:
        """One row per row of ``docs``, from edges (u, v) that connect the classes and the counts (node, there)."""
        classes = self.classes.select("node", "sig", "least", "here")
        texts = self.info.where("n > 0 AND doc_id IS NOT NULL")
        several = texts.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id")
        several = written(several, "jaccard-several")
        if not several.isEmpty():  # the texts of one doc_id are one node
            nodes = texts.join(several, "doc_id").select("doc_id", "sig").distinct().join(classes.select("sig", "node"), "sig")
            nodes = written(nodes.select("doc_id", "node"), "jaccard-nodes-of-several")
            one = nodes.groupBy("doc_id").agg(F.min("node").alias("v"))
            edges = edges.unionByName(nodes.join(one, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v"))
        found = self.found
        if not edges.isEmpty():
            edges = edges.unionByName(found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
            found = components(edges)
        least = found.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
        labels = classes.join(found.join(least, "component").select("node", "component_id"), "node", "left")
        if there is not None:
            labels = labels.join(there.groupBy("node").agg(F.sum("there").alias("there")), "node", "left")
            labels = labels.withColumn("n_links", F.col("here") - 1 + F.coalesce("there", F.lit(0)))
        labels = labels.select("sig", F.col("node").alias("class_id"), F.coalesce("component_id", "least").alias("component_id"), *["n_links"] * (there is not None))
        labels = written(labels, "jaccard-classes-labelled")
        discard(several, found, self.found, self.classes, self.links, self.nodes, self.chosen, self.among)
        release(self.docs.sparkSession)
        known = F.col("doc_id").isNotNull()
        return self.info.join(labels, "sig", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known, F.col("class_id")).alias("class_id"),
            *[F.when(known, F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ["n_links"] * (there is not None)],
        )

    def ends(self, pairs: DataFrame) -> DataFrame:
        """(node, there) of both ends of the pairs (u, v)."""
        pairs = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return pairs.join(self.classes.select(F.col("node").alias("v"), "here"), "v").select(F.col("u").alias("node"), F.col("here").alias("there"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links), one row per row of ``docs``.

    class_id is a number of the set that rows of equal sets share, null without shingles; n_links counts
    the other doc_ids whose sets the row's set links with, those of an equal set too.
    """
    steps = _Joined(docs, k, percent)
    among = steps.within(True)
    there = among.where("b IS NULL").select(F.col("a").alias("node"), "there").unionByName(steps.ends(steps.alone()))
    return steps.members(among.where("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v")), there)


def representative_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links, in two tables: links (a, b, shared, joint), every pair of class_ids a < b whose sets reach the
    similarity shared / joint; and the members of the classes, as ``jaccard_join`` gives them."""
    steps = _Joined(docs, k, percent)
    among = steps.within(True, listed=True)
    alone = steps.alone().select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "shared", "joint")
    links = written(among.unionByName(alone), "jaccard-all-links")
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return links, written(steps.members(pairs, steps.ends(pairs)), "jaccard-members")


def document_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b: the links of ``representative_links`` between documents."""
    of = members.where("n_links > 0").select("doc_id", "class_id").distinct()
    side = lambda x, r: of.select(F.col("doc_id").alias(x), F.col("class_id").alias(r))
    across = links.withColumnsRenamed({"a": "ra", "b": "rb"}).join(side("x", "ra"), "ra").join(side("y", "rb"), "rb")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("shared") / F.col("joint")).alias("similarity"))
    equal = side("a", "r").join(side("b", "r"), "r").where("a < b")
    return across.unionByName(equal.select("a", "b", F.lit(1.0).alias("similarity")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    steps = _Joined(docs, k, percent)
    among = steps.within(False)
    return steps.members(among.where("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v")), None).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest doc_id, and of several
    rows of it the one whose hash of all columns is least. Rows without doc_id stay."""
    found = jaccard_components(docs, k, percent).where("doc_id = component_id").select(F.col("doc_id").alias("lw_kept"))
    found = written(found, "jaccard-kept")
    once = found.distinct().hint("shuffle_hash")
    kept = docs.join(once, docs.doc_id == once.lw_kept, "left_semi")
    if found.count() > once.count():  # rows given more than once
        rows = kept.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("h"))
        least = rows.groupBy(F.col("id").alias("of")).agg(F.min("h").alias("least"))
        rows = rows.join(least, (F.col("id") == F.col("of")) & (F.col("h") == F.col("least")))
        kept = rows.dropDuplicates(["id"]).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))
