"""Suffix-array dedup: removal of every byte covered by a string of ``least`` bytes that
also starts anywhere else, across all documents.

1. Anchors: each window of ``least`` bytes chooses, by its content alone, the rightmost
   least hash among its GRAM-byte strings. Neighbouring windows of one choice form a
   context; equal windows lie in contexts of one anchor, at one distance from it. Only
   hashes and places are shuffled: a few percent of the text.
2. Contexts that are equal as a whole repeat as a whole. Those of one batch of rows are
   counted together before the shuffle, so that a passage of many texts, or a text that
   repeats itself, is a row for each batch.
3. Of the other contexts of an anchor the texts are fetched, one of each, and searched by
   threshold-bounded interval expansion: on the Burrows-Wheeler transform of the texts,
   a breadth-first backward extension sets common-prefix lengths by increasing value, and
   stops at ``least``. What has no value by then shares ``least`` bytes with its neighbour.
4. Anchors of more contexts than HOT are split before: the windows of a context are cut into
   parts by their distance from the anchor, and all that the windows of a part have in common
   becomes its anchor. Equal windows stay together; contexts that share less part. What is
   still large is cut again, down to single windows. A task so searches at most HOT contexts
   of an anchor at once, however many texts share a passage.

Texts are shuffled for rows that a bit array of fixed size lets through only.

Defined results: a null or empty text has 0 bytes and nothing removed; overlaps and
self-overlaps count; repeated rows, with equal or null ids too, remove each other; texts of any
length are taken whole, in pieces for the search of anchors; there are no ties; an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.llm.filters import id_filter, may_hold, passing
from linkwell.llm.runtime import discard, release, written
from linkwell.llm.shingles import buffers, chunks, mixed

GRAM = 64
HOT = 1000  # contexts of one anchor that are searched at once
PARTS = 8  # into which the windows of larger anchors are cut, again and again
BATCH = 1 << 20  # bytes searched at once
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_T1 = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_T2 = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Hashes of any substring of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray, *tables: np.ndarray):
        n = len(data)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = []
        for table in tables:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(table[data] * power[:n], out=s[1:])
            self.sums.append(s)
        power[:] = _INVERSE
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = power

    def of(self, start, end, table: int = 0) -> np.ndarray:
        s = self.sums[table]
        return mixed((s[end] - s[start]) * self.back[start])


def contexts(data: np.ndarray, offsets: np.ndarray, least: int):
    """(row, start in row, lead, span, anchor hash, context hash) arrays of a chunk of rows.

    Windows start at start .. start + span; the anchor lies lead bytes after start.
    """
    n = len(data)
    if n < least:
        return [np.zeros(0, np.int64)] * 6
    gram = min(GRAM, least)
    rolling = Rolling(data, _T1, _T2)
    at = np.arange(n - gram + 1)
    h = rolling.of(at, at + gram)
    width = least - gram + 1
    # hash bits above, place below, so that the least key is the rightmost of the least hash
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (low - at.astype(np.uint64))
    m = len(key) - width + 1
    full = -(-len(key) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least_key = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
    place = (low - (least_key & low)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(m), "right") - 1
    valid = np.arange(m) + least <= offsets[row + 1]
    new = np.ones(m, bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], m) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    r = row[first]
    return r, first - offsets[r], place[first] - first, last - first, h[place[first]].view(np.int64), rolling.of(first, last + least, 1).view(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, least: int):
    """Chunks of rows, and overlapping pieces of rows longer than a chunk: (first row, bytes, offsets, bytes of the row before)."""
    for i, j in chunks(offsets, SEGMENT):
        a, b = offsets[i], offsets[j]
        if b - a <= SEGMENT:
            yield i, data[a:b], offsets[i : j + 1] - a, 0
        else:
            for s in range(0, int(b - a) - least + 1, SEGMENT):
                piece = data[a + s : min(a + s + SEGMENT + least - 1, b)]
                yield i, piece, np.array([0, len(piece)]), s


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols at least, by prefix doubling.

    Zeros end a piece of text; each is a symbol of its own, less than all bytes. Symbols
    are below 512: seven fit one key.
    """
    n, k = len(text), 7
    ends = np.flatnonzero(text == 0)
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    left = ends[piece] - np.arange(n)  # symbols before the piece's end
    wide = np.concatenate([text.astype(np.int64), np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = key * 512 + np.where(left >= i, wide[i : n + i], 0)
    # suffixes that end within the key differ by their ends: these sort first among equals
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    short = left < k
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:]
        second += len(ends)
        if short is not None:
            second = np.where(short, piece, second)
            short = None
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=new[1:])
        rank[order] = new
        k *= 2
        if k >= depth or new[-1] == n - 1:
            return order


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """True where a string of ``least`` bytes starts that also starts elsewhere in ``text``.

    ``text``: pieces, each of bytes + 1 and a final 0.
    """
    n = len(text)
    order = suffix_array(text, least)
    bwt = text[order - 1]
    first = text[order]
    # the suffix one symbol longer than that of rank i has rank longer[i]
    longer = np.empty(n, np.int64)
    longer[np.argsort(bwt, kind="stable")] = np.arange(n)
    pieces = int((text == 0).sum())
    unset = np.ones(n + 1, bool)
    unset[: pieces + 1] = False
    unset[n] = False
    counts = np.bincount(text)
    upper = np.cumsum(counts)
    symbols = np.flatnonzero(counts[1:]) + 1
    # strings of one symbol; every final 0 is a string of its own
    lows = np.concatenate([np.arange(pieces), upper[symbols] - counts[symbols]])
    highs = np.concatenate([np.arange(pieces), upper[symbols] - 1])
    unset[highs + 1] = False
    owner = np.empty(n, np.int64)
    for _ in range(1, least):
        sizes = highs - lows + 1
        if not len(sizes):
            break
        many = int(sizes.sum())
        if many == len(sizes):
            to = longer[lows]
            group = np.arange(many)
        else:
            group = np.repeat(np.arange(len(sizes)), sizes)
            to = longer[np.arange(many) + np.repeat(lows - np.cumsum(sizes) + sizes, sizes)]
        # in the order of the longer strings' ranks, those of one symbol and one interval are neighbours
        if many > n // 16:
            owner[:] = -1
            owner[to] = group
            to = np.flatnonzero(owner >= 0)
            group = owner[to]
        else:
            by = np.argsort(to)
            to, group = to[by], group[by]
        at = np.searchsorted(to, pieces)  # what ends a piece is not extended over
        to, group = to[at:], group[at:]
        if not len(to):
            break
        symbol = first[to]
        edge = np.flatnonzero((group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1]))
        lows = to[np.append(0, edge + 1)]
        highs = to[np.append(edge, len(to) - 1)]
        open_ = unset[highs + 1]
        lows, highs = lows[open_], highs[open_]
        unset[highs + 1] = False
    out = np.zeros(n, bool)
    out[order[unset[:n] | unset[1:]]] = True
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, after last) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _anchored(least: int):
    """(doc_id, key, text) -> the contexts of a batch, equal ones once with their number; and,
    without anchor, the ranges of those that a batch has several times."""
    import pyarrow as pa

    names = ["doc_id", "key", "start", "stop", "lead", "span", "anchor", "context", "times"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def work(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            ids, keys, found = batch.column(0), batch.column(1), []
            for i, piece, off, before in segments(data, offsets, least):
                row, start, *rest = contexts(piece, off, least)
                found.append((row + i, start + before, *rest))
            if not found:
                continue
            row, start, lead, span, anchor, context = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(row):
                continue
            stop = start + span + least
            whole = mixed(anchor.view(np.uint64) ^ mixed(context.view(np.uint64) ^ (lead * 65536 + span).astype(np.uint64)))
            _, once, which, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            cols = [x[once] for x in (start, stop, lead, span, anchor, context)] + [times]
            take = pa.array(row[once])
            yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), *[pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(cols, types, strict=True)]], names=names)
            again = np.flatnonzero(times[which] > 1)
            if len(again):
                row, start, stop = row[again], start[again], stop[again]  # in order of rows and starts; stops ascend too
                new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(row)) - 1
                take, none = pa.array(row[first]), [None] * len(first)
                cols = [start[first], stop[last]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), *[pa.array(c) for c in cols], *[pa.array(none, type=t) for t in types[2:]]], names=names
                )

    return work


BODIES = "doc_id long, key long, start long, lead int, span int, anchor long, n long, body binary"


def _bodies(rows: list[tuple]):
    import pyarrow as pa

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    names = [c.split()[0] for c in BODIES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)


def _fetched(least: int):
    """(doc_id, key, text, wanted array) -> the contexts with their bytes."""

    def work(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            heads = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for row, (doc_id, key, wanted) in enumerate(heads):
                text = data[offsets[row] : offsets[row + 1]]
                for at in range(0, len(wanted), 1000):
                    yield _bodies([
                        (doc_id, key, w["start"], w["lead"], w["span"], w["anchor"], w["n"], text[w["start"] : w["start"] + w["span"] + least].tobytes())
                        for w in wanted[at : at + 1000]
                    ])

    return work


def _parted(least: int, width: int):
    """Contexts -> their windows in parts of ``width`` distances from the anchor, each with what
    all windows of these distances have in common as its anchor."""

    def parts(doc_id, key, start, lead, span, anchor, n, body):
        for q in range((lead - span) // width, lead // width + 1):
            far, close = min(lead, q * width + width - 1), max(lead - span, q * width)
            part = body[lead - far : lead - close + least]
            common = body[lead - q * width : lead + least - q * width - width + 1]
            digest = hashlib.blake2b(common, digest_size=8, salt=q.to_bytes(4, "little"), key=anchor.to_bytes(8, "little", signed=True)).digest()
            yield doc_id, key, start + lead - far, far, far - close, int.from_bytes(digest, "little", signed=True), n, part

    def work(batches):
        for batch in batches:
            rows = [p for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for p in parts(*row)]
            for at in range(0, len(rows), 1000):
                yield _bodies(rows[at : at + 1000])

    return work


def _searched(least: int):
    """Contexts with text (doc_id, key, start, anchor, n, body), sorted by anchor -> removed ranges of
    those that are alone in their kind."""
    import pyarrow as pa

    def search(held):
        text = np.zeros(sum(len(x[5]) + 1 for x in held), np.int16)
        at, starts = 0, []
        for x in held:
            starts.append(at)
            text[at : at + len(x[5])] = np.frombuffer(x[5], np.uint8).astype(np.int16) + 1
            at += len(x[5]) + 1
        found = repeated_starts(text, least)
        out = []
        for x, at in zip(held, starts, strict=True):
            if x[4] == 1:
                out += [(x[0], x[1], x[2] + a, x[2] + b - 1 + least) for a, b in runs(found[at : at + len(x[5])])]
        if out:
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "key", "start", "stop"])

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and x[:4] == held[-1][:4]:  # a row given more than once
                    continue
                if size > BATCH and x[3] != held[-1][3]:
                    yield from search(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[5]) + 1
        if held:
            yield from search(held)

    return work


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text, row): hashes of the text, and of both, which all equal rows share."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return keyed.withColumn("row", F.xxhash64("doc_id", "key"))


def removed_ranges(docs: DataFrame, least: int = 400) -> DataFrame:
    """(doc_id, key, start, stop): byte ranges to remove, overlapping; key is xxhash64(text)."""
    keyed = _keyed(docs)
    anchors = keyed.drop("row").mapInArrow(_anchored(least), "doc_id long, key long, start long, stop long, lead int, span int, anchor long, context long, times long")
    anchors = written(anchors, "repeat-anchors")
    held = anchors.where("anchor IS NOT NULL")
    often = held.groupBy("anchor").agg(F.sum("times").alias("all_times")).where("all_times > 1").select("anchor")
    shared = written(held.join(often, "anchor"), "repeat-shared")
    ranges = written(anchors.where("anchor IS NULL").select("doc_id", "key", "start", "stop"), "repeat-local")
    discard(anchors)
    release(docs.sparkSession)
    kind = ["anchor", "context", "lead", "span"]
    kinds = shared.groupBy(*kind).agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("at"))
    kinds = written(kinds, "repeat-kinds")
    same = shared.join(kinds.where("n > 1").select(*kind), kind, "left_semi")
    ranges = ranges.unionByName(same.select("doc_id", "key", "start", "stop"))

    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(several, "anchor").select("at.*", "anchor", "lead", "span", "n", (F.col("kinds") > HOT).alias("hot"))
    wanted = written(wanted.withColumn("row", F.xxhash64("doc_id", "key")), "repeat-wanted")
    found = [written(ranges, "repeat-ranges")]
    discard(shared)
    release(docs.sparkSession)

    def fetched(which: str) -> DataFrame:
        lists = wanted.where(which).groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "start", "lead", "span", "n")).alias("wanted"))
        lists = lists.withColumnsRenamed({"doc_id": "d", "key": "k"}).hint("shuffle_hash")
        # one row of those with the same doc_id and text
        rows = passing(keyed, "row", id_filter(wanted.where(which).select("row")))
        rows = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
        return rows.select("doc_id", "key", "text", "wanted").mapInArrow(_fetched(least), BODIES)

    def search(bodies: DataFrame) -> None:
        bodies = bodies.select("doc_id", "key", "start", "anchor", "n", "body")
        bodies = bodies.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "start")
        found.append(written(bodies.mapInArrow(_searched(least), "doc_id long, key long, start long, stop long"), "repeat-partly"))
        release(docs.sparkSession)

    search(fetched("NOT hot"))
    if not wanted.where("hot").isEmpty():
        # rows given more than once are fetched more than once
        hot = written(fetched("hot").dropDuplicates(["doc_id", "key", "start", "anchor"]), "repeat-hot")
        width = least - min(GRAM, least) + 1
        while width > 1:
            width = -(-width // PARTS)
            parts = written(hot.mapInArrow(_parted(least, width), BODIES).withColumn("context", F.xxhash64("body")), "repeat-parts")
            discard(hot)
            kinds = parts.groupBy(*kind).agg(F.count("*").alias("same"), F.max("n").alias("most"), F.min(F.struct("doc_id", "key", "start")).alias("at"))
            kinds = written(kinds, "repeat-kinds")
            again = parts.where("n = 1").join(kinds.where("same > 1 OR most > 1").select(*kind), kind, "left_semi")
            found.append(written(again.select("doc_id", "key", "start", (F.col("start") + F.col("span") + least).alias("stop")), "repeat-whole"))
            several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
            chosen = kinds.join(several, "anchor").select(*kind, "at", F.greatest("same", "most").alias("times"), "kinds")
            one = parts.withColumn("at", F.struct("doc_id", "key", "start")).join(chosen, [*kind, "at"])
            one = written(one.select("doc_id", "key", "start", "lead", "span", "anchor", F.col("times").alias("n"), "body", "kinds"), "repeat-one-of-each")
            discard(parts, kinds)
            release(docs.sparkSession)
            search(one.where(F.col("kinds") <= HOT))
            hot = one.where(F.col("kinds") > HOT).drop("kinds")
            hot.lw_path = one.lw_path
            if hot.isEmpty():
                break
        discard(hot)
    discard(wanted)
    for more in found[1:]:
        ranges = more if more is found[1] else ranges.unionByName(more)
    ranges = ranges.unionByName(found[0])
    ranges.lw_tables = found
    return ranges


def dedup(docs: DataFrame, least: int = 400, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row of ``docs``.

    ``kept`` is what is left of the text, as bytes; null unless ``with_text``.
    """
    import pyarrow as pa

    ranges = removed_ranges(docs, least)
    lists = ranges.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    lists = written(lists.withColumnsRenamed({"doc_id": "d", "key": "k"}), "repeat-lists")
    discard(*ranges.lw_tables)
    keyed, array = _keyed(docs), id_filter(lists.select(F.xxhash64("d", "k")))
    joined = passing(keyed, "row", array).join(lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    shared = docs.sparkSession.sparkContext.broadcast(array)

    def kept_of(batch, ranges):
        data, offsets = buffers(batch.column(1))
        rows = []
        for row, found in enumerate(ranges):
            text = data[offsets[row] : offsets[row + 1]]
            merged: list[list[int]] = []
            for x in sorted((x["start"], x["stop"]) for x in found or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            keep = np.ones(len(text), bool)
            for a, b in merged:
                keep[a:b] = False
            kept = text[keep].tobytes()
            rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def listed(batches):
        for batch in batches:
            yield kept_of(batch, batch.column(2).to_pylist())

    def others(batches):  # of which nothing is removed
        for batch in batches:
            batch = batch.filter(pa.array(~may_hold(shared.value, batch.column(2).to_numpy())))
            yield kept_of(batch, [None] * len(batch))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "ranges").mapInArrow(listed, schema).unionByName(keyed.select("doc_id", "text", "row").mapInArrow(others, schema))
