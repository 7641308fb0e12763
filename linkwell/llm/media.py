"""Media columns for ISO base media files (MP4, MOV): boxes, sample tables, key frames.

``write_track`` stores bytes losslessly as the samples of one track; ``walk`` and
``probe`` read any such file by its nested boxes and sample tables, never its payload;
``media_columns`` adds the findings to a table as typed columns.

Defined results: a null or empty file, or one whose boxes are cut short or contradict
each other, gives null columns (``feature`` "invalid"); files without tracks give an empty
track list. A null or empty text is stored as 64 bytes 0; equal texts, of repeated rows too, give equal
values. Samples are those of the sample tables: a fragmented file (moof boxes) gives the
tracks of its moov box, without samples if that has none. ``media_columns`` describes the first
track in columns and all tracks in media_feature; columns of the new names are replaced, extra
columns stay; an empty table gives an empty result. Work is row by row on whole values, very long
ones included; memory is bounded by the largest value. There are no ties.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
TIMESCALE = 8000
SAMPLE_BYTES = 1024
GROUP = 8  # a key frame every so many samples


class BadMedia(ValueError):
    pass


# -- writing


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = 64) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``unit``."""
    return data + b"\0" * ((-len(data)) % unit or (0 if data else unit))


def write_track(payload: bytes, sample_bytes: int = SAMPLE_BYTES, group: int = GROUP) -> bytes:
    """A file with one track of 8-bit samples ("raw "), ``sample_bytes`` of them a media sample.

    The bytes of a group of samples are one chunk; the first sample of each is a key frame.
    """
    n = -(-len(payload) // sample_bytes)
    last = len(payload) - (n - 1) * sample_bytes if n else 0
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    start = len(ftyp) + 8
    chunks = -(-n // group)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    # media time: one tick a byte
    stts = [(n - 1, sample_bytes), (1, last)] if n > 1 and last != sample_bytes else [(n, last)] if n else []
    full, rest = divmod(n, group)
    stsc = [(1, group)] * bool(full) + [(full + 1, rest)] * bool(rest)
    sizes = [sample_bytes] * (n - 1) + [last] if n else []
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, TIMESCALE << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">I", len(stts)), *[struct.pack(">II", *x) for x in stts]),
        _full(b"stss", struct.pack(">I", chunks), *[struct.pack(">I", 1 + i * group) for i in range(chunks)]),
        _full(b"stsc", struct.pack(">I", len(stsc)), *[struct.pack(">III", first, per, 1) for first, per in stsc]),
        _full(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)),
        _full(b"stco", struct.pack(f">I{chunks}I", chunks, *[start + i * group * sample_bytes for i in range(chunks)])),
    )
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    minf = _box(b"minf", _full(b"smhd", b"\0" * 4), dinf, stbl)
    mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, len(payload), 0x55C4, 0))
    hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0")
    tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0), matrix, b"\0" * 8, flags=3)
    trak = _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf))
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, len(payload), 0x10000, 0x100), matrix, b"\0" * 24, struct.pack(">I", 2))
    return ftyp + _box(b"mdat", payload) + _box(b"moov", mvhd, trak)


# -- reading


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, nested ones after their parent."""
    stack = [(start, len(data) if end is None else end, path)]
    while stack:
        at, stop, path = stack.pop()
        if at == stop:
            continue
        if stop - at < 8:
            raise BadMedia("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if stop - at < 16:
                raise BadMedia("a box header is cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = stop - at
        if kind == b"uuid":
            body += 16
        if at + size > stop or body > at + size:
            raise BadMedia("a box ends beyond its parent")
        here = (*path, kind)
        yield here, body, at + size
        stack.append((at + size, stop, path))
        if kind in CONTAINERS and len(here) < 16:
            stack.append((body, at + size, here))


def _table(data: bytes, body: int, end: int, fmt: str, head: int = 4) -> list[tuple]:
    """The entries of a table box: a count after ``head`` bytes, then entries."""
    if body + head + 4 > end:
        raise BadMedia("a table is cut short")
    (n,) = struct.unpack_from(">I", data, body + head)
    at = body + head + 4
    if n * struct.calcsize(fmt) > end - at:
        raise BadMedia("a table is cut short")
    return list(struct.iter_unpack(fmt, data[at : at + n * struct.calcsize(fmt)]))


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    version = data[boxes[b"mdhd"][0]]
    scale, ticks = struct.unpack_from(">IQ" if version else ">II", data, boxes[b"mdhd"][0] + (20 if version else 12))
    (codec,) = struct.unpack_from(">4s", data, boxes[b"stsd"][0] + 12)
    (handler,) = struct.unpack_from(">4s", data, boxes[b"hdlr"][0] + 8)
    fixed, n = struct.unpack_from(">II", data, boxes[b"stsz"][0] + 4)
    if fixed:
        if n > len(data):
            raise BadMedia("more samples than bytes")
        sizes = [fixed] * n
    else:
        sizes = [x for (x,) in _table(data, *boxes[b"stsz"], ">I", 8)]
    offsets = [x for (x,) in (_table(data, *boxes[b"stco"], ">I") if b"stco" in boxes else _table(data, *boxes[b"co64"], ">Q"))]
    runs = _table(data, *boxes[b"stsc"], ">III")
    ranges: list[tuple[int, int]] = []
    if runs and runs[0][0] != 1:
        raise BadMedia("the first run of chunks is not at chunk 1")
    for (first, per, _), (following, *_) in zip(runs, [*runs[1:], (len(offsets) + 1, 0, 0)], strict=True):
        if following <= first:
            raise BadMedia("the runs of chunks do not ascend")
        for chunk in range(first - 1, following - 1):
            if chunk >= len(offsets) or len(ranges) + per > len(sizes):
                raise BadMedia("the sample tables disagree")
            at = offsets[chunk]
            for size in sizes[len(ranges) : len(ranges) + per]:
                ranges.append((at, size))
                at += size
            if at > len(data):
                raise BadMedia("a sample ends beyond the file")
    if len(ranges) != len(sizes):
        raise BadMedia("the sample tables disagree")
    keys = [x - 1 for (x,) in _table(data, *boxes[b"stss"], ">I")] if b"stss" in boxes else list(range(len(sizes)))
    if any(not 0 <= k < len(sizes) for k in keys):
        raise BadMedia("a key frame is not a sample")
    spent = sum(count * delta for count, delta in _table(data, *boxes[b"stts"], ">II"))
    return {
        "codec": codec.decode("latin-1"),
        "handler": handler.decode("latin-1"),
        "duration": (ticks or spent) / scale if scale else 0.0,
        "samples": len(sizes),
        "ranges": ranges,
        "keyframes": [ranges[k] for k in keys],
    }


def probe(data: bytes) -> list[dict]:
    """The tracks of a file: codec, handler, duration in seconds, sample and key frame byte ranges."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, body, end in walk(data):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and tracks:
            tracks[-1].setdefault(path[-1], (body, end))
    try:
        return [_track(data, boxes) for boxes in tracks]
    except (KeyError, IndexError, struct.error) as e:
        raise BadMedia(f"a table is missing or cut short: {e}") from e


def payload_of(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, in sample order."""
    return b"".join(data[at : at + size] for at, size in track["ranges"])


def feature(tracks: list[dict]) -> str:
    return "|".join(
        f"codec={t['codec'].strip()};handler={t['handler']};duration={t['duration']:.6f};samples={t['samples']};"
        f"keyframes={len(t['keyframes'])}:" + ",".join(f"{at}+{size}" for at, size in t["keyframes"])
        for t in tracks
    )


# -- tables

COLUMNS = "media_codec string, media_duration double, media_samples long, media_keyframes array<struct<at:long,size:long>>, media_feature string"


def media_columns(df: DataFrame, content: str) -> DataFrame:
    """``df`` with the first track's codec, duration, sample count and key frame byte ranges.

    ``content`` is a binary column. The new columns replace columns of the same names.
    """
    import pyarrow as pa

    new = ["media_codec", "media_duration", "media_samples", "media_keyframes", "media_feature"]
    kept = [c for c in df.columns if c not in new]
    at = kept.index(content)
    frame_type = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))

    def found(data: bytes | None):
        try:
            tracks = probe(data) if data else []
        except BadMedia:
            return None, None, None, None, "invalid"
        if not tracks:
            return None, None, None, None, "invalid" if not data else ""
        t = tracks[0]
        return t["codec"], t["duration"], t["samples"], [{"at": a, "size": s} for a, s in t["keyframes"]], feature(tracks)

    def work(batches):
        for batch in batches:
            out = [found(x.as_py()) for x in batch.column(at)]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), frame_type, pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*kept, *new])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*df.select(*kept).schema.fields, *_parse_datatype_string(COLUMNS).fields])
    return df.select(*kept).mapInArrow(work, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as a media file and read back through its sample tables."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                data = write_track(pad(raw))
                tracks = probe(data)
                back = payload_of(data, tracks[0])
                rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(tracks)))
            cols = zip(*rows, strict=True) if rows else [()] * 8
            types = (batch.schema.types[0], pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(work, schema)
