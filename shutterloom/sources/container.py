"""Raw-photo containers: ISO boxes, TIFF directories, embedded JPEGs. Small byte helpers under Arrow functions.

Photographs are tens of megabytes, of which metadata, thumbnail and preview take the first few: previews() and
thumbnails() read a bounded head, full_images() the one range that the head names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

#: The bytes of each TIFF type, the user type of the preview's box.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PREVIEW_UUID = bytes.fromhex("eaf42b5e1c984b88b9fbb7dc406e4d16")


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, content start, end) of the boxes in a range; a malformed one, or one beyond the range, ends it."""
    end = len(data) if end is None else min(end, len(data))
    while start + 8 <= end:
        size, kind, head = int.from_bytes(data[start : start + 4], "big"), data[start + 4 : start + 8], 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        stop = end if size == 0 else start + size
        if stop < start + head or stop > end:
            return
        yield kind, start + head, stop
        start = stop


def payload_start(data: bytes, kind: bytes) -> int | None:
    """Where the content of a top-level box begins, also of one that runs beyond the data."""
    at = 0
    while at + 8 <= len(data):
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            if at + 16 > len(data):
                return None
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        if data[at + 4 : at + 8] == kind:
            return at + head
        if size < head:
            return None
        at += size
    return None


def child(data: bytes, start: int, end: int, kind: bytes) -> tuple[int, int] | None:
    return next(((a, b) for k, a, b in boxes(data, start, end) if k == kind), None)


def jpeg_in(data: bytes, start: int, end: int, kind: bytes) -> bytes | None:
    """The JPEG in a box found by its type's bytes: from its first start marker to the end of the box."""
    at = data.find(kind, start, end)
    if at < start + 4:
        return None
    stop = min(end, at - 4 + int.from_bytes(data[at - 4 : at], "big"))
    begin = data.find(b"\xff\xd8\xff", at, stop)
    return data[begin:stop] if begin >= 0 else None


def preview(data: bytes) -> bytes | None:
    for kind, a, b in boxes(data):
        if kind == b"uuid" and data[a : a + 16] == PREVIEW_UUID:
            return jpeg_in(data, a + 16, b, b"PRVW")
    return None


def thumbnail(data: bytes) -> bytes | None:
    moov = child(data, 0, len(data), b"moov")
    return jpeg_in(data, *moov, b"THMB") if moov else None


def _without_exif(jpeg: bytes) -> bytes:
    """Without the Exif segments of its head."""
    i, kept = 2, [jpeg[:2]]
    while i + 4 <= len(jpeg) and jpeg[i] == 0xFF and jpeg[i + 1] not in (0xDA, 0xD9):
        if jpeg[i + 1] == 1 or 0xD0 <= jpeg[i + 1] <= 0xD7:
            size = 2
        else:
            size = 2 + int.from_bytes(jpeg[i + 2 : i + 4], "big")
            if size < 4 or i + size > len(jpeg):
                break
        if not (jpeg[i + 1] == 0xE1 and jpeg[i + 4 : i + 10] == b"Exif\0\0"):
            kept.append(jpeg[i : i + size])
        i += size
    return b"".join(kept) + jpeg[i:]


def oriented(jpeg: bytes, orientation: int) -> bytes:
    """The JPEG with that orientation (3, 6 or 8; others change nothing) as its only Exif tag, pixels as they are."""
    if orientation not in (3, 6, 8) or jpeg[:2] != b"\xff\xd8":
        return jpeg
    directory = struct.pack("<HHHIHHI", 1, 0x0112, 3, 1, orientation, 0, 0)
    body = b"Exif\0\0" + struct.pack("<2sHI", b"II", 42, 8) + directory
    segment = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    rest = _without_exif(jpeg)
    return rest[:2] + segment + rest[2:]


def jpeg_end(data: bytes, start: int) -> int | None:
    """Where a JPEG really ends: segments are skipped by length, entropy-coded data by stuffing and restart markers."""
    i = start + 2
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            return None
        marker = data[i + 1]
        if marker == 0xD9:
            return i + 2
        if marker == 0xFF or 0xD0 <= marker <= 0xD7 or marker == 1:
            i += 1 if marker == 0xFF else 2
            continue
        i += 2 + int.from_bytes(data[i + 2 : i + 4], "big")
        if marker == 0xDA:
            while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data) and (data[i + 1] == 0 or 0xD0 <= data[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return i + 2 if data[i : i + 2] == b"\xff\xd9" else None


def full_jpeg(data: bytes) -> tuple[int, int] | None:
    """(offset, size) of the first sample of the track whose first chunk lies first."""
    moov = child(data, 0, len(data), b"moov")
    found = []
    for kind, a, b in boxes(data, *moov) if moov else ():
        place: tuple[int, int] | None = (a, b) if kind == b"trak" else None
        for name in (b"mdia", b"minf", b"stbl"):
            place = child(data, *place, name) if place else None
        if not place:
            continue
        size, offset = child(data, *place, b"stsz"), None
        if wide := child(data, *place, b"co64"):
            offset = int.from_bytes(data[wide[0] + 8 : wide[0] + 16], "big")
        elif narrow := child(data, *place, b"stco"):
            offset = int.from_bytes(data[narrow[0] + 8 : narrow[0] + 12], "big")
        if size and offset:
            same, first = (int.from_bytes(data[size[0] + i : size[0] + i + 4], "big") for i in (4, 12))
            found.append((offset, same or first))
    return min(found, default=None)


@dataclass
class Tiff:
    """One directory of a TIFF block; a read outside of the block gives None."""

    data: bytes

    def __post_init__(self) -> None:
        self.order = {b"II": "<", b"MM": ">"}.get(self.data[:2], "")
        self.entries: dict[int, tuple[int, int, int]] = {}
        first = self._int("I", 4) if self.order else None
        for i in range((self._int("H", first) or 0) if first else 0):
            at = first + 2 + 12 * i
            tag, kind, count = self._int("H", at), self._int("H", at + 2), self._int("I", at + 4)
            if None in (tag, kind, count):
                break
            place = at + 8 if TYPE_BYTES.get(kind, 1) * count <= 4 else self._int("I", at + 8)
            self.entries.setdefault(tag, (kind, count, place if place is not None else len(self.data)))

    def _int(self, kind: str, at: int | None) -> int | None:
        size = struct.calcsize(kind)
        return None if at is None or at + size > len(self.data) else struct.unpack_from(self.order + kind, self.data, at)[0]

    def text(self, tag: int) -> str | None:
        if tag not in self.entries or self.entries[tag][0] != 2:
            return None
        _, n, at = self.entries[tag]
        raw = self.data[at : at + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        return raw or None

    def number(self, tag: int) -> int | None:
        kind, _, at = self.entries.get(tag, (0, 0, 0))
        return self._int({1: "B", 3: "H", 4: "I"}.get(kind, "Q"), at) if kind in (1, 3, 4) else None

    def ratios(self, tag: int) -> list[float]:
        kind, n, at = self.entries.get(tag, (0, 0, 0))
        form = {5: "I", 10: "i"}.get(kind)
        pairs = [(self._int(form, at + 8 * i), self._int(form, at + 8 * i + 4)) for i in range(min(n, 64))] if form else []
        return [a / b if b else 0.0 for a, b in pairs if a is not None and b is not None]

    def shorts(self, tag: int) -> list[int]:
        """All values of a SHORT tag, as far as the block has them; none for another type."""
        kind, n, at = self.entries.get(tag, (0, 0, 0))
        n = min(n, max(0, len(self.data) - at) // 2) if kind == 3 else 0
        return list(struct.unpack_from(f"{self.order}{n}H", self.data, at)) if n else []

    def ratio(self, tag: int) -> float | None:
        return next(iter(self.ratios(tag)), None)


def drive_mode(maker: Tiff) -> int | None:
    """The sixth of the camera settings: 0 is single, others are continuous."""
    settings = maker.shorts(0x0001)
    return settings[5] if len(settings) > 5 else None


def focus_point(maker: Tiff, orientation: int) -> tuple[float, float] | None:
    """The middle of the active focus areas as displayed, in percent from the top left.

    The record has the number of areas (2), the image's size (6, 7), then four lists of that many: widths, heights,
    and signed places from the image's middle, upwards positive. (0, 0) is an unused area.
    """
    record = maker.shorts(0x0026)
    n = record[2] if len(record) >= 8 else 0
    if not n or not record[6] or not record[7] or len(record) < 8 + 4 * n:
        return None
    signed = [v - 65536 if v >= 32768 else v for v in record]
    used = [(x, y) for x, y in zip(signed[8 + 2 * n : 8 + 3 * n], signed[8 + 3 * n : 8 + 4 * n], strict=True) if x or y]
    if not used:
        return None
    x = (record[6] / 2 + sum(p[0] for p in used) / len(used)) / record[6] * 100
    y = (record[7] / 2 - sum(p[1] for p in used) / len(used)) / record[7] * 100
    turned = {3: (100 - x, 100 - y), 6: (100 - y, x), 8: (y, 100 - x)}.get(orientation, (x, y))
    return tuple(min(100.0, max(0.0, v)) for v in turned)


METADATA = (
    "path string, decode_ok boolean, orientation int, camera string, captured_at string, sub_sec string, lens string, focal_mm double, aperture double, shutter_seconds double, "
    "iso int, exposure_bias double, white_balance int, pixel_width int, pixel_height int, gps_lat double, gps_lon double, drive_mode int, af_x_pct double, af_y_pct double, preview_bytes int, full_offset bigint, full_bytes bigint"
)


def metadata(data: bytes) -> dict:
    """The columns of METADATA but path. Without a movie box only the orientation, 1, is known."""
    found: dict = {"orientation": 1}
    moov = child(data, 0, len(data), b"moov")
    blocks: dict[bytes, Tiff] = {}
    for kind, a, b in boxes(data, *moov) if moov else ():
        if kind == b"uuid":
            blocks |= {k: Tiff(data[x:y]) for k, x, y in boxes(data, a + 16, b) if k in (b"CMT1", b"CMT2", b"CMT3", b"CMT4")}
    if one := blocks.get(b"CMT1"):
        found |= {"orientation": one.number(0x0112) or 1, "camera": one.text(0x0110)}
    if two := blocks.get(b"CMT2"):
        found |= {"captured_at": two.text(0x9003), "sub_sec": two.text(0x9291), "lens": two.text(0xA434), "focal_mm": two.ratio(0x920A), "aperture": two.ratio(0x829D), "shutter_seconds": two.ratio(0x829A)}
        found |= {"iso": two.number(0x8827), "exposure_bias": two.ratio(0x9204), "white_balance": two.number(0xA403), "pixel_width": two.number(0xA002), "pixel_height": two.number(0xA003)}
    if maker := blocks.get(b"CMT3"):
        found["drive_mode"] = drive_mode(maker)
        if point := focus_point(maker, found["orientation"]):
            found["af_x_pct"], found["af_y_pct"] = point
    if gps := blocks.get(b"CMT4"):
        for name, ref, tag in (("gps_lat", 1, 2), ("gps_lon", 3, 4)):
            if len(parts := gps.ratios(tag)) >= 3:
                sign = -1 if (gps.text(ref) or "").upper() in ("S", "W") else 1
                found[name] = sign * (parts[0] + parts[1] / 60 + parts[2] / 3600)
    if jpeg := preview(data):
        found["preview_bytes"] = len(jpeg)
    if full := full_jpeg(data):
        found["full_offset"], found["full_bytes"] = full
    return found | {"decode_ok": bool(moov)}


_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in fields], [n for n, _ in fields])


def parsed(files: DataFrame) -> DataFrame:
    """METADATA of each file (path, content); what cannot be parsed has decode_ok false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([{"path": p} | metadata(c or b"") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], METADATA)

    return files.select("path", "content").mapInArrow(run, METADATA)


#: Bytes of a head and of each further read, for previews and for thumbnails, and the most of either.
HEAD, THUMBNAIL_HEAD, GROW, MOST = 2 << 20, 1 << 20, 2 << 20, 64 << 20


class Head:
    """The first bytes of a file in any store that Arrow opens, read as far as they are asked for."""

    def __init__(self, path: str, first: int):
        system, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.data = self.file.read_at(min(first, self.size), 0)

    def grow(self) -> bool:
        more = self.file.read_at(min(GROW, self.size - len(self.data)), len(self.data)) if len(self.data) < min(self.size, MOST) else b""
        self.data += more
        return bool(more)

    def until(self, enough: Callable[[bytes], bool]) -> bytes:
        while not enough(self.data) and self.grow():
            pass
        return self.data


def _has_preview(data: bytes) -> bool:
    found = {(kind, data[a : a + 16] == PREVIEW_UUID) for kind, a, _ in boxes(data)}
    return {(b"uuid", True), (b"moov", False)} <= found or payload_start(data, b"mdat") is not None


def _has_movie(data: bytes) -> bool:
    return child(data, 0, len(data), b"moov") is not None


def read_full(head: Head) -> bytes | None:
    """The full image by the range that the head names, if a JPEG begins there and ends inside; else the first one of the payload."""
    place = full_jpeg(head.data)
    if place and 0 < place[1] <= MOST and place[0] + place[1] <= head.size:
        found = head.file.read_at(place[1], place[0])
        if found[:2] == b"\xff\xd8" and (end := jpeg_end(found, 0)):
            return found[:end]
    start = payload_start(head.data, b"mdat")
    if start is None:
        return preview(head.data)
    found = head.file.read_at(min(MOST, head.size - start), start)
    end = jpeg_end(found, 0) if found[:2] == b"\xff\xd8" else None
    return found[:end] if end else preview(head.data)


def _read(files: DataFrame, first: int, enough: Callable[[bytes], bool], schema: str, made: Callable[[Head, dict], dict]) -> DataFrame:
    """One row for each path: metadata of a bounded head and what ``made`` adds; error where something is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    head = Head(path, first)
                    found = metadata(head.until(enough))
                    row = found | {"file_size": head.size} | made(head, found)
                except (OSError, ValueError, pa.ArrowException) as e:
                    row = {"orientation": 1, "decode_ok": False, "error": f"{type(e).__name__}: {e}"}
                yield _batch([{"path": path} | row], schema)

    return files.select("path").mapInArrow(run, schema)


PREVIEWS = f"{METADATA}, file_size bigint, jpeg binary, error string"
THUMBNAILS = f"{METADATA}, file_size bigint, display_width int, display_height int, jpeg binary, error string"
FULL = "path string, decode_ok boolean, orientation int, file_size bigint, jpeg binary, error string"


def previews(files: DataFrame) -> DataFrame:
    """PREVIEWS of each path: metadata, the preview with its orientation, from a head of 2 MiB or as much as it takes, 64 MiB at most.

    A file that cannot be read, or has no preview, has decode_ok false and an error.
    """

    def made(head: Head, found: dict) -> dict:
        jpeg = preview(head.data)
        return {"jpeg": oriented(jpeg, found["orientation"])} if jpeg else {"decode_ok": False, "error": "no preview"}

    return _read(files, HEAD, _has_preview, PREVIEWS, made)


def thumbnails(files: DataFrame) -> DataFrame:
    """THUMBNAILS of each path: the same with the thumbnail and the size at which it is shown, from a head of 1 MiB or as much as it takes."""

    def made(head: Head, found: dict) -> dict:
        jpeg = thumbnail(head.data)
        if not jpeg:
            return {"decode_ok": False, "error": "no thumbnail"}
        size = found.get("pixel_width"), found.get("pixel_height")
        width, height = size[::-1] if found["orientation"] in (6, 8) else size
        return {"jpeg": oriented(jpeg, found["orientation"]), "display_width": width, "display_height": height}

    return _read(files, THUMBNAIL_HEAD, _has_movie, THUMBNAILS, made)


def full_images(files: DataFrame) -> DataFrame:
    """FULL of each path: the full image with its orientation, by one read of the range that the head names."""

    def made(head: Head, found: dict) -> dict:
        jpeg = read_full(head)
        return {"decode_ok": True, "jpeg": oriented(jpeg, found["orientation"])} if jpeg else {"decode_ok": False, "error": "no full image"}

    return _read(files, HEAD, _has_movie, FULL, made)
