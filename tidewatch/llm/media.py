"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

UNIT = 576
WIDTH = 24


def write_pnm(a: np.ndarray) -> bytes:
    """P5 for a grey array (height, width), P6 for (height, width, 3); 8 bits a sample."""
    kind = b"P5" if a.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def read_pnm(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples and their greatest value, of P1 to P6 with 1 to 16 bits a sample; comments may stand between the header's fields. A bitmap's samples are 0 (black) and 1."""
    kind, fields, at = raw[:2], [], 2
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a supported Netpbm file")
    bitmap = kind in (b"P1", b"P4")
    while len(fields) < (2 if bitmap else 3):
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("header ends early")
        fields.append(int(raw[at:end]))
        at = end
    width, height, top = (*fields, 1)[:3]
    if not (width and height and 0 < top < 65536):
        raise ValueError("empty image or samples of more than 16 bits")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n, kept = width * height * (3 if len(shape) == 3 else 1), np.uint8 if top < 256 else np.uint16
    if kind == b"P4":
        row = -(-width // 8)
        return 1 - np.unpackbits(_samples(raw, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width], 1
    if kind in (b"P5", b"P6"):
        return _samples(raw, np.uint8 if top < 256 else np.dtype(">u2"), n, at + 1).reshape(shape).astype(kept, copy=False), top
    lines = b"\n".join(line.split(b"#")[0] for line in raw[at:].split(b"\n"))
    values = [c for c in lines if c in b"01"] if kind == b"P1" else lines.split()
    if len(values) < n:
        raise ValueError("fewer samples than the header says")
    out = (1 - (np.array(values[:n], np.uint8) - 48) if kind == b"P1" else np.array(values[:n], np.int64)).reshape(shape)
    if out.min() < 0 or out.max() > top:
        raise ValueError("sample out of range")
    return out.astype(kept), top


def _samples(raw: bytes, kind: np.dtype | type, n: int, at: int) -> np.ndarray:
    if len(raw) < at + n * np.dtype(kind).itemsize:
        raise ValueError("fewer samples than the header says")
    return np.frombuffer(raw, kind, n, at)


def write_bmp(a: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette, or 24 bits."""
    h, w = a.shape[:2]
    bits = 8 if a.ndim == 2 else 24
    rows = np.zeros((h, -(-w * bits // 32) * 4), np.uint8)
    rows[:, : w * bits // 8] = (a if a.ndim == 2 else a[:, :, ::-1]).reshape(h, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if bits == 8 else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + rows[::-1].tobytes()


def masked(pixels: np.ndarray, masks: tuple[int, int, int]) -> np.ndarray:
    """Red, green and blue of whole pixels by their bit masks, each scaled to 0 to 255."""
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        low = mask & -mask
        if not mask or mask // low & (mask // low + 1):
            raise ValueError("colour masks must be runs of bits")
        top = mask // low
        out[..., k] = np.rint(((pixels & np.uint32(mask)) // np.uint32(low)).astype(np.float64) * (255 / top))
    return out


def read_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4 or 8 (by its palette), 16, 24 or 32 bits, rows from the bottom or from the top; 16 and 32 bits by colour masks, where the file has them."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not a BMP file")
    start = struct.unpack_from("<I", raw, 10)[0]
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if head < 40 or bits not in (1, 4, 8, 16, 24, 32) or packed not in ((0, 3) if bits in (16, 32) else (0,)):
        raise ValueError("only uncompressed BMP files of 1, 4, 8, 16, 24 and 32 bits are supported")
    if w < 1 or not h:
        raise ValueError("empty image")
    row = -(-w * bits // 32) * 4
    a = _samples(raw, np.uint8, row * abs(h), start).reshape(abs(h), row)[:: -1 if h > 0 else 1]
    if bits == 16 or packed == 3:
        # masks follow a header of 40 bytes and stand at the same place in longer ones
        masks = (0x7C00, 0x3E0, 0x1F) if packed == 0 else struct.unpack("<3I", _samples(raw, np.uint8, 12, 54).tobytes())
        return masked(np.ascontiguousarray(a[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32), masks)
    if bits > 8:
        return a[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    used = min(struct.unpack_from("<I", raw, 46)[0] or 1 << bits, 1 << bits)
    palette = _samples(raw, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    if bits < 8:
        each = 8 // bits
        a = (np.repeat(a, each, 1) >> np.tile(np.arange(each)[::-1] * bits, row).astype(np.uint8)) & np.uint8((1 << bits) - 1)
    if a[:, :w].max() >= used:
        raise ValueError("sample out of range")
    rgb = palette[a[:, :w]]
    return rgb[:, :, 0] if (palette == palette[:, :1]).all() else rgb


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples and their greatest value."""
    return (read_bmp(raw), 255) if raw[:2] == b"BM" else read_pnm(raw)


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, by differences of the integral image at fractional edges."""
    a = a.astype(np.float64)
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1, *a.shape[2:]))
    np.cumsum(np.cumsum(a, 0), 1, out=total[1:, 1:])

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.arange(m + 1) * (n / m)
        lo = np.minimum(x.astype(np.int64), n - 1)
        return lo, lo + 1, x - lo

    lo, hi, f = at(a.shape[0], height)
    f = f.reshape(-1, *[1] * (total.ndim - 1))
    rows = total[lo] * (1 - f) + total[hi] * f
    lo, hi, f = at(a.shape[1], width)
    f = f.reshape(1, -1, *[1] * (total.ndim - 2))
    both = rows[:, lo] * (1 - f) + rows[:, hi] * f
    return np.diff(np.diff(both, axis=0), axis=1) / ((a.shape[0] / height) * (a.shape[1] / width))


def difference_hash(a: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means falls below its right neighbour's."""
    grey = a if a.ndim == 2 else a.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def tile_of(a: np.ndarray, top: int = 255, side: int = 16) -> bytes:
    """The NPY file of the array area-resized to side x side, 8 bits a sample."""
    return npy(np.clip(np.rint(area_resize(a, side, side) * (255 / top)), 0, 255).astype(np.uint8))


def text_image(text: bytes) -> np.ndarray:
    """The payload (text, then bytes 255 up to a positive multiple of 576) as a grey image 24 samples wide."""
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return np.frombuffer(text + b"\xff" * (size - len(text)), np.uint8).reshape(-1, WIDTH)


DECODED = (("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("samples", pa.binary()), ("top", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string()))


def _decoded(raw: bytes | None, side: int) -> tuple:
    if raw is None:
        return (None,) * 7 + ("null",)
    try:
        a, top = decode(raw)
    except (ValueError, struct.error) as e:
        return (None,) * 7 + (str(e),)
    return *a.shape[:2], 1 if a.ndim == 2 else a.shape[2], np.ascontiguousarray(a).tobytes(), top, tile_of(a, top, side), difference_hash(a), None


def decode_media(files: DataFrame, column: str = "media", side: int = 16) -> DataFrame:
    """files with what its column of Netpbm and BMP files holds: height, width, channels, samples (row by row; two bytes each where top, their
    greatest value, exceeds 255), tile (an NPY file of side x side area means), dhash (64 bits as hex) and error.

    A null file, a broken one, one that ends early or is of another format gives nulls and says why in error; no row is dropped. Repeated rows
    stay rows; an empty table gives no rows. Columns of files with these names are replaced.

    Scale: one pass, no exchange; memory holds a few megabytes of files, or one file with its samples.
    """
    small_batches(files.sparkSession)
    made = {n for n, _ in DECODED}
    files = files.select(*[c for c in files.columns if c.lower() not in made])
    at, names = files.columns.index(column), [*files.columns, *(n for n, _ in DECODED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                rows, held = [], 0
                while lo + len(rows) < batch.num_rows and held < 4_000_000:
                    value = batch.column(at)[lo + len(rows)]
                    rows.append(_decoded(value.as_buffer().to_pybytes() if value.is_valid else None, side))
                    held += len(rows[-1][3] or b"") + 2000
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(rows)).columns, *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), DECODED, strict=True))], names)
                lo += len(rows)

    kinds = {pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType(), pa.string(): T.StringType()}
    return files.mapInArrow(run, T.StructType([*files.schema.fields, *(T.StructField(n, kinds[t]) for n, t in DECODED)]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).slice(lo, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256).cast(pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([write_pnm(text_image(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """Every whole text as a Netpbm image, read back, hashed and tiled; one row for each row of docs.

    A null text counts as empty; an empty text is one unit of 255s. Equal texts give equal values; repeated rows stay rows.
    No exchange: memory holds 256 rows' images, so it follows the longest texts. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    stored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_texts, "doc_id long, n_bytes long, media binary")
    payload = F.col("samples")
    return decode_media(stored).select(
        "doc_id", "n_bytes", "media", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("dhash:"), "dhash").alias("feature"), "tile",
    )


def write_media(media: DataFrame, path: str) -> None:
    """The media and NPY tile columns as a Parquet table."""
    media.write.mode("errorifexists").parquet(path)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("tile_sha256", F.sha2("tile", 256)).drop("media", "tile")
