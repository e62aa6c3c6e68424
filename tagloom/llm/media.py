"""Audio columns: lossless 8-bit WAV media, polyphase resampling, log-mel tensors and energy segments.

``store_audio`` turns texts (or any bytes) into WAV files of one byte per sample; ``audio_features``
reads WAV bytes back, resamples them by ``up/down`` with a windowed-sinc polyphase filter, takes
overlapped log-mel frames and segments them by energy with two thresholds: a segment opens above the
high one and closes below the low one. Frames come in blocks of fixed shape (``BLOCK`` x ``MELS``,
float32, padded with the floor value), so that a column of them is an Arrow fixed-shape tensor. Every
document is computed alone, so equal bytes give equal features.

Null and empty texts are one block of spaces. A task holds one text's samples and frames, some 20 bytes for each byte of a
long text. Rows are heard each alone, so repeated rows and ids give repeated results. Bytes that are no such WAV file raise an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._tables import own_columns

RATE = 8000
UP, DOWN = 2, 3
FRAME, HOP, MELS, BLOCK = 200, 80, 40, 16
#: Milliseconds from frame to frame.
MS = HOP * 1000 * DOWN / (RATE * UP)
FLOOR = np.float32(-11.5)
PAD = 192
#: Bytes of texts or blocks that a task hands on together.
AT_ONCE = 1 << 20
#: Bytes before the samples in the files that ``wav`` makes.
HEADER = 44


def payload_of(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of PAD bytes."""
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b" ")


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit samples."""
    odd = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def samples_of(media: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if not form or (form[0], form[1], form[5]) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


#: Samples computed at once, each from a copy of its inputs.
RESAMPLED = 1 << 16


@lru_cache(maxsize=8)
def phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """The low-pass filter for ``up/down`` dealt into one row of taps for each of ``up`` phases."""
    width = max(up, down)
    k = np.arange(-half * width, half * width + 1)
    taps = np.sinc(k / width) * np.hamming(len(k)) * up / width
    return np.pad(taps, (0, -len(taps) % up)).reshape(-1, up).T.copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` at ``up/down`` times its rate; only the samples that are kept are computed."""
    bank = phases(up, down)
    taps = bank.shape[1]
    delay = 8 * max(up, down)
    n = -(-len(x) * up // down)
    at = np.arange(n) * down + delay
    padded = np.pad(x, (taps, taps + delay))
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for phase in range(up):  # output m meets inputs at//up, at//up - 1, ... under its phase's taps
        some = np.flatnonzero(at % up == phase)
        for k in range(0, len(some), RESAMPLED):
            part = some[k : k + RESAMPLED]
            out[part] = view[at[part] // up + 1] @ bank[phase, ::-1].astype(np.float32)
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: float, bins: int, mels: int = MELS) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32).T.copy()


_HANN = np.hanning(FRAME).astype(np.float32)
#: Frames transformed at once, which bounds a task's memory however long the sound is.
_AT_ONCE = 4096


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Log energies of overlapped frames, one row of MELS each; silence fills the last frame."""
    x = np.pad(x, (0, max(0, FRAME - len(x)) or -(len(x) - FRAME) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bank, out = mel_bank(rate, 129), np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), _AT_ONCE):
        power = np.abs(np.fft.rfft(frames[at : at + _AT_ONCE] * _HANN, 256).astype(np.complex64)) ** 2
        out[at : at + _AT_ONCE] = np.log(power @ bank + np.float32(1e-5))
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """Half-open frame ranges that open at the 70th percentile of ``energy`` and close under the 40th."""
    low, high = np.quantile(energy, (0.4, 0.7))
    # each frame's last decisive frame: above high opens, below low closes
    say = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    last = np.maximum.accumulate(np.where(say >= 0, np.arange(len(say)), -1))
    on = np.where(last >= 0, say[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


def features(media: bytes, up: int = UP, down: int = DOWN) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and the segments' spans in milliseconds."""
    x = (np.frombuffer(samples_of(media), np.uint8).astype(np.float32) - 128) / 128
    rate = RATE * up / down
    mel = log_mel(resample(x, up, down), rate)
    return mel, np.rint(segments(mel.mean(1)) * (HOP * 1000 / rate)).astype(np.int64)


def blocks(mel: np.ndarray) -> np.ndarray:
    full = np.full((-(-len(mel) // BLOCK) * BLOCK, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    return full.reshape(-1, BLOCK, MELS)


def digest(mel: np.ndarray, active: int) -> str:
    """Features as text: frames, segments and their time (``active`` frames), mean and checksum of the rounded energies."""
    rounded = np.rint(mel * 100).astype("<i4")
    return f"frames={len(mel)};segments={len(segments(mel.mean(1)))};active_ms={round(active * MS)};mean={int(rounded.sum()) // rounded.size};crc={zlib.crc32(rounded.tobytes()):08x}"


def store_audio(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with binary column ``media``: each text's UTF-8 bytes, padded, as a WAV file."""
    name = own_columns(docs, "media")["media"]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, text, AT_ONCE):
            media = [wav(payload_of((value.as_py() or "").encode())) for value in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(stored, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def mel_blocks(media: DataFrame, id: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per block: id, block, start_ms, end_ms, mel (BLOCK x MELS floats in row order), active (frames in a segment).

    ``tensor_type()`` is the Arrow type that ``mel`` converts to without a copy.
    """
    schema = T.StructType([T.StructField("id", media.schema[id].dataType), *T.StructType.fromDDL("block int, start_ms long, end_ms long, mel array<float>, active int").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, out = 0, 0, []

            def told(upto: int, batch=batch) -> pa.RecordBatch:
                """The blocks of rows ``done`` to ``upto``."""
                keys = batch.column(0).slice(done, upto - done).take(pa.array(np.repeat(np.arange(upto - done), [len(x[0]) for x in out])))
                number, start, end, mel, active = (np.concatenate(c) for c in zip(*out, strict=True))
                return pa.RecordBatch.from_arrays([keys, pa.array(number.astype(np.int32)), pa.array(start), pa.array(end), _flat(mel), pa.array(active.astype(np.int32))], ["id", "block", "start_ms", "end_ms", "mel", "active"])

            for row, value in enumerate(batch.column(1)):
                mel, spans = features(value.as_py() or wav(payload_of(b"")))
                on = np.zeros(len(mel), np.int64)
                for a, b in np.rint(spans / MS).astype(int):
                    on[a:b] = 1
                parts = blocks(mel)
                start = np.rint(np.arange(len(parts)) * BLOCK * MS).astype(np.int64)
                end = np.rint(np.minimum((np.arange(len(parts)) + 1) * BLOCK, len(mel)) * MS).astype(np.int64)
                active = np.add.reduceat(on, np.arange(0, len(mel), BLOCK)) if len(mel) else on[:0]
                out.append((np.arange(len(parts)), start, end, parts, active))
                held += len(parts)
                if held * BLOCK * MELS * 4 >= AT_ONCE:
                    yield told(row + 1)
                    done, held, out = row + 1, 0, []
            if out:
                yield told(batch.num_rows)

    return media.select(id, column).mapInArrow(cut, schema)


def _flat(parts: np.ndarray) -> pa.Array:
    offsets = np.arange(len(parts) + 1, dtype=np.int32) * (BLOCK * MELS)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(parts.reshape(-1)))


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), [BLOCK, MELS])


def audio_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: what was stored, and what is heard in its blocks. Media files and blocks are not shuffled."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id].dataType), *T.StructType.fromDDL("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields])
    stored = store_audio(docs.select(id, text), text)
    media = F.col(stored.columns[-1])
    payload = F.substring(media, HEADER + 1, (1 << 31) - 1)
    told = F.struct(
        F.col(id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"),
    )

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in order, a document after the other; block 0 begins the next one."""
        parts, active, end, row = [], 0, 0, None

        def said() -> pa.RecordBatch:
            frames = np.concatenate(parts).reshape(-1, MELS)[: round(end / MS)]
            return pa.RecordBatch.from_arrays([*row.flatten(), pa.array([digest(frames, active)])], schema.fieldNames())

        for batch in batches:
            told, number, stop, mel, on = batch.columns
            number, stop, on = (x.to_numpy() for x in (number, stop, on))
            flat = mel.flatten().to_numpy().reshape(-1, BLOCK * MELS)
            out = []
            cuts = np.flatnonzero((number == 0) | (np.arange(len(number)) == 0))
            for a, b in zip(cuts, [*cuts[1:], len(number)], strict=False):
                if number[a] == 0:
                    if parts:
                        out.append(said())
                    parts, active, row = [], 0, told.slice(int(a), 1)
                parts.append(flat[a:b].copy())
                active, end = active + int(on[a:b].sum()), int(stop[b - 1])
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if parts:
            yield said()

    return mel_blocks(stored.select(told.alias("told"), media.alias("media")), "told", "media").select("id", "block", "end_ms", "mel", "active").mapInArrow(heard, schema)
