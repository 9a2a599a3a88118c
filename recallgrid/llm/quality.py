"""Compression bands: reject repetitive or incompressible text by its zstandard ratio.

A text is compressed whole and in fixed chunks. Its ratio (bytes in, bytes out)
must reach a limit that depends on the length alone, as longer inputs of the
same kind compress better. Characters in to bytes out must stay below another:
scripts of two or three bytes a character have higher ratios for the same prose.
The word counts beside it are plain rules.

Defined results: a null text counts as empty; an empty text has no words and
fails; texts of any length are read whole, chunk by chunk; repeated rows get
equal rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, by_bytes, quoted

SYMBOLS = "#*$%&|<>"
#: (length below, least bytes, most characters a compressed byte). Upper limits lie about 6 % or more above the
#: highest value of texts labelled good on sf0.1 (1.84 below 600 bytes, 2.07 below 1600, 2.44 below 20,000), so that
#: a text half of which repeats, at about twice its own ratio, lies beyond; those from 20,000 on leave room for long
#: prose. Lower ones lie between base64 words (1.30 at 800 bytes, 1.40 at most) and the lowest prose (1.47 at 600, 1.72 at
#: 1000, 2.1 at 4000). Below 300 bytes the frame's own bytes weigh too much for a lower limit.
BANDS = ((300, 0.0, 1.75), (400, 1.19, 1.85), (500, 1.25, 2.0), (600, 1.29, 2.0), (800, 1.35, 2.1), (1000, 1.4, 2.15), (1250, 1.4, 2.2), (1600, 1.45, 2.3),
         (2000, 1.45, 2.35), (2500, 1.5, 2.35), (4000, 1.5, 2.4), (10000, 1.55, 2.5), (20000, 1.55, 2.65), (100000, 1.55, 2.9), (None, 1.55, 3.3))
CHUNK = 1024
#: Share of a text's bytes that may lie in chunks outside their band.
BAD_SHARE = 0.3
LEVEL = 3

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, ratio double, bad_chunk_bytes long, reason string, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in `words`."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1].astype(np.int64) * len(ids) + code[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift : shift + n - 2] |= again
    return int(hit.sum())


def _band(length: int, bands) -> tuple[float, float]:
    return next((least, most) for below, least, most in bands if below is None or length < below)


def outside(n_bytes: int, n_chars: int, packed: int, bands=BANDS) -> str | None:
    """`repetitive`, `incompressible` or None: where a text that is `packed` bytes compressed lies against the bands of its length."""
    if n_chars > _band(n_chars, bands)[1] * packed:
        return "repetitive"
    return "incompressible" if n_bytes < _band(n_bytes, bands)[0] * packed else None


def measure(text: str | None, press: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> tuple:
    """The METRICS of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup_lines += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    base_failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    packed = len(press.compress(raw))
    ratio = len(raw) / packed
    reason, bad = outside(len(raw), len(text), packed, bands), 0
    if len(raw) > chunk:
        ends = [*range(chunk, len(raw) - chunk // 2, chunk), len(raw)]  # a short rest joins the chunk before it
        for a, b in zip([0, *ends], ends):
            part = raw[a:b]
            if outside(b - a, len(part.decode(errors="ignore")), len(press.compress(part)), bands):
                bad += b - a
        if bad > bad_share * len(raw):
            reason = reason or "chunks"
    if base_failed:
        reason = "words"
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines, repeats, base_failed,
            len(raw), round(ratio, 6), bad, reason, reason is None)


def _measured(batch: pa.RecordBatch, text: str, press: zstandard.ZstdCompressor) -> list[tuple]:
    return [measure(t, press) for t in batch.column(text).to_pylist()]


def quality_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the METRICS of every row of `docs`."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{quoted(key)} {kind}, {METRICS}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in by_bytes(batches, "text"):
            columns = list(zip(*_measured(batch, "text", press)))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             [key, *(m.split()[0] for m in METRICS.split(", "))])

    return docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text passes. Only the text goes through Python."""

    def passes(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=LEVEL)
        return pa.array([measure(t.as_py(), press)[-1] for t in texts], pa.bool_())

    return docs.where(F.arrow_udf(passes, "boolean")(F.col(quoted(text))))
