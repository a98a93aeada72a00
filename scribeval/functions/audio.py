"""Audio preparation as array expressions (no per-row Python).

* ``downmix``: mean of the two channels, ``(l + r) / 2``;
* ``resample``: ``n = int(len / orig * target)`` points at
  ``linspace(0, len - 1, n)`` with linear interpolation (numpy ``interp``);
  same rate -> unchanged;
* ``quantize``: ``x * 32767`` truncated toward zero to int16.  Values are
  first clamped to [-1, 1] (the original wraps on overflow; a documented
  deviation), and a clip given as an array is quantised once (the original
  writes a 16-bit WAV first and quantises again);
* ``pcm_hex`` / chunks: little-endian int16 bytes, cut in 3200-byte pieces
  (100 ms at 16 kHz), the last one short; chunk k is sent at ``k * 20`` ms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
TARGET_RATE = 16000
CHUNK_BYTES = 3200
CHUNK_PAUSE_MS = 20
INT16_SCALE = 32767
# -----------------------------------------------------------------------------


def downmix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def resampled_length(n: Column, orig: Column, target) -> Column:
    return F.floor(n / orig.cast("double") * F.lit(float(target))).cast("int")


def resample(arr: Column, orig: Column, target=TARGET_RATE) -> Column:
    """Linear-interpolation resampling; ``arr`` must be a column reference
    (it is used inside the lambda)."""
    ln = F.size(arr)
    n = resampled_length(ln, orig, target)
    step = (ln - 1).cast("double") / (n - 1).cast("double")

    def point(k):
        x = F.when(k == n - 1, (ln - 1).cast("double")).otherwise(k * step)
        j = F.floor(x).cast("int")
        a = F.get(arr, j)
        b = F.get(arr, j + 1)
        return F.when(j >= ln - 1, F.get(arr, ln - 1)).otherwise((b - a) * (x - j) + a)

    pts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), point)
    res = F.when(n <= 0, F.array().cast("array<double>")).when(n == 1, F.array(F.get(arr, 0))).otherwise(pts)
    return F.when(orig == F.lit(target), arr).otherwise(res)


def quantize(arr: Column) -> Column:
    return F.transform(arr, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * INT16_SCALE)
                       .cast("int").cast("smallint"))


def pcm_hex(pcm: Column) -> Column:
    """int16 samples -> little-endian bytes as an upper-case hex string."""
    def le(v):
        u = F.when(v < 0, v.cast("int") + 65536).otherwise(v.cast("int"))
        lo = F.lpad(F.hex(u % 256), 2, "0")
        hi = F.lpad(F.hex(F.floor(u / 256).cast("int")), 2, "0")
        return F.concat(lo, hi)
    return F.array_join(F.transform(pcm, le), "")


def chunk_count(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / F.lit(CHUNK_BYTES)).cast("int")
