"""Pitch and time units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16000
HOP, WINDOW = 160, 400
FRAME_HZ = 100.0
HOP_MS = 10


def semitones(hz: Column, reference: float = 100.0) -> Column:
    """Semitones above the reference; 0 for unvoiced frames."""
    return F.when(hz > 0, F.log2(hz / reference) * 12).otherwise(0.0)


def ms_to_frame(ms: Column, frame_hz: float = FRAME_HZ) -> Column:
    return (ms * F.lit(frame_hz) / 1000).cast("int")


def ms_to_samples(ms: Column, rate: int = SAMPLE_RATE) -> Column:
    return (ms * F.lit(rate) / 1000).cast("long")


def samples_to_ms(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    return (samples / F.lit(rate) * 1000).cast("int")


def samples_to_frame(samples: Column, hop: int = HOP) -> Column:
    return F.greatest(F.lit(0), F.floor(samples / F.lit(hop)))


def frames_for_samples(samples: Column, window: int = WINDOW, hop: int = HOP) -> Column:
    """Complete frames of a signal; 1 where it is shorter than a window."""
    return F.when(samples < window, F.lit(1).cast("long")).otherwise(F.floor((samples - window) / F.lit(hop)) + 1)
