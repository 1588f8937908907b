"""SMPTE timecode at a fixed 24 frames a second, non-drop."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FPS = 24


def bcd(byte: Column) -> Column:
    """Value of a packed byte; null if its low digit is over 9 (the high one shows in the range checks)."""
    low = byte.bitwiseAND(F.lit(0x0F))
    return F.when(low <= 9, F.shiftright(byte, 4) * 10 + low)


def parse(ff: Column, ss: Column, mm: Column, hh: Column) -> Column:
    """struct(hh, mm, ss, ff, err) of four packed bytes; ``err`` names the first failing check."""
    f, s, m, h = bcd(ff), bcd(ss), bcd(mm), bcd(hh)
    err = (
        F.when(f.isNull(), "ff")
        .when(s.isNull(), "ss")
        .when(m.isNull(), "mm")
        .when(h.isNull(), "hh")
        .when(h > 23, "hh range")
        .when(f > 23, "ff range")
        .when(s > 59, "ss range")
        .when(m > 59, "mm range")
    )
    return F.struct(h.alias("hh"), m.alias("mm"), s.alias("ss"), f.alias("ff"), err.alias("err"))


def total_frames(hh: Column, mm: Column, ss: Column, ff: Column) -> Column:
    return ((hh * 60 + mm) * 60 + ss) * FPS + ff


def display(hh: Column, mm: Column, ss: Column, ff: Column) -> Column:
    return F.format_string("%02d:%02d:%02d:%02d", hh, mm, ss, ff)
