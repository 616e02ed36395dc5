"""Functions of sample, frame and code arrays, and of training steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import let, truncated_words


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def rms(samples: Column) -> Column:
    """Root of the mean square; 0 for no samples."""
    squares = F.transform(samples, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(_sum(squares) / F.greatest(F.size(samples), F.lit(1)))


def peak_normalised(samples: Column, peak: float = 0.95) -> Column:
    """Samples scaled to a greatest magnitude of ``peak``; silence stays."""
    most = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return let(most, lambda m: F.transform(samples, lambda x: F.when(m > 0, x.cast("double") * peak / m).otherwise(x.cast("double"))))


def snr_db(energies: Column) -> Column:
    """10 log10 of the mean of the upper third of frame energies over that of the lowest tenth; null below 8 frames."""

    def ratio(e: Column) -> Column:
        n = F.size(e)
        upper, lower = F.greatest(F.lit(1), F.floor(n / 3).cast("int")), F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
        high, low = _sum(F.slice(e, n - upper + 1, upper)) / upper, _sum(F.slice(e, 1, lower)) / lower
        return F.when(n >= 8, 10 * F.log10(F.greatest(high, F.lit(1e-12)) / F.greatest(low, F.lit(1e-12))))

    return let(F.array_sort(F.transform(energies, lambda x: x.cast("double"))), ratio)


def reserved_masked(scores: Column, codebook: int, end: int) -> Column:
    """Scores with null (no chance) for reserved tokens from ``codebook`` on, but not for ``end``."""
    return F.transform(scores, lambda x, i: F.when((i < codebook) | (i == end), x))


def is_padding(frame: Column, pad: Column) -> Column:
    """Whether every code of a frame is the padding code."""
    return F.forall(frame, lambda x: x == pad)


def valid_codes(frames: Column, width: int = 16, size: int = 2051) -> Column:
    """Whether all frames have ``width`` codes, each within [0, ``size``)."""
    return F.forall(frames, lambda f: (F.size(f) == width) & F.forall(f, lambda v: (v >= 0) & (v < size)))


def rate_factor(step: Column, total: int, warmup: int, floor: float = 0.0, cycles: int = 1) -> Column:
    """Factor of the learning rate: linear warm-up, then a cosine to 0, or with a ``floor`` equal cosine cycles to it."""
    wave = lambda part: 0.5 * (1 + F.cos(math.pi * part))
    if floor > 0:
        length = max(1, (total - warmup) // max(1, cycles))
        after = floor + (1 - floor) * wave(F.pmod(step - warmup, F.lit(length)) / length)
    else:
        after = wave(F.least((step - warmup) / max(1, total - warmup), F.lit(1.0)))
    return F.when(step < warmup, step / max(1, warmup)).otherwise(after)


def sound_ends(samples: Column, frame: int = 2048, hop: int = 512, top_db: float = 40.0) -> Column:
    """array<int>: where each stretch of sound ends, in samples.

    Frames of ``frame`` samples stand around every ``hop``-th sample, zeros beyond the ends. A frame sounds where its power
    is less than ``top_db`` below the loudest one's; a stretch ends at the frame after its last, or with the samples.
    """
    # fixed value: powers below this count as this
    least = 1e-10

    def ends(x: Column) -> Column:
        n = F.size(x)
        at = F.sequence(F.lit(0), F.floor(n / hop).cast("int"))

        def power(t: Column) -> Column:
            start, stop = F.greatest(F.lit(0), t * hop - frame // 2), F.least(n, t * hop - frame // 2 + frame)
            return _sum(F.transform(F.slice(x, start + 1, F.greatest(stop - start, F.lit(0))), lambda v: v.cast("double") * v.cast("double"))) / frame

        def loud(p: Column) -> Column:
            most = F.greatest(F.array_max(p), F.lit(least))
            sounds = F.transform(p, lambda v: 10 * F.log10(F.greatest(v, F.lit(least))) - 10 * F.log10(most) > -top_db)
            last = lambda s: F.filter(F.transform(s, lambda v, t: F.when(v & ~F.coalesce(F.get(s, t + 1), F.lit(False)), F.least((t + 1) * hop, n))), lambda v: v.isNotNull())
            return let(sounds, last)

        return F.when(n > 0, let(F.transform(at, power), loud)).otherwise(F.array().cast("array<int>"))

    return let(samples, ends)


def truncated_pair(samples: Column, text: Column, rate: float, cap: float, frame: int = 2048, hop: int = 512, top_db: float = 40.0) -> Column:
    """struct<kept int, share double, text string>: sound up to the last end of a stretch within ``cap`` seconds, and its text.

    Without such an end the sound is cut at ``cap``. The text keeps its words in the share of the sound that is kept.
    """
    most = int(cap * rate)

    def cut(found: Column) -> Column:
        n, inside = F.size(samples), F.filter(found, lambda e: e <= most)
        return F.least(F.when(F.size(inside) > 0, F.array_max(inside)).otherwise(most), n)

    kept = let(sound_ends(samples, frame, hop, top_db), cut)
    shared = lambda k: F.struct(k.alias("kept"), F.least(F.lit(1.0), k / F.greatest(F.size(samples).cast("double"), F.lit(1e-9 * rate))).alias("share"))
    return let(let(kept, shared), lambda s: F.struct(s["kept"].alias("kept"), s["share"].alias("share"), truncated_words(text, s["share"]).alias("text")))


def quality_ok(energies: Column, least: float) -> Column:
    """Whether the signal stands ``least`` decibels above its noise; always so where ``least`` is not positive or nothing is known."""
    return F.lit(True) if least <= 0 else F.coalesce(snr_db(energies) >= least, F.lit(True))


def level_matched(samples: Column, target: Column, most_gain: float = 4.0) -> Column:
    """Samples at the ``target`` root mean square, by a gain of 1/``most_gain`` to ``most_gain``, within -1 and 1; silence stays."""

    def matched(level: Column) -> Column:
        gain = F.greatest(F.lit(1 / most_gain), F.least(F.lit(most_gain), target / level))
        louder = F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * gain)))
        return F.when(level < 1e-6, F.transform(samples, lambda x: x.cast("double"))).otherwise(louder)

    return let(rms(samples), matched)
