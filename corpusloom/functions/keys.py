"""Deterministic keys and draws: every order and every draw is a function of SHA-1, never of generator state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNASSIGNED = ":99"
#: Corpora whose speakers carry an episode-local suffix.
SUFFIXED = ("tagarela", "podcast")


def _key(*parts) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def order_key(*parts) -> Column:
    """Hex digest of the parts joined by a bar, to sort by."""
    return F.sha1(_key(*parts))


def draw(*parts) -> Column:
    """A number in [0, 1): the first eight bytes of the digest over 2^64."""
    return F.conv(F.substring(F.sha1(_key(*parts)), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def assigned(speaker: Column) -> Column:
    """Whether a speaker id names a speaker: not empty and not the unassigned bucket."""
    return F.coalesce((speaker != "") & ~F.endswith(speaker, F.lit(UNASSIGNED)), F.lit(False))


def group_key(corpus: Column, speaker: Column, group: Column | None = None, idx: Column | None = None) -> Column:
    """corpus/group where a group is set, else corpus/speaker, without the last suffix in suffixed corpora.

    A clip without a speaker is a group of its own by its ``idx``, if that is given.
    """
    if idx is not None:
        speaker = F.when(F.coalesce(speaker, F.lit("")) != "", speaker).otherwise(idx)
    short = F.when(corpus.isin(*SUFFIXED), F.regexp_replace(speaker, ":[^:]*$", "")).otherwise(speaker)
    own = F.concat(corpus, F.lit("/"), short)
    return own if group is None else F.when(F.coalesce(group, F.lit("")) != "", F.concat(corpus, F.lit("/"), group)).otherwise(own)


def voice_key(corpus: Column, speaker: Column, idx: Column) -> Column:
    return F.concat_ws("|", corpus, F.when(F.coalesce(speaker, F.lit("")) != "", speaker).otherwise(idx))


def gender(label: Column) -> Column:
    """F, M or null."""
    low = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.when(low.startswith("female") | (low == "f"), "F").when(low.startswith("male") | (low == "m"), "M")
