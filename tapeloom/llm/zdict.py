"""Raw-content zstandard dictionaries built from bounded samples of labelled text, and sizes of texts under them."""

from __future__ import annotations

from collections.abc import Iterable

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL = 6
#: Bytes of one dictionary, and code points that one document gives to it.
DICT_BYTES, WINDOW_CHARS = 256 << 10, 512


def text_window(text: Column, key: Column, chars: int = WINDOW_CHARS) -> Column:
    """``chars`` code points from a place that the key's hash picks, so no part of the texts is favoured."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(key, F.lit(1)), room) + 1).cast("int"), F.lit(chars))


def sampled(rows: DataFrame, group: str, key: str, per_group: int) -> DataFrame:
    """``per_group`` rows of each group in order of the key's hash; rows far from that are gone before the window sorts."""
    n = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    share = F.coalesce(*[F.when(F.col(group) == g, F.lit(min(1.0, 2.0 * per_group / c + 50.0 / c))) for g, c in n.items()], F.lit(0.0)) if n else F.lit(0.0)
    near = rows.withColumn("_h", F.xxhash64(key)).where((F.col("_h") / F.lit(2.0**64) + 0.5) < share)
    order = Window.partitionBy(group).orderBy("_h", key)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_group).drop("_n", "_h")


def raw_dictionary(parts: Iterable[bytes], size: int = DICT_BYTES) -> bytes:
    """The parts one after another, up to ``size`` bytes; the caller gives them in order of a hash, so that no ids are favoured."""
    return b"\n".join(parts)[:size]


def compressors(dictionaries: dict, level: int = LEVEL) -> dict:
    """One compressor per label, its dictionary digested once."""
    out = {}
    for label, content in dictionaries.items():
        if len(content) < 8:  # zstandard takes no shorter dictionary
            out[label] = zstandard.ZstdCompressor(level=level)
            continue
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out[label] = zstandard.ZstdCompressor(dict_data=d, level=level)
    return out
