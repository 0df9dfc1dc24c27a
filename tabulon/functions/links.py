"""Texts as share links: gzip and base64 for URLs, and back with checks. Spark has no gzip, so this runs in Python, in Arrow batches."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: The most bytes of a link's text and of what it unpacks to.
MOST_LINK, MOST_TEXT = 32_768, 2_000_000
#: What a text must hold to be a game's log.
LOG_MARK = r"\bturn \d+\b"


def _unpacked(link: str | None) -> str | None:
    kind, _, data = (link or "").partition(".")
    if link is None or len(link) > MOST_LINK or kind not in ("gz", "raw") or not data or not all(c.isascii() and (c.isalnum() or c in "-_") for c in data):
        return None
    try:
        raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
        if kind == "gz":
            unzip = zlib.decompressobj(31)
            raw = unzip.decompress(raw, MOST_TEXT + 1)
            if not unzip.eof:
                return None
        return raw.decode() if len(raw) <= MOST_TEXT else None
    except (ValueError, zlib.error):
        return None


@pandas_udf(T.StringType())
def packed(texts: pd.Series) -> pd.Series:
    """'gz.' and the text's gzip in base64url without padding; NULL for NULL."""

    def pack(t: str) -> str:
        z = zlib.compressobj(9, zlib.DEFLATED, 31)
        return "gz." + base64.urlsafe_b64encode(z.compress(t.encode()) + z.flush()).decode().rstrip("=")

    return texts.map(lambda t: None if t is None else pack(t))


@pandas_udf(T.StringType())
def unpacked(links: pd.Series) -> pd.Series:
    """The text of a 'gz.' or 'raw.' link; NULL if it is no link, too long, broken, unpacks to too much or to no UTF-8."""
    return links.map(_unpacked)


def is_log(link: Column) -> Column:
    """Whether a link holds a game's log."""
    return F.coalesce(unpacked(link).rlike(LOG_MARK), F.lit(False))
