"""Names of unknown charset: one charset for an archive if its names agree on one, else one for each name, else a fallback."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Charsets tried, the strictest first: code pages 932, 936, 949, 950 and 1251.
CANDIDATES = ["cp932", "gbk", "cp949", "cp950", "cp1251"]
THRESHOLD = 0.3
#: Common characters by charset; a decoding is likely in proportion to how many of its non-ASCII characters are among them. Fixed values.
RANGES = {
    "cp932": [(0x3040, 0x30FF, 1.0), (0x4E00, 0x9FFF, 0.6), (0xFF61, 0xFF9F, 0.05)],
    "gbk": [(0x4E00, 0x9FFF, 0.7)],
    "cp950": [(0x4E00, 0x9FFF, 0.65)],
    "cp949": [(0xAC00, 0xD7A3, 1.0), (0x4E00, 0x9FFF, 0.3)],
    "cp1251": [(0x0430, 0x044F, 1.0), (0x0410, 0x042F, 0.8), (0x0451, 0x0451, 0.8)],
}


def _level(names: bytes, code: str) -> float:
    """How likely names are in a charset, from 0 to 1."""
    try:
        text = names.decode(code)
    except UnicodeDecodeError:
        return 0.0
    odd = [ord(c) for c in text if ord(c) > 127]
    if not odd:
        return 0.0
    fit = sum(max([w for lo, hi, w in RANGES[code] if lo <= c <= hi], default=0.0) for c in odd) / len(odd)
    # Level-one Han characters of GB 2312 and of Big5 have lead bytes in these ranges, which tells the two apart.
    if code in ("gbk", "cp950"):
        lead = [b for b, c in zip(names, names[1:]) if b > 0x80 and c > 0x3F]
        fit *= 0.6 + 0.4 * sum((0xB0 <= b <= 0xD7) if code == "gbk" else (0xA4 <= b <= 0xC6) for b in lead) / max(1, len(lead))
    return fit * min(1.0, 0.5 + len(odd) / 16)


def detect(names: bytes, threshold: float = THRESHOLD) -> str | None:
    """The likeliest charset of names, or None if none is likelier than threshold."""
    if all(b < 128 for b in names):
        return None
    level, code = max((_level(names, c), c) for c in CANDIDATES)
    return code if level >= threshold and level > 0 else None


def decode(name: bytes, code: str | None, fallback: str, threshold: float = THRESHOLD) -> str:
    if all(b < 128 for b in name):
        return name.decode("ascii")
    return name.decode(code or detect(name, threshold) or fallback, "replace")


def decoded(entries: DataFrame, archive: str, name: str, is_utf8: Column, fallback: str = "cp437", threshold: float = THRESHOLD) -> DataFrame:
    """entries with a text column name in place of its bytes. Only names that are neither flagged as UTF-8 nor ASCII go through Python;
    an archive's charset is found from all of those."""
    plain = F.col(name).isNull() | is_utf8 | ~F.decode(name, "ISO-8859-1").rlike(r"[^\x00-\x7F]")

    @F.pandas_udf("string")
    def guess(names: pd.Series) -> pd.Series:
        return names.map(lambda parts: detect(b"\0".join(bytes(p) for p in parts), threshold))

    @F.pandas_udf("string")
    def text(names: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else decode(bytes(n), c, fallback, threshold) for n, c in zip(names, codes)])

    odd = entries.where(~plain)
    per = odd.groupBy(archive).agg(F.array_sort(F.collect_set(name)).alias("_names")).select(archive, guess("_names").alias("_code"))
    done = odd.join(per, archive, "left").withColumn("_text", text(F.col(name), F.col("_code"))).drop("_code")
    rest = entries.where(plain).withColumn("_text", F.decode(name, "UTF-8"))
    return rest.unionByName(done).drop(name).withColumnRenamed("_text", "name")
