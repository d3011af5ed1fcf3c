"""Tokenizing rule shared by the retrieval operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Terms that are never cut (fixed values).
PROTECTED = (
    "仿宋_GB2312", "楷体_GB2312", "方正小标宋简体", "OMML", "OOXML", "三线表", "版心尺寸", "首行缩进", "段前间距", "段后间距", "行距倍数", "GB/T", "页边距", "页眉", "页脚",
)


def java_pattern(protected: Sequence[str] = PROTECTED) -> str:
    return "|".join([*protected, r"[\p{IsLatin}\p{N}]+", r"[^\s\p{IsLatin}\p{N}]"])


def tokenize(text: Column, protected: Sequence[str] = PROTECTED) -> Column:
    """Protected terms, runs of Latin letters and digits, and every other character alone; white space falls away, case stays."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(protected)), F.lit(0))


#: The same rule for DuckDB.
DUCK_PATTERN = "|".join([*PROTECTED, r"[\p{Latin}\p{N}]+", r"[^\s\p{Latin}\p{N}]"])
