"""Language of documents by the scripts of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import not_blank

#: Least share of texts with a script.
SHARE = 0.01


def languages(texts: DataFrame, key: str = "doc_id", text: str = "v") -> DataFrame:
    """key, language: KO if the share of non-blank texts with Hangul is enough and not below that with kana, else JA if
    that with kana is enough, else EN. Keys with blank texts alone are EN."""
    seen = not_blank(F.col(text))
    share = lambda p: F.coalesce(F.count_if(seen & F.col(text).rlike(p)) / F.nullif(F.count_if(seen), F.lit(0)), F.lit(0.0))
    hangul, kana = share(r"\p{IsHangul}"), share(r"[\p{IsHiragana}\p{IsKatakana}]")
    return texts.groupBy(key).agg(F.when((hangul >= SHARE) & (hangul >= kana), "KO").when(kana >= SHARE, "JA").otherwise("EN").alias("language"))
