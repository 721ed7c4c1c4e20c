"""Rule-based language routing by script and by simplified or traditional characters.

Which characters are simplified or traditional comes from two tables. The
default ones hold the characters of only one of the national character sets
(2,380 and 8,678); any other tables can be given.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "en"


@lru_cache(maxsize=1)
def one_sided_characters() -> tuple[str, str]:
    """Han characters of only the simplified and only the traditional national character set."""

    def has(ch: str, codec: str) -> bool:
        try:
            ch.encode(codec)
        except UnicodeEncodeError:
            return False
        return True

    han = [chr(c) for c in range(0x4E00, 0xA000)]
    simplified = "".join(c for c in han if has(c, "gb2312") and not has(c, "big5"))
    traditional = "".join(c for c in han if has(c, "big5") and not has(c, "gb2312"))
    return simplified, traditional


def _hits(text: Column, table: str) -> Column:
    """How many characters of ``text`` are in ``table``: what deleting them takes away."""
    return F.length(text) - F.length(F.translate(text, table, ""))


def character_counts(text: Column, tables: tuple[str, str] | None = None) -> dict[str, Column]:
    """Latin, Han, simplified-only and traditional-only characters, the last two by ``tables``."""
    text = F.coalesce(text, F.lit(""))
    simplified, traditional = tables or one_sided_characters()
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return {
        "latin": count("[A-Za-z]"), "han": count(r"[\x{4E00}-\x{9FFF}]"), "simplified": _hits(text, simplified), "traditional": _hits(text, traditional),
    }


def identify_language(text: Column, tables: tuple[str, str] | None = None) -> Column:
    """en, zh-cn, zh-tw or Undetermined."""
    n = character_counts(text, tables)
    mixed_even = F.when(n["latin"] > 0, "en").otherwise("zh-cn")
    chinese = F.when(n["simplified"] > n["traditional"], "zh-cn").when(n["traditional"] > n["simplified"], "zh-tw").otherwise(mixed_even)
    return F.when(n["han"] > 0, chinese).when(n["latin"] > 0, "en").otherwise("Undetermined")


def route(text: Column, tables: tuple[str, str] | None = None) -> Column:
    """The language whose index answers; undetermined texts go to the default."""
    lang = identify_language(text, tables)
    return F.when(lang == "Undetermined", DEFAULT).otherwise(lang)
