"""Column expressions: difficulty, language by script, normal forms, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that only Kazakh has among Cyrillic alphabets of the data.
KAZAKH = "ӘәҒғҚқҢңӨөҰұҮүҺһІі"
RULES = (("kz", f"[{KAZAKH}]"), ("ru", r"\p{IsCyrillic}"))


def difficulty(correct: Column, fail: Column) -> Column:
    """Smoothed logit difficulty, ln((fail + 1/2) / (correct + 1/2))."""
    return F.log((fail + 0.5) / (correct + 0.5))


def proportion(correct: Column, fail: Column) -> Column:
    return correct / (correct + fail)


def lang_by_script(text: Column, rules=RULES, other: str = "en") -> Column:
    """The first rule whose pattern the text holds; null text has none."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; null stays."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def norm_text(text: Column) -> Column:
    """Lower case, runs of characters other than letters, digits and _ as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(p: Column, least: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))


def logit(p: Column, least: float = 1e-3) -> Column:
    q = clip(p, least)
    return F.log(q / (1 - q))


def hash01(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a key and a seed that any engine can repeat: md5, first 8 hex digits."""
    return F.conv(F.substring(F.md5(hash_text(*parts, seed=seed)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_text(*parts: Column, seed: int = 0) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
