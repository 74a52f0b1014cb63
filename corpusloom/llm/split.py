"""Problem 3: cutting texts that are too long, at natural boundaries, with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(limit: int) -> str:
    """A regular expression whose matches tile a text; alternatives stand in order of boundary strength.

    Each takes as much as it can up to ``limit`` characters and at least half of that: up to a paragraph end,
    a line end, a sentence end, the end of a word, any character that no combining mark follows, any character.
    """
    low = max(1, limit // 2)
    span = f".{{{low},{limit}}}"
    last = rf".{{1,{limit}}}\z"
    return "(?s)" + "|".join([last, span + r"(?<=\n[ \t]{0,8}\n)", span + r"(?<=\n)", span + r"(?<=[.!?…][\"')\]]{0,2}\s|[。！？])", span + r"(?<=\s)", span + r"(?!\p{M})", f".{{1,{limit}}}"])


def pieces(text: Column, max_size: int, overlap: int) -> Column:
    """An array of structs (piece_no, start, text): at most ``max_size`` characters each, in text order.

    Every piece but the first begins with the last ``overlap`` characters of the text before its own part (all of
    them, if there are fewer), so the parts without overlap make up the text again. Null or empty text gives an empty
    array, text of at most ``max_size`` characters one piece. ``start`` counts from 0, in characters. Any overlap
    below the size will do; the parts get what it leaves.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be less than the size")
    body = max_size - overlap
    back = -(-overlap // max(1, body // 2))  # a part before the last has at least half a body, so these many hold the overlap

    def cut(parts: Column) -> Column:
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        begins = F.aggregate(F.transform(parts, F.length), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), step, lambda acc: acc["all"])
        if not overlap:
            return F.transform(F.arrays_zip(begins.alias("b"), parts.alias("p")), lambda x, i: F.struct((i + 1).alias("piece_no"), x["b"].alias("start"), x["p"].alias("text")))
        before = lambda i: F.right(F.array_join(F.slice(parts, F.greatest(F.lit(1), i - (back - 1)), F.least(i, F.lit(back))), ""), F.lit(overlap))
        lead = F.transform(parts, lambda p, i: F.when(i > 0, before(i)).otherwise(""))
        return F.transform(F.arrays_zip(begins.alias("b"), lead.alias("o"), parts.alias("p")), lambda x, i: F.struct((i + 1).alias("piece_no"), (x["b"] - F.length(x["o"])).alias("start"), F.concat(x["o"], x["p"]).alias("text")))

    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - a name for a value, so that it is made once
    long = once(F.regexp_extract_all(text, F.lit(pattern(body)), F.lit(0)), cut)
    whole = F.array(F.struct(F.lit(1).alias("piece_no"), F.lit(0).alias("start"), text.alias("text")))
    return F.when(F.length(text) > max_size, long).when(F.length(text) > 0, whole).otherwise(F.slice(whole, 1, 0))


def split_long(df: DataFrame, text: str, keys: list[str], max_size: int, overlap: int) -> DataFrame:
    """One row per piece: ``keys``, piece_no, start, n_pieces, text. Texts without characters give no row."""
    cut = df.select(*keys, F.col(text).alias("_t")).select(*keys, pieces(F.col("_t"), max_size, overlap).alias("_p"))
    return cut.select(*keys, F.size("_p").alias("n_pieces"), F.inline("_p").alias("piece_no", "start", "text"))
