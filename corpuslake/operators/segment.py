"""Sentence segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L
from corpuslake.functions.text import WS, let, replace_where, strip, token_count

_NONE = "array<string>"


def _parts(c: Column, regex: str) -> Column:
    return F.filter(F.transform(F.split(c, regex), strip), lambda s: s != "")


def split_on_verbs(c: Column, least: int = 40) -> Column:
    """Parts of a text of over `least` tokens, cut after each verb ending before more text; a shorter text is one part.

    Endings are tried one by one in their order, so a short one also cuts inside a longer one.
    """
    marked = reduce(lambda t, p: replace_where(t, p, f"({p})(?={WS}[؀-ۿ])", "$1\u0000"), L.VERB_ENDINGS, c)
    return F.when(token_count(c) > least, _parts(marked, "\u0000")).otherwise(F.array(c))


def sentences(c: Column) -> Column:
    """The sentences of a text: at sentence marks; if that gives one, at line ends; if it is long, after verb endings."""

    def of(t: Column, first: Column) -> Column:
        by_line = let(_parts(t, "(?U)\n|\\s{2,}"), lambda x: F.when(F.size(x) > 1, x))
        second = F.when(F.size(first) <= 1, by_line).otherwise(first)
        chosen = F.coalesce(second, first)
        return let(chosen, lambda x: F.when((F.size(x) == 1) & (token_count(F.get(x, F.lit(0))) > 20), let(split_on_verbs(F.get(x, F.lit(0))), lambda v: F.when(F.size(v) > 1, v).otherwise(x))).otherwise(x))

    return let(F.coalesce(c, F.lit("")), lambda t: let(_parts(t, f"[{L.SENTENCE_MARKS}]+"), lambda first: of(t, first)))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def chunks(c: Column, most: int = 30, least: int = 5) -> Column:
    """A sentence of over `most` words in chunks of at most that many; chunks of fewer than `least` words go.

    Words gather until there are `most`. If the gathered text holds a mark, the first kind of ۔ ؟ ! ، that it
    holds cuts it: all pieces but the last are chunks (with their mark) and the last stays; else all of it is a chunk.
    """

    def cut(buffer: Column) -> Column:
        def at(mark: str, rest: Column) -> Column:
            pieces = F.split(buffer, mark)
            done = F.transform(F.filter(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), strip), lambda p: p != ""), lambda p: F.concat(p, F.lit(mark)))
            return F.when(F.contains(buffer, F.lit(mark)), F.struct(done.alias("done"), strip(F.element_at(pieces, -1)).alias("rest"))).otherwise(rest)

        return reduce(lambda rest, mark: at(mark, rest), reversed(L.CHUNK_MARKS), F.struct(F.array(buffer).alias("done"), F.lit("").alias("rest")))

    def step(state: Column, word: Column) -> Column:
        buffer = F.when(state["rest"] == "", word).otherwise(F.concat_ws(" ", state["rest"], word))
        full = token_count(buffer) >= most
        return let(F.struct(cut(buffer).alias("x"), buffer.alias("b"), full.alias("f")), lambda s: F.struct(F.when(s["f"], F.concat(state["done"], s["x"]["done"])).otherwise(state["done"]).alias("done"), F.when(s["f"], s["x"]["rest"]).otherwise(s["b"]).alias("rest")))

    words = F.filter(F.split(c, WS), lambda w: w != "")
    start = F.struct(F.array().cast(_NONE).alias("done"), F.lit("").alias("rest"))
    end = F.aggregate(words, start, step, lambda s: F.when(s["rest"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["rest"]))))
    return F.when(token_count(c) <= most, F.array(c)).otherwise(F.filter(end, lambda s: token_count(s) >= least))
