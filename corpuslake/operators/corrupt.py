"""Rule-based corruption of sentences: reproducible draws, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L
from corpuslake.functions.rng import draw, index, pick, uniform
from corpuslake.functions.text import let, tokens
from corpuslake.operators.validate import accepted_pairs


def _map(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def _result(text: Column, label) -> Column:
    return F.struct(text.alias("incorrect_sentence"), (F.lit(label) if isinstance(label, str) else label).alias("error_type"))


def _replaced(words: Column, at: Column, word: Column) -> Column:
    """The words joined, with the word at place `at` replaced, or deleted where the new one is empty."""
    new = F.transform(words, lambda w, i: F.when(i == at, word).otherwise(w))
    return F.array_join(F.filter(new, lambda w, i: (i != at) | (w != "")), " ")


def _places(words: Column, keys) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(w.isin(*keys), i)), lambda i: i.isNotNull())


def spelling(s: Column, *key: Column) -> Column:
    """A confusable character of a random word becomes another; the word's first occurrence in the text changes. Null if there is none."""
    k = key or (s,)
    confusable = "[" + "".join(L.CONFUSABLE) + "]"

    def change(word: Column) -> Column:
        chars = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.when(F.substr(word, i, F.lit(1)).rlike(confusable), i)), lambda i: i.isNotNull())

        def at(p: Column) -> Column:
            other = pick("spelling_char", F.element_at(_map(L.CONFUSABLE), F.substr(word, p, F.lit(1))), *k)
            new = F.concat(F.substr(word, F.lit(1), p - 1), other, F.substr(word, p + 1))
            start = F.instr(s, word)
            return F.concat(F.substr(s, F.lit(1), start - 1), new, F.substr(s, start + F.length(word)))

        return let(pick("spelling_place", chars, *k), at)

    words = F.filter(tokens(s), lambda w: w.rlike(confusable))
    chosen = pick("spelling_word", words, *k)
    text = let(chosen, lambda w: F.when(w.isNotNull(), change(w)))
    return let(text, lambda t: F.when(t.isNotNull(), _result(t, "spelling_error")))


def postposition(s: Column, *key: Column) -> Column:
    """A random postposition becomes another or goes. Null if there is none."""
    k = key or (s,)

    def of(w: Column) -> Column:
        def at(i: Column) -> Column:
            def done(new: Column) -> Column:
                return F.when(new.isNotNull(), _result(_replaced(w, i, new), F.when(new == "", "postposition_deletion").otherwise("postposition_substitution")))
            return let(pick("postposition_new", F.try_element_at(_map(L.POSTPOSITIONS), F.get(w, i)), *k), done)
        return let(pick("postposition_place", _places(w, L.POSTPOSITIONS), *k), at)

    return let(tokens(s), of)


def gender(s: Column, *key: Column) -> Column:
    """A random word of the gender table becomes its counterpart. Null if there is none."""
    k = key or (s,)
    table = F.create_map(*[F.lit(x) for kv in L.GENDER.items() for x in kv])

    def of(w: Column) -> Column:
        return let(pick("gender_place", _places(w, L.GENDER), *k), lambda i: F.when(i.isNotNull(), _result(_replaced(w, i, F.try_element_at(table, F.get(w, i))), "gender_agreement")))

    return let(tokens(s), of)


def insertion(s: Column, *key: Column) -> Column:
    """A common word at a random place, the ends included."""
    k = key or (s,)
    word = pick("insertion_word", F.array(*map(F.lit, L.INSERTED)), *k)

    def of(w: Column) -> Column:
        place = (draw("insertion_place", *k) % (F.size(w) + 1)).cast("int")
        return let(place, lambda i: _result(F.array_join(F.concat(F.slice(w, F.lit(1), i), F.array(word), F.slice(w, i + 1, F.size(w) + 1)), " "), "word_insertion"))

    return let(tokens(s), of)


def deletion(s: Column, *key: Column) -> Column:
    """A random word goes. Null for three words or fewer."""
    k = key or (s,)

    def of(w: Column) -> Column:
        return let(index("deletion_place", F.size(w), *k), lambda i: F.when(F.size(w) > 3, _result(F.array_join(F.filter(w, lambda _, j: j != i), " "), "word_deletion")))

    return let(tokens(s), of)


FUNCTIONS = {"spelling": spelling, "postposition": postposition, "gender": gender, "insertion": insertion, "deletion": deletion}


def choice(s: Column, *key: Column) -> Column:
    """Which corruption a sentence gets, by the shares of the table."""

    def of(u: Column) -> Column:
        out, total = None, 0.0
        for name, share in L.CORRUPTION_SHARES[:-1]:
            total += share
            out = F.when(u < round(total, 9), name) if out is None else out.when(u < round(total, 9), name)
        return out.otherwise(L.CORRUPTION_SHARES[-1][0])

    return let(uniform("choice", *(key or (s,))), of)


def corrupt(s: Column, *key: Column) -> Column:
    """One corruption of a sentence, chosen by shares; null if that one doesn't apply. Only the chosen branch is evaluated."""
    def of(name: Column) -> Column:
        out = None
        for n, f in FUNCTIONS.items():
            out = F.when(name == n, f(s, *key)) if out is None else out.when(name == n, f(s, *key))
        return out
    return let(choice(s, *key), of)


def made_once(df: DataFrame, x: Column, *keep: str) -> DataFrame:
    """The columns `keep` and the fields of x, where x isn't null. Above an outer explode conditions on x read what has been
    made; the optimizer would write them out below, where each makes x once more."""
    return df.select(*keep, F.explode_outer(F.array(x)).alias("x")).where("x IS NOT NULL").select(*keep, "x.*")


def rule_pairs(df: DataFrame, column: str = "sentence", variations: int = 1) -> DataFrame:
    """incorrect_sentence, correct_sentence and error_type of each sentence and variation that gives an acceptable pair."""
    base = df.select(F.col(column).alias("correct_sentence"))
    if variations < 1:
        return base.select(F.lit("").alias("incorrect_sentence"), "correct_sentence", F.lit("").alias("error_type")).limit(0)
    s = F.col("correct_sentence")
    if variations == 1:
        made = made_once(base, corrupt(s), "correct_sentence")
    else:
        each = base.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(variations))))
        made = made_once(each, corrupt(s, F.col("v"), s), "correct_sentence")
    return accepted_pairs(made.select("incorrect_sentence", "correct_sentence", "error_type"))


def error_type_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("error_type").agg(F.count("*").alias("n"))


def unify_pairs(**sets: DataFrame) -> DataFrame:
    """Pairs of several methods in one format, with the method's name; types that a method lacks are its own name."""
    out = None
    for name, df in sets.items():
        bad = next(c for c in ("incorrect_sentence", "error_sentence", "corrupted") if c in df.columns)
        good = next(c for c in ("correct_sentence", "original_sentence", "original") if c in df.columns)
        kind = F.col("error_type") if "error_type" in df.columns else F.lit(name)
        part = df.select(F.col(bad).alias("incorrect_sentence"), F.col(good).alias("correct_sentence"), kind.alias("error_type"), F.lit(name).alias("method"))
        out = part if out is None else out.unionByName(part)
    return out
