"""Dictionary checks, variants, look-ups and the audit trail. A dictionary is a table of word forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import stored
from .reshape import flags_to_list, lookup_replace


def _known(words: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """words with __ok: is the column's text in the dictionary?"""
    forms = dictionary.select(F.col("word").alias(column)).distinct().withColumn("__hit", F.lit(True))
    return words.join(forms, column, "left").withColumn("__ok", F.coalesce("__hit", F.lit(False))).drop("__hit")


def _per_text(df: DataFrame, column: str, checked: DataFrame, name: str) -> DataFrame:
    """Puts results of distinct texts back on all rows; a null text has a null result."""
    return df.drop(name).join(checked, column, "left")


def is_word(df: DataFrame, column: str, dictionary: DataFrame, name: str = "spelling_ok") -> DataFrame:
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    return _per_text(df, column, _known(texts, column, dictionary).withColumnRenamed("__ok", name), name)


def any_casing_ok(df: DataFrame, column: str, dictionary: DataFrame, name: str = "spelling_ok") -> DataFrame:
    """Is the text a word in its own, lower, upper, sentence or title case?"""
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    forms = texts.select(column, F.explode(text.casings(F.col(column))).alias("__form"))
    return _per_text(df, column, _known(forms, "__form", dictionary).groupBy(column).agg(F.bool_or("__ok").alias(name)), name)


#: Words of a look-up, up to which it is broadcast (about 100 bytes each).
BROADCAST_WORDS = 2_500_000


def _in_place(df: DataFrame, column: str, table: DataFrame, most: int) -> DataFrame:
    """df with, for the k-th of the text's words between single spaces, __wk and what the table (word, value) has for it, __vk;
    null beyond the last word. The table is broadcast, so texts are not dealt out. A text of more than ``most`` words is an error."""
    words = F.split(column, " ", -1)
    first = F.when(F.size(words) > most, F.raise_error(F.lit(f"a text of more than {most} words"))).otherwise(F.get(words, F.lit(0)))
    out = df.select("*", first.alias("__w0"), *(F.get(words, F.lit(k)).alias(f"__w{k}") for k in range(1, most)))
    for k in range(most):
        out = out.join(F.broadcast(table.toDF(f"__w{k}", f"__v{k}")), f"__w{k}", "left")
    return out


def multiword_ok(df: DataFrame, column: str, dictionary: DataFrame, name: str = "spelling_ok", custom: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Are all words between single spaces in the dictionary, or in the custom one?

    ``most``, where it is known and small, is the largest number of words that a text holds: then each is looked up in its row, while the
    dictionary holds ``BROADCAST_WORDS`` or fewer. Else distinct texts are taken apart, their words looked up and put together again.
    """
    known = dictionary.select("word") if custom is None else dictionary.select("word").union(custom.select("word"))
    if most:
        known = stored(known.distinct())
        if known.count() <= BROADCAST_WORDS:
            out = _in_place(df.drop(name), column, known.withColumn("value", F.lit(True)), most)
            ok = reduce(Column.__and__, (F.col(f"__w{k}").isNull() | F.col(f"__v{k}").isNotNull() for k in range(most)))
            return out.select(column, *(c for c in df.columns if c not in (column, name)), F.when(F.col(column).isNotNull(), ok).alias(name))
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    forms = texts.select(column, F.explode(F.split(column, " ", -1)).alias("__form"))
    return _per_text(df, column, _known(forms, "__form", known).groupBy(column).agg(F.bool_and("__ok").alias(name)), name)


#: Words that change, up to which they are broadcast (about 100 bytes each).
SMALL_WORDS = 200_000


def improve_phrases(df: DataFrame, column: str, dictionary: DataFrame, name: str = "improved", vocabulary: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Each word replaced by its best variant: the only viable one, else the only viable one that is not upper case,
    else the first viable one, else the word itself. Works on distinct words, then distinct phrases.

    Only words that change are looked up in the phrases: by broadcast where they are ``SMALL_WORDS`` or fewer, so that phrases are
    dealt out once, else by a join. ``vocabulary`` (word), where it is at hand, holds all words of the phrases, which are then not read for them.
    ``most``, where it is known and small, is the largest number of words that a phrase holds: then each is looked up in its row, while
    ``BROADCAST_WORDS`` or fewer change, and phrases are not dealt out at all.
    """
    single = df.select(F.explode(F.split(column, " ", -1)).alias("__word")) if vocabulary is None else vocabulary.select(F.col("word").alias("__word"))
    single = single.distinct()
    forms = single.select("__word", F.posexplode(text.spelling_variants(F.col("__word"))).alias("__ord", "__form"))
    found = _known(forms, "__form", dictionary).where("__ok").groupBy("__word").agg(F.transform(F.array_sort(F.collect_list(F.struct("__ord", "__form"))), lambda x: x["__form"]).alias("__viable"))
    mixed = F.filter("__viable", lambda v: v != F.upper(v))
    best = found.select("__word", F.when((F.size("__viable") > 1) & (F.size(mixed) == 1), F.get(mixed, F.lit(0))).otherwise(F.get("__viable", F.lit(0))).alias("__best"))
    best = stored(best.where("__best <> __word"))
    if most and best.count() <= BROADCAST_WORDS:
        out = _in_place(df.drop(name), column, best, most)
        joined = F.concat_ws(" ", *(F.coalesce(f"__v{k}", f"__w{k}") for k in range(most)))  # nulls beyond the last word are left out
        return out.select(column, *(c for c in df.columns if c not in (column, name)), F.when(F.col(column).isNotNull(), joined).alias(name))
    phrases = df.select(column).where(F.col(column).isNotNull()).distinct()
    words = phrases.select(column, F.posexplode(F.split(column, " ", -1)).alias("__at", "__word"))
    if best.limit(SMALL_WORDS + 1).count() <= SMALL_WORDS:
        best = F.broadcast(best)
    done = words.join(best, "__word", "left").groupBy(column).agg(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("__best", "__word").alias("w")))).alias("__ws"))
    return df.drop(name).join(done.select(column, F.array_join(F.transform("__ws", lambda x: x["w"]), " ").alias(name)), column, "left")


def title_corrections(df: DataFrame, column: str, titles: DataFrame) -> DataFrame:
    """The normalised title where a look-up (word, wikipedia_page, title) found another one that is the same but for case
    and spelling; the look-up is made unique by word."""
    hits = titles.where("wikipedia_page AND title IS NOT NULL AND title <> word").select(F.col("word").alias(column), "title")
    return lookup_replace(df, hits, column, "title")


def track(df: DataFrame, before: str, after: str, flag: str) -> DataFrame:
    """Sets the flag where a step has changed the text; a comparison with null sets nothing."""
    old = F.col(flag) if flag in df.columns else F.lit(None).cast("boolean")
    return df.withColumn(flag, F.when(F.col(before) != F.col(after), F.lit(True)).otherwise(old))


def corrections(flags: dict[str, str]) -> Column:
    return flags_to_list(flags)


def mask_one(long: DataFrame, ids: tuple[str, ...] = ("id_r", "cue"), mask: str = "WORD") -> DataFrame:
    """For each misspelled answer of a trial a row with all its answers, that one masked (long: position, response,
    spelling_ok). One pass over the trial instead of one per position."""
    per = long.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("response", "spelling_ok")))).alias("m"))
    one = lambda p: F.element_at("m", F.lit(p))
    rows = []
    for p in (1, 2, 3):
        shown = [F.when(F.lit(q == p), F.lit(mask)).otherwise(one(q)["response"]).alias(f"resp_{q}") for q in (1, 2, 3)]
        rows.append(F.when(~one(p)["spelling_ok"], F.struct(*shown, one(p)["response"].alias("incorrect"))))
    return per.select(*ids, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(*ids, "r.*")


def apply_corrections(long: DataFrame, fixes: DataFrame, keys: tuple[str, ...] = ("id_r", "cue", "position")) -> DataFrame:
    """Answers replaced by a model's, where it gave one for the same trial, cue and position."""
    new = fixes.groupBy(*keys).agg(F.min("model").alias("__new"))
    return long.join(new, list(keys), "left").withColumn("response", F.coalesce("__new", F.col("response"))).drop("__new").select(*long.columns)


def correction_eval(df: DataFrame, original: str = "original", gold: str = "gold", model: str = "model") -> DataFrame:
    """One row: accuracy on misspelled words, over-correction of right ones, overall accuracy. A null poisons a measure
    in which it occurs; nothing to measure gives null."""
    o, g, m = F.col(original), F.col(gold), F.col(model)
    wrong, right, hit = o != g, o == g, m == g

    def mean(of: Column, where: Column) -> Column:
        unknown = F.count_if(where.isNull() | (where & of.isNull()))
        return F.when(unknown == 0, F.try_divide(F.count_if(where & of), F.count_if(where)))

    return df.agg(mean(hit, wrong).alias("acc_misspelled"), mean(m != g, right).alias("over_correction"), mean(hit, F.lit(True)).alias("accuracy"))
