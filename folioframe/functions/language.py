"""Language codes and language detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.session import broadcast_if_few, cut_lineage

# ISO 639-1, ISO 639-3 and the English name.
LANGUAGES = (
    ("ar", "ara", "Arabic"), ("bg", "bul", "Bulgarian"), ("ca", "cat", "Catalan"), ("cs", "ces", "Czech"),
    ("da", "dan", "Danish"), ("de", "deu", "German"), ("el", "ell", "Greek"), ("en", "eng", "English"),
    ("es", "spa", "Spanish"), ("et", "est", "Estonian"), ("fa", "fas", "Persian"), ("fi", "fin", "Finnish"),
    ("fr", "fra", "French"), ("he", "heb", "Hebrew"), ("hi", "hin", "Hindi"), ("hr", "hrv", "Croatian"),
    ("hu", "hun", "Hungarian"), ("id", "ind", "Indonesian"), ("it", "ita", "Italian"), ("ja", "jpn", "Japanese"),
    ("ko", "kor", "Korean"), ("lt", "lit", "Lithuanian"), ("lv", "lav", "Latvian"), ("ms", "msa", "Malay"),
    ("nl", "nld", "Dutch"), ("no", "nor", "Norwegian"), ("pl", "pol", "Polish"), ("pt", "por", "Portuguese"),
    ("ro", "ron", "Romanian"), ("ru", "rus", "Russian"), ("sk", "slk", "Slovak"), ("sl", "slv", "Slovenian"),
    ("sr", "srp", "Serbian"), ("sv", "swe", "Swedish"), ("th", "tha", "Thai"), ("tr", "tur", "Turkish"),
    ("uk", "ukr", "Ukrainian"), ("vi", "vie", "Vietnamese"), ("zh", "zho", "Chinese"),
)

# The two Chinese scripts have codes of their own.
SPECIAL = {"chs": "zh", "cht": "cht"}


def normalise_code(code: Column) -> Column:
    """Two-letter code where there is one; null for an unknown code."""
    c = F.lower(F.regexp_replace(code, r"(?U)^\s+|\s+\z", ""))
    pairs = [F.lit(v) for a, b, _ in LANGUAGES for v in (a, a, b, a)]
    pairs += [F.lit(v) for kv in SPECIAL.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def language_name(code: Column) -> Column:
    pairs = [F.lit(v) for a, _, n in LANGUAGES for v in (a, n)] + [F.lit("cht"), F.lit("Chinese (Traditional)")]
    return F.try_element_at(F.create_map(*pairs), code)


def script_language(text: Column) -> Column:
    """Language decided by the script alone, null for Latin and the like."""
    return (
        F.when(text.rlike("[぀-ヿ]"), F.lit("ja"))
        .when(text.rlike("[가-힯]"), F.lit("ko"))
        .when(text.rlike("[一-鿿]"), F.lit("zh"))
        .when(text.rlike("[Ѐ-ӿ]"), F.lit("ru"))
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


def train_profiles(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The trigrams of every language with a whole-number weight.

    Words are counted before they are cut into trigrams, so the shuffle carries
    the vocabulary and not the texts.  Trigrams below a millionth of a language
    have weight zero and are left out: they could not change a score.
    """
    words = df.select(lang, F.explode(_words(F.col(text))).alias("word")).groupBy(lang, "word").count()
    grams = (
        words.select(lang, F.explode(_grams(F.col("word"))).alias("gram"), "count")
        .groupBy(lang, "gram").agg(F.sum("count").alias("n"))
    )
    total = grams.groupBy(lang).agg(F.sum("n").alias("total"))
    weight = F.floor(F.col("n") * 1000000.0 / F.col("total")).cast("bigint")
    return grams.join(total, lang).select(F.col(lang).alias("lang"), "gram", weight.alias("weight")).where("weight > 0")


#: Languages up to which a trigram meets the weights of all of them in one row.
MANY_LANGUAGES = 64


def _best_of_few(grams: DataFrame, profiles: DataFrame, key: list[str], langs: list[str | None]) -> DataFrame:
    """:func:`best_language` with one row per trigram, whose columns are the weights of the languages; a language never met has no sum."""
    own = [F.sum(F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.col("weight"))).alias(f"_w{i}") for i, lang in enumerate(langs)]
    wide = F.broadcast(cut_lineage(profiles.groupBy("gram").agg(*own)))
    sums = grams.join(wide, "gram").groupBy(*key).agg(*[F.sum(f"_w{i}").alias(f"_w{i}") for i in range(len(langs))])
    scores = F.array(*[F.when(F.col(f"_w{i}").isNotNull(), F.struct(F.col(f"_w{i}").alias("score"), F.lit(lang).cast("string").alias("lang"))) for i, lang in enumerate(langs)])
    return sums.select(*key, F.array_max(F.array_compact(scores)).alias("best"))


def best_language(df: DataFrame, profiles: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``best``, the highest ``(score, lang)`` of all texts of a key together; keys without a known trigram get no row.

    Profiles are bounded, so trigrams meet them where the texts are and only one
    row per key moves, with a sum for each language. Profiles of very many languages
    are shuffled, and so are the trigrams, counted per key.
    """
    profiles = cut_lineage(profiles)
    profile = broadcast_if_few(profiles)
    grams = df.select(*key, F.explode(_words(F.col(text))).alias("word")).select(*key, F.explode(_grams(F.col("word"))).alias("gram"))
    if profile is not profiles:
        langs = profiles.groupBy("lang").agg(F.bool_or(F.col("weight").isNull()).alias("unknown")).limit(MANY_LANGUAGES + 1).collect()
        if 0 < len(langs) <= MANY_LANGUAGES and not any(r.unknown for r in langs):
            return _best_of_few(grams, profiles, key, [r.lang for r in langs])
    if profile is profiles:
        grams = grams.groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("n"))
        weight = F.col("n") * F.col("weight")
    else:
        weight = F.col("weight")
    return (
        grams.join(profile, "gram").groupBy(*key, "lang").agg(F.sum(weight).alias("score"))
        .groupBy(*key).agg(F.max(F.struct("score", "lang")).alias("best"))
    )


def detect_language(df: DataFrame, profiles: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Add ``language``: by script, else the profile with the highest score."""
    scored = best_language(df, profiles, key, text)
    return df.join(scored, key, "left").withColumn(
        "language", F.coalesce(script_language(F.col(text)), F.col("best.lang"))).drop("best")
