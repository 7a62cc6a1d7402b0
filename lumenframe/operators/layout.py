"""What a whole asset's text tells: its class by layout, and whether translations fit their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.text import as_col, em_width, rounded

# Widths relative to English by language, then by script, and each language's script
LANGUAGE_WIDTH = {
    "en": 1.00, "de": 1.35, "fi": 1.30, "hu": 1.25, "es": 1.25, "fr": 1.20, "pt": 1.20, "it": 1.20, "pl": 1.20, "nl": 1.20, "ru": 1.15,
    "el": 1.15, "vi": 1.15, "th": 1.15, "sv": 1.10, "tr": 1.10, "ar": 1.05, "hi": 1.05, "he": 0.95, "ko": 0.80, "ja": 0.60,
}
SCRIPT_WIDTH = {
    "Latn": 1.15, "Cyrl": 1.15, "Grek": 1.15, "Arab": 1.05, "Hebr": 0.95, "Hans": 0.60, "Hant": 0.60, "Hani": 0.60, "Jpan": 0.60, "Kore": 0.80, "Hang": 0.80,
    "Deva": 1.05, "Beng": 1.05, "Guru": 1.05, "Gujr": 1.05, "Taml": 1.10, "Telu": 1.10, "Knda": 1.10, "Mlym": 1.15, "Sinh": 1.10, "Thai": 1.15, "Laoo": 1.15,
    "Mymr": 1.15, "Khmr": 1.20, "Ethi": 1.05, "Armn": 1.10, "Geor": 1.10,
}
SCRIPT_OF = {
    "Latn": "uz az no da is cs sk ro hr sl et lv lt", "Cyrl": "uk mn kk bg sr", "Arab": "fa", "Deva": "mr", "Beng": "bn", "Guru": "pa", "Gujr": "gu", "Taml": "ta", "Telu": "te",
    "Knda": "kn", "Mlym": "ml", "Sinh": "si", "Mymr": "my", "Khmr": "km", "Laoo": "lo", "Ethi": "am ti", "Armn": "hy", "Geor": "ka",
}
TIGHT, TOO_WIDE = 1.05, 1.35
POINTS_OF_HEIGHT = 0.75

QUANTITY = r"(?iU)(?:\d+(?:[.,]\d+)?\s*(?:%|kg|g|mg|l|ml|cl|oz|lb|cm|mm|°[cf])\b)|(?:[$€£¥]\s*\d)"


def _width_of(language: Column) -> Column:
    scripts = {lang: SCRIPT_WIDTH[script] for script, langs in SCRIPT_OF.items() for lang in langs.split()}
    table = F.create_map(*[F.lit(x) for pair in {**scripts, **LANGUAGE_WIDTH}.items() for x in pair])
    return F.try_element_at(table, language)


def expansion_factor(lang) -> Column:
    """Width of a language's text relative to English: by language, else its base language, else its script, else 1.

    Any regional tag of a listed language counts; Chinese needs one.
    """
    tag = F.lower(as_col(lang))
    return F.coalesce(F.when(tag.startswith("zh-"), SCRIPT_WIDTH["Hans"]), _width_of(F.substring_index(tag, "-", 1)), F.lit(1.0))


def expansion_fit(source, target, width, height, size, source_lang, target_lang) -> Column:
    """Struct of fit (expected width over the box's, three places) and severity (error, warning, null).

    A target is measured; without one the source's width is scaled by the two languages' factors, and only then can it be
    an error. A missing or zero size is three quarters of the height. Null for blank sources and boxes without width.
    """
    source, target, width = as_col(source), F.nullif(as_col(target), F.lit("")), as_col(width)
    points = F.coalesce(F.nullif(as_col(size).cast("double"), F.lit(0.0)), as_col(height) * POINTS_OF_HEIGHT)
    ratio = expansion_factor(target_lang) / expansion_factor(F.coalesce(F.nullif(as_col(source_lang), F.lit("")), F.lit("en")))
    fit = F.when(target.isNotNull(), em_width(target) * points / width).otherwise(em_width(source) * points * ratio / width)
    severity = F.when((fit > TOO_WIDE) & target.isNull(), "error").when(fit > TIGHT, "warning")
    return F.when((source != "") & (width > 0), F.struct(rounded(fit, 3).alias("fit"), severity.alias("severity")))


def layout_class(regions: DataFrame, *, key: str = "asset") -> DataFrame:
    """Per asset: its most likely class, confidence, the scores and what they rest on.

    Regions have ``text``, ``x``, ``h``, ``image_width``, ``image_height`` and ``excluded``. Blank and excluded regions count for
    nothing; an asset without any other has no row. Medians are the upper ones; equal scores go to the alphabet.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    words = F.regexp_count("__t", F.lit(r"(?U)\S+"))
    counted = regions.withColumn("__t", text).where((F.col("__t") != "") & ~F.coalesce("excluded", F.lit(False)))
    middle = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    wide, high = F.coalesce("image_width", F.lit(0)), F.coalesce("image_height", F.lit(0))
    anchor = rounded(F.col("x") / F.greatest(F.lit(1), F.when(wide == 0, 100).otherwise(wide)), 1)
    facts = (
        counted.withColumns({"__w": words, "__a": anchor, "__short": (F.length("__t") <= 24) & (words <= 4), "__q": F.col("__t").rlike(QUANTITY), "__share": F.when(high > 0, F.col("h") / high)})
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"), middle("__w").cast("int").alias("median_words"), F.coalesce(F.max("__share"), F.lit(0.0)).alias("height_share"),
            (F.max("h") / F.greatest(F.lit(1.0), middle("h"))).alias("hierarchy"), F.count_if("__q").alias("quantities"), F.count_if("__short").alias("short"), F.count_distinct("__a").alias("anchors"),
        )
    )
    n, short = F.col("n"), F.col("short") / F.col("n")
    grid = 1.0 - F.least(F.lit(1.0), F.col("anchors") / n)
    if_ = lambda test, value: F.when(test, value).otherwise(0.0)
    scores = {
        "billboard": F.lit(0.10) + if_(n <= 2, 0.45) + if_(F.col("height_share") >= 0.10, 0.30),
        "poster": F.lit(0.20) + if_(n >= 3, 0.30) + if_(F.col("hierarchy") >= 1.6, 0.25),
        "product_label": F.lit(0.10) + F.least(F.lit(0.60), F.col("quantities") * 0.30) + if_(n >= 3, 0.20),
        "sign": F.lit(0.45) + if_(n <= 2, 0.20) + 0.15 * short,
        "ui_graphic": F.lit(0.10) + if_((n >= 4) & (F.col("median_words") <= 3), 0.35) + 0.25 * grid + 0.15 * short,
    }
    ranked = facts.withColumn("__r", F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(k).alias("k")) for k, s in scores.items()])))
    lead = F.greatest(F.lit(0.0), F.col("__r")[1]["s"] - F.col("__r")[0]["s"])
    told = F.map_from_entries(F.transform("__r", lambda r: F.struct(r["k"], rounded(-r["s"], 3))))
    return ranked.select(
        key, F.col("__r")[0]["k"].alias("asset_class"), rounded(F.least(F.lit(0.95), 0.55 + lead * 0.5), 3).alias("confidence"), told.alias("scores"), n.alias("regions"), "median_words",
        rounded(short, 3).alias("short_ratio"), rounded("height_share", 3).alias("height_share"), rounded("hierarchy", 3).alias("hierarchy"), "quantities", rounded(grid, 3).alias("grid"),
    )


def composition(tracks: DataFrame, observations: DataFrame, keyframes: DataFrame, start: int, end: int, *, on: tuple[str, ...] = ("job", "track"), at: str = "frame") -> DataFrame:
    """The observations of frames ``start`` to ``end`` (inclusive) with their track's columns and the keyframes about them.

    Keyframes have ``value``. Only the range's frames meet tracks and keyframes; a track without keyframes has nulls.
    """
    from lumenframe.operators.store import bracket_keyframes

    on = list(on)
    ranged = observations.where(F.col(at).between(start, end))
    about = bracket_keyframes(ranged.select(*on, at).distinct(), keyframes, on, at)
    return ranged.join(tracks, on, "left").join(about, [*on, at], "left")
