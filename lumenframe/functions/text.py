"""Column functions on strings: normal forms, scripts, distances, placeholders and locale tags.

Everything is built from Spark's own functions; the few rules that need Unicode normal forms or difflib are Arrow-batched
pandas UDFs at the end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic letters and the Latin letters that look like them, in this order.
CYRILLIC_TWINS = "АВЕКМНОРСТУХЅІЈҮаеорсухѕіјԛԝ"
LATIN_TWINS = "ABEKMHOPCTYXSIJYaeopcyxsijqw"

# Marks that take a space before or after them, by locale, and the locale that a bare language stands for.
SPACED_BEFORE = {"fr-FR": "!?;:»", "fr-BE": "!?;:»", "fr-CH": "!?;:»", "fr-CA": ":»"}
SPACED_AFTER = {"fr-FR": "«", "fr-BE": "«", "fr-CH": "«", "fr-CA": "«"}
DEFAULT_LOCALE = {"fr": "fr-FR"}

#: Scripts written without spaces, by character class.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
RTL = r"[\p{IsArabic}\p{IsHebrew}]"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

# What counts as a placeholder and as a number of a translated text.
PLACEHOLDER = r"%(?:\d+\$)?[a-zA-Z]|\{[^{}\s]+\}|\$\{[^{}]+\}|\{\{\s*[^{}]+\s*\}\}|</?[A-Za-z][^>]*>"
NUMBER = r"(?U)(?<!\w)[+-]?\d+(?:[.,]\d+)*(?:%|°[CFcf])?(?!\w)"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c, places: int) -> Column:
    """Rounded as the number's binary value is, not its decimal notation: 0.5075 to three places is 0.507."""
    return F.round(as_col(c) * 10**places) / 10**places


def normalize_text(c) -> Column:
    """Letters, marks and digits only, in lower case; null stays null."""
    return F.lower(F.regexp_replace(as_col(c), r"[^\p{L}\p{M}\p{N}]+", ""))


def segment_normalize(c) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(as_col(c), r"\s+", " ")))


def skeleton(c) -> Column:
    """Cyrillic letters replaced by the Latin letters they look like; case is kept."""
    return F.translate(as_col(c), CYRILLIC_TWINS, LATIN_TWINS)


def twin_share(c) -> Column:
    """Share of letters that have a twin in the other script; 0 without letters."""
    c = as_col(c)
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    twins = F.length(F.regexp_replace(c, f"[^{CYRILLIC_TWINS}{LATIN_TWINS}]", ""))
    return F.when(c.isNotNull() & (letters > 0), twins / letters).otherwise(0.0)


def class_count(c, pattern: str) -> Column:
    return F.regexp_count(as_col(c), F.lit(pattern))


def script_counts(c) -> Column:
    """Characters of each script class, as a struct."""
    return F.struct(
        class_count(c, r"\p{IsLatin}").alias("latin"), class_count(c, r"\p{IsCyrillic}").alias("cyrillic"), class_count(c, r"\p{IsGreek}").alias("greek"),
        class_count(c, r"\p{IsHan}").alias("han"), class_count(c, r"[\p{IsHiragana}\p{IsKatakana}]").alias("kana"), class_count(c, r"\p{IsHangul}").alias("hangul"), class_count(c, RTL).alias("rtl"),
    )


def script_class(c) -> Column:
    """unspaced, rtl, spaced or neutral, by majority of the letters; ties in this order."""
    unspaced, rtl, letters = class_count(c, UNSPACED), class_count(c, RTL), class_count(c, r"\p{L}")
    spaced = letters - unspaced - rtl
    return F.when(letters == 0, "neutral").when((unspaced >= rtl) & (unspaced >= spaced), "unspaced").when(rtl >= spaced, "rtl").otherwise("spaced")


def dominant_script(c) -> Column:
    """Japanese if any kana; else the script with most characters, the first in alphabetical order of equals; null without any."""
    names = ("cyrillic", "greek", "han", "hangul", "latin", "rtl")
    counts = script_counts(c)
    ranked = F.array_sort(F.array(*[F.struct((-counts[n]).alias("n"), F.lit(n).alias("script")) for n in names]))[0]
    return F.when(counts["kana"] > 0, "japanese").when(ranked["n"] < 0, ranked["script"])


def direction(c) -> Column:
    return F.when(class_count(c, RTL) > 0, "rtl").otherwise("ltr")


def is_square_script(c) -> Column:
    """Over half the characters that aren't white space are CJK."""
    return 2 * class_count(c, CJK) > F.length(F.regexp_replace(as_col(c), r"\s", ""))


def scripts_in(c) -> Column:
    """Names of the scripts of the text, alphabetically."""
    counts = script_counts(c)
    return F.array_compact(F.array(*[F.when(counts[n] > 0, F.lit(n)) for n in ("cyrillic", "greek", "han", "hangul", "kana", "latin", "rtl")]))


def scripts_compatible(a, b) -> Column:
    """True where either set is empty, else where they share a member."""
    a, b = as_col(a), as_col(b)
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def script_pair_compatible(a, b, lang) -> Column:
    """Null if either is missing; in Japanese, han and japanese go together."""
    a, b = as_col(a), as_col(b)
    both = F.array(F.lit("japanese"), F.lit("han"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(a == b, True).when((as_col(lang) == "ja") & F.array_contains(both, a) & F.array_contains(both, b), True).otherwise(False)


def error_rate(hypothesis, reference) -> Column:
    """Character edits of the compatibility forms over the reference's length, at most 1, to four places; null for a reference without letters."""
    h, r = F.coalesce(nfkc_key(as_col(hypothesis)), F.lit("")), F.coalesce(nfkc_key(as_col(reference)), F.lit(""))
    return F.when(F.length(r) > 0, rounded(F.least(F.lit(1.0), F.levenshtein(h, r) / F.length(r)), 4))


def word_error_rate(hypothesis, reference) -> Column:
    """The same over words, for references in scripts that are written with spaces; null for others."""
    r = as_col(reference)
    spaced = r.rlike(r"\p{L}") & ~r.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]")
    counted = word_edits(as_col(hypothesis), r)
    return F.when(spaced & (counted["words"] > 0), rounded(F.least(F.lit(1.0), counted["edits"] / counted["words"]), 4))


def normalized_edit(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


def base_language(c) -> Column:
    return F.lower(F.split(as_col(c), "-")[0])


def locale_ladder(c) -> Column:
    """a-b-c gives [a-b-c, a-b, a]."""
    parts = F.split(as_col(c), "-")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))


def multiset(c, pattern: str) -> Column:
    return F.array_sort(F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(0)))


def placeholders(c) -> Column:
    return multiset(c, PLACEHOLDER)


def numbers(c) -> Column:
    return multiset(c, NUMBER)


def expansion_ratio(source, target) -> Column:
    """Trimmed target length over trimmed source length (1 at least)."""
    return F.length(F.trim(as_col(target))) / F.greatest(F.lit(1), F.length(F.trim(as_col(source))))


def validation(source, target, missed=None) -> Column:
    """A translation's issues (code, severity), eligible (no error among them) and review_required (any); ``missed`` is the number of glossary terms it lacks."""
    source, target = (F.coalesce(as_col(c), F.lit("")) for c in (source, target))
    plain = lambda c: F.lower(F.trim(c))
    ratio = expansion_ratio(source, target)
    rules = [
        (placeholders(source) != placeholders(target), "placeholder_mismatch", "error"), (numbers(source) != numbers(target), "number_mismatch", "error"), (F.trim(target) == "", "empty_target", "error"),
        ((plain(source) != "") & (plain(source) == plain(target)), "source_identical", "review"), ((ratio > 2.5) | (ratio < 0.25), "expansion_risk", "review"),
    ]
    if missed is not None:
        rules.append((F.coalesce(as_col(missed), F.lit(0)) > 0, "glossary_violation", "error"))
    issues = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for on, code, severity in rules]))
    bound = F.transform(F.array(issues), lambda i: F.struct(i.alias("issues"), (~F.exists(i, lambda x: x["severity"] == "error")).alias("eligible"), (F.size(i) > 0).alias("review_required"), rounded(ratio, 4).alias("length_ratio")))
    return bound[0]


def clean_cell(c) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"(?U)\s+", " "))


def locale_tag(c) -> Column:
    """Language in lower case, subtags of two or three letters in upper case, joined by hyphens."""
    parts = F.split(F.replace(F.trim(F.coalesce(as_col(c), F.lit(""))), F.lit("_"), F.lit("-")), "-")
    rest = F.transform(F.slice(parts, 2, 99), lambda p: F.when(F.length(p).isin(2, 3), F.upper(p)).otherwise(p))
    return F.array_join(F.concat(F.array(F.lower(parts[0])), rest), "-")


def joined_runs(parts) -> Column:
    """Texts put together with a space, but for seams between two characters of scripts without spaces."""
    pieces = F.filter(F.transform(as_col(parts), lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != "")

    def add(text, piece):
        tight = F.substring(text, -1, 1).rlike(f"^{UNSPACED}$") & F.substring(piece, 1, 1).rlike(f"^{UNSPACED}$")
        return F.when(text == "", piece).otherwise(F.concat(text, F.when(tight, "").otherwise(" "), piece))

    return F.aggregate(pieces, F.lit(""), add)


def restored_cyrillic(c) -> Column:
    """Latin look-alikes back to Cyrillic in words that hold a Cyrillic letter, where the text has one without a Latin twin."""
    c = as_col(c)
    sure = F.regexp_replace(c, f"[{CYRILLIC_TWINS}]", "").rlike(r"\p{IsCyrillic}")
    tokens = F.regexp_extract_all(c, F.lit(r"\s+|\S+"), F.lit(0))
    back = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"\p{IsCyrillic}"), F.translate(t, LATIN_TWINS, CYRILLIC_TWINS)).otherwise(t)), "")
    return F.when(sure, back).otherwise(c)


def agreement_form(c, language=None) -> Column:
    """Compatibility form with white space collapsed, in lower case but for Chinese, Japanese and Korean."""
    spaced = F.trim(F.regexp_replace(nfkc(F.coalesce(as_col(c), F.lit(""))), r"(?U)\s+", " "))
    keep = F.lit(False) if language is None else F.lower(F.coalesce(as_col(language), F.lit(""))).rlike("^(ja|zh|ko)")
    return F.when(keep, spaced).otherwise(F.lower(spaced))


def pared_ratio(a, b) -> Column:
    """Ratio of matching blocks of the normal forms of both texts' Latin skeletons."""
    return fuzzy_ratio(normalize_text(skeleton(a)), normalize_text(skeleton(b)))


def earliest_text(steps, original, history) -> Column:
    """What was read first: the first step's original, the correction's, else the first text of the history."""
    told = lambda c: F.when(c != "", c)
    steps, history = as_col(steps), as_col(history)
    first = F.try_element_at(F.filter(F.transform(history, lambda h: h["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(1))
    return F.coalesce(told(F.try_element_at(steps, F.lit(1))["original_text"]), told(as_col(original)), first)


def text_density(w, h, text) -> Column:
    """Pixels a character along the longer side; null without a text or a box."""
    n = F.length(F.trim(as_col(text)))
    w, h = as_col(w), as_col(h)
    return F.when((n > 0) & (w > 0) & (h > 0), F.greatest(w, h) / n)


def box_note(c) -> Column:
    """The numbers of a note "bbox: x, y, w, h" as a struct, null without one."""
    pattern = r"(?i)\bbbox\s*:\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    part = lambda i: F.regexp_extract(as_col(c), pattern, i).cast("int")
    return F.when(as_col(c).rlike(pattern), F.struct(*[part(i + 1).alias(k) for i, k in enumerate("xywh")]))


def payload_checksum(c) -> Column:
    """SHA-256 of a JSON text with sorted keys and no spaces."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(as_col(c)), 256))


def xml_escape(c) -> Column:
    return F.replace(F.replace(F.replace(as_col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def resolve_locale(region, asset=None) -> Column:
    """The region's locale; one without a country takes the asset's of the same language, else its language's default. Null without any."""
    own, lent = _locale_parts(region), _locale_parts(F.lit(None).cast("string") if asset is None else asset)
    first = F.when(own["base"] != "", own).otherwise(lent)
    known = F.create_map(*[F.lit(x) for kv in DEFAULT_LOCALE.items() for x in kv])
    country = F.coalesce(first["country"], F.when(lent["base"] == first["base"], lent["country"]))
    return F.when(first["base"] != "", F.when(country.isNotNull(), F.concat_ws("-", first["base"], country)).otherwise(F.try_element_at(known, first["base"])))


def _locale_parts(c) -> Column:
    parts = F.split(F.replace(F.trim(F.coalesce(as_col(c), F.lit(""))), F.lit("_"), F.lit("-")), "-")
    countries = F.filter(F.slice(parts, 2, 9), lambda p: p.rlike(r"^\p{L}{2}$"))
    return F.struct(F.lower(parts[0]).alias("base"), F.upper(F.try_element_at(countries, F.lit(1))).alias("country"))


def punctuation_spacing(c, locale) -> Column:
    """A locale's space before a run of its marks that ends a token, and after its opening marks; other locales leave the text alone."""
    c, locale, out = as_col(c), as_col(locale), as_col(c)
    for name in sorted(SPACED_BEFORE):
        spaced = F.regexp_replace(c, rf"(?U)(\S)([{SPACED_BEFORE[name]}]+)(?=\s|$)", "$1 $2")
        spaced = F.regexp_replace(spaced, rf"(?U)([{SPACED_AFTER[name]}])(\S)", "$1 $2")
        out = F.when(locale == name, spaced).otherwise(out)
    return out


def source_hash(c) -> Column:
    return F.sha2(F.replace(as_col(c), F.lit("\r\n"), F.lit("\n")), 256)


def membership_hash(ids, text, schema: int = 1) -> Column:
    """SHA-256 over a schema number, the ids and the text's composed form."""
    return F.sha2(F.concat_ws("␟", F.lit(str(schema)), F.array_join(as_col(ids), "␞"), nfc_trimmed(F.coalesce(as_col(text), F.lit("")))), 256)


def candidate_id(image, stage, geometry, parents=None, salt="", run_kind="production") -> Column:
    """Stage prefix and twelve digits of a SHA-1 over image, stage, run, geometry to two places, sorted parents and salt."""
    stage = as_col(stage)
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    above = F.array_join(F.array_sort(F.coalesce(as_col(parents), F.array().cast("array<string>"))), ",") if parents is not None else F.lit("")
    key = F.concat_ws("|", as_col(image), stage, lit(run_kind), two_places(as_col(geometry).cast("array<double>")), above, lit(salt))
    return F.concat(F.substring(stage, 1, 4), F.lit("-"), F.substring(F.sha1(key), 1, 12))


def detector_fingerprint(*settings) -> Column:
    """Ten digits of a SHA-1 over the settings."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(as_col(x).cast("string"), F.lit("")) for x in settings])), 1, 10)


def lm_tokens(c, family: str = "latin") -> Column:
    """Words in lower case and signs, each a token of its own; of the family ``cjk`` every character."""
    c = F.coalesce(as_col(c), F.lit(""))
    if family == "cjk":
        return F.regexp_extract_all(c, F.lit(r"(?U)\S"), F.lit(0))
    folded = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.filter(F.split(F.regexp_replace(folded, r"(?U)([^\p{L}\p{N}\s])", " $1 "), r"(?U)\s+"), lambda t: t != "")


def bidi_variants(c) -> Column:
    """The text and, for right-to-left scripts, its words in reverse order."""
    c = as_col(c)
    back = F.array_join(F.reverse(F.split(c, " ")), " ")
    return F.when(class_count(c, RTL) > 0, F.array_distinct(F.array(c, back))).otherwise(F.array(c))


def ordered_distinct(c) -> Column:
    """White-space separated words, first occurrences in order."""
    return F.array_distinct(F.filter(F.split(as_col(c), r"\s+"), lambda t: t != ""))


def atom_kind(c) -> Column:
    c = as_col(c)
    return F.when(c.rlike(r"^[\p{N}.,:/%+-]*\p{N}[\p{N}.,:/%+-]*$"), "numeric").when(c.rlike(r"^[^\p{L}\p{M}\p{N}]+$"), "punctuation").when(c.rlike(r"\s"), "phrase").otherwise("word")


def humanise(flag, labels: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in (labels or {}).items() for x in kv]) if labels else None
    plain = F.replace(as_col(flag), F.lit("_"), F.lit(" "))
    return F.coalesce(known[as_col(flag)], plain) if known is not None else plain


def style_fingerprint(weight, italic, colour) -> Column:
    return F.concat_ws("|", F.coalesce(as_col(weight).cast("string"), F.lit("")), F.coalesce(as_col(italic).cast("string"), F.lit("")), F.coalesce(as_col(colour), F.lit("")))


def em_width(c) -> Column:
    """Wide characters count 1, combining marks 0, all others a half."""
    c = as_col(c)
    wide = class_count(c, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}！-｠]")
    return wide + (F.length(c) - wide - class_count(c, r"\p{M}")) * 0.5


def json_array(c) -> Column:
    """A JSON array of strings; bad JSON gives an empty one."""
    return F.coalesce(F.from_json(as_col(c), "array<string>"), F.array().cast("array<string>"))


def stopword_scores(c, lexicon: dict[str, tuple[str, str]]) -> Column:
    """Per language (stopwords, marks): two for each stopword, one for each mark; an array of structs, best first."""
    words = F.split(F.lower(as_col(c)), r"[^\p{L}]+")
    out = []

    def count(stop: str) -> Column:
        known = F.array(*map(F.lit, stop.split()))
        return F.size(F.filter(words, lambda w: F.array_contains(known, w)))

    for lang, (stop, marks) in sorted(lexicon.items()):
        hits = count(stop)
        out.append(F.struct((-(2 * hits + (class_count(F.lower(as_col(c)), f"[{marks}]") if marks else F.lit(0)))).alias("score"), F.lit(lang).alias("lang")))
    return F.array_sort(F.array(*out))


# Rules without a native form.


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, 0 if either is blank or null; the order of the arguments matters."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def best_span_ratio(needle: pd.Series, text: pd.Series) -> pd.Series:
    """The best ratio of any window of the text as long as the needle."""
    from difflib import SequenceMatcher

    def best(x, y):
        if not x or not y:
            return 0.0
        n = min(len(x), len(y))
        return max(SequenceMatcher(None, x, y[i : i + n]).ratio() for i in range(len(y) - n + 1))

    return pd.Series([best(x, y) for x, y in zip(needle, text)])


@F.pandas_udf(T.StringType())
def nfkc_key(c: pd.Series) -> pd.Series:
    """Compatibility form without tatweel and signs, case-folded."""
    import re
    import unicodedata

    def key(x):
        return None if x is None else re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", x).replace("ـ", "")).casefold()

    return c.map(key, na_action="ignore")


@F.pandas_udf(T.StringType())
def accent_fold(c: pd.Series) -> pd.Series:
    """Case-folded, without combining marks."""
    import unicodedata

    def fold(x):
        return "".join(ch for ch in unicodedata.normalize("NFD", x.casefold()) if not unicodedata.combining(ch))

    return c.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_word(c: pd.Series) -> pd.Series:
    """Compatibility form without signs; case and composed marks stay."""
    import re
    import unicodedata

    return c.map(lambda x: None if x is None else re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", x)), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc_trimmed(c: pd.Series) -> pd.Series:
    import unicodedata

    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.strip()), na_action="ignore")


@F.pandas_udf(T.StringType())
def two_places(c: pd.Series) -> pd.Series:
    """Numbers to two places, comma-joined, rounded as their exact binary values are."""
    return c.map(lambda xs: None if xs is None else ",".join(f"{x:.2f}" for x in xs), na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("edits", T.LongType()), T.StructField("words", T.LongType())]))
def word_edits(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Word edits from the reference, and its number of words, of compatibility forms without tatweel, case-folded."""
    import unicodedata

    def words(x):
        return unicodedata.normalize("NFKC", x or "").replace("ـ", "").casefold().split()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        return row[-1]

    pairs = [(words(h), words(r)) for h, r in zip(hypothesis, reference)]
    return pd.DataFrame({"edits": [edits(r, h) for h, r in pairs], "words": [len(r) for _, r in pairs]})


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    import unicodedata

    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_json(c: pd.Series) -> pd.Series:
    """Sorted keys, no spaces; null for what is no JSON."""
    import json

    def canonical(x):
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return c.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def han_variant(c: pd.Series) -> pd.Series:
    """Hans, Hant, mixed or undetermined, by characters that only one of the two national character sets has."""

    def has(x, charset):
        try:
            x.encode(charset)
            return True
        except UnicodeEncodeError:
            return False

    def variant(x):
        han = [ch for ch in x or "" if "\u3400" <= ch <= "\u9fff"]
        simple = any(has(ch, "gb2312") and not has(ch, "big5") for ch in han)
        full = any(has(ch, "big5") and not has(ch, "gb2312") for ch in han)
        return "mixed" if simple and full else "Hans" if simple else "Hant" if full else "undetermined"

    return c.map(variant)
