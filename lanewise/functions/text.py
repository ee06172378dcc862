"""Text projections: excerpts, features, hashes, language and tokens, as Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits, patterns and stop words.
MAX_EXCERPT_CHARS = 4000
PRIOR_TURNS = 2
ROUTED_ROLES = ("user", "assistant")
CODE_FENCE = r"```"
INLINE_CODE = r"`[^`\n]{1,}`"
URL = r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s<>\"']+"
STACK_FRAME = r"(?m)(?:at\s+[\w.$<>]+\s*\([^)]*\)|File\s+\"[^\"]+\",\s+line\s+\d+|^\s*#\d+\s+0x[0-9a-f]+)"
DIFF_LINE = r"(?m)^(?:[+-]{3}\s|@@\s|[-+](?!---|\+\+))"
JSONISH = r"(?s)^\s*[\[{].*[\]}]\s*$"
WORD = r"(?U)[^\W\d_]+"
SENTENCE_END = r"[.!?]+\s"
STOP_WORDS = {
    "en": ("the", "and", "is", "of", "to", "you", "that", "it", "for", "with"),
    "de": ("der", "die", "und", "ist", "nicht", "sie", "mit", "auf", "für", "ein"),
    "fr": ("le", "la", "et", "est", "des", "une", "pour", "avec", "dans", "vous"),
    "es": ("el", "la", "que", "de", "y", "no", "un", "por", "con", "para"),
    "it": ("il", "che", "di", "e", "la", "non", "per", "un", "con", "sono"),
    "pt": ("o", "que", "de", "e", "não", "um", "para", "com", "os", "por"),
    "hu": ("a", "az", "és", "hogy", "nem", "egy", "meg", "van", "már", "kell"),
    "nl": ("de", "het", "en", "een", "van", "is", "dat", "niet", "voor", "met"),
}


def strip(text: Column) -> Column:
    """White space off both ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def excerpt_text(text: Column, max_chars: int = MAX_EXCERPT_CHARS) -> Column:
    return F.substring(strip(F.coalesce(text, F.lit(""))), 1, max_chars)


def flatten_parts(parts: Column) -> Column:
    """Plain text of array<struct<type,text>> content: other parts show as ``[type]``."""
    flat = F.transform(
        parts, lambda p: F.when((p["type"] == "text") & p["text"].isNotNull(), p["text"]).otherwise(F.concat(F.lit("["), F.coalesce(p["type"], F.lit("non-text")), F.lit("]")))
    )
    return F.array_join(F.filter(flat, lambda s: s != ""), "\n")


def excerpt_messages(messages: Column, max_chars: int = MAX_EXCERPT_CHARS, prior_turns: int = PRIOR_TURNS, system: bool = False) -> Column:
    """Excerpt of array<struct<role,content>>: newest first within the budget, shown oldest first.

    A fold from the newest message: user turns are counted, and each text takes what is left.
    """
    roles = [*ROUTED_ROLES, *(["system"] if system else [])]
    said = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("text")))
    said = F.reverse(F.filter(said, lambda m: m["role"].isin(*roles) & (m["text"] != "")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("turns"), F.lit(max_chars).alias("left"), F.lit(False).alias("over"))

    def step(s: Column, m: Column) -> Column:
        turns = s["turns"] + F.when(m["role"] == "user", 1).otherwise(0)
        over = s["over"] | (turns > prior_turns + 1) | (s["left"] <= 0)
        piece = F.substr(m["text"], F.lit(1), s["left"])
        joined = F.when(s["out"] == "", piece).otherwise(F.concat(piece, F.lit("\n\n"), s["out"]))
        return F.struct(
            F.when(over, s["out"]).otherwise(joined).alias("out"),
            turns.alias("turns"),
            F.when(over, s["left"]).otherwise(s["left"] - F.length(piece)).alias("left"),
            over.alias("over"),
        )

    return F.substring(F.coalesce(F.aggregate(said, start, step, lambda s: s["out"]), F.lit("")), 1, max_chars)


def hash_text(text: Column, salt: str = "") -> Column:
    """First 16 hex digits of sha256(salt, NUL, text)."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\x00"), text), 256), 1, 16)


def words(text: Column) -> Column:
    """Lower-case words of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


#: Takes the stop words of all languages out of a lower-case text in one pass.
_ANY_STOP = "|".join(sorted({w for stops in STOP_WORDS.values() for w in stops}, key=lambda w: (-len(w), w)))
_STOPS = rf"(?U)(?<![\w&&[^\d_]])(?:{_ANY_STOP})(?![\w&&[^\d_]])"


def detect_language(text: Column) -> Column:
    """Language with the most stop words (the first of equals); ``und`` when there are too few."""
    low = F.lower(text)
    stops = F.regexp_extract_all(low, F.lit(_STOPS), F.lit(0))
    return F.element_at(F.transform(F.array(F.struct(stops.alias("w"), F.regexp_count(low, F.lit(WORD)).alias("n"))), _language_of), 1)


def _language_of(found: Column) -> Column:
    # a list of more than ten literals is looked up by hash; no word is empty
    hits = lambda stops: F.size(F.filter(found["w"], lambda w: w.isin(*stops, "")))
    counts = F.array(*[hits(stops) for stops in STOP_WORDS.values()])
    best = F.element_at(F.transform(F.array(counts), lambda c: F.struct(F.array_max(c).alias("n"), F.array_position(c, F.array_max(c)).cast("int").alias("at"))), 1)
    return _named(found["n"], best["n"], F.element_at(F.array(*[F.lit(x) for x in STOP_WORDS]), best["at"]))


def _named(words: Column, best: Column, name: Column) -> Column:
    return F.when((words >= 4) & (best >= F.greatest(F.lit(2), F.floor(words / 40).cast("int"))), name).otherwise("und")


def with_language(df: DataFrame, text: str, name: str) -> DataFrame:
    """``detect_language`` in columns of their own, so that nothing is counted twice and all stays in generated code."""
    df = df.withColumn("_low", F.lower(text))
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all("_low", F.lit(_STOPS), F.lit(0)), "  "), F.lit(" "))
    df = df.withColumns({"_spaced": spaced, "_letters": F.regexp_count("_low", F.lit(WORD))})
    df = df.withColumns({f"_in_{x}": F.regexp_count("_spaced", F.lit(f" (?:{'|'.join(stops)}) ")) for x, stops in STOP_WORDS.items()})
    df = df.withColumn("_best", F.greatest(*[f"_in_{x}" for x in STOP_WORDS]))
    first = F.lit("und")
    for x in reversed(STOP_WORDS):
        first = F.when(F.col(f"_in_{x}") == F.col("_best"), x).otherwise(first)
    df = df.withColumn(name, _named(F.col("_letters"), F.col("_best"), first))
    return df.drop("_low", "_spaced", "_letters", "_best", *[f"_in_{x}" for x in STOP_WORDS])


def _share(text: Column, pattern: str) -> Column:
    """Characters that match ``pattern``; patterns match runs, so that a run is replaced at once."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(text: Column, messages: Column | None = None) -> Column:
    """The text-free description of a request as one struct."""
    found, letters = F.regexp_count(text, F.lit(r"(?U)\S+")), _share(text, r"\p{L}+")
    return _features(text, messages, found, letters, strip(text), detect_language(text))


def with_features(df: DataFrame, text: str, name: str = "features", messages: str | None = None) -> DataFrame:
    """Adds ``features`` of a column, with what several of them need in columns of their own."""
    t = F.col(text)
    df = with_language(df, text, "_lang").withColumns({"_found": F.regexp_count(t, F.lit(r"(?U)\S+")), "_letter_count": _share(t, r"\p{L}+"), "_trimmed": strip(t)})
    whole = _features(t, F.col(messages) if messages else None, F.col("_found"), F.col("_letter_count"), F.col("_trimmed"), F.col("_lang"))
    return df.withColumn(name, whole).drop("_lang", "_found", "_letter_count", "_trimmed")


def _features(text: Column, messages: Column | None, found: Column, letters: Column, trimmed: Column, language: Column) -> Column:
    n = F.length(text)
    upper = _share(text, r"\p{Lu}+")
    ratio = lambda part, whole, places=4: F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), places)
    if messages is None:
        n_messages, prior, tools = F.when(n > 0, 1).otherwise(0), F.lit(0), F.lit(False)
    else:
        n_messages = F.size(messages)
        prior = F.greatest(F.lit(0), F.size(F.filter(messages, lambda m: m["role"] == "user")) - 1)
        tools = F.exists(messages, lambda m: F.coalesce(m["role"], F.lit("")).isin("tool", "function"))
    return F.struct(
        n.alias("char_len"),
        found.alias("word_count"),
        F.when(n > 0, F.regexp_count(text, F.lit("\n")) + 1).otherwise(0).alias("line_count"),
        # pieces between sentence ends that hold more than white space
        F.regexp_count(F.regexp_replace(F.translate(text, "\x01", "x"), SENTENCE_END, "\x01"), F.lit("(?U)[^\\x01\\s][^\\x01]*")).alias("sentence_count"),
        ratio(_share(text, r"(?U)\S+"), found, 3).alias("mean_word_len"),
        ratio(_share(text, r"\p{Nd}+"), n).alias("digit_ratio"),
        ratio(upper, F.greatest(letters, F.lit(1))).alias("upper_ratio"),
        ratio(_share(text, r"(?U)[^\p{L}\p{N}\s]+"), n).alias("punct_ratio"),
        ratio(_share(text, r"[^\x00-\x7F]+"), n).alias("non_ascii_ratio"),
        F.floor(F.regexp_count(text, F.lit(CODE_FENCE)) / 2).cast("int").alias("code_blocks"),
        F.regexp_count(text, F.lit(INLINE_CODE)).alias("inline_code_spans"),
        F.regexp_count(text, F.lit(URL)).alias("urls"),
        F.regexp_count(text, F.lit(r"\?")).alias("question_marks"),
        F.regexp_count(text, F.lit("!")).alias("exclamations"),
        text.rlike(STACK_FRAME).alias("has_stack_trace"),
        text.rlike(DIFF_LINE).alias("has_diff"),
        ((trimmed != "") & trimmed.rlike(JSONISH)).alias("has_json"),
        language.alias("lang"),
        n_messages.alias("n_messages"),
        prior.alias("n_prior_turns"),
        tools.alias("tool_output_present"),
    )


def normalized(text: Column) -> Column:
    """NFKC, case folding and single spaces.  ASCII rows stay in the JVM; others take an Arrow UDF."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(text.rlike(r"[^\x00-\x7F]"), _normalize(text)).otherwise(plain)


@F.pandas_udf(StringType())
def _normalize(texts):
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def token_list(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(r"(?U)\w+"), F.lit(0))


def token_set(normal: Column) -> Column:
    return F.array_distinct(token_list(normal))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def tokens(text: Column, bigrams: bool = True) -> Column:
    """Lower-case tokens of at least two characters (or a digit), then ``a_b`` bigrams."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W_]+"), F.lit(0))
    one = F.filter(found, lambda w: (F.length(w) >= 2) | w.rlike(r"^\p{Nd}$"))
    if not bigrams:
        return one

    def pairs(w: Column) -> Column:
        after = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), F.size(after)), after, lambda a, b: F.concat(a, F.lit("_"), b)))

    return F.element_at(F.transform(F.array(one), pairs), 1)


def head_tail(text: Column, budget: int, marker: str = "...") -> Column:
    """First and last words within ``budget`` words, a marker between them."""
    parts = F.split(strip(text), r"\s+")
    head = (budget + 1) // 2
    cut = F.concat(F.slice(parts, 1, head), F.array(F.lit(marker)), F.slice(parts, -(budget - head), budget - head) if budget > head else F.array().cast("array<string>"))
    return F.when(F.size(parts) <= budget, F.array_join(parts, " ")).otherwise(F.array_join(cut, " "))


def sample_hit(key: Column, rate: float) -> Column:
    """Deterministic sampling: the first 32 bits of sha256(key) below ``rate``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) < rate


def split_bucket(key: Column, salt: str | None = "lanewise-split") -> Column:
    """A number in [0, 1) from the first 48 bits of sha256(salt, NUL, key); no salt, only the key."""
    body = key if salt is None else F.concat(F.lit(salt), F.lit("\x00"), key)
    return F.conv(F.substring(F.sha2(body, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
