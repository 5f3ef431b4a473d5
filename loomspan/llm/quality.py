"""Operator 9, quality rules: base counts of a text, then the divergence of its histograms from language references.

Only DataFrame functions run over the rows: no Python, Arrow or RDD code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Table, quoted

#: Frequent words of each language that has a reference, the most frequent first.
COMMON = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by", "be"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "dans", "qui", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "una", "su"),
}
SPACES = r"[\x20\x09-\x0D]+"
#: Character classes by name: a-z is what the others leave. ``script`` holds letters of other scripts than the Latin one.
_IN = {
    "upper": r"A-Z",
    "digit": r"0-9",
    "punct": r".,;:!?'\"()\-",
    "symbol": r"#*$%&|<>@=+_/\\~^\[\]{}`",
    "accent": r"\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
    "script": r"\x{0370}-\x{1DFF}\x{1F00}-\x{1FFF}\x{2C00}-\x{2DFF}\x{2E80}-\x{D7FF}\x{F900}-\x{FDFF}\x{FE70}-\x{FEFF}\x{FF66}-\x{FFDC}\x{10000}-\x{1EFFF}\x{20000}-\x{3FFFF}",
}
PATTERNS = {name: f"[{chars}]" for name, chars in _IN.items()} | {"other": r"[^a-z\x20\x09-\x0D" + "".join(_IN.values()) + "]"}
CLASSES = ("lower", "space", *PATTERNS)
#: What of ``other`` is ASCII.
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F]"
#: Shares of a language's characters in the order of CLASSES, as plain prose has them.
CHARS = {
    "en": (0.785, 0.166, 0.020, 0.004, 0.024, 0.001, 0.0, 0.0, 0.0),
    "de": (0.765, 0.155, 0.020, 0.004, 0.023, 0.001, 0.032, 0.0, 0.0),
    "fr": (0.725, 0.166, 0.018, 0.004, 0.024, 0.001, 0.062, 0.0, 0.0),
    "es": (0.735, 0.163, 0.018, 0.004, 0.024, 0.001, 0.055, 0.0, 0.0),
}
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A text whose words are to less than this share among a language's common ones isn't taken for that language.
MIN_COMMON_PERCENT = 8


def zipf_shares(n: int, first: float = 0.063, power: float = 0.85) -> tuple[float, ...]:
    """Shares of the n most frequent words of a language, and the rest: the k-th has ``first`` / k^``power``."""
    shares = [first / k**power for k in range(1, n + 1)]
    return (*shares, 1 - sum(shares))


#: language: (shares of CLASSES, shares of its common words and the rest). None is for texts in no language known here.
REFERENCES: dict[str | None, tuple[tuple[float, ...], tuple[float, ...] | None]] = {
    **{lang: (CHARS[lang], zipf_shares(len(words))) for lang, words in COMMON.items()},
    None: (tuple(sum(x) / len(CHARS) for x in zip(*CHARS.values(), strict=True)), None),
}


def _forms(word: str) -> list[str]:
    return [f + end for f in dict.fromkeys((word, word.capitalize())) for end in ("", ",", ".")]


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts of the contract, ``base_failed`` and what later steps count from (``_t``, ``_rest``, ``_words``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", F.btrim(t, F.lit(ASCII_SPACE)))
    df = df.withColumn("_rest", F.regexp_replace("_t", "[a-z ]+", ""))  # all other characters, which are counted in it
    df = df.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_words", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", SPACES, -1)))
    n = F.size("_words")
    w = F.col("_words")
    # Windows' hashes by doubling: words 1, then 2, then 2 + 2 + 1, which reads half as many array elements.
    df = df.withColumn("_h1", F.when(n >= WINDOW, F.transform(w, lambda x: F.xxhash64(x))))
    df = df.withColumn("_h2", F.transform("_h1", lambda x, i: F.xxhash64(x, F.get("_h1", i + 1))))
    windows = F.transform("_h2", lambda x, i: F.xxhash64(x, F.get("_h2", i + 2), F.get("_h1", i + 4)))
    df = df.withColumn("_h", F.slice(windows, 1, n - (WINDOW - 1)))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_pairs", F.when(F.col("_h").isNotNull() & twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_pairs")
    beside = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_twice", F.filter(p, lambda x, k: beside(x, k - 1) | beside(x, k + 1)))
    df = df.withColumn("_starts", F.sort_array(F.transform("_twice", lambda x: x["i"])))
    s = F.col("_starts")
    covered = F.aggregate(
        F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_rest", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_lines", "_h", "_h1", "_h2", "_pairs", "_twice", "_starts")


def histograms(df: DataFrame) -> DataFrame:
    """Adds ``_lang`` (the language whose common words the text has most of, null if too few of any), ``_counts`` (characters
    by class), ``_chars`` and ``_common`` (shares)."""
    every = sorted({f for words in COMMON.values() for w in words for f in _forms(w)})
    df = df.withColumn("_some", F.transform(F.filter("_words", lambda x: x.isin(every)), lambda x: F.lower(F.rtrim(x, F.lit(",.")))))
    among = lambda words: F.size(F.filter("_some", lambda x: x.isin(list(words))))
    df = df.withColumns({f"_n_{lang}": among(words) for lang, words in COMMON.items()})
    most = F.greatest(*[F.col(f"_n_{lang}") for lang in COMMON])
    enough = 100 * most >= MIN_COMMON_PERCENT * F.greatest(F.col("n_words"), F.lit(1))
    df = df.withColumn("_lang", F.coalesce(*[F.when(enough & (F.col(f"_n_{lang}") == most), F.lit(lang)) for lang in COMMON]))
    count = lambda w: F.size(F.filter("_some", lambda x: x == w))
    bins = F.when(F.lit(False), F.array(F.lit(0)))
    for lang, words in COMMON.items():
        bins = bins.when(F.col("_lang") == lang, F.array(*[count(w) for w in words]))
    size = F.length("_t")
    df = df.withColumn("_wide", F.regexp_replace("_rest", r"[\x00-\x7F]+", ""))
    wide = ("accent", "script")
    found = {name: F.regexp_count("_wide" if name in wide else "_rest", F.lit(PATTERNS[name])) for name in _IN}
    found["other"] = F.length("_wide") - found["accent"] - found["script"] + F.regexp_count("_rest", F.lit(CONTROL))
    df = df.withColumns({"_bins": bins, "_found": F.array(*[(size - F.col("word_chars")).cast("long"), *[c.cast("long") for c in found.values()]])})
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    df = df.withColumn("_counts", F.concat(F.array(size - total(F.col("_found"))), F.col("_found")))
    n, size = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.length("_t"), F.lit(1))
    shares = F.transform("_counts", lambda x: x / size)
    common = F.concat(F.transform("_bins", lambda x: x / n), F.array((F.col("n_words") - total(F.col("_bins"))) / n))
    return df.withColumns({"_chars": shares, "_common": common}).drop("_some", "_bins", "_found", "_wide", *[f"_n_{lang}" for lang in COMMON])


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (root of the divergence, base 2: 0 to 1) of two arrays of shares."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x)), F.lit(0.0), lambda a, x: a + x) / 2))


def fit_references(accepted: DataFrame, *, min_words: int = 50, text: str = "text") -> dict:
    """References of accepted texts, to be given to ``quality_rules``: the mean histograms by language of those that pass the
    base rules and have ``min_words`` words. All of ``accepted`` count; the driver gets one row a language of COMMON."""
    df = histograms(base_counts(accepted.select(F.col(quoted(text)).alias("_text")), "_text"))
    # Written, as a filter would otherwise be moved below the projections and count everything again.
    df = Table(df.select("base_failed", "n_words", "_lang", "_chars", "_common"), "histograms").read()
    df = df.where(~F.col("base_failed") & (F.col("n_words") >= min_words) & F.col("_lang").isNotNull())
    mean = lambda c, n: F.array(*[F.avg(F.col(c)[i]) for i in range(n)])
    sizes = len(CLASSES), max(map(len, COMMON.values())) + 1
    rows = df.groupBy("_lang").agg(mean("_chars", sizes[0]).alias("chars"), mean("_common", sizes[1]).alias("words")).collect()
    found = {r["_lang"]: (tuple(r["chars"]), tuple(x for x in r["words"] if x is not None)) for r in rows}
    every = [chars for chars, _ in found.values()] or list(CHARS.values())
    return {**REFERENCES, **found, None: (tuple(sum(x) / len(every) for x in zip(*every, strict=True)), None)}


def quality_rules(docs: DataFrame, carry: list[str] | None = None, *, min_words: int = 50, max_char_distance: float = 0.17, max_word_distance: float = 0.35, references: dict = REFERENCES, text: str = "text") -> DataFrame:
    """Judges every row of ``docs``, by itself: one pass without a shuffle.

    Returns the columns ``carry`` (all by default) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance and kept. A text that has passed the base rules and has at least
    ``min_words`` words is compared with the reference of the language of which it has the most common words: its character
    classes must be within ``max_char_distance`` and its common words within ``max_word_distance`` (Jensen-Shannon). A text
    that has too few common words of any language is compared by its character classes with their mean only; a text of
    which most characters are letters of another script has no reference and is kept, as are shorter texts, whose histograms would be noise.

    Null, empty or blank text: no words, so base_failed. Repeated rows are judged alike, an empty table gives an empty
    one. Columns of ``docs`` named as a result column are replaced by it; others may have any name. A text's words and
    their hashes are arrays of its row, about 250 bytes a word in the executor's heap, so texts of some 20 MB fit a
    task with a gigabyte.
    """
    carry = docs.columns if carry is None else carry
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keep = [c for c in carry if c not in {*made, "kept", "char_distance", "word_distance"}]
    df = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], F.col(quoted(text)).alias("_text"))
    df = histograms(base_counts(df, "_text"))
    pick = lambda k: [F.when(F.col("_lang").eqNullSafe(F.lit(lang)), F.array(*map(F.lit, ref[k]))) for lang, ref in references.items() if ref[k]]
    long = ~F.col("base_failed") & (F.col("n_words") >= min_words)
    foreign = 2 * F.col("_counts")[CLASSES.index("script")] > F.col("word_chars")
    df = df.withColumns({"_judged": long & ~foreign, "_r_chars": F.coalesce(*pick(0)), "_r_common": F.coalesce(*pick(1))})
    far = lambda p, q: F.when(F.col("_judged") & F.col(q).isNotNull(), jensen_shannon(F.col(p), F.col(q)))
    # The row's number keeps filters above this projection: below it they would count everything a second time.
    df = df.select(*[f"c{i}" for i in range(len(keep))], *made, far("_chars", "_r_chars").alias("_far_chars"), far("_common", "_r_common").alias("_far_words"), F.monotonically_increasing_id().alias("_row"))
    near = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(True))
    kept = ~F.col("base_failed") & near("_far_chars", max_char_distance) & near("_far_words", max_word_distance) & (F.col("_row") >= 0)
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *made, F.col("_far_chars").alias("char_distance"), F.col("_far_words").alias("word_distance"), kept.alias("kept"))


def quality_sql(min_words: int = 50, max_char_distance: float = 0.17, max_word_distance: float = 0.35) -> str:
    """DuckDB SQL for the judgement of ``documents`` (columns of the query)."""
    sql = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(sql, words)) + "]"
    every = sorted({f for words in COMMON.values() for w in words for f in _forms(w)})
    counts = ", ".join(f"len(list_filter(hits, lambda x: list_contains({listed(words)}, x))) AS n_{lang}" for lang, words in COMMON.items())
    most = "greatest(" + ", ".join(f"n_{lang}" for lang in COMMON) + ")"
    lang = f"CASE WHEN 100 * {most} < {MIN_COMMON_PERCENT} * greatest(n_words, 1) THEN NULL " + " ".join(f"WHEN n_{x} = {most} THEN '{x}'" for x in COMMON) + " END"
    bins = "CASE lang " + " ".join(f"WHEN '{x}' THEN [" + ", ".join(f"len(list_filter(hits, lambda x: x = {sql(w)}))" for w in words) + "]" for x, words in COMMON.items()) + " END"
    found = "[length(t) - word_chars, " + ", ".join(f"len(regexp_extract_all(t, {sql(p)}))" for p in PATTERNS.values()) + "]"
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    distance = lambda p, q, n: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: {half.format(f'{p}[i]', f'{q}[i]')} + {half.format(f'{q}[i]', f'{p}[i]')})) / 2))"
    array = lambda a: "[" + ", ".join(f"{x!r}::DOUBLE" for x in a) + "]"
    refs = " UNION ALL ".join(f"SELECT {sql(k) if k else 'NULL'} AS lang, {array(c)} AS rc, {array(w) if w else 'NULL'} AS rw" for k, (c, w) in REFERENCES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, pos, ws[pos:pos + 4] AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM d)),
g AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, five) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(next - pos, 5))) AS n_repeat_words FROM g GROUP BY doc_id),
b AS (SELECT doc_id, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
 list_transform(list_filter(ws, lambda x: list_contains({listed(every)}, x)), lambda x: lower(rtrim(x, ',.'))) AS hits,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {counts}, {found} AS found FROM b),
l AS (SELECT *, {lang} AS lang, list_concat([length(t) - list_sum(found)::BIGINT], found) AS k FROM f),
m AS (SELECT *, {bins} AS bins FROM l),
h AS (SELECT * EXCLUDE (t, lines, hits), list_transform(k, lambda x: x::DOUBLE / greatest(length(t), 1)) AS chars,
 list_concat(list_transform(bins, lambda x: x::DOUBLE / greatest(n_words, 1)), [(n_words - list_sum(bins))::DOUBLE / greatest(n_words, 1)]) AS common FROM m),
refs AS ({refs}),
j AS (SELECT h.*, {distance("chars", "rc", len(CLASSES))} AS cd, {distance("common", "rw", 17)} AS wd, 2 * k[{CLASSES.index("script") + 1}] > word_chars AS other_script FROM h JOIN refs ON h.lang IS NOT DISTINCT FROM refs.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND (n_words < {min_words} OR other_script OR (cd <= {max_char_distance} AND (lang IS NULL OR wd <= {max_word_distance}))) AS kept FROM j
"""
