"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every measure is a built-in expression over the whole text; RULES is data, and compile_rules()
turns it into one boolean column. Nothing shuffles, so the plan is a scan and a projection.

Defined results: a null text has no words (all counts 0, base_failed true, kept false) and so
has an empty one; repeated rows are judged each for itself; an empty table gives an empty
result; columns of the input that aren't asked for pass through unread, and the measures never
clash with them, as quality_measures() returns only what it lists.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a word: ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Very frequent short words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are with as at be this have from by not or an "
    "le la les de des du et en un une que qui est dans pour sur au par pas ce il "
    "der die das und in den von zu mit sich auf ist im dem nicht ein eine als auch es "
    "el los las y que en un una por con no se su para es al lo como del"
).split()
#: As they stand in a text: also capitalised, also before a comma or full stop. A set, so a lookup is one hash.
STOP_FORMS = sorted({form + end for w in STOP_WORDS for form in (w, w.capitalize()) for end in ("", ",", ".")})

#: (name, measure, least, most); None: no bound. A text passes if it passes every row.
RULES = (
    ("length", "n_words", 10, 200_000),
    ("mean_word", "mean_word_chars", 1.2, 25.0),
    ("symbols", "symbols_per_word", None, 0.75),
    ("stop_words", "stop_word_ratio", 0.002, None),
    ("repeated_lines", "dup_line_ratio", None, 0.6),
    ("repeated_words", "repeat_word_ratio", None, 0.2),
)


def _bind(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """Hashes of the 5-word windows; two windows hash alike if and, but for 2**-64, only if equal."""

    def paired(x: Column, y: Column, step: int) -> Column:
        """Hashes of (x[i], y[i + step]); null where y has no such element."""
        return F.zip_with(x, F.slice(y, step + 1, F.size(y)), lambda a, b: F.xxhash64(a, b))

    def of_hashes(h: Column) -> Column:
        two = lambda p: _bind(paired(p, p, 2), lambda four: F.slice(paired(four, h, 4), 1, F.size(h) - 4))
        return F.when(F.size(h) >= 5, _bind(paired(h, h, 1), two)).otherwise(F.array().cast("array<bigint>"))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), keep equal neighbours, sum the union."""
    pairs = F.sort_array(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("i")))

    def repeated(p: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"],
            )
        )

    return _bind(
        pairs,
        lambda p: _bind(
            repeated(p),
            lambda at: F.aggregate(
                F.transform(at, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - x, F.lit(5))).cast("bigint")),
                F.lit(0).cast("bigint"),
                lambda a, x: a + x,
            ),
        ),
    )


def _all_measures(text: Column) -> tuple[Column, Column]:
    text = F.coalesce(text, F.lit(""))

    line_counts = _bind(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda lines: F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        ),
    )

    def of_words(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        return F.struct(
            n.alias("n_words"),
            F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            _bind(
                _windows(words),
                lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("bigint")).otherwise(_covered(ws)),
            ).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("bigint").alias("n_stop_words"),
        )

    return _bind(F.filter(F.split(text, WORD_GAP), lambda w: w != ""), of_words), line_counts


WORD_MEASURES = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")
LINE_MEASURES = ("n_dup_lines", "n_lines")


def compile_rules(m: dict[str, Column], rules=RULES) -> Column:
    """One boolean column: every rule's measure lies within its bounds."""
    n = F.greatest(m["n_words"], F.lit(1))
    value = {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / n,
        "symbols_per_word": m["n_symbols"] / n,
        "stop_word_ratio": m["n_stop_words"] / n,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeat_word_ratio": m["n_repeat_words"] / n,
    }
    out = F.lit(True)
    for _, measure, least, most in rules:
        if least is not None:
            out = out & (value[measure] >= F.lit(least))
        if most is not None:
            out = out & (value[measure] <= F.lit(most))
    return out


def quality_measures(docs: DataFrame, *, keep: list[str], text_col: str = "text", rules=RULES) -> DataFrame:
    """Columns `keep`, the measures, base_failed and kept, for each row of docs."""
    m = {c: F.col(f"__of_words.{c}") for c in WORD_MEASURES} | {c: F.col(f"__of_lines.{c}") for c in LINE_MEASURES}
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    of_words, of_lines = _all_measures(F.col(text_col))
    return docs.select(*keep, of_words.alias("__of_words"), of_lines.alias("__of_lines")).select(
        *keep,
        *[m[c].alias(c) for c in (*WORD_MEASURES, *LINE_MEASURES)],
        failed.alias("base_failed"),
        (~failed & compile_rules(m, rules)).alias("kept"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from ._store import table

    out = quality_measures(table(spark, sf_dir, "documents"), keep=["doc_id"])
    asked = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*asked, *[c for c in out.columns if c not in asked])


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_FORMS)
OP10_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), m AS (
  SELECT doc_id, t, ws, len(ws) AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    len(list_filter(ws, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words
  FROM w
), g AS (
  SELECT doc_id, i, ws[i:i + 4] AS win FROM (SELECT doc_id, ws, unnest(range(1, n_words - 3)) AS i FROM m)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), c2 AS (
  SELECT doc_id, sum(k) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS k FROM r) GROUP BY doc_id
), f AS (
  SELECT m.*, coalesce(c2.n, 0) AS n_repeat_words, greatest(n_words, 1)::DOUBLE AS d FROM m LEFT JOIN c2 USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
  n_stop_words::BIGINT AS n_stop_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND n_words >= 10 AND n_words <= 200000
    AND word_chars / d >= 1.2 AND word_chars / d <= 25.0
    AND n_symbols / d <= 0.75
    AND n_stop_words / d >= 0.002
    AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.6
    AND n_repeat_words / d <= 0.2 AS kept
FROM f
"""
