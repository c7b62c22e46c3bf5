"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Every figure comes from one pass over a row, in built-in functions; nothing is shuffled. Repeated three-word windows
are found by sorting a text's window hashes (64 bits of the three words) with their positions, in n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: Frequent short words of the languages that the corpus holds.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "was", "with", "for", "on", "as", "are", "by", "this"),
    "fr": ("le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "est", "dans", "pour", "par", "au"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "nicht", "ein", "eine", "sich", "auf"),
    "es": ("el", "la", "los", "de", "que", "y", "en", "un", "una", "se", "por", "con", "para", "es", "las"),
}

#: (name, ratio, least, most): a document fails a rule outside its bounds; null is no bound.
THRESHOLDS = (
    ("word_length", "word_chars / n_words", 2.0, 15.0),
    ("symbols", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words / n_words", 0.005, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    plain = F.translate(text, BLANK, " " * len(BLANK))
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, the first included."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.arrays_zip(F.slice(w, 1, n - 2).alias("a"), F.slice(w, 2, n - 2).alias("b"), F.slice(w, 3, n - 2).alias("c")), lambda z: F.xxhash64(z["a"], z["b"], z["c"]))

    def starts(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(t: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), t)
            after = F.concat(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
            rows = F.arrays_zip(t.alias("t"), F.slice(before, 1, F.size(t)).alias("p"), after.alias("n"))
            kept = F.filter(rows, lambda z: F.coalesce(z["t"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["t"]["h"] == z["n"]["h"], F.lit(False)))
            return F.sort_array(F.transform(kept, lambda z: z["t"]["i"]))

        return let(tagged, again)

    def covered(at: Column) -> Column:
        n = F.size(at)
        gaps = F.zip_with(F.slice(at, 2, F.greatest(n - 1, F.lit(0))), F.slice(at, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(a - b, F.lit(3)))
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(starts(hashes), covered))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows(words), count))


def counted(text: Column) -> Column:
    """A struct of all counts that rules refer to; words and lines of the text are made once."""
    plain = F.coalesce(text, F.lit(""))
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    lines = F.filter(F.split(plain, "\n"), lambda x: _without(x, BLANK) != "")
    long = lambda c: c.cast("long")

    def body(w: Column, l: Column) -> Column:  # noqa: E741
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(_without(plain, BLANK))).alias("word_chars"),
            long(F.length(plain) - F.length(_without(plain, SYMBOLS))).alias("n_symbols"),
            long(F.size(l)).alias("n_lines"),
            long(F.size(l) - F.size(F.array_distinct(l))).alias("n_dup_lines"),
            _repeated_words(w).alias("n_repeat_words"),
            long(F.size(F.filter(w, lambda x: F.lower(x).isin(stops)))).alias("n_stop_words"),
        )

    return let(_words(plain), lambda w: let(lines, lambda l: body(w, l)))  # noqa: E741


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the counts that rules refer to, for each row."""
    return docs.select("doc_id", counted(F.col(text)).alias("f")).select("doc_id", "f.*")


def _base_failed(get: Callable[[str], Column], min_words: int) -> Column:
    return (get("n_words") < min_words) | (100 * get("n_repeat_words") > 50 * get("n_words"))


def compiled(thresholds=THRESHOLDS, get: Callable[[str], Column] | None = None) -> list[tuple[str, Column]]:
    """A failure flag for each rule of a threshold table; a ratio over nothing fails nothing. get: a figure by name."""
    out, get = [], get or F.col
    for name, ratio, least, most in thresholds:
        over, under = ratio.split(" / ")
        x = F.try_divide(get(over).cast("double"), get(under))
        bad = F.lit(False)
        if least is not None:
            bad = bad | F.coalesce(x < least, F.lit(False))
        if most is not None:
            bad = bad | F.coalesce(x > most, F.lit(False))
        out.append((name, bad))
    return out


def quality_report(docs: DataFrame, thresholds=THRESHOLDS, min_words: int = MIN_WORDS) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed.

    base_failed: fewer than min_words words, or over half of them in repeated windows. kept: not base_failed, and no
    rule of the table fails; failed names those that do. Null and empty texts have no words, and fail. Repeated rows
    and null doc_ids stay; other columns of docs are ignored.
    """
    rows = figures(docs)
    base = _base_failed(F.col, min_words)
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in compiled(thresholds)]))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rows.select(*counts, base.alias("base_failed"), failed.alias("failed"))
    return rows.select(*counts, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def accepted(docs: DataFrame, thresholds=THRESHOLDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that quality_report keeps, with all their columns. Works on each row alone: no join.

    Null and empty texts go; repeated rows are judged alike and stay or go together; null doc_ids make no difference;
    an empty table stays one. Texts of any length are judged whole.
    """

    def verdict(f: Column) -> Column:
        bad = _base_failed(lambda n: f[n], min_words)
        for _, failed in compiled(thresholds, lambda n: f[n]):
            bad = bad | failed
        return ~bad

    # one expression: a filter over columns would be pushed down with each of them computed again
    return docs.where(let(counted(F.col("text")), verdict))
