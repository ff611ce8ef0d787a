"""Quality rules: a table of thresholds compiled into one projection.

`measures` counts, per text and with built-in functions only: words, their code points,
stop words, symbols, words without a letter, lines with a word, lines equal to an earlier
one, lines that are rows of a table, end in an ellipsis or open with a bullet, and words
inside three-word windows that the text holds twice or more. `compile_rules` turns the rows
of a threshold table into one array expression that names the rules a text fails. No row
leaves its task, so neither hot sources nor groups of copies matter.

Repeated windows are found in two steps on the row itself. Each window becomes one long, its
32-bit hash above its place; the sorted longs put equal hashes side by side. Windows whose
hash has a neighbour (few in clean text) are then compared by their words, so a clash of
hashes changes nothing. Both steps are sorts: a text of n words costs n log n.

Defined results: a null text and an empty one have no words and all counts 0, and fail the
base rules; a rule whose measure has nothing to divide by (no words, no lines) isn't failed;
rows are judged one by one, so ties, repeated rows and null ids don't matter; columns of the
input that bear an output's name are replaced, all others are kept; an empty table gives an
empty result. Texts are read whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

BASE_WORDS = 50
BASE_REPEATED = 50  # of 100 words
WINDOW = 3
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his in is it not of on or that the their they this to was "
    "were which with you "
    "als auch auf aus bei das dem den der des die ein eine einer er es für ich im in ist mit nicht sich sie sind und von "
    "war wie zu zum zur "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se son sur un une "
    "al como con de del el en es la las lo los más no para pero por que se su sus un una y").split()
PUNCTUATION = ".,;:!?\"'()[]«»“”„…¿¡"
SPACES = r"[\x20\x09-\x0D]+"
BLANK = r"^[\x20\x09-\x0D]*$"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_no_letter", "n_lines",
            "n_table_lines", "n_ellipsis_lines", "n_bullet_lines", "n_shout_words")
OUTPUTS = (*MEASURES, "base_failed", "failed_rules", "kept")


@dataclass(frozen=True)
class Rule:
    """`measure` per thousand of `per` (or itself, if `per` is None) must lie in [low, high]; a
    text with fewer than `least` of `per` is not judged."""
    name: str
    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None
    least: int = 1


#: Limits in thousandths of the measure they are taken of.
THRESHOLDS = (
    Rule("few words", "n_words", None, low=BASE_WORDS),
    Rule("short or long words", "word_chars", "n_words", low=2_000, high=12_000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("shouted words", "n_shout_words", "n_words", high=300),
    Rule("words without a letter", "n_no_letter", "n_words", high=200),
    Rule("few stop words", "n_stop_words", "n_words", low=20, least=BASE_WORDS),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=300, least=10),
    Rule("table rows", "n_table_lines", "n_lines", high=500),
    Rule("cut lines", "n_ellipsis_lines", "n_lines", high=300),
    Rule("bullets", "n_bullet_lines", "n_lines", high=900),
    Rule("repeated windows", "n_repeat_words", "n_words", high=10 * BASE_REPEATED),
)


def _let(value: Column, body) -> Column:
    """body(value), with `value` computed once: lambdas bind it."""
    return F.transform(F.array(value), body)[0]


def _neighbours(items: Column, key) -> Column:
    """The items of a sorted array that share their key with the item before or after."""
    def shares(x: Column, i: Column) -> Column:
        near = [F.coalesce(key(F.get(items, i + d)) == key(x), F.lit(False)) for d in (-1, 1)]
        return near[0] | near[1]
    return F.filter(items, shares)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more among `words`."""
    def window(i: Column) -> list[Column]:
        return [F.get(words, i + d) for d in range(WINDOW)]
    last = F.size(words) - F.lit(WINDOW)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    place = lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    coded = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.hash(*window(i)).cast("long"), 32).bitwiseOR(i.cast("long"))))
    alike = _let(coded, lambda s: F.transform(_neighbours(s, lambda x: F.shiftright(x, 32)), place))
    spelt = F.sort_array(F.transform(alike, lambda i: F.struct(F.array(*window(i)).alias("w"), i.alias("i"))))
    sure = _let(spelt, lambda s: F.sort_array(F.transform(_neighbours(s, lambda x: x["w"]), lambda x: x["i"])))
    # each window adds the words that the next repeated one doesn't hold
    gain = lambda s: F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    return _let(sure, lambda s: F.aggregate(gain(s), F.lit(0).cast("long"), lambda a, x: a + x))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the columns of MEASURES, all long."""
    kept = without(docs, *MEASURES)
    read = kept.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parted = read.select("row", "text", F.array_remove(F.split("text", SPACES), "").alias("words"),
                         F.filter(F.split("text", "\n"), lambda x: ~x.rlike(BLANK)).alias("lines"))
    bare = lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION)))
    return parted.select(
        "row.*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _count(F.col("words"), lambda w: bare(w).isin(*sorted(set(STOP_WORDS)))).alias("n_stop_words"),
        _count(F.col("words"), lambda w: ~w.rlike(r"\p{L}")).alias("n_no_letter"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("lines"), lambda x: x.rlike(r"\|[^|]*\|")).alias("n_table_lines"),
        _count(F.col("lines"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
        _count(F.col("lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣·][\x20\x09]")).alias("n_bullet_lines"),
        _count(F.col("words"), lambda w: w.endswith("!!") & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")).alias("n_shout_words"))


def compile_rules(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The names of the rules that a row of `measures` fails, in the order of the table."""
    def fails(r: Rule) -> Column:
        value, base = (F.col(r.measure), F.lit(1)) if r.per is None else (F.col(r.measure) * 1000, F.col(r.per))
        out = F.lit(False)
        if r.low is not None:
            out = out | (value < base * F.lit(r.low))
        if r.high is not None:
            out = out | (value > base * F.lit(r.high))
        return out & (base >= r.least)
    return F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """`docs` with MEASURES, base_failed, failed_rules (names) and kept."""
    got = measures(without(docs, "base_failed", "failed_rules", "kept"), text_col)
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    base = (words < BASE_WORDS) | (repeated * 100 > words * BASE_REPEATED)
    failed = compile_rules(rules)
    return got.select("*", base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))
