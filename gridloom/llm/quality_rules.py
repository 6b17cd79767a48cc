"""Quality rules: a table of thresholds compiled into one projection.

The measures of a text (lengths, symbols, stop words, repeated lines and
windows) are computed in one pass over the row by built-in functions, and each
rule of the table becomes a Boolean of two of them.  No user functions, no
shuffle: every row is judged on its own, so hot sources and groups of copies
need no care.

Defined cases: null and blank texts have all measures 0 and fail the base
rule; a rule with ``min_words`` passes shorter texts; ids are not looked at,
so repeated rows and null ids are fine; extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.expressions import let, upto, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are with as be at by this from or an "
    "der die das und ist von zu mit den dem auf für nicht ein eine sich des im "
    "le la les de et est un une que qui dans pour pas sur par au en du "
    "el los las y por con no se del al para como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low * over <= measure <= high * over (either bound may be open)."""

    name: str
    measure: str
    over: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0, 20),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.25),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=0.3, min_words=20),
    Rule("stop_word_ratio", "n_stop", "n_words", low=0.02, min_words=40),
    Rule("upper_case_ratio", "n_upper", "word_chars", high=0.5, min_words=20),
    Rule("mean_line_length", "n_words", "n_lines", high=5000.0),
)


def repeated_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that are found twice or more; ``w`` must be a bound variable."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeats(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))

        return F.filter(s, lambda _, i: same(i, i - 1) | same(i, i + 1))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        places = let(ordered, lambda s: F.sort_array(F.transform(repeats(s), lambda x: x["p"])))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places, covered))

    hashes = F.transform(upto(F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


def measures(text: Column) -> Column:
    """A struct of the measures of a text; all of them longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        ),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        by_word.alias("word"),
        by_line.alias("line"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}++", "")).cast("long").alias("n_upper"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """One Boolean column for each rule: whether the row passes it."""
    out = {}
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok &= F.col(r.measure) >= F.lit(float(r.low)) * F.col(r.over)
        if r.high is not None:
            ok &= F.col(r.measure) <= F.lit(float(r.high)) * F.col(r.over)
        out[f"rule_{r.name}"] = ok | (F.col("n_words") < r.min_words) if r.min_words else ok
    return out


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: id, the measures, base_failed, kept and one Boolean a rule."""
    m = docs.select(F.col(id_col).alias("id"), measures(F.col(text_col)).alias("m"))
    flat = m.select("id", "m.word.*", "m.line.*", "m.n_symbols", "m.n_upper")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    named = compile_rules(rules)
    passed = F.lit(True)
    for ok in named.values():
        passed &= ok
    return flat.select("*", base.alias("base_failed"), (~base & passed).alias("kept"), *(c.alias(k) for k, c in named.items()))
