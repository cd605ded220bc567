"""Text normalisation as built-in column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import wordlists as wl

# Java and RE2 agree on these classes, and they match Unicode letters.
WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x0B\x85\p{Z}"
SENTENCE_END = r"[.|?!\n…]"


def _spaced_hint() -> str:
    """A pattern that finds just the spaced contractions; texts without any skip that rule set."""
    rest: dict[str, set[str]] = {}
    for pattern, _ in wl.spaced_rules():
        first, _, more = pattern[1:].partition(" ")
        rest.setdefault(first, set()).add(more)
    return " (?:" + "|".join(f"{first} (?:{'|'.join(sorted(more))})" for first, more in sorted(rest.items())) + ")"


_SPACED_HINT = _spaced_hint()


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def constant_words(words: list[str]) -> Column:
    """A constant array, written as one literal to keep plans small."""
    return F.split(F.lit("\n".join(words)), "\n")


def _apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply ordered literal replacements as a fold over constant arrays."""
    patterns, full = (constant_words([r[i] for r in rules]) for i in (0, 1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), text,
                       lambda t, i: F.replace(t, patterns[i], full[i]))


def expand_contractions(text: Column) -> Column:
    """Write contractions in full. Each rule set runs only on texts it can touch."""
    def spaced(t: Column) -> Column:
        return F.when(t.rlike(_SPACED_HINT), _apply_rules(t, wl.spaced_rules())).otherwise(t)

    def with_apostrophe(t: Column) -> Column:
        return F.when(t.contains("'"), _apply_rules(t, wl.apostrophe_rules())).otherwise(t)

    return bind(bind(F.replace(text, F.lit("’"), F.lit("'")), spaced), with_apostrophe)


def normalize_text(text: Column) -> Column:
    """Lower-case, expand contractions, apply the residual rules, squeeze spaces."""
    text = expand_contractions(F.lower(text))
    text = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), wl.RESIDUAL_RULES, text)
    return F.regexp_replace(text, "[ ]{2,}", " ")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ ]{2,}", " ")


def punctuate(line: Column) -> Column:
    """Close a line with a full stop unless it already ends a sentence."""
    return F.when(line.rlike("[.|?!…]$"), line).otherwise(F.concat(line, F.lit(".")))


def with_title(title: Column, text: Column) -> Column:
    """Put the title, without its season and episode numbers, before the text."""
    head = F.regexp_replace(punctuate(F.lower(title)), "^season [^ ]* episode [^ ]* ", "")
    return F.concat(head, F.lit(" "), text)


def split_words(text: Column) -> Column:
    """Separate clitics and punctuation, and cut at blanks: the raw word list."""
    text = F.regexp_replace(text, r'([\[\](){}<>;@#$%&?!"*`«»“”„…]|--|\.\.+)', " ")
    text = F.regexp_replace(text, "[:,]([^0-9])", " $1")
    text = F.regexp_replace(
        text, rf"('(?:s|m|d|ll|re|ve)|n't)([.,:'\"]*(?:[{BLANK}]|$))", " $1$2")
    split = F.create_map(*[x for k, v in wl.SPLIT_WORDS.items()
                           for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = F.lit(" " + " ".join(wl.SPLIT_WORDS) + " ")

    def cut(t: Column) -> Column:
        words = F.split(t, rf"[{BLANK}]+")
        return F.when(
            t.rlike("|".join(wl.SPLIT_WORDS)),
            F.flatten(F.transform(words, lambda w: F.when(
                known.contains(F.concat(F.lit(" "), w, F.lit(" "))), split[w]
            ).otherwise(F.array(w)))),
        ).otherwise(words)

    return bind(text, cut)


def clean_words(words: Column) -> Column:
    """Drop everything but letters, digits and underscores; drop empty words."""
    joined = F.regexp_replace(F.array_join(words, " "), f"[^{WORD} ]", "")
    return F.filter(F.split(joined, " "), lambda w: w != "")


def number_words(token: Column) -> Column:
    """English words for an all-digit token, to decillions (36 digits); others unchanged."""
    ones, tens = constant_words(wl.ONES), constant_words(wl.TENS)

    def below_thousand(n: Column) -> Column:
        hundreds, rest = F.floor(n / 100).cast("int"), n % 100
        small = F.when(rest < 20, ones[rest]).otherwise(F.concat(
            tens[F.floor(rest / 10).cast("int") - 2],
            F.when(rest % 10 > 0, F.concat(F.lit("-"), ones[rest % 10])).otherwise("")))
        return F.concat_ws(
            " and ",
            F.when(hundreds > 0, F.concat(ones[hundreds], F.lit(" hundred"))),
            F.when(rest > 0, small))

    padded = F.lpad(token, wl.NUMBER_DIGITS, "0")
    scales = constant_words(["", *wl.SCALES])

    def group(i: Column) -> Column:
        return F.substring(padded, wl.NUMBER_DIGITS - 2 - 3 * i, 3).cast("int")

    def scaled(i: Column) -> Column:
        return F.when(group(i) > 0, F.concat(below_thousand(group(i)), F.lit(" "), scales[i]))

    head = F.array_join(F.transform(F.sequence(F.lit(len(wl.SCALES)), F.lit(1)), scaled), ", ")
    last = group(F.lit(0))
    glue = F.when(head == "", "").when(last < 100, " and ").otherwise(", ")
    whole = F.when(last > 0, F.concat(head, glue, below_thousand(last))).otherwise(head)
    return F.when(token.rlike(f"^[0-9]{{1,{wl.NUMBER_DIGITS}}}$"),
                  F.when(whole == "", "zero").otherwise(whole)).otherwise(token)


def tokenize(text: Column) -> Column:
    """Normalised text to its cleaned token array, numbers spelled out."""
    def spell(words: Column) -> Column:
        # one search for all words, which hold no blanks
        return F.when(F.array_join(words, " ").rlike("(?:^| )[0-9]+(?: |$)"),
                      F.transform(words, number_words)).otherwise(words)

    return bind(clean_words(split_words(text)), spell)


STOP_SQL = "(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in wl.STOP_WORDS) + ")"


def is_stop(word: str) -> Column:
    """Stop-word test of a column given by name or SQL expression (one parsed hash lookup)."""
    return F.expr(f"{word} IN {STOP_SQL}")


def boundary_ok(first: str, last: str) -> Column:
    """A term may hold stop words inside, but not at either end."""
    return ~is_stop(f"substring_index({first}, '_', 1)") & ~is_stop(f"substring_index({last}, '_', -1)")


def content_words(words: str) -> Column:
    """The words of an array column that are no stop words and longer than two letters."""
    return F.expr(f"filter({words}, w -> length(w) > 2 AND w NOT IN {STOP_SQL})")


def fold_possessive(label: Column) -> Column:
    return F.regexp_replace(F.replace(label, F.lit("_s_"), F.lit("s_")), "_s$", "s")


def count_underscores(label: Column) -> Column:
    return F.length(label) - F.length(F.replace(label, F.lit("_"), F.lit("")))


def sentences(text: Column) -> Column:
    """Sentence texts in order: cut at sentence ends, trimmed, empty ones dropped."""
    trimmed = F.transform(
        F.split(text, SENTENCE_END),
        lambda s: F.regexp_replace(s, rf"^[{BLANK}]+|[{BLANK}]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def sentence_length_weight(sentence: Column, threshold: int = 6) -> Column:
    """Zero below the threshold, then growing with the logarithm of the length."""
    n = F.size(F.regexp_extract_all(sentence, F.lit(f"[{WORD}] [{WORD}]"), F.lit(0))) + 1
    return (F.when(n < threshold, F.lit(0.0))
            .otherwise(F.ln((n - threshold) / 2 + 1) + 1))


def sentence_case(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))


def url_slug(name: Column) -> Column:
    return F.replace(sentence_case(name), F.lit(" "), F.lit("-"))


def table_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))
