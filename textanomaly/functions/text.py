"""Tokenisation and cleaning as chains of regular expressions.

The expressions avoid look-around, so the same lists run on any RE2 engine.
Replacements name groups as ``\\1``; ``spark_replacement`` turns them into ``$1``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Treebank-style word tokenisation, in the order the rules are applied.
TREEBANK_RULES: list[tuple[str, str]] = [
    # the marker of the next rule is no character of a text
    ("\u0001", " "),
    # a period after a title or an initial does not end the sentence
    (r"(^|[\s(])(Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|[A-Z])\.(\s)", "\\1\\2\u0001\\3"),
    # opening quotes
    (r'^"', "``"),
    ("([«“‘„]|`+)", r" \1 "),
    (r"""([ (\[{<])("|'')""", r"\1 `` "),
    # sentence-final period: at the end, or before a capital letter
    (r"""([^.])\.([\])}>"'»”’ ]*)\s*\z""", r"\1 . \2 "),
    (r"""([^.])\.([\])}>"'»”’]*)(\s+)([\p{Lu}«“‘"(\[])""", r"\1 . \2 \3\4"),
    # punctuation, brackets, dashes, closing quotes
    (r"([:,])([^\p{Nd}]|\z)", r" \1 \2"),
    (r"([^'])' ", r"\1 ' "),
    (r"(\.{2,}|--|''|[;@#$%&?!*\]\[(){}<>»”’])", r" \1 "),
    (r'"', " '' "),
    # two spaces, so that neighbouring words do not share one
    (r"[\s\p{Z}]+|\z", "  "),
    # clitics
    (r"([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|') ", r"\1 \2 "),
    # contractions that are two words
    (
        r"(^| )(?:([Cc]an)(not)|([Gg]im|[Ll]em)(me)|([Gg]on|[Ww]an)(na)|([Gg]ot)(ta)) ",
        r"\1\2\4\6\8 \3\5\7\9 ",
    ),
    (r"(^| )(?:([Dd])('ye)|([Mm]ore)('n)|('[Tt])(is|was)) ", r"\1\2\4\6 \3\5\7 "),
    ("\u0001", "."),
]

# A text without any of these parts is left as it is by the rule of the same place; none: always applied.
TREEBANK_PARTS: list[tuple[str, ...]] = [
    (),
    (".",),
    ('"',),
    ("«", "“", "‘", "„", "`"),
    ('"', "''"),
    (".",),
    (".",),
    (":", ","),
    ("' ",),
    (),
    (),
    (),
    ("'",),
    ("annot", "imme", "emme", "onna", "anna", "otta"),
    ("'",),
    (),
]

# The "basic English" word tokenisation, in the order the rules are applied.
BASIC_ENGLISH_RULES: list[tuple[str, str]] = [
    (r"(['.,()!?])", r" \1 "),
    (r'"', ""),
    (r"<br />|[;:]", " "),
]

WHITESPACE = r"[\s\p{Z}]+"
ALPHANUMERIC = r"^[\p{L}\p{N}]+$"
# a space and a word after it that ALPHANUMERIC does not fit ($ also stands before a last U+0085)
_OTHER_WORD = r" (?![\p{L}\p{N}]++\u0085?(?: |\z))[^ ]++"


def spark_replacement(text: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def _apply(column: Column, pattern: str, replacement: str) -> Column:
    if re.escape(pattern) == pattern and "\\" not in replacement:
        return F.replace(column, F.lit(pattern), F.lit(replacement))  # no expression needed
    return F.regexp_replace(column, pattern, spark_replacement(replacement))


def apply_rules(column: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        column = _apply(column, pattern, replacement)
    return column


def _apply_where(column: Column, parts: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """A rule for the texts that hold one of ``parts``: to look for them costs far less than the rule."""

    def changed(text: Column) -> Column:
        return F.when(reduce(or_, [text.contains(part) for part in parts]), _apply(text, pattern, replacement)).otherwise(text)

    # a list of one, so that the text so far is worked out once
    return F.transform(F.array(column), changed)[0]


def _treebank(column: Column) -> Column:
    for (pattern, replacement), parts in zip(TREEBANK_RULES, TREEBANK_PARTS, strict=True):
        column = _apply_where(column, parts, pattern, replacement) if parts else _apply(column, pattern, replacement)
    return column


def split_words(column: Column) -> Column:
    return F.filter(F.split(column, WHITESPACE), lambda w: w != "")


def word_tokens(column: Column) -> Column:
    """Treebank-style word tokens."""
    return split_words(_treebank(column))


def basic_english_tokens(column: Column) -> Column:
    """Lower-cased tokens with punctuation split off."""
    return split_words(apply_rules(F.lower(column), BASIC_ENGLISH_RULES))


def clean_text(column: Column, lowercase: bool = False, alnum: bool = False) -> Column:
    """Tokens joined by one space; null stays null; ``alnum`` keeps whole-word tokens."""
    source = F.lower(column) if lowercase else column
    words = F.trim(F.regexp_replace(_treebank(source), WHITESPACE, " "))
    if not alnum:
        return words
    return F.substring(F.regexp_replace(F.concat(F.lit(" "), words), _OTHER_WORD, ""), 2, 1 << 30)
