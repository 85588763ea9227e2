"""Compiler commands: shell words, options taken out, include paths. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Options that would spoil a dependency listing, and whether a value follows them.
SPOILING = [("-o", True), ("--output", True), ("-MM", False), ("-MF", True), ("-MP", False), ("-MT", True), ("-MQ", True), ("-MD", False), ("-MMD", False), ("-MJ", True), ("-MV", False)]
LISTING = ["-E", "-M", "-MT", "__dummy"]
SEARCH_FLAGS = ["-iquote", "-isystem", "-idirafter", "-I"]

#: What a shell word is made of: plain characters, an escaped one, or quotes of either kind. All repeats are
#: possessive, so a long word neither backtracks nor takes the matcher's stack.
_PIECE = r"""[^ \t\r\n'"\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+\""""
_WORD = f"(?s)(?:{_PIECE})++"


def shell_words(command: Column) -> Column:
    """A command line's words, as a POSIX shell splits them; null if its quotes don't match or it ends in an escape."""
    words = F.regexp_extract_all(command, F.lit(_WORD), F.lit(0))
    rest = F.regexp_replace(command, f"{_WORD}|[ \t\r\n]++", "")
    return F.when(rest == "", F.transform(words, _unquoted))


def _unquoted(word: Column) -> Column:
    def one(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
        # Between double quotes a backslash escapes only itself and the quote.
        return (
            F.when(F.startswith(piece, F.lit("'")), inner)
            .when(F.startswith(piece, F.lit('"')), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(F.startswith(piece, F.lit("\\")), F.substr(piece, F.lit(2)))
            .otherwise(piece)
        )

    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(f"(?s){_PIECE}"), F.lit(0)), one), "")


def without_option(words: Column, option: str, has_value: bool = False) -> Column:
    """words without those that begin with option, and without the value after one that is the option alone.

    As in the tool that this stands in for, a match at the very first word is left and ends the search.
    """
    no, yes = F.lit(False), F.lit(True)
    start = F.struct(F.array().cast("array<string>").alias("left"), no.alias("value_follows"), no.alias("ended"))

    def step(state: Column, word: Column) -> Column:
        hit = ~state["ended"] & ~state["value_follows"] & F.startswith(word, F.lit(option))
        first = hit & (F.size(state["left"]) == 0)
        gone = (hit & ~first) | state["value_follows"]
        left = F.when(gone, state["left"]).otherwise(F.array_append(state["left"], word))
        follows = hit & ~first & (word == option) if has_value else no
        return F.struct(left.alias("left"), follows.alias("value_follows"), F.when(first, yes).otherwise(state["ended"]).alias("ended"))

    return F.aggregate(words, start, step, lambda s: s["left"])


def dependency_command(words: Column) -> Column:
    """The words of the command that lists a compilation's dependencies; null without a word."""
    left = words
    for option, has_value in SPOILING:
        left = without_option(left, option, has_value)
    left = F.concat(F.slice(left, 1, 1), F.array(*map(F.lit, LISTING)), F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0))))
    return F.when(F.size(words) > 0, without_option(F.filter(left, lambda w: w != ""), "--gcc-toolchain"))


def search_paths(words: Column) -> Column:
    """The include paths of a command, in order: what follows a flag, joined to it or as the next word."""
    flag = lambda w: F.regexp_extract(w, "^(" + "|".join(SEARCH_FLAGS) + ")", 1)
    rest = lambda w: F.substr(w, F.length(flag(w)) + 1)
    found = F.transform(words, lambda w, i: F.when(flag(w) != "", F.when(rest(w) != "", rest(w)).otherwise(F.get(words, i + 1))))
    return F.filter(found, lambda p: p.isNotNull())
