"""Text search: lexemes with positions, queries parsed on the driver into Boolean expressions over a lexeme map.

A vector is map<lexeme, array<position>>. The configuration `simple` lower-cases, by built-in functions; `english` also drops
stop words and stems (Porter2), in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions.stemmer import stem

#: English stop words.
STOP = "i me my we our you your he him his she her it its they them their what which who this that these those am is are was were be been being have has had do does did a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
_STOP = frozenset(STOP)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda x: None if x is None else [stem(w) for w in x])


def lexemes(words: Column, config: str = "simple") -> Column:
    """An array of lower-case words as lexemes; the query side stems by the same function."""
    return _stems(words) if config == "english" else words


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def _english(words: pd.Series) -> pd.Series:
    def vector(row) -> dict | None:
        if row is None:
            return None
        placed: dict[str, list[int]] = {}
        for p, w in enumerate(row, 1):
            if w not in _STOP:
                placed.setdefault(stem(w), []).append(p)
        return {w: placed[w] for w in sorted(placed)}

    return words.map(vector)


def to_tsvector(text: Column, config: str = "simple") -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if config == "english":
        return _english(words)
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p")))
    keys = F.array_sort(F.array_distinct(words))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(placed, lambda x: x["w"] == k), lambda x: x["p"])))


def tsvector_rows(df, id_column: str, text_column: str, config: str = "simple"):
    """(id, lexeme, positions) by explode and one aggregation: the form to use for whole tables of long texts, linear in them."""
    words = df.select(id_column, F.posexplode(F.filter(F.split(F.lower(text_column), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("p", "w"))
    if config == "english":
        words = words.where(~F.col("w").isin(STOP))
    out = words.select(id_column, lexemes(F.array("w"), config)[0].alias("lexeme"), (F.col("p") + 1).alias("p"))
    return out.groupBy(id_column, "lexeme").agg(F.array_sort(F.collect_list("p")).alias("positions"))


#: What a position of each letter counts in a rank: ts_rank's weight.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def setweight(vector: Column, letter: str) -> Column:
    """One weight over every position: map<lexeme, array<struct<position, weight>>>; positions() gives the vector again."""
    if letter.upper() not in WEIGHTS:
        raise ValueError(f"unrecognized weight: {letter!r}")
    return F.transform_values(vector, lambda _, ps: F.transform(ps, lambda p: F.struct(p.alias("position"), F.lit(letter.upper()).alias("weight"))))


def positions(weighted: Column) -> Column:
    return F.transform_values(weighted, lambda _, ps: F.transform(ps, lambda p: p["position"]))


def strip(vector: Column) -> Column:
    return F.map_keys(vector)


def _lexeme_of(word: str, config: str) -> str | None:
    word = word.lower()
    return word if config != "english" else None if word in STOP else stem(word)


class Query:
    """A parsed query: ("word", lexeme, prefix), ("and" | "or", left, right), ("not", x) or ("phrase", left, right, distance)."""

    def __init__(self, node, config: str = "simple"):
        self.node, self.config = node, config

    def numnode(self) -> int:
        count = lambda n: 0 if n is None else 1 if n[0] == "word" else 1 + sum(count(x) for x in n[1:] if isinstance(x, tuple))
        return count(self.node)

    def words(self) -> list[str]:
        """The lexemes of the query, in order."""
        of = lambda n: [] if n is None else [n[1]] if n[0] == "word" else [w for x in n[1:] if isinstance(x, tuple) for w in of(x)]
        return of(self.node)

    def matches_text(self, text: Column) -> Column:
        """The same answer without building a vector: one pass over the text's words (simple configuration, no phrases)."""
        words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")

        def at(n) -> Column:
            if n[0] == "word":
                return F.exists(words, lambda w: F.startswith(w, F.lit(n[1]))) if n[2] else F.array_contains(words, n[1])
            if n[0] == "phrase":
                raise ValueError("phrases need a vector's positions")
            return ~at(n[1]) if n[0] == "not" else at(n[1]) & at(n[2]) if n[0] == "and" else at(n[1]) | at(n[2])

        return at(self.node) if self.node else F.lit(False)

    def matches(self, vector: Column) -> Column:
        def at(n) -> Column:
            if n[0] == "word":
                if n[2]:
                    return F.exists(F.map_keys(vector), lambda k: F.startswith(k, F.lit(n[1])))
                return F.map_contains_key(vector, n[1])
            if n[0] == "not":
                return ~at(n[1])
            if n[0] == "phrase":
                return F.size(places(n)) > 0
            return at(n[1]) & at(n[2]) if n[0] == "and" else at(n[1]) | at(n[2])

        def places(n) -> Column:
            none = F.array().cast("array<int>")
            if n[0] == "word":
                return F.coalesce(F.try_element_at(vector, F.lit(n[1])), none)
            left, right = places(n[1]), places(n[2])
            return F.filter(right, lambda p: F.array_contains(left, p - n[3]))

        return at(self.node) if self.node else F.lit(False)


def to_tsquery(text: str, config: str = "simple") -> Query:
    """word, word:*, !, &, |, <->, <n> and parentheses, loosest | then & then <n>."""
    items = re.findall(r"<->|<\d+>|[()&|!]|[\w]+(?::\*)?", text)

    def binary(level: int, at: int):
        if level == 3:
            return unary(at)
        node, at = binary(level + 1, at)
        while at < len(items) and (items[at] == "|" if level == 0 else items[at] == "&" if level == 1 else items[at].startswith("<")):
            sign = items[at]
            right, at = binary(level + 1, at + 1)
            kind = "or" if level == 0 else "and" if level == 1 else "phrase"
            if node is None or right is None:
                node = node or right
            else:
                node = (kind, node, right) if kind != "phrase" else (kind, node, right, 1 if sign == "<->" else int(sign[1:-1]))
        return node, at

    def unary(at: int):
        if items[at] == "!":
            node, at = unary(at + 1)
            return (("not", node) if node else None), at
        if items[at] == "(":
            node, at = binary(0, at + 1)
            if at >= len(items) or items[at] != ")":
                raise ValueError(f"syntax error in tsquery: {text!r}")
            return node, at + 1
        word, _, star = items[at].partition(":")
        known = _lexeme_of(word, config)
        return (("word", known, bool(star)) if known else None), at + 1

    node, end = binary(0, 0) if items else (None, 0)
    if end != len(items):
        raise ValueError(f"syntax error in tsquery: {text!r}")
    return Query(node, config)


def plainto_tsquery(text: str, config: str = "simple") -> Query:
    return to_tsquery(" & ".join(re.findall(r"\w+", text)), config)


def phraseto_tsquery(text: str, config: str = "simple") -> Query:
    return to_tsquery(" <-> ".join(re.findall(r"\w+", text)), config)


def websearch_to_tsquery(text: str, config: str = "simple") -> Query:
    """Quoted phrases, or, and - for not; all else is AND."""
    parts: list[str] = []
    for quoted, sign, word in re.findall(r'"([^"]*)"|(-?)(\w+)', text):
        if word.lower() == "or" and parts:
            parts.append("|")
            continue
        if parts and parts[-1] != "|":
            parts.append("&")
        parts.append("(" + " <-> ".join(re.findall(r"\w+", quoted)) + ")" if quoted else ("!" if sign else "") + word)
    return to_tsquery(" ".join(parts), config)


def _occurrences(vector: Column, word: str, weighted: bool) -> Column:
    """(p, w) of each occurrence of a lexeme, in order."""
    found = F.try_element_at(vector, F.lit(word))
    if not weighted:
        return F.transform(F.coalesce(found, F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(WEIGHTS["D"]).alias("w")))
    value = lambda x: F.coalesce(*(F.when(x["weight"] == k, F.lit(v)) for k, v in WEIGHTS.items()))
    return F.transform(F.coalesce(found, F.array().cast("array<struct<position:int,weight:string>>")), lambda x: F.struct(x["position"].alias("p"), value(x).alias("w")))


def _met(a: Column, b: Column) -> Column:
    """(d, w): distance and product of weights of each occurrence of one word with each of another."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.abs(x["p"] - y["p"]).alias("d"), (x["w"] * y["w"]).alias("w")))))


def _near(d: Column) -> Column:
    return F.when(d > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))


def ts_rank(vector: Column, query: Query | list[str], weighted: bool = False) -> Column:
    """The rank of a vector for a query (or for any of some words). weighted: the vector is one of setweight's.

    Words combined by & or <-> count by the distance of their occurrences, all others by their number: each word's weights over
    the squares of their turns, the largest weight taken first, over pi^2 / 6.
    """
    words = list(dict.fromkeys(query if isinstance(query, list) else query.words()))
    together = isinstance(query, Query) and query.node is not None and query.node[0] in ("and", "phrase") and len(words) > 1
    if not words:
        return F.lit(0.0)
    seen = [_occurrences(vector, w, weighted) for w in words]
    if together:
        rest = F.lit(1.0)
        for i, a in enumerate(seen):
            for b in seen[:i]:
                rest = rest * F.aggregate(F.filter(_met(a, b), lambda x: x["d"] > 0), F.lit(1.0), lambda acc, x: acc * (1 - F.sqrt(x["w"] * _near(x["d"]))))
        return F.when(rest == 1.0, F.lit(1e-20)).otherwise(1 - rest)
    total = F.lit(0.0)
    for own in seen:
        top = F.array_max(F.transform(own, lambda x: x["w"]))
        first = F.array_position(F.transform(own, lambda x: x["w"]), top)
        squares = F.aggregate(F.transform(own, lambda x, i: x["w"] / ((i + 1) * (i + 1))), F.lit(0.0), lambda acc, x: acc + x)
        total = total + F.when(F.size(own) > 0, (top + squares - top / (first * first)) / 1.64493406685).otherwise(0.0)
    return total / len(words)


def ts_headline(text: Column, words: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    if not words:
        return text
    return F.regexp_replace(text, r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])", f"{start}$1{stop}")
