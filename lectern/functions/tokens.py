"""Index terms, query tokens and their weights, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import ASCII_WORD, HAN_RUN, clean_text, inline

#: Words that are neither indexed nor searched.
STOP_WORDS = (
    "一个 一种 这个 那个 这些 那些 我们 你们 他们 她们 它们 自己 什么 为什么 怎么 可以 没有 不是 但是 因为 所以 如果 只是 还是 以及 或者 进行 时候 现在 这样 那样 "
    "the a an and or but if then else of to in on for with as by is are was were be been being this that these those it its from at not"
).split()
#: Fixed value: longest term that is indexed.
LONGEST = 30




def _grams(text: Column, size: int) -> Column:
    runs = F.filter(F.regexp_extract_all(text, F.lit(HAN_RUN), F.lit(0)), lambda s: F.length(s) >= size)
    return F.flatten(F.transform(runs, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - (size - 1)), lambda i: F.substring(s, i, F.lit(size)))))


def index_terms(text: Column, *, min_length: int = 2, sizes: tuple[int, ...] = (2,)) -> Column:
    """Every occurrence of every term: lower-cased ASCII words and n-grams of ideograph runs."""
    text = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0)), F.lower)
    every = F.concat(words, *(_grams(text, n) for n in sizes if n >= min_length))
    return F.filter(every, lambda t: F.length(t).between(min_length, LONGEST) & ~t.isin(STOP_WORDS))


def query_tokens(query: Column) -> Column:
    """Distinct tokens in order: ASCII words; of each ideograph run itself (if 2 or 3 long) and its pairs; else the whole query."""
    text = clean_text(query)
    words = F.transform(F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(text, F.lit(HAN_RUN), F.lit(0))

    def of_run(s: Column) -> Column:
        whole = F.when(F.length(s).between(2, 3), F.array(s)).otherwise(F.array().cast("array<string>"))
        pairs = F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(whole, pairs)

    tokens = F.array_distinct(F.filter(F.concat(words, F.flatten(F.transform(runs, of_run))), lambda t: ~t.isin(STOP_WORDS)))
    rest = inline(query)
    return F.when(F.size(tokens) > 0, tokens).when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))


def token_weight(token: Column) -> Column:
    return F.when(token.rlike("[A-Za-z]") | (F.length(token) >= 3), 2).otherwise(1)
