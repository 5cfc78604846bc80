"""Text functions as native Spark Column expressions (no Python in the hot path).

All builders return ``Column`` objects, so they stay inside whole-stage code generation
(regexp / split) or the interpreted higher-order array functions, and are evaluated per
partition without a shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the published behaviour they stand for)
# ---------------------------------------------------------------------------------------------

# English stop words: Spark ML's default list, StopWordsRemover.loadDefaultStopWords("english").
STOPWORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't",
    "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's",
    "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]

# Word-tokeniser approximation (regular expressions applied in this order to lower-cased text).
TOKEN_PUNCT = r'[“”«»?!;@#$%&\[\](){}<>"`]|\.\.\.|--'   # -> space
TOKEN_COLON_COMMA = r"[:,]([^0-9]|$)"                      # -> ' ' + group 1
TOKEN_CLITIC = r"(n't|'s|'m|'d|'ll|'re|'ve|')(\s|$)"       # -> ' ' + group 2
TOKEN_FINAL_PERIOD = r"\.(\s|$)"                           # -> ' ' + group 1
# Same matches as TOKEN_CLITIC with the whitespace left in place (lookahead) -> ' ';
# two alternatives to try per position instead of eight (Java regex only; SQL uses the above).
TOKEN_CLITIC_FAST = r"(?:n't|'(?:s|m|d|ll|re|ve)?)(?=\s|$)"
TOKEN_KEEP = r"^[\p{L}\p{N}]+$"                            # isalnum()

# Noun detachment rules (suffix -> replacement), tried in this order.
NOUN_DETACHMENT_RULES = [
    ("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
    ("men", "man"), ("ies", "y"),
]

# Vectoriser token pattern: runs of two or more word characters (unicode letters, digits, _).
TFIDF_TOKEN = r"[\p{L}\p{N}_]{2,}"

# ROUGE tokeniser: lower case, every run outside [a-z0-9] becomes a space.
ROUGE_NON_ALNUM = r"[^a-z0-9]+"

# BLEU 13a tokeniser steps (pattern -> replacement), applied in order after newline removal.
BLEU_13A_STEPS = [
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_text(text) -> Column:
    """Lower-cased text with punctuation and clitics split off by spaces (tokens = runs of
    non-space characters). NULL becomes the empty string."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    t = F.regexp_replace(t, TOKEN_PUNCT, " ")
    t = F.regexp_replace(t, TOKEN_COLON_COMMA, " $1")
    t = F.regexp_replace(t, TOKEN_CLITIC_FAST, " ")
    return F.regexp_replace(t, TOKEN_FINAL_PERIOD, " $1")


def keep_token(tok, stopwords: bool = True) -> Column:
    keep = _col(tok).rlike(TOKEN_KEEP)
    return keep & ~_col(tok).isin(STOPWORDS_EN) if stopwords else keep


def tokenize(text, stopwords: bool = True) -> Column:
    """Word tokens: split punctuation and clitics, lower-case, keep alphanumeric tokens,
    drop English stop words. NULL text gives an empty array (it still counts as a document).
    For whole corpora prefer ``token_rows`` (exploded rows, code-generated filter)."""
    return F.filter(F.split(token_text(text), r"\s+"), lambda x: keep_token(x, stopwords))


def token_rows(df, key: str, text: str, stopwords: bool = True, out: str = "term", mark: bool = False):
    """``(key, term)`` one row per kept token (multiplicity kept): explode + a row-level filter
    that whole-stage codegen compiles (``rlike`` and an ``InSet`` of stop words). With ``mark``
    each text has one more row, without a term."""
    tokens = F.split(token_text(F.col(text)), r"\s+")
    if mark:
        ex = df.select(key, F.explode(F.array_append(tokens, F.lit(None).cast("string"))).alias(out))
        return ex.filter(F.col(out).isNull() | keep_token(F.col(out), stopwords))
    ex = df.select(key, F.explode(tokens).alias(out))
    return ex.filter(keep_token(F.col(out), stopwords))


def python_tokenizer(text: str | None) -> list[str]:
    """The same rules as ``tokenize`` for one string in plain Python (``regex`` module for the
    ``\\p{..}`` classes) -- an example of a user tokenizer callable for ``bm25.build_index``."""
    import regex

    a = regex.ASCII  # \s is ASCII whitespace, as in Java regex
    t = (text or "").lower()
    t = regex.sub(TOKEN_PUNCT, " ", t)
    t = regex.sub(TOKEN_COLON_COMMA, r" \1", t)
    t = regex.sub(TOKEN_CLITIC, r" \2", t, flags=a)
    t = regex.sub(TOKEN_FINAL_PERIOD, r" \1", t, flags=a)
    stop = set(STOPWORDS_EN)
    return [w for w in regex.split(r"\s+", t, flags=a) if regex.fullmatch(r"[\p{L}\p{N}]+", w) and w not in stop]


def tokenizer_udf(fn):
    """Wrap a per-text Python tokenizer as an Arrow-batched pandas UDF -> ARRAY<STRING>."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(fn(x)) for x in texts])

    return run


def token_count(text) -> Column:
    """Whitespace token count; NULL stays NULL."""
    return F.size(F.filter(F.split(F.trim(_col(text)), r"\s+"), lambda x: x != F.lit("")))


def whitespace_tokens(text) -> Column:
    """Case-sensitive whitespace tokens without empties."""
    return F.filter(F.split(_col(text), r"\s+"), lambda x: x != F.lit(""))


def tfidf_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TFIDF_TOKEN), 0)


def rouge_tokens(text) -> Column:
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), ROUGE_NON_ALNUM, " "))
    return F.filter(F.split(t, " "), lambda x: x != F.lit(""))


def bleu_tokens(text) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    for pat, rep in BLEU_13A_STEPS:
        t = F.regexp_replace(t, pat, rep)
    return F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != F.lit(""))


def ngrams(tokens, n: int) -> Column:
    """Ordered n-grams (space-joined) of a token array; empty when fewer than n tokens.

    ``sequence(0, -1)`` would count downwards, hence the guard."""
    toks = _col(tokens)
    return F.when(
        F.size(toks) >= n,
        F.transform(F.sequence(F.lit(0), F.size(toks) - n),
                    lambda i: F.array_join(F.slice(toks, i + 1, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def ordered_distinct_nonempty(arr) -> Column:
    """Unique elements in first-occurrence order, empty strings removed."""
    return F.filter(F.array_distinct(_col(arr)), lambda x: x != F.lit(""))


def instruct_prefix(task: str, query) -> Column:
    return F.format_string("Instruct: %s\nQuery: %s", F.lit(task), _col(query))
