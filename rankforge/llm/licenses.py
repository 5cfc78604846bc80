"""License scan by ordered signature rules, in DataFrame functions only.

Rules are written by family: each family has a keyword (the prefilter: the rule's pattern runs only on
texts whose normalised form contains it, so every match of the pattern must contain it at the start of a word) and patterns for its name, its identifier and its grant, with and without version.
Overlapping detections are resolved by priority and containment: a detection is dropped if another of higher
priority (or equal priority and longer, or equal length and earlier in the rules) overlaps and contains it.

A text is normalised to its words (lower-cased ASCII, joined and framed by one blank), so a rule is a regex over
words. Everything is an expression on one row: no shuffle, no Python, a hot source or group of copies is spread
as the input is. Texts without any keyword never reach the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words in a text that is not lower-cased.
ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_LIC = "licen[sc]e"
_V = "(v|ver|version)? ?"
#: Families: label, keyword of the prefilter, pattern of the name, versions that have a label of their own.
FAMILIES = (
    ("apache", "apache", "apache( software)?( foundation)?", ("1 0", "1 1", "2 0")),
    ("mit", "mit", "mit", ()),
    ("bsd", "bsd", "bsd( (2|3|4|two|three|four) clause)?", ()),
    ("bsd-2-clause", "bsd", "(simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)", ()),
    ("bsd-3-clause", "bsd", "(new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", ()),
    ("bsd-4-clause", "bsd", "(original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", ()),
    ("lgpl", "general public", "(gnu )?(lesser|library) general public", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", "affero", "(gnu )?affero general public", ("1", "1 0", "3", "3 0")),
    ("gpl", "general public", "(gnu )?general public", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("gfdl", "free documentation", "(gnu )?free documentation", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", "mozilla( foundation)? public", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public", ("1 0", "2 0")),
    ("cddl", "common development", "common development and distribution", ("1 0", "1 1")),
    ("cpl", "common public", "common public", ("1 0",)),
    ("eupl", "european union", "european union public", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("zlib", "zlib", "zlib( libpng)?", ()),
    ("boost", "boost", "boost software", ("1 0",)),
    ("isc", "isc", "isc", ()),
    ("unlicense", "unlicense", "(the )?unlicense", ()),
    ("wtfpl", "what the fuck", "do what the fuck you want to public", ("2", "2 0")),
    ("postgresql", "postgresql", "postgresql", ()),
    ("python", "python", "python( software foundation)?", ("2", "2 0")),
    ("php", "php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby", ()),
    ("openssl", "openssl", "openssl", ()),
    ("openldap", "openldap", "openldap public", ("2 7", "2 8")),
    ("ms-pl", "microsoft public", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", ()),
    ("apsl", "apple public", "apple public source", ("1 0", "1 1", "1 2", "2 0")),
    ("osl", "open software", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ofl", "open font", "(sil )?open font", ("1 0", "1 1")),
    ("odbl", "open database", "open database", ("1 0",)),
    ("odc-by", "open data commons", "open data commons attribution", ("1 0",)),
    ("pddl", "public domain dedication", "(open data commons )?public domain dedication and", ("1 0",)),
    ("sspl", "server side public", "server side public", ("1", "1 0")),
    ("busl", "business source", "business source", ("1 0", "1 1")),
    ("elastic", "elastic", "elastic", ("1 0", "2 0")),
    ("upl", "universal permissive", "universal permissive", ("1 0",)),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)?", ()),
    ("vim", "vim", "vim", ()),
    ("ijg", "independent jpeg", "independent jpeg group", ()),
    ("x11", "x11", "x11", ()),
    ("curl", "curl", "curl", ()),
    ("ibm-pl", "ibm public", "ibm public", ("1 0",)),
    ("qpl", "q public", "q public", ("1 0",)),
    ("sleepycat", "sleepycat", "sleepycat", ()),
    ("zpl", "zope", "zope public", ("1 1", "2 0", "2 1")),
    ("cecill", "cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
)
#: Creative Commons elements and their labels.
CC = (("attribution noncommercial noderivatives", "by nc nd", "cc-by-nc-nd"), ("attribution noncommercial sharealike", "by nc sa", "cc-by-nc-sa"),
      ("attribution noncommercial", "by nc", "cc-by-nc"), ("attribution noderivatives", "by nd", "cc-by-nd"),
      ("attribution sharealike", "by sa", "cc-by-sa"), ("attribution", "by", "cc-by"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Single rules: priority, label, keyword, pattern.
SINGLE = (
    (90, "mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    (90, "isc", "permission to use copy", "permission to use copy modify and( or)? distribute this software for any purpose"),
    (90, "bsd", "redistribution", "redistributions? and use in source and binary forms"),
    (90, "zlib", "provided as is without", "this software is provided as is without any express or implied warranty"),
    (90, "unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    (70, "cc0", "cc0", "cc0( 1 0)?( universal)?"),
    (70, "cc0", "no rights reserved", "no rights reserved"),
    (40, "public-domain", "public domain", "(in|into|to) the public domain"),
    (30, "spdx", "spdx", "spdx license identifier( [a-z0-9]+){1,4}"),
    (20, "reserved", "rights reserved", "(all|some) rights reserved"),
    (20, "copyright", "copyright", "copyright( c)?( [12][0-9]{3}){1,2}( by)?( [^ ]+)?"),
    (15, "proprietary", "proprietary", "proprietary and confidential"),
    (15, "confidential", "confidential", "strictly confidential"),
    *((15, "no-distribution", f"{no} not {be}{key}", f"{no} not {be}{verb}") for no in ("may", "must", "do") for be in ("", "be ")
      for key, verb in (("cop", "(copied|copy)"), ("redistribut", "redistributed?"), ("distribut", "distributed?"))),
    (10, "permission-required", "permission", "(without|with) (the )?(prior )?written permission"),
    (5, "generic", "licen", "(licensed|released|distributed) under( [^ ]+){1,4} licen[sc]e"),
)


def rules() -> list[tuple[int, str, str, str]]:
    """All signature rules ``(priority, label, keyword, pattern)`` in order, built from the families."""
    out = [(p, label, key, f" {rx} ") for p, label, key, rx in SINGLE if p >= 70]
    for label, key, name, versions in FAMILIES:
        for v in sorted(versions, key=len, reverse=True):
            out.append((80, f"{label}-{v.replace(' ', '.')}", key, f" {name} {_LIC} {_V}{v} "))
            out.append((78, f"{label}-{v.replace(' ', '.')}", key, f" {name}( {_LIC})? {_V}{v} "))
        out.append((60, label, key, f" {name} (public )?{_LIC} "))
        out.append((58, label, key, f" {_LIC} {name} "))
        out.append((56, label, key, f" (under|terms of) (the )?{name} "))
        if label in ("lgpl", "agpl", "gpl", "gfdl", "mpl", "epl", "cddl", "cpl", "eupl", "apsl", "osl", "afl", "ofl"):
            out.append((50, label, label, f" {label} ?{_V}[0-9]( [0-9])? "))
            out.append((48, label, label, f" {label} "))
    for name, code, label in CC:
        for v in CC_VERSIONS:
            out.append((76, f"{label}-{v.replace(' ', '.')}", "cc by", f" cc {code} {v} "))
            out.append((76, f"{label}-{v.replace(' ', '.')}", "creative commons", f" creative commons {name} {v} "))
        out.append((66, label, "cc by", f" cc {code} "))
        out.append((66, label, "creative commons", f" creative commons {name} "))
    return out + [(p, label, key, f" {rx} ") for p, label, key, rx in SINGLE if p < 70]


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _places(norm: str, pattern: str) -> str:
    """SQL: ``(s, e)`` of the matches of a pattern, in order, as counts of the words before them. Matches are
    marked in one pass; the words that carry a mark give the places. The last blank of a match is left to the next one."""
    marked = f"regexp_replace({norm}, ' (' || substring({pattern}, 2, length({pattern}) - 2) || ')(?= )', concat(' ', chr(1), '$1', chr(2)))"
    at = lambda test, i: f"filter(transform(_w, (w, i) -> if({test}, {i}, null)), i -> i is not null)"
    pairs = f"zip_with({at('startswith(w, chr(1))', 'i - 1')}, {at('endswith(w, chr(2))', 'i')}, (s, e) -> named_struct('s', s, 'e', e))"
    return _let(marked, "_m", f"if(contains(_m, chr(1)), {_let('split(_m, chr(32))', '_w', pairs)}, cast(array() as array<struct<s:int,e:int>>))")


def _best(found: str) -> str:
    """SQL: the detections that no better one contains. Sorted by start, longest, priority and rule, whatever
    contains a detection and is better stands before it, and no more than ``_k`` places before: ``_k`` is the
    first power of two for which every detection ``_k`` places back starts too early to reach the end of this one
    at the greatest length of a detection. Time is linear in the detections of a text but for the sort."""
    early = "_d[j - k].s < -_d[j].l - _len"
    reach = f"aggregate(sequence(3, 30), 0, (a, b) -> if(a > 0, a, {_let('shiftleft(1, b)', 'k', f'if(k >= size(_d) or forall(sequence(k, size(_d) - 1), j -> {early}), k, 0)')}))"
    better = "y.l <= x.l and (y.q < x.q or (y.q = x.q and (-y.l - y.s > -x.l - x.s or (-y.l - y.s = -x.l - x.s and y.i < x.i))))"
    kept = f"filter(_d, (x, j) -> not exists(slice(_d, greatest(j - _k, 0) + 1, least(j, _k)), y -> {better}))"
    return _let(f"array_sort({found})", "_d", _let("coalesce(array_max(transform(_d, x -> -x.l - x.s)), 0)", "_len", _let(reach, "_k", kept)))


def _rule_table(spec: list[tuple[int, str, str, str]]) -> str:
    """SQL: the rules of each keyword."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    of = {}
    for i, (p, lab, key, rx) in enumerate(spec):
        of.setdefault(key, []).append(f"named_struct('p',{p},'i',{i},'label',{q(lab)},'rx',{q(rx)})")
    return "map(" + ",".join(f"{q(k)},array({','.join(r)})" for k, r in of.items()) + ")"


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: list[tuple[int, str, str, str]] | None = None) -> DataFrame:
    """Per document: id, ``n_words``, ``base`` (array of ``label, s``: places of the base phrases), ``found``
    (the detections that remain: ``p, label, s, e`` in word positions, by start) and ``score``, the largest priority
    of a detection over 100. A NULL or empty text has no words and no detections. Labels are sorted and distinct; equal
    detections of repeated rules count once. Very long texts with many detections take time linear in both."""
    spec = rules() if spec is None else spec
    keys = sorted({k for _, _, k, _ in spec} | {p for p, _ in BASE})
    # cheap test on the raw text: a keyword starts here; alternatives are grouped by their first letter
    letters = sorted({k[0] for k in keys})
    first = "|".join(f"{c}(?:{'|'.join(k[1:].replace(' ', ANY_CASE_GAP) for k in keys if k[0] == c)})" for c in letters)
    gate = f"(?i)(?<![a-z0-9])(?=[{''.join(letters)}])(?:{first})"
    low = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    low = low.withColumn("n_words", F.size(F.array_remove(F.split("_t", ANY_CASE_GAP), "")).cast("long")).withColumn(
        "_n", F.when(F.col("_t").rlike(gate), F.concat(F.lit(" "), F.regexp_replace(_lower(F.col("_t")), _GAP, " "), F.lit(" "))))
    low = low.withColumn("_n", F.regexp_replace("_n", "  +", " "))
    base = "concat(" + ", ".join(f"transform({_places('_n', repr(' ' + p + ' '))}, x -> named_struct('label', '{lab}', 's', x.s))" for p, lab in BASE) + ")"
    # each keyword is looked for once, then the rules of those that occur are run
    names = "array(" + ",".join(f"'{k}'" for k in sorted({k for _, _, k, _ in spec})) + ")"
    found = f"""flatten(transform(flatten(transform(filter({names}, k -> contains(_n, ' ' || k)), k -> element_at({_rule_table(spec)}, k))), r -> transform({_places('_n', 'r.rx')},
        x -> named_struct('s', x.s, 'l', -x.e, 'q', -r.p, 'i', r.i, 'label', r.label))))"""
    out = low.withColumn("base", F.when(F.col("_n").isNotNull(), F.expr(base))).withColumn("_f", F.when(F.col("_n").isNotNull(), F.expr(_best(found))))
    return out.select(
        "doc_id", "n_words", F.expr("coalesce(base, cast(array() as array<struct<label:string,s:int>>))").alias("base"),
        F.expr("coalesce(transform(_f, x -> named_struct('p', -x.q, 'label', x.label, 's', x.s, 'e', -x.l)), "
               "cast(array() as array<struct<p:int,label:string,s:int,e:int>>))").alias("found"),
        F.expr("coalesce(array_max(transform(_f, x -> -x.q)), 0) / 100D").alias("score"))


def digest(d: DataFrame) -> DataFrame:
    lab = F.transform("base", lambda x: x["label"])
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["s"])).cast("long").alias("last_word"),
        line(lab).alias("base_labels"), line(F.concat(lab, F.transform("found", lambda x: x["label"]))).alias("labels"), "score")
