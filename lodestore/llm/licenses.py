"""License scans by ordered signature rules, on column expressions alone (operator 10).

Rules are regular expressions with a priority, a label and a confidence, matched over the
whole lower-cased text, in which runs of blanks are one blank or line break and comment
marks at line starts are gone, so that a reference may be wrapped. The words that a match
must contain are read from the patterns: a text without any isn't examined further, and a
rule is only tried where it has its words. A rule gives all its matches. A detection is
suppressed if its interval lies within that of one with a higher priority, or with the
same priority and a longer interval.

Most rules come from names of licenses (label, how the name is written) and
three ways to refer to one; others are written out.
"""

from __future__ import annotations

import json
from functools import reduce
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ANY_CASE_WORD, ascii_lower

# Phrases of the data contract.
PHRASES = {
    "mit": ("under", "the", "mit", "license"),
    "apache-2": ("apache", "license", "version", "2"),
    "cc-by-nc": ("cc", "by", "nc"),
}

_V = r"[ ,]*(?:v\.?|ver\.?|version)? ?"
_GNU = r"(?:gnu )?"

# Label and written name of common licenses.
NAMES = [
    ("mit", r"(?:the )?mit(?: x11)?"),
    ("mit-0", r"mit no attribution|mit-0"),
    ("apache-1.0", rf"apache(?: software)? licen[sc]e{_V}1\.0|apache-1\.0"),
    ("apache-1.1", rf"apache(?: software)? licen[sc]e{_V}1\.1|apache-1\.1"),
    ("apache-2.0", rf"apache(?: software)?(?: licen[sc]e)?{_V}2(?:\.0)?\b|apache-2\.0|asl ?2\.0"),
    ("gpl-1.0", rf"(?:{_GNU}gpl|{_GNU}general public licen[sc]e){_V}1(?:\.0)?\b|gpl-1\.0"),
    ("gpl-2.0", rf"(?:{_GNU}gpl|{_GNU}general public licen[sc]e){_V}2(?:\.0)?\b|gpl-2\.0|gplv2"),
    ("gpl-3.0", rf"(?:{_GNU}gpl|{_GNU}general public licen[sc]e){_V}3(?:\.0)?\b|gpl-3\.0|gplv3"),
    ("lgpl-2.0", rf"(?:{_GNU}lgpl|{_GNU}library general public licen[sc]e){_V}2(?:\.0)?\b|lgpl-2\.0|lgplv2\b"),
    ("lgpl-2.1", rf"(?:{_GNU}lgpl|{_GNU}lesser general public licen[sc]e){_V}2\.1|lgpl-2\.1"),
    ("lgpl-3.0", rf"(?:{_GNU}lgpl|{_GNU}lesser general public licen[sc]e){_V}3(?:\.0)?\b|lgpl-3\.0|lgplv3"),
    ("agpl-3.0", rf"(?:{_GNU}agpl|{_GNU}affero general public licen[sc]e){_V}3(?:\.0)?\b|agpl-3\.0|agplv3"),
    ("gfdl-1.2", rf"{_GNU}free documentation licen[sc]e{_V}1\.2|gfdl-1\.2"),
    ("gfdl-1.3", rf"{_GNU}free documentation licen[sc]e{_V}1\.3|gfdl-1\.3"),
    ("bsd-2-clause", r"(?:simplified |freebsd |2-clause |two-clause )bsd|bsd[ -]2(?:-clause)?"),
    ("bsd-3-clause", r"(?:new |revised |modified |3-clause |three-clause )bsd|bsd[ -]3(?:-clause)?"),
    ("bsd-4-clause", r"(?:original |4-clause |four-clause )bsd|bsd[ -]4(?:-clause)?"),
    ("0bsd", r"0bsd|zero[- ]clause bsd|bsd zero clause"),
    ("isc", r"\bisc\b"),
    ("zlib", r"zlib(?:/libpng)?"),
    ("mpl-1.0", rf"(?:mpl|mozilla public licen[sc]e){_V}1\.0|mpl-1\.0"),
    ("mpl-1.1", rf"(?:mpl|mozilla public licen[sc]e){_V}1\.1|mpl-1\.1"),
    ("mpl-2.0", rf"(?:mpl|mozilla public licen[sc]e){_V}2(?:\.0)?\b|mpl-2\.0"),
    ("epl-1.0", rf"(?:epl|eclipse public licen[sc]e){_V}1(?:\.0)?\b|epl-1\.0"),
    ("epl-2.0", rf"(?:epl|eclipse public licen[sc]e){_V}2(?:\.0)?\b|epl-2\.0"),
    ("cddl-1.0", rf"(?:cddl|common development and distribution licen[sc]e){_V}1\.0|cddl-1\.0"),
    ("cddl-1.1", rf"(?:cddl|common development and distribution licen[sc]e){_V}1\.1|cddl-1\.1"),
    ("cpl-1.0", rf"common public licen[sc]e{_V}1\.0"),
    ("eupl-1.1", rf"(?:eupl|european union public licen[sc]e){_V}1\.1|eupl-1\.1"),
    ("eupl-1.2", rf"(?:eupl|european union public licen[sc]e){_V}1\.2|eupl-1\.2"),
    ("artistic-1.0", rf"artistic licen[sc]e{_V}1\.0|artistic-1\.0"),
    ("artistic-2.0", rf"artistic licen[sc]e{_V}2\.0|artistic-2\.0"),
    ("bsl-1.0", rf"boost(?: software)? licen[sc]e{_V}(?:1\.0)?|bsl-1\.0"),
    ("busl-1.1", rf"business source licen[sc]e{_V}1\.1|busl-1\.1"),
    ("sspl-1.0", rf"server side public licen[sc]e{_V}(?:1)?|sspl-1\.0"),
    ("elastic-2.0", rf"elastic licen[sc]e{_V}2(?:\.0)?\b|elastic-2\.0"),
    ("unlicense", r"(?:the )?unlicense"),
    ("wtfpl", r"wtfpl"),
    ("psf-2.0", rf"psf licen[sc]e|python software foundation licen[sc]e{_V}(?:2)?|psf-2\.0"),
    ("php-3.0", rf"php licen[sc]e{_V}3(?:\.0)?\b"),
    ("php-3.01", rf"php licen[sc]e{_V}3\.01"),
    ("ruby", r"ruby(?:'s)?"),
    ("openssl", r"openssl"),
    ("postgresql", r"postgresql"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)?"),
    ("ms-pl", r"microsoft public licen[sc]e|ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e|ms-rl"),
    ("afl-3.0", rf"academic free licen[sc]e{_V}3\.0|afl-3\.0"),
    ("osl-3.0", rf"open software licen[sc]e{_V}3\.0|osl-3\.0"),
    ("ofl-1.1", rf"(?:sil )?open font licen[sc]e{_V}(?:1\.1)?|ofl-1\.1"),
    ("odbl-1.0", rf"open (?:data commons open )?database licen[sc]e{_V}(?:1\.0)?|odbl(?:-1\.0)?"),
    ("cecill-2.1", rf"cecill{_V}2\.1|cecill-2\.1"),
    ("upl-1.0", rf"universal permissive licen[sc]e{_V}(?:1\.0)?|upl-1\.0"),
    ("vim", r"\bvim\b"),
    ("x11", r"\bx11\b"),
    ("hpnd", r"historical permission notice and disclaimer|\bhpnd\b"),
    ("blueoak-1.0", rf"blue oak model licen[sc]e{_V}(?:1\.0(?:\.0)?)?"),
    ("cc0-1.0", r"cc0(?:[ -]1\.0)?|cc[ -]zero"),
]

#: Creative Commons: element codes, written out, and the versions in use.
_CC = {
    "by": "attribution", "by-sa": "attribution[ -]+share ?alike", "by-nc": "attribution[ -]+non-?commercial", "by-nd": "attribution[ -]+no ?deriv(?:ative)?s(?: works)?",
    "by-nc-sa": "attribution[ -]+non-?commercial[ -]+share ?alike", "by-nc-nd": "attribution[ -]+non-?commercial[ -]+no ?deriv(?:ative)?s(?: works)?",
}
NAMES += [
    (f"cc-{code}-{version}", rf"cc[ -]{code.replace('-', '[ -]')}[ -]?{_V}{version.replace('.', chr(92) + '.')}|creative commons {name}{_V}{version.replace('.', chr(92) + '.')}")
    for code, name in _CC.items()
    for version in ("2.0", "2.5", "3.0", "4.0")
]

# Rules that aren't made from a name: priority, label, pattern, confidence.
WRITTEN = [
    (70, "mit", r"permission is hereby granted, free of charge, to any person", 0.95),
    (70, "isc", r"permission to use, copy, modify, and(?:/or)? distribute this software", 0.9),
    (70, "bsd", r"redistribution and use in source and binary forms", 0.9),
    (70, "bsd-3-clause", r"neither the name of .{0,80} (?:may|nor).{0,60}endorse or promote", 0.9),
    (70, "zlib", r"this software is provided 'as-is', without any express or implied", 0.9),
    (70, "gpl", r"this (?:program|library|file) is free software[;:,] you can redistribute it", 0.9),
    (70, "unlicense", r"released into the public domain", 0.85),
    (70, "wtfpl", r"do what the fuck you want to", 0.95),
    (70, "boost", r"distributed under the boost software licen[sc]e", 0.9),
    (60, "gpl", r"gnu general public licen[sc]e", 0.6),
    (60, "lgpl", r"gnu lesser general public licen[sc]e", 0.6),
    (60, "agpl", r"gnu affero general public licen[sc]e", 0.6),
    (60, "cc", r"creative commons[a-z -]{0,60}licen[sc]e", 0.5),
    (60, "cc-by", r"\bcc[ -]by\b", 0.5),
    (50, "public-domain", r"(?:in|into|to) the public domain", 0.6),
    (50, "proprietary", r"all rights reserved", 0.5),
    (50, "proprietary", r"proprietary and confidential", 0.7),
    (50, "no-redistribution", r"(?:may not|not permitted to|no) (?:be )?redistribut", 0.6),
    (50, "noncommercial", r"non-?commercial (?:use|purposes?)(?: only)?", 0.5),
    (40, "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 0.4),
    (40, "copyright", r"\(c\) ?(?:19|20)\d\d", 0.4),
    (10, "unknown-license", r"\b(?:un)?licen[sc]e[ds]?\b(?: (?:under|agreement|terms))?", 0.2),
    (10, "unknown-license", r"without (?:any )?warrant(?:y|ies)", 0.2),
]

_GRANT = r"\b(?:licen[sc]ed|released|distributed|available|provided|published|covered|governed)\b[^.]{0,40}?\b(?:under|by)(?: the)?(?: terms of)?(?: the)? "


def rules() -> list[dict]:
    """All rules in their order: priority downwards, then as listed. A blank in a pattern
    is a blank or a line break of the tidied text; ``need`` lists sets of words, of which
    every text that the pattern matches contains one set whole."""
    out = [(100, label, rf"spdx-licen[sc]e-identifier: ?{label.replace('.', chr(92) + '.')}(?![\w.-])", 1.0) for label, _ in NAMES]
    # A further word counts to the reference only in the same line: the next may begin another.
    out += [(90, label, rf"{_GRANT}(?:{name})(?:\x20\w+)? ?(?:licen[sc]e)?", 0.95) for label, name in NAMES]
    out += [(80, label, _named(name), 0.75) for label, name in NAMES]
    out += WRITTEN
    keys = ("priority", "label", "pattern", "confidence", "need")
    return [dict(zip(keys, (*r[:2], "(?s)" + r[2].replace(" ", r"\s"), r[3], needed(r[2])), strict=True)) for r in sorted(out, key=lambda r: -r[0])]


def _named(name: str) -> str:
    if _needs_word(name):
        return rf"(?<![\w-])(?:{name})(?![\w-]) licen[sc]e\b|\blicen[sc]e[ds]?[\"')]{{0,2}} ?[:=(] ?[\"'(]{{0,2}}(?:{name})(?![\w-])"
    return rf"(?<![\w.-])(?:{name})(?![\w-])(?: licen[sc]e\b)?"


def _needs_word(name: str) -> bool:
    """Whether a name is an everyday word ("mit" is German) unless "license" is beside it."""
    return not any(c.isdigit() for c in name.replace("(?: x11)?", ""))


def _spelled(parsed) -> list[str]:
    """What a parsed pattern spells, per alternative; blanks where it isn't fixed."""
    out = [""]
    for kind, arg in parsed:
        if kind is sre.LITERAL:
            more = [chr(arg)]
        elif kind is sre.BRANCH:
            more = [s for part in arg[1] for s in _spelled(part)]
        elif kind is sre.SUBPATTERN:
            more = _spelled(arg[3])
        elif kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            more = [""]
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0]:
            more = [f" {s} " for s in _spelled(arg[2])]
        else:
            more = [" "]
        out = list(dict.fromkeys(a + b for a in out for b in more))
    return out


def needed(pattern: str) -> list[list[str]]:
    """Sets of words (of two characters at least), one of which is whole in each match."""
    sets = {frozenset(w for w in s.split() if len(w) > 1 and w not in _EVERYWHERE) for s in _spelled(sre.parse(pattern))}
    return sorted(sorted(s) for s in sets if not any(other < s for other in sets))


#: Words that most texts have, so that they tell rules apart badly.
_EVERYWHERE = {"any", "available", "be", "by", "can", "covered", "distributed", "do", "for", "governed", "in", "is", "it", "licensed", "may", "no", "not", "of", "or", "provided", "published", "released", "terms", "the", "this", "to", "under", "want", "what", "without", "you"}


def _opens(gate: str, word: str) -> bool:
    """Whether the gate finds ``word``: short names are only looked for at its start."""
    return word.startswith(gate) if _short(gate) else gate in word


def _short(gate: str) -> bool:
    return len(gate) < 5 and gate.isalpha()


def gates(table: list[dict]) -> list[str]:
    """Words of which every match of every rule contains one: the word in most sets
    that have none yet is added until all have one."""
    left = {tuple(s) for r in table for s in r["need"]}
    out: list[str] = []
    while left:
        # The last keys only make the order definite.
        best = max({w for s in left for w in s}, key=lambda w: (sum(any(_opens(w, x) for x in s) for s in left), len(w), w))
        out.append(best)
        left = {s for s in left if not any(_opens(best, x) for x in s)}
    return out


#: Blanks and line breaks beyond ASCII count as " " and "\n".
_WIDE_BLANKS = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u205f\u3000\ufeff"
_WIDE_BREAKS = "\x85\u2028\u2029"
#: A line break with the blanks before it and the comment marks that begin the next line;
#: a run of blanks that isn't one " " already.
_LINE_BREAK = r"[ \t]*+[\n\r\x0B\f](?:[ \t\n\r\x0B\f/*#;%>|!\"<-]*+(?:(?:dnl|rem)[ \t]++)?+)"
_BLANKS = r"[ \t](?:[ \t]++|(?<=\t))"


def _tidy(low: Column) -> Column:
    """``low`` with one blank for a run of blanks, and one line break for a run that has
    any, with the comment marks behind it."""
    plain = F.translate(low, _WIDE_BLANKS + _WIDE_BREAKS, " " * len(_WIDE_BLANKS) + "\n" * len(_WIDE_BREAKS))
    return F.regexp_replace(F.regexp_replace(plain, _LINE_BREAK, "\n"), _BLANKS, " ")


DETECTIONS = "array<struct<priority:int,label:string,confidence:double,start:int,size:int>>"
KEPT = "array<struct<label:string,confidence:double>>"


def _gated(text: Column, lower: Column, table: list[dict]) -> Column:
    """Whether a text has a gate word: short ones at the start of a word, where all rules
    have them, others anywhere."""
    words = gates(table)
    found = (F.contains(lower, F.lit(w)) for w in words if not _short(w))
    return reduce(lambda a, b: a | b, found) | F.rlike(text, F.lit(rf"(?<![A-Za-z0-9_])(?i:{'|'.join(w for w in words if _short(w))})"))


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Numbers of the words where ``phrase`` begins."""

    def begins(w: Column, i: Column) -> Column:
        follow = (F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(phrase[1:], 1))
        return F.when(reduce(lambda a, b: a & b, follow, w == phrase[0]), i.cast("long"))

    return F.filter(F.transform(words, begins), lambda i: i.isNotNull())


def _detections(text: Column, table: Column) -> Column:
    """What the rules find in a text, without suppressed detections."""

    def look(r: Column) -> Column:
        said = F.call_function("regexp_extract_all", text, r["pattern"], F.lit(0))
        between = F.split(text, r["pattern"], -1)

        def step(state: Column, pair: Column) -> Column:
            start, size = state["at"] + F.length(pair["gap"]), F.length(pair["said"])
            one = F.struct(r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"), start.alias("start"), size.alias("size"))
            return F.struct((start + size).alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

        pairs = F.filter(F.arrays_zip(between.alias("gap"), said.alias("said")), lambda x: x["said"].isNotNull())
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(DETECTIONS).alias("found")), step, lambda state: state["found"])

    return _unsuppressed(F.flatten(F.transform(F.filter(table, lambda r: F.rlike(text, r["pattern"])), look)))


def _unsuppressed(found: Column) -> Column:
    """The distinct labels with their confidences of detections that aren't suppressed.
    In order of start, longer and higher ones first, whatever suppresses a detection comes
    before it and hasn't ended, so only such detections are held against it."""

    def within(d: Column, e: Column) -> Column:
        inside = (e["start"] <= d["start"]) & (d["start"] + d["size"] <= e["start"] + e["size"])
        return inside & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["size"] > d["size"])))

    def step(state: Column, x: Column) -> Column:
        d = x["d"]
        still = F.filter(state["open"], lambda e: e["start"] + e["size"] > d["start"])
        one = F.struct(d["label"].alias("label"), d["confidence"].alias("confidence"))
        kept = F.when(F.exists(still, lambda e: within(d, e)), state["kept"]).otherwise(F.array_union(state["kept"], F.array(one)))
        return F.struct(F.concat(still, F.array(d)).alias("open"), kept.alias("kept"))

    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["size"]).alias("size"), (-d["priority"]).alias("priority"), d.alias("d"))))
    start = F.struct(F.array().cast(DETECTIONS).alias("open"), F.array().cast(KEPT).alias("kept"))
    return F.aggregate(order, start, step, lambda state: state["kept"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of
    every row; null texts count as empty, labels are "" where nothing is found, and the
    score is the largest confidence (1 for the contract's phrases), else 0.

    There is no shuffle and no Python: all is one projection over the scan.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    listed = rules()
    schema = "array<struct<priority:int,label:string,pattern:string,confidence:double,need:array<array<string>>>>"
    table = F.from_json(F.lit(json.dumps(listed)), schema)
    words = F.from_json(F.lit(json.dumps(sorted({w for r in listed for s in r["need"] for w in s}))), "array<string>")
    lower = F.lower(text)
    phrased = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(lower, F.lit(w)) for w in p)) for p in PHRASES.values()))
    gated = docs.select("doc_id", F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), text.alias("text"), _gated(text, lower, listed).alias("gated"), phrased.alias("phrased"))
    lowered = gated.select("doc_id", "n_words", "gated", "phrased", F.when(F.col("gated") | F.col("phrased"), ascii_lower(F.col("text"))).alias("low"))
    split = lowered.select("doc_id", "n_words", F.when(F.col("phrased"), F.regexp_extract_all("low", F.lit(ALNUM_WORD), 0)).alias("words"), F.when(F.col("gated"), _tidy(F.col("low"))).alias("tidy"))
    # The words are found once per text, and bound to a name for all rules.
    has = F.array(F.filter(words, lambda w: F.contains(F.col("tidy"), w)))
    asked = F.transform(has, lambda h: F.filter(table, lambda r: F.exists(r["need"], lambda s: F.size(F.array_except(s, h)) == 0)))[0]
    found = F.transform(F.array(F.struct(F.col("tidy").alias("text"), asked.alias("rules"))), lambda x: _detections(x["text"], x["rules"]))[0]
    placed = split.select("doc_id", "n_words", *(_places(F.col("words"), p).alias(f"at_{k}") for k, p in enumerate(PHRASES.values())), F.when(F.col("tidy").isNotNull(), found).alias("found"))
    ats = [F.coalesce(F.col(f"at_{k}"), F.array().cast("array<bigint>")) for k in range(len(PHRASES))]
    everywhere = F.concat(*ats)
    base = F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(ats, PHRASES, strict=True))))
    found = F.coalesce(F.col("found"), F.array().cast(KEPT))
    counted = placed.select("doc_id", "n_words", everywhere.alias("places"), F.array_sort(base).alias("base"), F.transform(found, lambda d: d["label"]).alias("own"), F.transform(found, lambda d: d["confidence"]).alias("sure"))
    return counted.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base", "own"))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("sure"), F.lit(0.0))).alias("score"),
    )
