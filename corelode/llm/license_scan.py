r"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags in whole texts, and a shunting-yard
parser evaluates the and/or/with expressions behind the tags.

Texts become lower-case words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z) joined by single blanks, so a
phrase matches wherever its words stand consecutively; overlapping places all count. Expressions are read from the
line of the tag in the original text, whatever stands between the tag's words.

An expression is evaluated over its postfix form to three values. Labels: those of all identifiers, and ``exception`` for
`with`; ``+`` and version suffixes fold into the family. Certainty: 1 for an identifier of a known family, 0.5 for another;
`or` takes the larger side (any branch will do), `and` the smaller (all must hold), `with` that of its identifier.
Permissive: whether permissive families alone meet it, by any branch of `or` and all of `and`; an exception changes nothing.

Score: the largest that any evidence gives: the certainty of a tag that parses, 0.9 for a base phrase, 0.7 for another phrase, 0.4 for a
tag whose expression doesn't parse; without any 0. `permissive` is true if all tags that parse are, null if none does.

Defined results: null and empty texts have no words, null places, empty labels and score 0; null or repeated ids are
kept, each row is scanned alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from corelode.llm.common import ALNUM, pair

# The phrases whose places count, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices.
MORE_PHRASES = {
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software": "isc",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"(?<![0-9A-Za-z\x80-\U0010ffff])spdx[\x00-/:-@\[-`{-\x7f]+license[\x00-/:-@\[-`{-\x7f]+identifier[ \t]*[:=][ \t]*([^\r\n]*)", re.I)
#: Families that ask for no more than a notice.
PERMISSIVE = {"mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0"}
#: Identifier prefixes and families, the longest match counts.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "0bsd": "bsd", "mpl": "mpl", "isc": "isc", "epl": "epl", "cc-by": "cc-by", "cc0": "cc0", "unlicense": "unlicense", "zlib": "zlib"}
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_JUNK = re.compile(r"(\*/|-->|[#\"'`;]).*$")


def family(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    return max((f for f in FAMILIES if name == f or name.startswith(f + "-")), key=len, default="")


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None where it is malformed. `with` binds strongest, then
    `and`, then `or`; all group to the left."""
    out, held, operand_next = [], [], True
    tokens = _TOKEN.findall(expression)
    if not tokens or _TOKEN.sub("", expression).strip():
        return None
    for t in tokens:
        low = t.lower()
        if low in _STRENGTH:
            if operand_next:
                return None
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif t == "(":
            if not operand_next:
                return None
            held.append(t)
        elif t == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


class Value(NamedTuple):
    """What an expression comes to."""

    labels: frozenset[str]
    certainty: float
    permissive: bool
    whole: bool = True  # of a single identifier


def evaluate(expression: str) -> Value | None:
    """None where it doesn't parse."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[Value] = []
    for t in postfix:
        if t not in _STRENGTH:
            name = family(t)
            stack.append(Value(frozenset({name or "other"}), 1.0 if name else 0.5, name in PERMISSIVE))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            if not (left.whole and right.whole):  # it joins two identifiers, not expressions
                return None
            stack.append(Value(left.labels | {"exception"}, left.certainty, left.permissive, False))
        else:
            pick, meets = (max, left.permissive or right.permissive) if t == "or" else (min, left.permissive and right.permissive)
            stack.append(Value(left.labels | right.labels, pick(left.certainty, right.certainty), meets, False))
    return stack[0]


@lru_cache(1)
def automaton():
    found = ahocorasick.Automaton()
    for phrase in (*BASE_PHRASES, *MORE_PHRASES, TAG):
        found.add_word(f" {phrase} ", (len(phrase) + 2, phrase))
    found.make_automaton()
    return found


def scan(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive."""
    words = (text or b"").translate(ALNUM).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    places, base, more, tagged = [], set(), set(), False
    for end, (size, phrase) in automaton().iter(line):
        if phrase in BASE_PHRASES:
            places.append(end + 1 - size)
            base.add(BASE_PHRASES[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            more.add(MORE_PHRASES[phrase])
    score = 0.9 if base else 0.7 if more else 0.0
    permissive = None
    if tagged:
        named = [evaluate(_JUNK.sub("", x).strip()) for x in _TAG_LINE.findall(text.decode("utf-8", "replace"))]
        known = [x for x in named if x is not None]
        score = max([score, 0.4, *(x.certainty for x in known)])  # more evidence never takes any away
        permissive = all(x.permissive for x in known) if known else None
        more.update(*(x.labels for x in known))
    where = (line.count(" ", 0, min(places)), line.count(" ", 0, max(places))) if places else (None, None)
    return len(words), len(places), *where, ",".join(sorted(base)), ",".join(sorted(base | more)), score, permissive


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "permissive": pa.bool_()}

    def run(batches):
        for b in batches:
            found = [scan(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in found], t) for k, t in enumerate(types.values()))], names=["doc_id", *types])

    out = pair(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean")
    return out.withColumnRenamed("doc_id", id_col)
