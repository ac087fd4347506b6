"""License scans: an Aho-Corasick automaton over normalised text finds identifier tags and notice
phrases, and a shunting-yard parser evaluates licence expressions with and/or/with.

Text is taken as bytes, A-Z lower-cased and every non-word byte made a space, so the words stand between
spaces and one automaton pass finds all phrases, overlapping ones too. Tags (`SPDX-License-Identifier:`) are
the places where the automaton saw their three words and a colon follows; what stands behind is their value.

Cases: the tag's words without a colon, or with nothing behind it, are no tag; sentence punctuation is no part of an
identifier, and an expression ends before a word that doesn't look like one; null and empty texts have no words and no labels (score 0.0); ties need no order, as labels are sets;
repeated rows give repeated rows; other columns pass through `license_columns` untouched, and a column that
has one of its output names is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, small_batches

# Phrases of the base labels, and phrases of licence notices with the identifier they stand for.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license": "apache",
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "the above copyright notice and this permission notice shall be included": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of": "bsd-3-clause",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0-1.0",
    "creative commons zero": "cc0-1.0",
    "public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl-1.0",
    "do what the fuck you want to public license": "wtfpl",
    "zlib license": "zlib",
    "proprietary and confidential": "proprietary",
    "no part of this publication may be reproduced": "proprietary",
}
TAG = "spdx license identifier"
#: How sure a finding makes us, strongest first: an evaluated tag, a base phrase, another notice.
TAG_SCORE, BASE_SCORE, NOTICE_SCORE = 1.0, 0.8, 0.6
#: Licences that permit reuse, for the verdict on an expression.
ACCEPTED = frozenset("mit mit-0 apache-2.0 bsd-2-clause bsd-3-clause isc zlib bsl-1.0 unlicense cc0-1.0 cc-by-4.0 0bsd".split())
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_COLON = re.compile(rb"[ \t]*:[ \t]*")
_LINE_END = re.compile(rb"[\r\n]")
# Identifiers of one word without a digit; all others have a hyphen or a digit.
ONE_WORD = frozenset("mit isc zlib unlicense wtfpl beerware ncsa ntp psf ruby sleepycat vim postgresql openssl php xnet none noassertion".split())


def is_identifier(low: str) -> bool:
    """Whether a lower-case word looks like an identifier of a licence, so that prose behind a tag isn't taken for one."""
    return low.rstrip("+") in ONE_WORD or ("-" in low.strip("-") or any(c.isdigit() for c in low)) and any(c.isalpha() for c in low)


def to_postfix(expression: str, fits: Callable[[str], bool] | None = None) -> list[str] | None:
    """Shunting-yard: the longest well-formed expression that `expression` begins with, in postfix order; None if there is none. Identifiers are lower-cased; `+` stays part of them, a full stop or colon at their end doesn't, and ends the expression. With `fits`, a word that doesn't fit is no identifier."""
    best: tuple[int, list[str]] | None = None
    out: list[str] = []
    ops: list[str] = []
    operand, ends = True, False
    for match in _TOKEN.finditer(expression):
        low = match[0].lower()
        bare = low.rstrip(".:")
        if bare != low:
            low, ends = bare, True
        if ends and not low:
            break
        if operand:
            if low == "(":
                ops.append(low)
                continue
            if low == ")" or low in PRECEDENCE or fits is not None and not fits(low):
                break
            out.append(low)
            operand = False
        elif low in PRECEDENCE:
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif low == ")" and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            break
        if not operand and "(" not in ops:
            best = len(out), ops[::-1]
        if ends:
            break
    return best and out[: best[0]] + best[1]


def evaluate(postfix: list[str], accepted: frozenset[str] = None) -> tuple[bool, list[str]]:
    """Whether the accepted licences satisfy an expression, and its identifiers in order: `or` needs one side, `and` both, and an exception tied by `with` stands or falls with its licence."""
    accepted = ACCEPTED if accepted is None else accepted
    stack: list[bool] = []
    names: list[str] = []
    for token in postfix:
        if token not in PRECEDENCE:
            names.append(token)
            stack.append(token in accepted)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left or right if token == "or" else left and right if token == "and" else left)
    return stack.pop(), names


def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        auto.add_word(f" {phrase} ", phrase)
    auto.make_automaton()
    return auto


_TO_SPACES = bytes(b + 32 if 65 <= b <= 90 else b if ALNUM[b] else 32 for b in range(256))
_EDGES = re.compile(rb" +")


def scan(raw: bytes, auto) -> tuple[int, list[tuple[int, str]], list[str]]:
    """Words of a text, (first word, phrase) of each phrase found, and the expressions of its tags."""
    words = raw.translate(_TO_SPACES).split()
    found = []
    line = f" {b' '.join(words).decode('latin-1')} "
    at = word = 0
    for end, phrase in auto.iter(line):
        start = end - len(phrase) - 1
        # Ends come in order, starts need not: count spaces from the last place, forwards or backwards.
        word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        found.append((word, phrase))
    tagged = [w for w, p in found if p == TAG]
    return len(words), found, tag_values(raw, tagged) if tagged else []


def tag_values(raw: bytes, tagged: list[int]) -> list[str]:
    """What stands behind each tag, to the end of its line or the next tag. tagged: the numbers of the first words of the automaton's hits."""
    words = [m.span() for m in _RAW_WORD.finditer(raw)]
    colons = [(words[w][0], _COLON.match(raw, words[w + 2][1])) for w in tagged]
    places = [(start, colon.end()) for start, colon in colons if colon]
    out = []
    for k, (_, at) in enumerate(places):
        to = places[k + 1][0] if k + 1 < len(places) else len(raw)
        end = _LINE_END.search(raw, at, to)
        value = raw[at : end.start() if end else to]
        if value:
            out.append(value.decode("utf-8", "replace"))
    return out


def judged(n_words: int, found: list[tuple[int, str]], tags: list[str]) -> tuple:
    base = [(w, p) for w, p in found if p in BASE]
    labels = {BASE[p] for _, p in base}
    own = {NOTICES[p] for _, p in found if p in NOTICES}
    expressions, verdicts = [], []
    for tag in tags:
        postfix = to_postfix(tag, is_identifier)
        if postfix:
            expressions.append(" ".join(postfix))
            ok, names = evaluate(postfix)
            own.update(names)
            verdicts.append(ok)
    score = max([0.0, *[TAG_SCORE] * bool(expressions), *[BASE_SCORE] * bool(labels), *[NOTICE_SCORE] * bool(own)])
    places = [w for w, _ in base]
    return (n_words, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), expressions, all(verdicts) if verdicts else None, score)


_OUT = [
    ("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()),
    ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("expressions", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("permissive", T.BooleanType(), pa.bool_()), ("score", T.DoubleType(), pa.float64()),
]


def license_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, expressions (postfix), permissive (the accepted licences satisfy every expression; null without one) and score added, in one pass without a shuffle."""
    kept = [c for c in docs.columns if c not in {n for n, _, _ in _OUT}]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t, _ in _OUT]])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton()
        for batch in batches:
            rows = [judged(*scan((x or "").encode(), auto)) for x in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[n for n, _, _ in _OUT]])

    return docs.mapInArrow(run, schema)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document, without its text."""
    return license_columns(docs.select("doc_id", "text")).drop("text")
