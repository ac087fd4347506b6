"""Dictionary matching and classification of texts by term lists."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG, CONTEXT, OTHERS, SCALE, LONE_CAP = 1.0, 0.45, 0.35, 1.6, 0.28


def term_pattern(term: str) -> str:
    """A pattern for a term in lower-cased text: words joined by spaces or hyphens, a hyphen may be missing, a plural allowed, alphanumeric edges. Plain enough for any engine."""
    body = re.escape(term).replace(r"\ ", " ").replace(r"\-", "-")
    body = body[:-1] + "(y|ys|ies)" if body.endswith("y") else body + "(s|es)?"
    body = body.replace("-", "@").replace(" ", r"[\s-]+").replace("@", r"[\s-]*")
    return f"(^|[^a-z0-9]){body}($|[^a-z0-9])"


def said(low: Column, term: str) -> Column:
    """Does lower-cased text say the term? Its first word is looked for as a plain piece of text, so that the pattern is tried on texts that have it alone; there it mostly matches at once."""
    first = re.split("[ -]", term)[0]
    stem = first[:-1] if first == term and term.endswith("y") else first
    return low.contains(stem) & low.rlike(term_pattern(term))


def mass_of(scores: Sequence[Column]) -> Column:
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return best + OTHERS * (reduce(lambda a, b: a + b, scores) - best)


class Terms:
    """A dictionary of sectors, each with strong and context terms, as columns: `hits` of a text, and `verdict` of such hits."""

    def __init__(self, dictionary: Mapping[str, Mapping[str, Sequence[str]]], false_friends: Sequence[str] = (), unambiguous: Sequence[str] = ()) -> None:
        self.terms = [(s, t, w) for s, groups in dictionary.items() for kind, w in (("strong", STRONG), ("context", CONTEXT)) for t in groups.get(kind, ())]
        self.sectors, self.friends, self.sure = list(dictionary), list(false_friends), set(unambiguous)
        self.names = {t: f"_t{i}" for i, t in enumerate(dict.fromkeys(t for _, t, _ in self.terms))}

    def low(self, text: Column) -> Column:
        """Lower-case text with the false friends blanked out."""
        low = F.lower(text)
        return F.regexp_replace(low, "|".join(re.escape(x) for x in self.friends), " ") if self.friends else low

    def hits(self, low: Column) -> list[Column]:
        return [F.coalesce(said(low, t), F.lit(False)).alias(n) for t, n in self.names.items()]

    def verdict(self, hits: DataFrame, kept: Sequence[str]) -> DataFrame:
        add = lambda a, b: a + b
        sums = [reduce(add, [F.when(F.col(self.names[t]), F.lit(w)).otherwise(F.lit(0.0)) for x, t, w in self.terms if x == s], F.lit(0.0)) for s in self.sectors]
        scored = hits.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(sums)])
        scores = [F.col(f"_s{i}") for i in range(len(sums))]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        sector = F.coalesce(*[F.when((c == best) & (c > 0), F.lit(s)) for s, c in zip(self.sectors, scores, strict=True)])
        n = reduce(add, [F.col(c).cast("int") for c in self.names.values()])
        sure = reduce(lambda a, b: a | b, [F.col(c) for t, c in self.names.items() if t in self.sure], F.lit(False))
        fit = 1 - F.exp(-mass_of(scores) / SCALE)
        fit = F.when((n == 1) & ~sure, F.least(fit, F.lit(LONE_CAP))).otherwise(fit)
        found = F.array_join(F.array_sort(F.filter(F.array(*[F.when(F.col(c), F.lit(t)) for t, c in self.names.items()]), lambda x: x.isNotNull())), ",")
        return scored.select(*kept, sector.alias("sector"), F.round(fit, 3).alias("fit"), found.alias("terms"))


def classify(df: DataFrame, text: str, dictionary: Mapping[str, Mapping[str, Sequence[str]]], false_friends: Sequence[str] = (), unambiguous: Sequence[str] = ()) -> DataFrame:
    """df with sector (first by dictionary order on ties; null without a term), fit (0 to 1, rounded to 3) and terms (sorted, comma-joined).

    One projection and no shuffle: each distinct term counts once, 1 if strong and 0.45 if context; the best sector's sum
    and 0.35 of the others' make fit = 1 - exp(-mass / 1.6); one lone term that isn't unambiguous holds fit at 0.28."""
    t = Terms(dictionary, false_friends, unambiguous)
    # As generators' outputs the lower-cased text and the hits are made once a row: a filter on fit above isn't pushed below with all terms in it.
    low = df.select("*", F.explode(F.array(t.low(F.col(text)))).alias("_low"))
    return t.verdict(low.select("*", F.inline(F.array(F.struct(*t.hits(F.col("_low")))))), df.columns)


def classify_groups(df: DataFrame, keys: Sequence[str], text: str, dictionary: Mapping[str, Mapping[str, Sequence[str]]], false_friends: Sequence[str] = (), unambiguous: Sequence[str] = ()) -> DataFrame:
    """The same of all texts of a key together. Only which terms a row has is aggregated, so texts are neither joined nor gathered; a term doesn't reach over two rows."""
    t = Terms(dictionary, false_friends, unambiguous)
    hits = df.select(*keys, F.explode(F.array(t.low(F.col(text)))).alias("_low")).select(*keys, *t.hits(F.col("_low")))
    return t.verdict(hits.groupBy(*keys).agg(*[F.bool_or(c).alias(c) for c in t.names.values()]), keys)


def longest_matches(df: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(key, term, start): places of terms that don't overlap, longer terms first, then by term and place. One automaton finds the places of all terms in a pass; the greedy choice goes from place to place, so it is Python over Arrow batches."""
    wanted = sorted({t for t in terms if t})
    schema = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in wanted:
            found.add_word(t, t)
        if wanted:
            found.make_automaton()
        edge = set("abcdefghijklmnopqrstuvwxyz0123456789")
        for pdf in frames:
            rows = []
            for k, x in zip(pdf[key], pdf[text], strict=True):
                low = (x or "").lower()
                hits = []
                for end, t in found.iter(low) if wanted else ():
                    start = end + 1 - len(t)
                    if not (start and low[start - 1] in edge) and not (end + 1 < len(low) and low[end + 1] in edge):
                        hits.append((-len(t), t, start))
                # Taken stretches in order of place: a new one needs to fit between its neighbours.
                starts: list[int] = []
                ends: list[int] = []
                for size, t, start in sorted(hits):
                    at = bisect(starts, start)
                    if (at and ends[at - 1] > start) or (at < len(starts) and starts[at] < start - size):
                        continue
                    starts.insert(at, start)
                    ends.insert(at, start - size)
                    rows.append((k, t, start))
            yield pd.DataFrame(rows, columns=[key, "term", "start"])

    return df.select(key, text).mapInPandas(run, schema)


#: Bytes of phrases up to which they are sent to every task.
SENT_BYTES = 8 << 20


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, sent: int = SENT_BYTES) -> DataFrame:
    """(key, phrase): phrases whose words stand consecutively in a text. Blocked by each phrase's rarest word, so no text meets a phrase that it can't hold.

    Phrases of up to `sent` bytes in all go to the texts, and no text is shuffled; more of them meet the texts' words in a join, and only texts with candidates are brought back."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    words = lambda c: F.array_distinct(F.split(plain(c), " "))
    padded = lambda c: F.concat(F.lit(" "), plain(c), F.lit(" "))
    wanted = phrases.select(phrase).distinct().filter(plain(F.col(phrase)) != "")
    few = (wanted.agg(F.sum(F.octet_length(phrase))).first()[0] or 0) <= sent
    hint = F.broadcast if few else lambda df: df
    exploded = wanted.select(phrase, F.explode(words(F.col(phrase))).alias("w"))
    in_texts = texts.select(F.col(key).alias("_k"), F.explode(words(F.col(text))).alias("w"))
    known = in_texts.join(hint(exploded.select("w").distinct()), "w", "left_semi")
    often = known.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = exploded.join(often, "w", "left").groupBy(phrase).agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), F.col("w"))).alias("w"))
    if few:
        # Each text with its own words that some phrase is blocked by; the phrases follow by a broadcast join.
        own = texts.select(F.col(key).alias("_k"), F.explode(F.array(padded(F.col(text)))).alias("_text"))
        met = own.select("_k", "_text", F.explode(F.array_distinct(F.split(F.trim("_text"), " "))).alias("w")).join(F.broadcast(rarest), "w")
        return met.filter(F.col("_text").contains(padded(F.col(phrase)))).select(F.col("_k").alias(key), phrase)
    candidates = known.join(rarest, "w").select("_k", phrase)
    full = texts.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(candidates.select("_k").distinct(), "_k", "left_semi")
    return candidates.join(full, "_k").filter(padded(F.col("_text")).contains(padded(F.col(phrase)))).select(F.col("_k").alias(key), phrase)
