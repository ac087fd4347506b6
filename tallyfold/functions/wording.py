"""Names and sentences fit to show."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .exprs import ladder, strip_legal

# Words that stay small, and those that stay in capitals.
SMALL = ["of", "and", "the", "for", "de", "la", "van", "von", "at", "in", "on"]
CAPITALS = ["AI", "USA", "US", "UAV", "UAS", "RF", "LLC", "LP", "PBC", "II", "III", "IV", "3D", "IO", "XR", "EV", "HQ"]


def display_name(name: Column) -> Column:
    """Without legal forms; several words all in capitals become readable, a single one may be a brand and stays."""
    s = strip_legal(name)
    core = lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", "")
    capital = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "-")
    word = lambda w, i: ladder((core(w).isin(CAPITALS) | (core(w).rlike("[0-9]") & (F.length(core(w)) <= 5)), w), ((i > 0) & F.lower(core(w)).isin(SMALL), F.lower(w)), otherwise=capital(w))
    shouted = s.rlike(r"\p{L}") & (s == F.upper(s)) & s.contains(" ")
    return F.when(shouted, F.array_join(F.transform(F.split(s, r"\s+"), word), " ")).otherwise(s)


def first_sentence(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = F.regexp_extract(t, r"^(.*?[.!?])(\s|$)", 1)
    return F.when(found == "", t).otherwise(found)


def name_cue(company: Column) -> Column:
    """2 if a company's name says aviation or robots, 1 if it says technology, else 0; null for null."""
    return F.when(company.rlike(fixed.CUE_AVIATION), 2).when(company.rlike(fixed.CUE_TECHNOLOGY) | company.rlike(fixed.CUE_AI), 1).when(company.isNotNull(), 0)


def is_service(company: Column) -> Column:
    """Whether a name is one of a business for hire."""
    return company.rlike(fixed.SERVICE_NAME)


def looks_individual(company: Column, person: Column) -> Column:
    """Whether the name of a company is a person's, or empty: the person's own one or part of it, one of the same surname, a login made of initial and surname, or two words that begin with a common given name. Words of organisations and cues of a business speak against it. Null is empty."""
    company, person = F.coalesce(company, F.lit("")), F.coalesce(person, F.lit(""))
    extras, names = (F.array(*[F.lit(x) for x in xs]) for xs in (fixed.NAME_EXTRAS, fixed.GIVEN_NAMES))
    tokens = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~F.array_contains(extras, t)))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    letters = lambda c: F.transform(F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    c, p, told = tokens(company), tokens(person), letters(person)
    words = F.filter(letters(company), lambda w: (w != "") & ~F.array_contains(extras, w))
    n, first, last = F.size(words), F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    end = F.get(told, F.size(told) - 1)
    surname = F.coalesce(F.when((F.size(told) > 1) & F.array_contains(extras, end), F.get(told, F.size(told) - 2)).otherwise(end), F.lit(""))
    login = (n == 1) & (F.length(surname) >= 3) & first.endswith(surname) & (first != surname) & (F.substring(first, 1, 1) == F.substring(F.get(told, F.lit(0)), 1, 1))
    plain = F.regexp_replace(company, " ", "").rlike(r"^\p{L}+$")
    rules = [
        (F.size(c) == 0, True), (company.rlike(fixed.ORG_WORD), False), ((F.size(p) > 0) & (within(c, p) | within(p, c)), True), (name_cue(company) > 0, False), (n == 0, True),
        (n.between(2, 3) & (surname != "") & (last == surname), True), (F.coalesce(login, F.lit(False)), True), ((n == 2) & F.array_contains(names, first) & plain, True),
    ]
    return ladder(*[(when, F.lit(is_so)) for when, is_so in rules], otherwise=F.lit(False))


def name_kind(name: Column, person: Column | None = None) -> Column:
    """person, service or company, by cues in a name (and in that of the person behind it)."""
    given = F.lit(None).cast("string") if person is None else person
    single = name.rlike(r"^\p{Lu}\p{Ll}+ (\p{Lu}\. )?\p{Lu}\p{Ll}+$") & (name_cue(name) == 0) & ~name.rlike(fixed.ORG_WORD) & ~name.rlike(FOR_HIRE)
    return ladder((name.rlike(FOR_HIRE) | is_service(name), F.lit("service")), (single | looks_individual(name, given), F.lit("person")), otherwise=F.lit("company"))


#: Trades whose names speak of a business for hire.
FOR_HIRE = r"(?i)\b(consulting|photography|roofing|insurance|realty)\b"


class _Page(HTMLParser):
    SKIPPED, BLOCKS = {"script", "style", "noscript", "template"}, {"p", "div", "br", "li", "h1", "h2", "h3", "tr", "article", "section"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.found: dict[str, str] = {}
        self.links: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIPPED or tag in ("title", "h1"):
            self.open.append(tag)
        if tag in self.BLOCKS:
            self.text.append("\n")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "meta" and a.get("content"):
            key = {"og:title": "og_title", "og:site_name": "site_name", "description": "description"}.get(a.get("property") or a.get("name") or "")
            if key:
                self.found.setdefault(key, a["content"].strip())

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if any(t in self.SKIPPED for t in self.open):
            return
        if self.open:
            key = self.open[-1]
            if key not in self.found or self.found[key].endswith("\0"):
                self.found[key] = self.found.get(key, "").rstrip("\0") + data + "\0"
        if "title" not in self.open:
            self.text.append(data)


def page_facts(raw: str | None) -> tuple:
    page = _Page()
    try:
        page.feed(raw or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    text = re.sub(r"[ \t]+", " ", "".join(page.text))
    text = re.sub(r"\s*\n\s*", "\n", text).strip()
    tidy = lambda k: re.sub(r"\s+", " ", html.unescape(page.found.get(k, "").replace("\0", ""))).strip() or None
    mark = re.search(r"(?:©|\(c\)|copyright)\s*(?:\d{4}(?:\s*[-–]\s*\d{4})?)?\s*([^\n.|]{2,60})", text, re.I)
    return tidy("title"), tidy("og_title"), tidy("site_name"), tidy("h1"), tidy("description"), mark.group(1).strip() if mark else None, text, page.links


PAGE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("title", "og_title", "site_name", "h1", "description", "copyright", "text")], T.StructField("links", T.ArrayType(T.StringType()))])


def read_pages(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, title, og_title, site_name, h1, description, copyright, text, links) of HTML pages, a batch at a time."""

    def run(frames):
        for pdf in frames:
            rows = [page_facts(x) for x in pdf[raw]]
            yield pd.DataFrame([(k, *r) for k, r in zip(pdf[key], rows, strict=True)], columns=[key, *PAGE.names])

    return pages.select(key, raw).mapInPandas(run, T.StructType([pages.schema[key], *PAGE.fields]))
