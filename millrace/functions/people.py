"""People of a page: names that stand beside a title, found in one pass over its tags and one over its text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import col, folded

# --- fixed values -------------------------------------------------------------------------------------------
TITLE = r"(?:g[ée]rant[e]?|fondateur|fondatrice|directeur|directrice|pr[ée]sident[e]?|CEO|PDG|DG|DGA|dirigeant[e]?|co-fondateur|co-fondatrice|co-g[ée]rant[e]?|managing\s+director|owner|propri[ée]taire|associ[ée][e]?|chef\s+d['']entreprise|responsable)"
STRICT_TITLE = r"((?:g[ée]rant[e]?|fondateur|fondatrice|directeur|directrice|pr[ée]sident[e]?|CEO|PDG|DG|DGA|dirigeant[e]?|co-fondateur|co-fondatrice|co-g[ée]rant[e]?|managing\s+director|propri[ée]taire|associ[ée][e]?|chef\s+d['']entreprise)[a-zéè]*(?:\s+g[ée]n[ée]ral[e]?)?)"
NAME_WORD = "[A-ZÀ-ÖÙ-Ü][a-zà-öù-ü]+"
ELEMENTS = "h[1-6]|span|p|div|strong|b|em|li"
SEPARATORS = r"[,\-–—|:]"
LEAST_TEXT, MOST_FIRST, MOST_SECOND, MOST_PAGE_PEOPLE, AROUND = 3, 50, 80, 5, 200
# ------------------------------------------------------------------------------------------------------------
_OPENING, _CLOSING = re.compile(f"<(?:{ELEMENTS})", re.I), re.compile(f"</(?:{ELEMENTS})>", re.I)
_TITLE, _TITLE_AFTER, _SEPARATOR = re.compile(TITLE, re.I), re.compile(rf"\s*{STRICT_TITLE}", re.I), re.compile(SEPARATORS)
_NAME = re.compile(rf"{NAME_WORD}(?:\s+{NAME_WORD}){{1,3}}")
_SHORT_NAME = re.compile(rf"{NAME_WORD}(?:\s+{NAME_WORD}){{1,2}}")
_LETTERS = re.compile("[A-Za-zÀ-ÖÙ-Üà-öù-ü]+")
#: Words of a table of words that no name has, at most: it goes to every task.
MOST_WORDS = 100_000


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "̀" <= c <= "ͯ")


def is_name(text: str, not_names: frozenset[str]) -> bool:
    """Two to four capitalised words of 5 to 40 characters, none that no name has, not one or two words in capitals."""
    words = text.split()
    if not (2 <= len(words) <= 4 and 5 <= len(text) <= 40) or not_names & set(_plain(text).split()):
        return False
    return all(re.match("[A-ZÀ-ÖÙ-Ü]", w) for w in words) and not (len(words) <= 2 and text == text.upper())


def neighbours(page: str) -> Iterator[tuple[str, str]]:
    """Texts of two elements with nothing but tags and blanks between them, each element in one pair at most.

    An element counts if it holds text alone. Every ``<`` is looked at once from the right (where its tag ends, and the last
    element in the run of tags from there) and once from the left.
    """
    starts = [m.start() for m in re.finditer("<", page)]
    n = len(starts)
    after, text_end, last = [0] * n, [n] * n, [-1] * n  # where a tag ends, the next < behind it, the last element of its run
    close, k = -1, n
    closings = [_CLOSING.match(page, s) for s in starts]

    def element(i: int, most: int) -> bool:
        j = text_end[i]
        if not after[i] or j == n or closings[j] is None or starts[j] - after[i] < LEAST_TEXT:
            return False
        return _OPENING.match(page, starts[i]) is not None and len(page[after[i] : starts[j]].strip()) <= most

    def run_from(at: int, j: int) -> int:
        """The last element of the run of tags that starts at the j-th < if only blanks lie before it, else -1."""
        return last[j] if j < n and not page[at : starts[j]].strip() else -1

    for i in range(n - 1, -1, -1):
        end = page.find(">", starts[i], starts[i + 1] if i + 1 < n else len(page))
        close = end if end >= 0 else close  # the first > behind this <, which may lie behind others
        if close < 0:
            continue
        after[i] = close + 1
        if end >= 0:
            k = i + 1
        text_end[i] = k
        further = run_from(after[i], k)
        last[i] = further if further >= 0 else i if element(i, MOST_SECOND) else -1
    i = 0
    while i < n:
        second = -1
        if element(i, MOST_FIRST):
            j = text_end[i]
            second = run_from(closings[j].end(), j + 1)
        if second < 0:
            i += 1
            continue
        yield page[after[i] : starts[text_end[i]]].strip(), page[after[second] : starts[text_end[second]]].strip()
        i = text_end[second] + 1


def before_titles(page: str) -> Iterator[tuple[str, str]]:
    """Two to four words with a separator and a title behind them, whatever the case."""
    free = 0  # behind the last pair, and behind the separator before
    for m in _SEPARATOR.finditer(page):
        if m.start() < free:
            continue
        title = _TITLE_AFTER.match(page, m.end())
        words: list[re.Match] = []
        if title:
            end = len(page[free : m.start()].rstrip()) + free
            runs = list(_LETTERS.finditer(page, free, end))
            while runs and len(words) < 4 and runs[-1].end() - runs[-1].start() > 1:
                if runs[-1].end() != end if not words else page[runs[-1].end() : words[0].start()].strip():
                    break
                words.insert(0, runs.pop())
        free = m.end()
        if len(words) > 1:
            yield page[words[0].start() : words[-1].end()], title[1].strip()
            free = title.end()


def _without(page: str, element: str) -> str:
    """A page without elements of a kind and what they hold; one that is not closed stays."""
    out, at = [], 0
    opening, closing = re.compile(f"<{element}", re.I), re.compile(f"</{element}>", re.I)
    while (start := opening.search(page, at)) and (head := page.find(">", start.end())) >= 0 and (end := closing.search(page, head + 1)):
        out.append(page[at : start.start()])
        at = end.end()
    return "".join([*out, page[at:]])


def near_titles(page: str, not_names: frozenset[str]) -> Iterator[tuple[str, str]]:
    """For each title in the page's text the first name within AROUND characters of its start."""
    text = _without(_without(page, "script"), "style")
    tags = text.rfind(">") + 1  # behind it no tag ends
    text = re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", text[:tags]) + text[tags:])
    for title in _TITLE.finditer(text):
        for name in _SHORT_NAME.findall(text[max(0, title.start() - AROUND) : title.start() + AROUND]):
            if is_name(name, not_names):
                yield name, title[0]
                break


def people_of_page(page: str, not_names: frozenset[str]) -> list[tuple[str, str]]:
    """Names and titles of a page, at most MOST_PAGE_PEOPLE: neighbouring elements, then "name, title", then names near a title."""
    found: dict[str, tuple[str, str]] = {}

    def candidates() -> Iterator[tuple[str, str]]:
        for a, b in neighbours(page):
            for person, title in ((a, b), (b, a)):
                if _NAME.search(person) and _TITLE.search(title):
                    yield person, title
        yield from before_titles(page)
        yield from near_titles(page, not_names)

    for person, title in candidates():
        if is_name(person, not_names) and _plain(person) not in found:
            found[_plain(person)] = (person, title)
            if len(found) == MOST_PAGE_PEOPLE:
                break
    return list(found.values())


def words_of(not_names: list[str] | DataFrame) -> frozenset[str]:
    """The words that no name has, folded: a list, or a table of one column of at most MOST_WORDS rows."""
    if isinstance(not_names, DataFrame):
        rows = not_names.limit(MOST_WORDS + 1).collect()
        if len(rows) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words")
        not_names = [r[0] for r in rows if r[0] is not None]
    return frozenset(_plain(w) for w in not_names)


def page_people(page: Column | str, not_names: list[str] | DataFrame) -> Column:
    """People of a page as array<struct<name, title>>; only pages with a title reach Python."""
    words = words_of(not_names)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())])))
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [] if p is None else [{"name": n, "title": t} for n, t in people_of_page(p, words)])

    return found(F.when(col(page).rlike(f"(?i){TITLE}"), col(page)))


def people_table(not_names: list[str] | DataFrame):
    """A table function from a page to rows nth, name, title, for ``lateralJoin`` or, once registered, LATERAL in SQL."""
    words = words_of(not_names)

    class People:
        def eval(self, page: str):
            for k, (name, title) in enumerate(people_of_page(page or "", words)):
                yield k, name, title

    return F.udtf(People, returnType="nth int, name string, title string", useArrow=True)


def common_words(texts: DataFrame, text: str, least: int = 3) -> DataFrame:
    """Words (folded, column ``word``) that running text has at least ``least`` times, at least as often in small letters as with a capital.

    A rule that makes the table of words no name has from the texts at hand. Counted before the shuffle; null texts have none.
    """
    words = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0)).alias("w"))
    small = F.count_if(F.substring("w", 1, 1) == F.lower(F.substring("w", 1, 1)))
    counted = words.groupBy(folded("w").alias("word")).agg(F.count("*").alias("n"), small.alias("small"))
    return counted.where((F.col("n") >= least) & (2 * F.col("small") >= F.col("n"))).select("word")
