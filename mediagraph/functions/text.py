"""Text columns: folding, words, titles, names.

Everything here stays on the JVM except the two `*_exact` helpers, which send Arrow batches to Python for the
parts of Unicode and HTML that have no built-in function, and `title_words` and `IndexWords`: they fold each word of a task
once, where a Spark lambda folds every occurrence.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediagraph.functions import fixed

WORD = r"[\p{L}\p{N}_]+"
INDEX_WORD = r"[\p{L}\p{N}]+"
KNOWN = 500_000
LEGAL_FORMS = frozenset(fixed.LEGAL_FORMS)


def fold_text(text: str) -> str:
    """Case and accents removed, white space collapsed (plain Python, for driver-side literals and tests)."""
    flat = unicodedata.normalize("NFKD", text.casefold())
    return " ".join("".join(ch for ch in flat if not unicodedata.combining(ch)).split())


def _fold_char(ch: str) -> str:
    flat = unicodedata.normalize("NFKD", ch.casefold())
    return "".join(c for c in flat if not unicodedata.combining(c))


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """The folding of the Basic Multilingual Plane, derived from the Unicode database of this interpreter.

    Returns characters that fold to one character, what they fold to, characters that vanish, and the letters and
    ligatures that expand (sharp s and its like). Hangul and compatibility ideographs and Arabic presentation forms
    are left to `normalize_text_exact`.
    """
    single, target, gone, wide = [], [], [], []
    for code in (*range(0x80, 0xAC00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)):
        ch = chr(code)
        if not unicodedata.category(ch).startswith(("L", "M", "N", "S", "P")):
            continue
        folded = _fold_char(ch)
        if folded == ch:
            continue
        if len(folded) == 1:
            single.append(ch)
            target.append(folded)
        elif not folded:
            gone.append(ch)
        elif ch.isalpha() and (code < 0x250 or 0x1E00 <= code < 0x1F00 or code >= 0xFB00):
            wide.append((ch, folded))
    return "".join(single), "".join(target), "".join(gone), tuple(wide)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def normalize_text(c: Column) -> Column:
    """Case and accents removed, white space collapsed. ASCII values skip the folding tables."""
    single, target, gone, wide = _fold_tables()
    expanded = c
    for ch, folded in wide:
        expanded = F.replace(expanded, F.lit(ch), F.lit(folded))
    wide_class = "[" + "".join(ch for ch, _ in wide) + "]"
    opened = F.when(c.rlike(wide_class), expanded).otherwise(c)
    # Characters past the end of `target` are deleted by translate: that is where the combining marks go.
    folded = F.lower(F.translate(opened, single + gone, target))
    return collapse(F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(F.lower(c)))


@functools.lru_cache(maxsize=1)
def _fold_map() -> dict[int, str]:
    single, target, gone, wide = _fold_tables()
    return dict(zip(map(ord, single), target, strict=True)) | dict.fromkeys(map(ord, gone), "") | {ord(ch): folded for ch, folded in wide}


def fold_as_columns(value: str) -> str:
    """What `normalize_text` makes of a value, in plain Python: settings and search words must be folded as the columns they meet."""
    return " ".join(value.translate(_fold_map()).lower().split())


@F.pandas_udf(T.StringType())
def normalize_text_exact(values: pd.Series) -> pd.Series:
    """`normalize_text` for all of Unicode, at the price of an Arrow hop."""
    return values.map(fold_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    """All named and numeric character references. Spark has no built-in for them."""
    return values.map(html.unescape, na_action="ignore")


def unescape_basic(c: Column) -> Column:
    """The five predefined entities and the non-breaking space, on the JVM. `&amp;` goes last."""
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                       ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return c


def tidy_title(c: Column) -> Column:
    """Control and unassigned characters become spaces, white space collapses."""
    return collapse(F.regexp_replace(c, r"\p{C}", " "))


def clean_title(c: Column, exact: bool = True) -> Column:
    """A headline as stored: entities decoded (all of them with `exact`), then `tidy_title`."""
    return F.coalesce(tidy_title(unescape_html(c) if exact else unescape_basic(c)), F.lit(""))


def strip_tags(c: Column, exact: bool = False) -> Column:
    """Markup out of a title, only where there is any."""
    bare = F.regexp_replace(c, "<[^>]+>", " ")
    opened = unescape_html(bare) if exact else unescape_basic(bare)
    return F.when(c.contains("<") | c.contains("&"), opened).otherwise(c)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def index_tokens(c: Column) -> Column:
    """Words as the text index splits them (an underscore separates), already folded."""
    return F.regexp_extract_all(normalize_text(c), F.lit(f"({INDEX_WORD})"), F.lit(1))


def name_key(c: Column) -> Column:
    """The form two names are compared in; '' when under three letters."""
    words = F.array_join(word_tokens(normalize_text(c)), " ")
    no_article = F.regexp_replace(words, "^the( |$)", "")
    forms = "|".join(fixed.LEGAL_FORMS)
    key = F.regexp_replace(no_article, rf"(?<=\S)( ({forms}))+$", "")
    return F.when(F.length(F.replace(key, F.lit(" "), F.lit(""))) >= 3, key).otherwise(F.lit(""))


def is_acronym(c: Column) -> Column:
    """A short name in capitals, dots aside."""
    compact = F.trim(F.replace(c, F.lit("."), F.lit("")))
    return compact.rlike(r"^[\p{L}\p{N}]{3,8}$") & (F.regexp_count(compact, F.lit(r"\p{Lu}")) >= 2)


def is_lower(c: Column) -> Column:
    return (F.lower(c) == c) & c.rlike(r"\p{Ll}")


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital ("o'brien" is "O'Brien"; initcap only looks at spaces)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    raised = F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2)))))
    return F.array_join(raised, "")


def display_name(c: Column) -> Column:
    """Lower-cased names for display: one short word is an acronym, anything else is title-cased."""
    short = ~c.contains(" ") & (F.length(c) <= 4)
    return F.when(~is_lower(c), c).when(short, F.upper(c)).otherwise(title_case(c))


def section_parts(label: Column) -> Column:
    """A section label's parts: cut at / > | , ; or a spaced dash."""
    return F.split(label, "\\s*(?:[/>|,;]|\\s[-\u2013]\\s)\\s*")


def alias_keys(label: Column, aliases: Column) -> Column:
    """Keys an item can be recognised by: its label, and its aliases of several words or in capitals."""
    specific = F.filter(aliases, lambda a: F.trim(a).contains(" ") | is_acronym(a))
    keys = F.array_union(F.array(name_key(label)), F.transform(specific, name_key))
    return F.array_remove(keys, F.lit(""))


def plain_name_key(name: str, folds: dict[int, str]) -> str:
    """`name_key` in plain Python."""
    words = re.findall(r"\w+", name.lower() if name.isascii() else name.translate(folds).lower())
    words = words[words[:1] == ["the"] :]
    while len(words) > 1 and words[-1] in LEGAL_FORMS:
        words.pop()
    return " ".join(words) if sum(map(len, words)) >= 3 else ""


def headline_term(word: str, folds: dict[int, str], stop: frozenset[str]) -> str | None:
    """The term a headline word stands for, or None: three letters or more, not only digits, no stopword; a plural s is
    dropped."""
    w = word.lower() if word.isascii() else " ".join(word.translate(folds).lower().split())
    if len(w) < 3 or w.isdecimal() or w in stop:
        return None
    return w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w


def title_words() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow, (key, title) to (key, terms, words): a title's meaningful words, each term once and in the spelling
    first used. A task remembers `KNOWN` words at most."""
    folds, stop = _fold_map(), frozenset(fold_text(t) for t in (fixed.STOPWORDS_EN + fixed.STOPWORDS_FR).split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = re.compile(r"\w+").findall  # in Python the characters of WORD
        known: dict[str, str | None] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                terms, words, ends = [], [], [0]
                for title in batch.column(1).to_pylist():
                    found = words_of(title or "")
                    known.update({w: headline_term(w, folds, stop) for w in set(found).difference(known)})
                    first = {known[w]: w for w in reversed(found)}
                    first.pop(None, None)
                    terms += first
                    words += first.values()
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string())) for flat in (terms, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [batch.schema.names[0], "terms", "words"])
                if len(known) > KNOWN:
                    known.clear()

    return run


class TitleNumbers(dict):
    """Words to the numbers of the terms they stand for, -1 where they stand for none."""

    def __init__(self, folds: dict[int, str], stop: frozenset[str]) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.folds, self.stop = folds, stop
        self.keys: dict[str, str] = {}

    def __missing__(self, word: str) -> int:
        term = headline_term(word, self.folds, self.stop)
        self[word] = at = -1 if term is None else self.number(term)
        return at

    def number(self, term: str) -> int:
        if (at := self.numbers.setdefault(term, len(self.names))) == len(self.names):
            self.names.append(term)
        return at

    def of_names(self, names: list[str | None], title: set[int]) -> list[int]:
        """Numbers of names' keys (marked with @) whose last word is not among a title's terms; a one-word name always counts."""
        self.keys.update({name: plain_name_key(name, self.folds) for name in names if name and name not in self.keys})
        keys = [self.keys[name] for name in names if name]
        return [self.number("@" + k) for k in keys if k and (" " not in k or self.numbers.get(k.rsplit(" ", 1)[1], -2) not in title)]


def numbered_titles() -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, TitleNumbers, np.ndarray, np.ndarray]]]:
    """For use in tasks: parts of batches (key, title, ...), and the distinct terms of each title: numbers, and where each title's begin and end.
    A third column `named` holds names, which count as terms where the title does not stand for them. A task remembers about `KNOWN` words; then it starts to number afresh."""
    folds, stop = _fold_map(), frozenset(fold_text(t) for t in (fixed.STOPWORDS_EN + fixed.STOPWORDS_FR).split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, TitleNumbers, np.ndarray, np.ndarray]]:
        words_of, known = re.compile(r"\w+").findall, TitleNumbers(folds, stop)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found, sizes = [], []
                named = batch.column(2).to_pylist() if "named" in batch.schema.names else [None] * batch.num_rows
                for title, names in zip(batch.column(1).to_pylist(), named, strict=True):
                    some = list(map(known.__getitem__, words_of(title or "")))
                    if names:
                        some += known.of_names(names, set(some))
                    found += some
                    sizes.append(len(some))
                numbers = np.array(found, np.int64)
                key = np.unique((np.repeat(np.arange(len(sizes)), sizes) * len(known.names) + numbers)[numbers >= 0])
                of, numbers = np.divmod(key, max(len(known.names), 1))
                yield batch, known, numbers, np.searchsorted(of, np.arange(len(sizes) + 1))
                if len(known) + len(known.keys) > KNOWN:
                    known = TitleNumbers(folds, stop)

    return run


class IndexWords(dict):
    """`index_tokens` with numbered terms: what stands between white space, to the numbers of its terms. Folding is done letter
    by letter and makes no white space vanish, so that each piece is folded by itself, and once."""

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.folds, self.words_of = _fold_map(), re.compile(r"[^\W_]+").findall  # in Python the characters of INDEX_WORD

    def __missing__(self, piece: str) -> tuple[int, ...]:
        folded = piece.lower() if piece.isascii() else piece.translate(self.folds).lower()
        found = []
        for word in self.words_of(folded):
            number = self.numbers.setdefault(word, len(self.names))
            if number == len(self.names):
                self.names.append(word)
            found.append(number)
        if len(piece) <= 64:
            self[piece] = tuple(found)
        return tuple(found)

    def terms(self, numbers: np.ndarray) -> pa.Array:
        used, back = np.unique(numbers, return_inverse=True)
        return pa.array([self.names[k] for k in used.tolist()], pa.string()).take(pa.array(back))

    def forget(self) -> None:
        """Begin anew where much is remembered; numbers given so far are void."""
        if len(self) + len(self.names) > KNOWN:
            self.clear(), self.numbers.clear(), self.names.clear()

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, freq) of each text's terms, and each text's number of words."""
        ids, ends = [], []
        for text in texts:
            ids.extend(itertools.chain.from_iterable(map(self.__getitem__, (text or "").split())))
            ends.append(len(ids))
        sizes = np.diff(np.array([0, *ends], np.int64))
        pairs, freq = np.unique(np.repeat(np.arange(len(texts)) << 32, sizes) | np.array(ids, np.int64), return_counts=True)
        return pairs >> 32, pairs & 0xFFFFFFFF, freq, sizes
