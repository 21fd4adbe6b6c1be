"""The document filter language: terms, phrases, booleans, prefixes, wildcards, fuzzy terms and ranges on metadata,
compiled to one column expression over the documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import fold, fold_text, wildcard_regex


class FilterError(ValueError):
    pass


_LEX = re.compile(
    r"""\s*(?:
    (?P<range>[\[{]\s*(?P<low>"[^"]*"|\S+)\s+TO\s+(?P<high>"[^"]*"|[^\s\]}]+)\s*[\]}])
  | (?P<phrase>"(?:[^"\\]|\\.)*")
  | (?P<op>&&|\|\||[()!+\-:])
  | (?P<word>(?:[^\s()":!\[\]{}+\-]|\\.)(?:[^\s()":\[\]{}]|\\.)*)
  )""",
    re.VERBOSE,
)
NUMERIC = ("int", "bigint", "smallint", "double", "float")


class _Parser:
    def __init__(self, text: str, df: DataFrame, default: str):
        self.items, at = [], 0
        while at < len(text.rstrip()):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise FilterError(f"unexpected {text[at:at + 10]!r}")
            self.items.append((m.lastgroup if m.lastgroup not in ("low", "high") else "range", m))
            at = m.end()
        self.i, self.types, self.default = 0, dict(df.dtypes), default

    def peek(self) -> tuple[str, str]:
        if self.i >= len(self.items):
            return "end", ""
        kind, m = self.items[self.i]
        return kind, m.group(kind)

    def is_op(self, *ops: str) -> bool:
        kind, text = self.peek()
        return kind == "op" and text in ops or kind == "word" and text in ops

    def clauses(self, field: str) -> Column:
        """`a b` is a or b, unless + or - or AND and OR say otherwise."""
        groups: list[list[tuple[str, Column]]] = [[]]
        joined = False
        while self.peek()[0] != "end" and not self.is_op(")"):
            if self.is_op("OR", "||"):
                self.i += 1
                groups.append([])
                joined = False
                continue
            if self.is_op("AND", "&&"):
                self.i += 1
                joined = True
                continue
            sign = ""
            while self.is_op("+", "-", "!", "NOT"):
                sign = "+" if self.peek()[1] == "+" else "-"
                self.i += 1
            c = self.clause(field)
            if sign or joined or not groups[-1]:
                if joined and groups[-1] and groups[-1][-1][0] == "":
                    groups[-1][-1] = ("+", groups[-1][-1][1])
                groups[-1].append((sign or ("+" if joined else ""), c))
            else:
                groups[-1].append(("", c))
            joined = False
        out = []
        for g in groups:
            if not g:
                continue
            must = [c for s, c in g if s == "+"]
            may = [c for s, c in g if s == ""]
            never = [~c for s, c in g if s == "-"]
            parts = must + never
            if may and not must:
                parts = [reduce(Column.__or__, may), *parts]
            out.append(reduce(Column.__and__, parts))
        if not out:
            raise FilterError("an empty filter")
        return reduce(Column.__or__, out)

    def clause(self, field: str) -> Column:
        kind, text = self.peek()
        if kind == "op" and text == "(":
            self.i += 1
            c = self.clauses(field)
            if not self.is_op(")"):
                raise FilterError("a bracket isn't closed")
            self.i += 1
            return c
        if kind == "word" and self.i + 1 < len(self.items) and self.items[self.i + 1][0] == "op" and self.items[self.i + 1][1].group("op") == ":":
            self.i += 2
            return self.clause(re.sub(r"\\(.)", r"\1", text))
        if kind in ("word", "phrase", "range"):
            m = self.items[self.i][1]
            self.i += 1
            return self.value(field, kind, m)
        raise FilterError(f"unexpected {text or 'end of the filter'!r}")

    def value(self, field: str, kind: str, m: re.Match) -> Column:
        if field not in self.types:
            raise FilterError(f"no metadata field {field}")
        numeric = self.types[field] in NUMERIC
        c = F.col(field)
        false = F.lit(False)
        if kind == "range":  # both ends count, however it is written
            low, high = (x.strip('"') for x in (m.group("low"), m.group("high")))
            v = c.cast("bigint") if numeric else fold(c)
            conv = (lambda x: int(x)) if numeric else fold_text
            test = F.lit(True) & c.isNotNull()
            if low != "*":
                test = test & (v >= F.lit(conv(low)))
            if high != "*":
                test = test & (v <= F.lit(conv(high)))
            return F.coalesce(test, false)
        text = m.group(kind)
        if numeric:
            try:
                return F.coalesce(c == int(text.strip('"')), false)
            except ValueError as e:
                raise FilterError(f"{field} is a number") from e
        if kind == "phrase":
            words = words_of_text(fold_text(re.sub(r"\\(.)", r"\1", text[1:-1])))
            return self.phrase(c, self.types[field], words)
        if m2 := re.fullmatch(r"(.+)~([0-2]?)", text):
            want, edits = fold_text(m2.group(1)), int(m2.group(2) or 2)
            return self.any_token(c, self.types[field], lambda w: F.levenshtein(w, F.lit(want), edits) >= 0)
        plain = re.sub(r"\\(.)", r"\1", text)
        if text == "*":
            return c.isNotNull()
        if re.search(r"(?<!\\)[*?]", text):
            pattern = f"^(?:{wildcard_regex(fold_text(plain))})$"
            return self.any_token(c, self.types[field], lambda w: w.rlike(pattern))
        words = words_of_text(fold_text(plain))
        return self.phrase(c, self.types[field], words)

    def any_token(self, c: Column, kind: str, test) -> Column:
        tokens = words_of(c, kind)
        return F.coalesce(F.exists(tokens, test), F.lit(False))

    def phrase(self, c: Column, kind: str, words: list[str]) -> Column:
        if not words:
            return F.lit(False)
        if len(words) == 1:
            return F.coalesce(F.array_contains(words_of(c, kind), words[0]), F.lit(False))
        joined = F.concat(F.lit(" "), F.array_join(words_of(c, kind), " "), F.lit(" "))
        return F.coalesce(joined.contains(" " + " ".join(words) + " "), F.lit(False))


def words_of_text(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text)


def words_of(c: Column, kind: str) -> Column:
    """Metadata in folded words, as it is searched; several values follow each other."""
    text = F.array_join(c, " ") if kind.startswith("array") else c.cast("string")
    return F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}]+"), 0)


def compile_filter(text: str, documents: DataFrame, default: str = "title") -> Column:
    """A filter text as a condition on the documents; never null."""
    p = _Parser(text, documents, default)
    c = p.clauses(default)
    if p.peek()[0] != "end":
        raise FilterError(f"unexpected {p.peek()[1]!r}")
    return c


def filter_documents(documents: DataFrame, text: str, default: str = "title") -> DataFrame:
    return documents.where(compile_filter(text, documents, default))
