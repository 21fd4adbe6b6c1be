"""A tool to query a written corpus from a terminal: `python -m spanloom.tool FOLDER`, then patterns and commands.

Commands: `:sort BY`, `:group BY`, `:filter DOCUMENT-FILTER`, `:page N`, `:size N`, `:docs`, `:colloc`, `:csv`, `:explain`, `:describe`, `:help`, `:quit`.
A property or filter without a value is taken back. Everything else is a pattern.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import functions as F

from spanloom.corpus import Corpus, Hits


class Tool:
    """Keeps what was asked last, and says what it finds as lines."""

    def __init__(self, corpus: Corpus, size: int = 20):
        self.corpus, self.size = corpus, size
        self.pattern: str | None = None
        self.by = self.filter = None
        self.page = 0

    def hits(self) -> Hits:
        if self.pattern is None:
            raise ValueError("no pattern yet")
        return self.corpus.search(self.pattern, self.filter)

    def shown(self) -> Iterator[str]:
        h = self.hits()
        n = h.count().first()
        ordered = h.sort(self.by) if self.by else h.sort("docid,hitposition")
        rows = ordered.window(self.page * self.size, self.size).kwic()
        word = next(iter(self.corpus.tables.annotations)).replace("/", "_")
        for r in rows.collect():
            yield f"{r['doc_id']}:{r['start_pos']}\t{' '.join(w or '' for w in r[f'left_{word}'])} [{' '.join(w or '' for w in r[f'match_{word}'])}] {' '.join(w or '' for w in r[f'right_{word}'])}"
        yield f"{n['hits']} hits in {n['docs']} documents, page {self.page + 1}"

    def say(self, line: str) -> list[str]:
        """The answer to one line."""
        line = line.strip()
        if not line:
            return []
        try:
            if not line.startswith(":"):
                self.pattern, self.page = line, 0
                return list(self.shown())
            return list(self.command(*line[1:].partition(" ")[::2]))
        except (ValueError, KeyError) as e:
            return [f"error: {e}"]

    def command(self, name: str, value: str) -> Iterator[str]:
        value = value.strip() or None
        if name == "sort":
            self.by = value
            yield from self.shown()
        elif name == "filter":
            self.filter, self.page = value, 0
            yield from self.shown() if self.pattern else ()
        elif name == "page":
            self.page = max(0, int(value or 1) - 1)
            yield from self.shown()
        elif name == "size":
            self.size = max(1, int(value or 20))
        elif name == "group":
            for r in self.hits().group(value or "hit").orderBy(F.desc("size"), "g0").limit(self.size).collect():
                yield f"{r['size']}\t{r['g0']}"
        elif name == "docs":
            for r in self.hits().docs().orderBy(F.desc("n_hits"), "doc_id").limit(self.size).collect():
                yield f"{r['n_hits']}\t{r['pid'] if 'pid' in r else r['doc_id']}"
        elif name == "colloc":
            for r in self.hits().collocations().orderBy(F.desc("freq"), "term").limit(self.size).collect():
                yield f"{r['freq']}\t{r['term']}"
        elif name == "csv":
            yield from self.hits().csv().splitlines()
        elif name == "explain":
            yield from self.hits().explain().splitlines()
        elif name == "describe":
            yield from (f"{k}: {v}" for k, v in self.corpus.describe().items())
        elif name == "help":
            yield from (__doc__ or "").splitlines()
        else:
            raise ValueError(f"unknown command {name}")

    def run(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip() == ":quit":
                return
            yield from self.say(line)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("spanloom-tool").getOrCreate()
    for out in Tool(Corpus.open(spark, sys.argv[1])).run(sys.stdin):
        print(out, flush=True)


if __name__ == "__main__":
    main()
