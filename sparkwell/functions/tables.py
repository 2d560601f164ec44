"""Chunkers as table functions for SQL: SELECT ... FROM docs, LATERAL chunks('sentences', text).

`register` makes one function for each strategy (chunk_windows, ...) and `chunks`, which takes the strategy's name.  A strategy is
a function of a text to a list of strings; `STRATEGIES` can be given others.  They state what the column expressions
of operators.chunking and operators.variants state, row by row in Arrow batches: for plans that are column
expressions those are the faster form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkwell import ship

ship(__name__)

SIZE, OVERLAP = 512, 64
#: White space as the column expressions count it.
SPACE = " \t\n\x0b\x0c\r"


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    parts = (text[at : at + size].strip(SPACE) for at in range(0, len(text), size - overlap))
    return [p for p in parts if p]


def sentences(text: str) -> list[str]:
    parts = (p.strip(SPACE) for p in re.split(r"(?a:(?<=[.!?])\s+)|\n+", text))
    return [p for p in parts if p]


def filled(parts: list[str]) -> list[str]:
    return [p for p in (p.strip(SPACE) for p in parts) if p]


def units(text: str) -> list[str]:
    """Lines of paragraphs that have several, and the other paragraphs."""
    paragraphs = filled(re.split(r"\n{2,}", text.replace("\r\n", "\n")))
    return [line for p in paragraphs for line in filled(re.split(r"[\n\r]", p))]


def grouped(parts: list[str], glue: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Parts put together while they fit; the windows of a longer part stand alone."""
    out: list[str] = []
    held = ""
    for part in parts:
        if len(part) > size:
            out += [held] * bool(held) + windows(part, size, overlap)
            held = ""
        elif held and len(held) + len(glue) + len(part) <= size:
            held += glue + part
        else:
            out += [held] * bool(held)
            held = part
    return out + [held] * bool(held)


def structure(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs, lines of long paragraphs, sentences of long lines and windows of long sentences, packed."""
    finer = [lambda p: filled(re.split(r"\n", p)), sentences, lambda s: windows(s, size, overlap)]

    def cut(parts, level):
        return [x for p in parts for x in ([p] if len(p) <= size or level == len(finer) else cut(finer[level](p), level + 1))]

    return grouped(cut(filled(re.split(r"(?a:\n\s*\n)", text)), 0), " ", size, overlap)


STRATEGIES: dict[str, Callable[[str], list[str]]] = {
    "windows": windows,
    "sentences": lambda text: grouped([s for u in units(text) for s in sentences(u)], " "),
    "units": lambda text: grouped(units(text), "\n"),
    "structure": structure,
}


def table_function(cut: Callable[[str], list[str]]):
    """A table function (chunk_index, chunk) of a text; null and blank texts give no rows."""

    class Chunks:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(cut(text or ""))

    return udtf(Chunks, returnType="chunk_index: int, chunk: string", useArrow=True)


def register(spark: SparkSession, strategies: dict[str, Callable[[str], list[str]]] | None = None) -> list[str]:
    """Registers the functions; returns their names."""
    known = STRATEGIES | (strategies or {})
    for name, cut in known.items():
        spark.udtf.register(f"chunk_{name}", table_function(cut))

    class Named:
        def eval(self, strategy: str, text: str) -> Iterator[tuple[int, str]]:
            if strategy not in known:
                raise ValueError(f"no strategy {strategy}: there are {', '.join(sorted(known))}")
            yield from enumerate(known[strategy](text or ""))

    spark.udtf.register("chunks", udtf(Named, returnType="chunk_index: int, chunk: string", useArrow=True))
    return ["chunks", *(f"chunk_{n}" for n in known)]
