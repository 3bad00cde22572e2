"""Boolean searches as data: blocks of terms, all of which have to be met, as column expressions over title and abstract.

A block is met by any of its terms.  A term is a word or a phrase; ``*`` behind it stands for any rest of the last
word, and a field tag for where it is looked for: ``[ti]``, ``[ab]`` or, as without one, ``[tiab]``.  Hyphens and other
marks count as blanks and case does not count, as in the databases that such searches are written for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions import text as T

FIELDS = {"ti": ("title",), "ab": ("abstract",), "tiab": ("title", "abstract")}


@dataclass(frozen=True)
class Term:
    """One term as it is looked for: ``words`` in order, the last one open behind or not, in ``fields``."""

    words: str
    open: bool
    fields: tuple[str, ...]

    @classmethod
    def of(cls, written: str) -> Term:
        bare, tag = re.fullmatch(r"\s*(.*?)\s*(?:\[(\w+)\])?\s*", written, re.DOTALL).groups()
        if tag is not None and tag.lower() not in FIELDS:
            raise ValueError(f"no field [{tag}] in {written!r}")
        bare = bare.strip('"').strip()
        words = " ".join(re.sub("[^a-z0-9]+", " ", bare.removesuffix("*").lower()).split())
        if not words or "*" in bare.removesuffix("*"):
            raise ValueError(f"a term needs letters, and * may only stand behind them: {written!r}")
        return cls(words, bare.endswith("*"), FIELDS[(tag or "tiab").lower()])

    @property
    def pattern(self) -> str:
        """For texts of lower-case words one blank apart."""
        return f"(^| ){self.words}{'' if self.open else '( |$)'}"


@dataclass(frozen=True)
class Search:
    """``blocks`` are all met, none of ``without`` is, and the year lies between ``years`` (both included; unknown years do not)."""

    blocks: list[list[str]]
    without: list[str] = field(default_factory=list)
    years: tuple[int, int] | None = None

    def over_limits(self, terms: int | None = None, in_block: int | None = None, stars: int | None = None) -> list[str]:
        """Which of a database's limits the search breaks."""
        known = [[Term.of(t) for t in b] for b in [*self.blocks, *([self.without] if self.without else [])]]
        counts = {"terms": (sum(map(len, known)), terms), "terms in a block": (max(map(len, known), default=0), in_block), "truncations": (sum(t.open for b in known for t in b), stars)}
        return [f"{n} {what}, at most {most}" for what, (n, most) in counts.items() if most is not None and n > most]

    def _any(self, terms: list[str], plain: dict[str, Column]) -> Column:
        """Whether any of the terms is met: one pattern for each field."""
        told = F.lit(False)
        for name, column in plain.items():
            patterns = [t.pattern for t in map(Term.of, terms) if name in t.fields]
            if patterns:
                told = told | column.rlike("|".join(patterns))
        return told

    def met(self, title: Column, abstract: Column, year: Column | None = None) -> Column:
        """Whether a record is found.  ``title`` and ``abstract`` are as they come; null counts as empty."""
        plain = {"title": T.normalize_title(title), "abstract": T.normalize_title(abstract)}
        told = F.lit(True)
        for block in self.blocks:
            told = told & self._any(block, plain)
        if self.without:
            told = told & ~self._any(self.without, plain)
        if self.years:
            told = told & F.coalesce((F.lit(None) if year is None else year).between(*self.years), F.lit(False))
        return told


def term_counts(records: DataFrame, search: Search) -> DataFrame:
    """block, term and n: how many records (title, abstract) each term of the blocks finds alone; one pass, one row a term."""
    plain = records.select(T.normalize_title(F.col("title")).alias("title"), T.normalize_title(F.col("abstract")).alias("abstract"))
    listed = [(i, t) for i, block in enumerate(search.blocks) for t in block]
    hit = [Search([[t]])._any([t], {"title": F.col("title"), "abstract": F.col("abstract")}) for _, t in listed]
    counted = plain.agg(F.array(*(F.count_if(h) for h in hit)).alias("n"))
    names = F.array(*(F.struct(F.lit(i).alias("block"), F.lit(t).alias("term")) for i, t in listed))
    return counted.select(F.explode(F.arrays_zip(names.alias("t"), F.col("n"))).alias("x")).select("x.t.block", "x.t.term", "x.n")
