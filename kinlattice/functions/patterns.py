"""Paralog patterns: regular expressions from aliases, and the names they give to rows.

The rules: aliases are lower-cased and trimmed; a spacer ends a block and is dropped, a change between
letters and digits ends a block; escaped blocks are joined by any number of spacers. The last character
always belongs to the last block. A name's own lower-cased form is one of its aliases. Where the pattern
of X finds an alias of Y, that alias is put in a negative look-ahead of X. Afterwards each built pattern
must match all its own aliases and none of another built one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACERS = " -_."


def alias_regex(alias: str, spacers: str = SPACERS) -> str:
    text = alias.strip().lower()
    blocks, block = [], ""
    for i, c in enumerate(text):
        last = i == len(text) - 1
        if c in spacers and not last:
            if block:
                blocks.append(block)
            block = ""
            continue
        if block and block[-1].isdigit() != c.isdigit():
            blocks.append(block)
            block = ""
        block += c
    if block:
        blocks.append(block)
    gap = "[" + "".join(re.escape(s) for s in spacers) + "]*"
    return gap.join(re.escape(b) for b in blocks)


class Pattern:
    """A name, what it looks for and what must not be there."""

    def __init__(self, name: str, positive: str, negative: str = "", ignorecase: bool = True):
        self.name, self.positive, self.negative, self.ignorecase = name, positive, negative, ignorecase

    @property
    def regex(self) -> str:
        return f"^(?!.*({self.negative})).*({self.positive})" if self.negative else self.positive

    def matches(self, text: Column) -> Column:
        """Positive and negative apart, so that engines without look-aheads can say the same."""
        case = "(?i)" if self.ignorecase else ""
        hit = text.rlike(case + self.positive)
        return F.coalesce(hit & ~text.rlike(case + self.negative) if self.negative else hit, F.lit(False))

    def search(self, text: str) -> bool:
        return re.search(self.regex, text, re.I if self.ignorecase else 0) is not None


def build_patterns(aliases: dict, spacers: str = SPACERS, ignorecase: bool = True) -> list[Pattern]:
    """Patterns of name -> list of aliases, one alias, or a compiled pattern (taken as it is)."""
    if not aliases:
        raise ValueError("no paralog is given")
    fixed = {n: v for n, v in aliases.items() if isinstance(v, re.Pattern)}
    built: dict[str, dict[str, str]] = {}
    for name, given in aliases.items():
        if name in fixed:
            continue
        if not isinstance(name, str) or not name.strip():
            raise ValueError(f"{name!r} is no paralog name")
        many = [given] if isinstance(given, str) else list(given)
        if not all(isinstance(a, str) and a.strip() for a in many):
            raise ValueError(f"aliases of {name} must be text")
        own = sorted({a.strip().lower() for a in [*many, name]})
        built[name] = {a: alias_regex(a, spacers) for a in own}
    for x, y in ((x, y) for x in built for y in built if x < y):
        if both := set(built[x]) & set(built[y]):
            raise ValueError(f"{x} and {y} share the aliases {sorted(both)}")
    out = []
    for name, given in aliases.items():
        if name in fixed:
            out.append(Pattern(name, given.pattern, "", bool(given.flags & re.I) or ignorecase))
            continue
        positive = "|".join(sorted(set(built[name].values())))
        avoid = sorted({r for other, theirs in built.items() if other != name for a, r in theirs.items() if re.search(positive, a)})
        out.append(Pattern(name, positive, "|".join(avoid), ignorecase))
    for p in out:
        if p.name not in built:
            continue
        for other, theirs in built.items():
            wrong = [a for a in theirs if p.search(a) != (other == p.name)]
            if wrong:
                raise ValueError(f"the pattern of {p.name} {'misses' if other == p.name else 'finds'} {wrong} of {other}")
    return out


def nickname(text: Column, patterns: list[Pattern], unassigned: str = "unassigned") -> Column:
    """Name of the first pattern that matches."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(p.matches(text), F.lit(p.name)).otherwise(out)
    return F.coalesce(out, F.lit(unassigned))


def with_nicknames(df: DataFrame, patterns: list[Pattern], source: str = "name", into: str = "nickname", unassigned: str = "unassigned", overwrite: bool = False) -> DataFrame:
    if source not in df.columns:
        raise ValueError(f"no column {source}")
    if into in df.columns and not overwrite:
        raise ValueError(f"column {into} is there already")
    if into in ("species", "name", "sequence", "uid", "ott", "alignment", "keep", "always_keep"):
        raise ValueError(f"{into} is a reserved column")
    return df.withColumn(into, nickname(F.col(source), patterns, unassigned))
