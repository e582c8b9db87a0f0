"""Column names: normalising, snake case, and telling duplicates apart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ref(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalised(name: str) -> str:
    """Lower-case words joined by underscores; "col" if nothing is left."""
    out = re.sub(r"\s+", "_", name.strip()).lower()
    return re.sub(r"[^a-z0-9_]+", "_", out).strip("_") or "col"


def snake(name: str) -> str:
    """Blanks, dashes and slashes as underscores; other signs go."""
    out = "".join("_" if c in " -/" else c for c in name.strip().lower() if c.isalnum() or c in " -/_")
    return re.sub(r"_+", "_", out).strip("_")


def unique(names: list[str]) -> list[str]:
    """Each repeated name gets the lowest free " [N]", in order of appearance."""
    taken, out = set(names), []
    seen: set[str] = set()
    for name in names:
        if name in seen:
            n = 2
            while f"{name} [{n}]" in taken or f"{name} [{n}]" in seen:
                n += 1
            name = f"{name} [{n}]"
        seen.add(name)
        out.append(name)
    return out


def renamed(df: DataFrame, how=normalised) -> DataFrame:
    return df.toDF(*unique([how(c) for c in df.columns]))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in the order asked for; "a.b" keeps the struct around b. An unknown name is refused
    with those there are; no column at all is a legal projection."""
    tops = {c.split(".")[0] for c in columns}
    if unknown := sorted(tops - set(df.columns)):
        import difflib

        near = difflib.get_close_matches(unknown[0], df.columns, 1)
        raise KeyError(f"no column {', '.join(unknown)}; there are {', '.join(df.columns)}" + (f"; did you mean {near[0]}?" if near else ""))
    made = []
    for top in dict.fromkeys(c.split(".")[0] for c in columns):
        paths = [c.split(".", 1)[1] for c in columns if c.startswith(top + ".")]
        whole = top in columns or not paths
        made.append(ref(top) if whole else F.struct(*[F.col(f"`{top}`.{p}").alias(p.split(".")[-1]) for p in paths]).alias(top))
    return df.select(*made)
