"""Questions as files: loading, naming, and composing templates.

A template includes another by ``:compose(path)``; ``:compose(path, @slot =
path)`` fills the included one's ``:compose(@slot)``. Lines that begin with #
are comments. What a composed text still leaves open is refused.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.digest import fingerprint

INCLUDE = re.compile(r":compose\(\s*([^()]*?)\s*\)")
DIRECTIVE = re.compile(r":(compose|bind)\(|(?<!:):[a-z_]+\(")


class Open(ValueError):
    """A template with a directive left, a slot unfilled or a file missing."""


def stripped(text: str) -> str:
    return "\n".join(x for x in text.split("\n") if not x.lstrip().startswith("#"))


def found(name: str, folders: list[Path]) -> Path:
    for f in folders:
        if (p := f / name).is_file():
            return p
    raise Open(f"no file {name}")


def compose(path: str | Path, folders: list[str | Path] = (), slots: dict[str, str] | None = None, above: tuple[Path, ...] = ()) -> str:
    """The text of a template with everything it includes, in place."""
    p = Path(path)
    search = [p.parent, *map(Path, folders)]
    if p.resolve() in above:
        raise Open(f"{p} includes itself")
    slots = slots or {}

    def fill(m: re.Match) -> str:
        first, *rest = [x.strip() for x in m[1].split(",")]
        if first.startswith("@"):
            if first not in slots:
                raise Open(f"{p}: slot {first} is open")
            first = slots[first]
        own = dict(tuple(y.strip() for y in x.split("=", 1)) for x in rest)
        return compose(found(first, search), search, own, (*above, p.resolve())).strip().rstrip(";")

    out = INCLUDE.sub(fill, stripped(p.read_text()))
    if left := DIRECTIVE.search(out):
        raise Open(f"{p}: {left[0]} is left")
    return out


def load(folder: str | Path, search: list[str | Path] = ()) -> dict[str, str]:
    """Every .sql and .sqlc file below a folder, composed, by its path without
    the ending; two files of one name are refused."""
    out: dict[str, str] = {}
    for p in sorted(Path(folder).rglob("*.sql*")):
        name = str(p.relative_to(folder).with_suffix(""))
        if name in out:
            raise ValueError(f"{name} is there twice")
        out[name] = compose(p, [folder, *search]).strip().rstrip(";")
    return out


def named(questions: dict[str, str]) -> str:
    """A short name of a question set, by its texts."""
    return fingerprint(*[x.encode() for k in sorted(questions) for x in (k, questions[k])])


def answered(spark: SparkSession, text: str, **args) -> DataFrame:
    """A question's rows. Only a single query is taken: commands are refused."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    kind = plan.getClass().getName()
    if ".command." in kind or "Create" in kind or "Insert" in kind or "Drop" in kind or "SetCommand" in kind:
        raise ValueError(f"not a query: {kind.rsplit('.', 1)[-1]}")
    return spark.sql(text, args=args) if args else spark.sql(text)
