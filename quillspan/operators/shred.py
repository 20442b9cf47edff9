"""Deeply nested records as columns with repetition and definition levels, and back to flat tables (problem 4).

A schema names the nodes of a record: ``group`` (an object), ``leaf`` (a value) and ``repeated`` (a list of
one of these). ``shred`` parses each record once and writes, for every leaf path, three aligned arrays: the
values that are present, and for each entry a repetition level (the repeated ancestor at which the entry
begins anew: 0 = new record, k = next element of the k-th repeated ancestor) and a definition level (how many
of the optional or repeated nodes of the path are there). Nulls and empty lists need no value: their level
says where the path ends. ``flatten`` rebuilds the table of one repeated ancestor from the level sequences
alone: element numbers by counting repetitions, presence by definition levels.

How JSON that departs from the schema is read: an object (or value) in place of a list is a list of one; a
string in place of an object is parsed as JSON if it holds an object; anything else of a wrong type counts as
null; a null element of a list keeps its place and has no row. Unknown fields are left out. A body that is
null, isn't valid JSON, or isn't an object gives no row in any table (``invalid_records`` lists them). Numbers
such as NaN aren't JSON. Rows under the same key stay apart only if their keys differ; a null key gives no row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A place in the schema. ``box`` leaves hold four numbers given as a list or as an object of x0 y0 x1 y1."""

    name: str
    kind: str = "leaf"  # leaf, box, group
    repeated: bool = False
    children: tuple["Node", ...] = field(default=())


def leaf(name: str) -> Node:
    return Node(name)


def box(name: str) -> Node:
    return Node(name, "box")


def group(name: str, *children: Node) -> Node:
    return Node(name, "group", False, children)


def many(name: str, *children: Node) -> Node:
    return Node(name, "group" if children else "leaf", True, children)


@dataclass(frozen=True)
class LeafPath:
    """A leaf path: its dotted name and, for every node on it, whether it's repeated."""

    path: str
    repeated: tuple[bool, ...]
    kind: str

    @property
    def max_def(self) -> int:
        return len(self.repeated) + sum(self.repeated)


def columns_of(root: Node) -> list[LeafPath]:
    out: list[LeafPath] = []

    def walk(node: Node, path: tuple[str, ...], reps: tuple[bool, ...]) -> None:
        path, reps = (*path, node.name), (*reps, node.repeated)
        if node.kind == "group":
            for c in node.children:
                walk(c, path, reps)
        else:
            out.append(LeafPath(".".join(path), reps, node.kind))

    for c in root.children:
        walk(c, (), ())
    return out


def prune(root: Node, paths: set[str]) -> Node:
    """The schema with only these leaf paths, so that a query shreds no column it doesn't read."""

    def keep(node: Node, at: str) -> Node | None:
        if node.kind != "group":
            return node if at in paths else None
        kids = tuple(k for c in node.children if (k := keep(c, f"{at}.{c.name}" if at else c.name)))
        return Node(node.name, "group", node.repeated, kids) if kids else None

    return keep(root, "") or Node("", "group")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_object(body: str | None) -> dict | None:
    """A JSON object, or None."""
    if body is None:
        return None
    try:
        value = json.loads(body, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _text(value: object) -> str | None:
    if value is None or isinstance(value, dict | list):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    text = value if isinstance(value, str) else repr(value)
    return text.encode("utf-8", "replace").decode("utf-8") if isinstance(value, str) else text


def _box(value: object) -> str | None:
    if isinstance(value, dict):
        parts = [value.get(k) for k in ("x0", "y0", "x1", "y1")]
    elif isinstance(value, list):
        parts = value[:4] if len(value) >= 4 else []
    elif isinstance(value, str):
        parts = re.findall(r"-?\d+(?:[.,]\d+)?", value)[:4]
    else:
        return None
    texts = [_text(p) for p in parts]
    return "|".join("" if t is None else t.replace(",", ".").strip() for t in texts) if any(t is not None for t in texts) else None


def shred_record(value: dict, root: Node, sink: dict[str, tuple[list[int], list[int], list[str]]]) -> None:
    """Append one record's entries to ``sink``: path -> (repetition levels, definition levels, values)."""

    def absent(node: Node, path: str, rep: int, dfn: int) -> None:
        if node.kind == "group":
            for c in node.children:
                absent(c, f"{path}.{c.name}", rep, dfn)
        else:
            r, d, _ = sink[path]
            r.append(rep)
            d.append(dfn)

    def one(node: Node, x: object, path: str, rep: int, dfn: int, depth: int) -> None:
        """An element or single value; ``dfn`` counts the nodes that are there before it."""
        if node.kind == "group":
            if isinstance(x, str):
                x = parse_object(x)
            if not isinstance(x, dict):
                absent(node, path, rep, dfn)
                return
            for c in node.children:
                put(c, x.get(c.name), f"{path}.{c.name}", rep, dfn + 1, depth)
            return
        text = _box(x) if node.kind == "box" else _text(x)
        r, d, v = sink[path]
        r.append(rep)
        d.append(dfn + (text is not None))
        if text is not None:
            v.append(text)

    def put(node: Node, x: object, path: str, rep: int, dfn: int, depth: int) -> None:
        if not node.repeated:
            one(node, x, path, rep, dfn, depth)
            return
        if isinstance(x, str) and node.kind == "group":
            try:
                x = json.loads(x, parse_constant=_no_constant)
            except (ValueError, RecursionError):
                x = None
        elements = x if isinstance(x, list) else [] if x is None or (node.kind == "group" and not isinstance(x, dict)) else [x]
        if not elements:
            absent(node, path, rep, dfn)
            return
        for i, e in enumerate(elements):
            one(node, e, path, rep if i == 0 else depth + 1, dfn + 1, depth + 1)

    for c in root.children:
        put(c, value.get(c.name), c.name, 0, 0, 0)


LEVELS = "array<tinyint>"


def shred(rows: DataFrame, key: str, body: str, root: Node) -> DataFrame:
    """(key, columns): for each readable record, path -> (rep, def, vals). One narrow pass."""
    paths = [c.path for c in columns_of(root)]
    fields = ", ".join(f"`{p}`: struct<rep: {LEVELS}, def: {LEVELS}, vals: array<string>>" for p in paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "columns": []}
            for k, text in zip(batch["key"], batch["body"], strict=True):
                value = parse_object(text)
                if value is None:
                    continue
                sink: dict[str, tuple] = {p: ([], [], []) for p in paths}
                shred_record(value, root, sink)
                out["key"].append(k)
                out["columns"].append({p: {"rep": r, "def": d, "vals": v} for p, (r, d, v) in sink.items()})
            if out["key"]:
                yield pd.DataFrame(out)

    return (
        rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{body}`").alias("body"))
        .where("key is not null and body is not null")
        .mapInPandas(run, f"key long, columns struct<{fields}>")
    )


def _assemble(columns: list[LeafPath], wanted: dict[str, str], ancestor_depth: int, ancestors: int, names: list[str], above: dict[str, str]):
    """Rebuild the rows of one repeated ancestor from level sequences (or one row a record, with no ancestor)."""
    by_path = {c.path: c for c in columns}
    # the ancestor's own element is there when this many levels are defined
    need = {out: sum(1 + r for r in by_path[p].repeated[:ancestor_depth]) for out, p in wanted.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, cols in zip(batch["key"], batch["columns"], strict=True):
                head = [cols[p]["vals"][0] if cols[p]["def"][0] == by_path[p].max_def else None for p in above.values()]
                found: dict[tuple[int, ...], dict[str, str | None]] = {}
                for out, path in wanted.items():
                    column, part = by_path[path], cols[path]
                    at, used, full = [0] * ancestors, 0, column.max_def
                    vals = part["vals"]
                    for rep, dfn in zip(part["rep"], part["def"], strict=True):
                        if rep == 0:
                            at = [1] * ancestors
                        elif rep <= ancestors:
                            at = [*at[: rep - 1], at[rep - 1] + 1, *[1] * (ancestors - rep)]
                        there = dfn == full
                        if dfn >= need[out]:
                            found.setdefault(tuple(at), dict.fromkeys(wanted))[out] = vals[used] if there else None
                        used += there
                rows += [(k, *at, *values.values(), *head) for at, values in found.items()]
            yield pd.DataFrame(rows or None, columns=["key", *names, *wanted, *above])

    return run


def flatten(shredded: DataFrame, root: Node, ancestor: str, wanted: dict[str, str], numbers: list[str], above: dict[str, str] | None = None) -> DataFrame:
    """The table of the repeated node ``ancestor`` (dotted path, '' = the record itself).

    ``wanted``: output column -> leaf path at or below no further repeated node. ``numbers`` names the place
    columns, one for each repeated node on the ancestor's path, outermost first: with the key they are the
    row's own key, and without the last the key of its parent row. ``above``: output column -> leaf path under
    no repeated node, copied to each row of its record.
    """
    columns = columns_of(root)
    depth = len(ancestor.split(".")) if ancestor else 0
    sample = next(c for c in columns if c.path in wanted.values())
    ancestors = sum(sample.repeated[:depth])
    if len(numbers) != ancestors:
        raise ValueError(f"{ancestor} has {ancestors} repeated nodes")
    above = above or {}
    keep = shredded.select("key", F.struct(*[F.col(f"columns.`{p}`").alias(p) for p in dict.fromkeys((*wanted.values(), *above.values()))]).alias("columns"))
    schema = ", ".join(["key long", *[f"{n} long" for n in numbers], *[f"{w} string" for w in (*wanted, *above)]])
    return keep.mapInPandas(_assemble(columns, wanted, depth, ancestors, numbers, above), schema)


def number_of(text: Column) -> Column:
    """A number however written: blanks are left out and a comma may stand for the point. Null if it isn't one."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x{A0}\x{2009}\x{202F}]", ""), ",", ".").try_cast("double")


def box_column(text: Column, i: int) -> Column:
    """The i-th number of a box leaf, rounded half up to a BIGINT; -1 if absent or null."""
    return F.coalesce(F.floor(number_of(F.element_at(F.split(text, r"\|"), i + 1)) + 0.5).cast("long"), F.lit(-1).cast("long"))


# The response part of the contract's open_question records.
OPEN_QUESTION = group(
    "",
    group(
        "request",
        leaf("job_id"), leaf("language"),
        group("key", many("questions", leaf("id"), leaf("question"), leaf("points"))),
    ),
    group(
        "response",
        leaf("job_id"), leaf("type"), leaf("status"),
        many(
            "marks",
            leaf("kind"), box("bbox"), leaf("reason"), leaf("text"), leaf("explanation"), leaf("confidence"), leaf("line_id"), leaf("needs_review"),
            many("letters", leaf("ink"), leaf("correct"), box("bbox")),
        ),
        group(
            "score_card",
            leaf("score"), leaf("max_score"), leaf("summary"), leaf("confidence"), leaf("feedback_for_teacher"),
            many(
                "answers",
                leaf("id"), leaf("points_awarded"), leaf("points_max"), leaf("comment"), leaf("read_answer"), box("answer_bbox"),
                many("required_points_hit", leaf("point"), leaf("hit"), leaf("line_id")),
                many("factual_errors", leaf("text"), box("bbox"), leaf("why"), leaf("kind")),
            ),
        ),
    ),
)
