"""Newick trees: a parser without recursion, a writer, and the relational form."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TableError


@dataclass(eq=False)
class Node:
    name: str = ""
    children: list[Node] = field(default_factory=list)
    dist: float | None = None
    support: float | None = None
    props: dict = field(default_factory=dict)
    parent: Node | None = field(default=None, repr=False)

    def __post_init__(self):
        for c in self.children:
            c.parent = self

    def add(self, child: Node) -> Node:
        self.children.append(child)
        child.parent = self
        return child

    def preorder(self) -> list[Node]:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += reversed(n.children)
        return out

    def postorder(self) -> list[Node]:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += n.children
        return out[::-1]

    def leaves(self) -> list[Node]:
        return [n for n in self.preorder() if not n.children]

    def depth(self) -> int:
        n, d = self, 0
        while n.parent is not None:
            n, d = n.parent, d + 1
        return d


def parse(text: str) -> Node:
    """Tree of a newick string; inner labels that are numbers are supports, others names."""
    tokens, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "(),:;":
            tokens.append(c)
            i += 1
        elif c == "'":
            j = i + 1
            while j < n and (text[j] != "'" or text[j + 1 : j + 2] == "'"):
                j += 2 if text[j] == "'" else 1
            tokens.append("=" + text[i + 1 : j].replace("''", "'"))
            i = j + 1
        elif c == "[":
            i = text.find("]", i) + 1 or n
        elif c.isspace():
            i += 1
        else:
            j = i
            while j < n and text[j] not in "(),:;['" and not text[j].isspace():
                j += 1
            tokens.append("=" + text[i:j])
            i = j
    if not tokens or tokens[-1] != ";":
        raise TableError("a tree ends with ';'")
    root = at = Node()
    after_colon = False
    opened = False
    for t in tokens[:-1]:
        if t == "(":
            at = at.add(Node())
            opened = True
        elif t == ",":
            if at.parent is None:
                raise TableError("a comma outside brackets")
            at = at.parent.add(Node())
        elif t == ")":
            if at.parent is None:
                raise TableError("brackets don't match")
            at = at.parent
        elif t == ":":
            after_colon = True
            continue
        elif t.startswith("="):
            if after_colon:
                try:
                    at.dist = float(t[1:])
                except ValueError:
                    raise TableError(f"{t[1:]!r} is no length") from None
            elif at.children:
                try:
                    at.support = float(t[1:])
                except ValueError:
                    at.name = t[1:]
            else:
                at.name = t[1:]
        after_colon = False
    if at is not root or not (opened or root.name):
        raise TableError("brackets don't match")
    return root


def _label(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if any(c in text for c in "()[]:;,' \t") else text


def write(root: Node, inner=None, lengths: bool = True) -> str:
    """Newick of a tree; inner: a function of an inner node that gives its label (its name or support by default)."""

    def given(n: Node) -> str:
        if n.name:
            return n.name
        return "" if n.support is None else f"{n.support:g}"

    inner = inner or given
    text: dict[int, str] = {}
    for n in root.postorder():
        s = "(" + ",".join(text.pop(id(c)) for c in n.children) + ")" + _label(str(inner(n))) if n.children else _label(n.name)
        text[id(n)] = s + (f":{n.dist:.10g}" if lengths and n.dist is not None and n is not root else "")
    return text[id(root)] + ";"


def splits(root: Node, rooted: bool = True) -> list[tuple[str, Node]]:
    """Key and node of every node: sorted leaves joined by commas; ROOT for all leaves.

    Unrooted, a side that holds the smallest leaf name is replaced by the other one.
    """
    below: dict[int, frozenset[str]] = {}
    for n in root.postorder():
        below[id(n)] = frozenset([n.name]) if not n.children else frozenset().union(*(below[id(c)] for c in n.children))
    every = below[id(root)]
    smallest = min(every)
    out = []
    for n in root.preorder():
        side = below[id(n)]
        if side == every:
            out.append(("ROOT", n))
            continue
        if not rooted and smallest in side:
            side = every - side
        out.append((",".join(sorted(side)), n))
    return out


NODES = "tree_id long, node_id long, parent_id long, depth long, is_leaf boolean, name string, dist double, support double, n_children long, split_key string"


def node_table(trees: DataFrame, key: str = "tree_id", newick: str = "newick", rooted: bool = True) -> DataFrame:
    """One row for each node of each tree; ids in preorder, 0 is the root."""

    def run(batches):
        for b in batches:
            rows = []
            for k, text in zip(b["k"], b["t"], strict=True):
                root = parse(text)
                ids = {id(n): i for i, n in enumerate(root.preorder())}
                depth: dict[int, int] = {}
                for s, n in splits(root, rooted):
                    depth[id(n)] = 0 if n.parent is None else depth[id(n.parent)] + 1
                    rows.append((k, ids[id(n)], ids[id(n.parent)] if n.parent is not None else None, depth[id(n)], not n.children, n.name, n.dist, n.support, len(n.children), s))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in NODES.split(", ")])
            out["parent_id"] = out["parent_id"].astype("Int64")
            yield out

    return trees.select(F.col(key).cast("long").alias("k"), F.col(newick).alias("t")).mapInPandas(run, NODES)


def read_trees(spark, path: str) -> DataFrame:
    """tree_id and newick, one for each line that has a ';'."""
    lines = spark.read.text(path).where(F.col("value").contains(";"))
    return lines.select(F.monotonically_increasing_id().alias("tree_id"), F.col("value").alias("newick"))
