"""The least way to name equal ligands: over all permutations of a group's ids, whose trans pairs, written in order, are least.

Ids are given in the order of texts, least first. A ligand's pairs to later ones are written as it gets its
id, its partners standing before others of their cell; of all ligands that can have the id, those that write
the least are kept. Where two ways have written the same and leave equal graphs, one is followed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chelate.functions.smiles import numbered, ranks

#: Follows every text: a list that goes on is less than one that ends, since what comes later is greater.
END = "\U0010ffff"

#: A pair's ligands, each with its place: the donor's element and rank.
Pair = tuple[str, str, str, str]


def in_text(lig: str) -> str:
    """Orders ids as the texts do that they begin: L10: is before L1:."""
    return f"{lig}:"


@lru_cache(10_000)
def certificate(colours: tuple, edges: tuple) -> tuple:
    """Equal for equal graphs alone; edges are (i, j, kind as i has it), either way about."""
    graph: list[dict] = [{} for _ in colours]
    for i, j, kind in edges:
        graph[i][j] = kind
    places = ranks(graph, numbered(list(colours))) if len(colours) > 1 else [0]
    return tuple(sorted(zip(places, colours, strict=True))), tuple(sorted((places[i], places[j], kind) for i, j, kind in edges))


def least_pairs(group: tuple[str, ...], pairs: tuple[Pair, ...]) -> tuple[tuple[str, ...], bool]:
    """The pairs' texts in order, least over all ways to deal the group's ids to its members; and whether several ways give them."""
    near: dict[str, list[tuple[str, str, str]]] = {}
    for u, p, v, q in pairs:
        if u == v:
            near.setdefault(u, []).append((min(p, q), u, max(p, q)))
        else:
            near.setdefault(u, []).append((p, v, q))
            near.setdefault(v, []).append((q, u, p))
    members = [v for v in group if v in near]
    ids = sorted(group, key=in_text)[: len(members)]  # who isn't in a pair comes last
    fixed = near.keys() - set(group)

    def wrote(v: str, name: str, cells: list[list[str]]) -> tuple[list[str], list[list[str]]]:
        """The pairs of v, named so, with what comes later, and the cells of the members without a name, split by them."""
        out = []
        for own in sorted({p for p, _, _ in near[v]}):
            to: dict[str, list[str]] = {}
            for p, w, q in sorted(near[v]):
                if p == own:
                    to.setdefault(w, []).append(q)
            split = []
            for cell in cells:
                kinds: dict[tuple, list[str]] = {}
                for w in cell:
                    kinds.setdefault((*(f"{q}}}" for q in to.get(w, ())), END), []).append(w)
                split += [kinds[k] for k in sorted(kinds)]
            cells = split
            left = [w for cell in cells for w in cell]
            later = {v: name} | {w: w for w in fixed if in_text(w) > in_text(name)} | dict(zip(left, ids[len(ids) - len(left) :], strict=True))
            out += [f"{name}:{own}--{t}" for t in sorted(f"{later[w]}:{q}" for w, qs in to.items() if w in later for q in qs)]
        return out, cells

    def left_over(cells: list[list[str]], name: str) -> tuple:
        """Equal where the graphs of members without a name are, so that they will write the same."""
        cell_of = {w: k for k, cell in enumerate(cells) for w in cell}
        colour = {w: (k, tuple(sorted((p, "" if x == w else x, q) for p, x, q in near[w] if x == w or x in fixed and in_text(x) > in_text(name)))) for w, k in cell_of.items()}
        out, seen = [], set()
        for start in cell_of:
            if start in seen:
                continue
            seen.add(start)
            part = [start]
            for w in part:
                for _, x, _ in near[w]:
                    if x in cell_of and x not in seen:
                        seen.add(x)
                        part.append(x)
            at = {w: n for n, w in enumerate(sorted(part, key=lambda w: (colour[w], len(near[w]))))}
            kinds: dict[tuple[int, int], list] = {}
            for w, i in at.items():
                for p, x, q in near[w]:
                    if x in at and x != w:
                        kinds.setdefault((i, at[x]), []).append((p, q))
            out.append(certificate(tuple(colour[w] for w in at), tuple((*e, tuple(sorted(k))) for e, k in sorted(kinds.items()))))
        return tuple(sorted(out))

    ways, texts, several = [[members] if members else []], [], len(group) - len(members) > 1
    for name in sorted([*fixed, *ids], key=in_text):
        found = []
        for cells in ways:
            for v in [name] if name in fixed else cells[0]:
                rest = cells if name in fixed else [c for c in ([w for w in cells[0] if w != v], *cells[1:]) if c]
                found.append(wrote(v, name, rest))
        least = min(([*(f"{t}}}" for t in out), END] for out, _ in found))
        kept = [(out, cells) for out, cells in found if [*(f"{t}}}" for t in out), END] == least]
        texts += kept[0][0]
        unlike = {left_over(cells, name): cells for _, cells in kept} if len(kept) > 1 else {(): kept[0][1]}
        several = several or len(unlike) < len(kept)
        ways = list(unlike.values())
    return tuple(texts), several


@lru_cache(10_000)
def least_names(kinds: tuple, pairs: tuple[Pair, ...]) -> tuple[tuple[str, ...], bool]:
    """The least texts, one group of equal ligands named anew at a time, and whether names other than the given ones have them; pairs are in order."""
    groups: dict[object, list[str]] = {}
    for i, kind in enumerate(kinds, 1):
        if kind is not None:
            groups.setdefault(kind, []).append(f"L{i}")
    found = [least_pairs(tuple(g), pairs) for g in groups.values() if len(g) > 1]
    given = tuple(f"{u}:{p}--{v}:{q}" for u, p, v, q in pairs)
    texts = min([given, *(t for t, _ in found)], key=lambda t: [f"{x}}}" for x in t])
    return texts, texts != given or any(several for _, several in found)


def least_trans(ligands: Column) -> Column:
    """pairs and again: least_names() of a struct with the smiles of ligands L1, L2 and so on, and with pairs, two ids and places of each in a row; null for null."""

    @F.arrow_udf("struct<pairs:array<string>,again:boolean>")
    def of_rows(ligands: pa.Array) -> pa.Array:
        there = ligands.is_valid()  # most rows are null: only the others become Python's
        out = []
        for x in ligands.filter(there).to_pylist():
            first: dict[str, int] = {}  # kinds by number: rows with other ligands named alike are looked up
            kinds = tuple(None if s is None else first.setdefault(s, len(first)) for s in x["smiles"])
            texts, again = least_names(kinds, tuple(zip(*[iter(x["pairs"])] * 4, strict=True)))
            out.append({"pairs": texts, "again": again})
        place = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
        found = pa.array(out, pa.struct([("pairs", pa.list_(pa.string())), ("again", pa.bool_())]))
        return found.take(pa.array(place, pa.int64(), mask=ligands.is_null().to_numpy(zero_copy_only=False)))

    return of_rows(ligands)
