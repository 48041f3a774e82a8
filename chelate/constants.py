"""Element tables, reference polyhedra, tokens and thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import sqrt

#: Symbol -> row, group, electronegativity.
METALS = {
    "Sc": (4, 3, 1.36), "Ti": (4, 4, 1.54), "V": (4, 5, 1.63), "Cr": (4, 6, 1.66), "Mn": (4, 7, 1.55),
    "Fe": (4, 8, 1.83), "Co": (4, 9, 1.88), "Ni": (4, 10, 1.91), "Cu": (4, 11, 1.90), "Zn": (4, 12, 1.65),
    "Y": (5, 3, 1.22), "Zr": (5, 4, 1.33), "Nb": (5, 5, 1.6), "Mo": (5, 6, 2.16), "Tc": (5, 7, 1.9),
    "Ru": (5, 8, 2.2), "Rh": (5, 9, 2.28), "Pd": (5, 10, 2.20), "Ag": (5, 11, 1.93), "Cd": (5, 12, 1.69),
    "La": (6, 3, 1.1), "Hf": (6, 4, 1.3), "Ta": (6, 5, 1.5), "W": (6, 6, 2.36), "Re": (6, 7, 1.9),
    "Os": (6, 8, 2.2), "Ir": (6, 9, 2.2), "Pt": (6, 10, 2.28), "Au": (6, 11, 2.54), "Hg": (6, 12, 2.0),
}
#: Oxidation state by metal and coordination number; 2 for the metal's other numbers.
OXIDATION = {
    "Fe": {4: 2, 5: 2, 6: 2}, "Co": {4: 2, 5: 2, 6: 3}, "Ni": {4: 2, 5: 2, 6: 2}, "Cu": {4: 2, 5: 2, 6: 2}, "Zn": {4: 2, 5: 2, 6: 2},
    "Pd": {4: 2, 5: 2, 6: 4}, "Pt": {4: 2, 5: 2, 6: 4}, "Ru": {5: 2, 6: 2}, "Rh": {4: 1, 5: 3, 6: 3},
}
#: What the graph builder knows besides; encoding doesn't use it.
BUILDER_OXIDATION = OXIDATION | {"Ir": {4: 1, 5: 3, 6: 3}}
#: Elements that can donate, and atomic numbers (others count as 0).
DONORS = ("N", "O", "S", "P", "Cl", "Br", "I", "F", "C", "Se", "Te", "As")
ATOMIC_NUMBER = {"H": 1, "C": 6, "N": 7, "O": 8, "F": 9, "P": 15, "S": 16, "Cl": 17, "Br": 35, "I": 53, "Se": 34, "Te": 52, "As": 33}
#: The numbers that order ligands know only these elements.
LIGAND_NUMBER = {e: ATOMIC_NUMBER[e] for e in ("H", "C", "N", "O", "F", "P", "S", "Cl", "Br", "I")}
H3 = sqrt(3) / 2
#: Vertices of the reference polyhedra by coordination number, in label order.
POLYHEDRA = {
    2: {"L": [(0, 0, 1), (0, 0, -1)]},
    3: {"TP": [(1, 0, 0), (-0.5, H3, 0), (-0.5, -H3, 0)]},
    4: {"Td": [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)], "SP": [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)]},
    5: {
        "TBP": [(0, 0, 1), (0, 0, -1), (1, 0, 0), (-0.5, H3, 0), (-0.5, -H3, 0)],
        "SPY": [(0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)],
    },
    6: {
        "Oh": [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)],
        "TPr": [(1, 0, 0.5), (-0.5, H3, 0.5), (-0.5, -H3, 0.5), (1, 0, -0.5), (-0.5, H3, -0.5), (-0.5, -H3, -0.5)],
    },
}


def polyhedron(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Vertices about their centroid, at a mean radius of 1."""
    n = len(points)
    mid = [sum(p[k] for p in points) / n for k in range(3)]
    moved = [tuple(p[k] - mid[k] for k in range(3)) for p in points]
    mean = sum(sqrt(x * x + y * y + z * z) for x, y, z in moved) / n
    return [(x / mean, y / mean, z / mean) for x, y, z in moved]


def orders(n: int) -> list[tuple[int, ...]]:
    return list(permutations(range(n)))


@dataclass(frozen=True)
class Config:
    """Thresholds of the encoding."""

    bond_order: float = 0.3
    distance: float = 2.8
    edge_order: float = 0.1
    edge_distance: float = 1.8
    trans_angle: float = 165.0
    cis_angles: tuple[float, float] = (75.0, 105.0)
    #: "greedy": vertices are assigned in signature order, ties by position; "exact": the least over all assignments
    assignment: str = "greedy"
    decimals: int = 2
    #: whether more than one metal is no issue
    allow_multimetal: bool = False
    #: "formula": a ligand is named by its formula; "smiles": by its canonical SMILES where there are bond orders
    ligand_key: str = "formula"
