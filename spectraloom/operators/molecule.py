"""Structures as small graphs: a SMILES reader and the anatomy of glycerophospholipids.

A molecule is one row's value, tens of atoms large, so it is taken apart inside one Arrow-batched
function over the distinct structures; no graph ever crosses rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.arrow import map_columns
from spectraloom.functions import rules

#: Atoms that take no part in the partition (counter-ions), and default valences of the organic subset.
COUNTER_IONS = {"Li", "Na", "Mg", "K", "Ca", "Cl", "Br", "I"}
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
PARSER_VERSION = "graph-v1"

_TOKEN = re.compile(r"\[(?P<iso>\d*)(?P<sym>[A-Z][a-z]?|[a-z]{1,2}|\*)(?P<chiral>@{0,2})(?:H(?P<h>\d*))?(?P<charge>\++\d*|-+\d*)?(?::\d+)?\]|(?P<organic>Br|Cl|[BCNOPSFI]|[bcnops])|(?P<bond>[-=#$:/\\~])|(?P<ring>%\d\d|\d)|(?P<open>\()|(?P<close>\))|(?P<dot>\.)")
_ORDER = {"-": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "/": 1.0, "\\": 1.0, "~": 1.0}


class BadStructure(ValueError):
    """A text that is no structure."""


@dataclass
class Molecule:
    """Heavy atoms with charges, and bonds by neighbour. Explicit hydrogens are folded into their atoms."""

    symbol: list[str] = field(default_factory=list)
    charge: list[int] = field(default_factory=list)
    aromatic: list[bool] = field(default_factory=list)
    bonds: list[dict[int, float]] = field(default_factory=list)

    def reach(self, start: int, blocked: set[int]) -> set[int]:
        """Atoms reachable from ``start`` around ``blocked``."""
        if start in blocked:
            return set()
        found, front = {start}, [start]
        while front:
            front = [n for a in front for n in self.bonds[a] if n not in blocked and n not in found and not found.add(n)]
        return found

    def near(self, atom: int, symbol: str) -> list[int]:
        return [n for n in self.bonds[atom] if self.symbol[n] == symbol]

    def double_to(self, atom: int, symbol: str) -> bool:
        return any(self.symbol[n] == symbol and order == 2 for n, order in self.bonds[atom].items())

    def ring_bonds(self) -> set[frozenset[int]]:
        """Bonds that lie on a cycle: those whose ends stay connected without them."""
        out: set[frozenset[int]] = set()
        seen: set[int] = set()
        pieces = sum(1 for i in range(len(self.bonds)) if i not in seen and not seen.update(self.reach(i, set())))
        if sum(map(len, self.bonds)) // 2 == len(self.bonds) - pieces:
            return out  # a forest
        for a, near in enumerate(self.bonds):
            for b in list(near):
                if a < b:
                    order_ab = self.bonds[a].pop(b)
                    self.bonds[b].pop(a)
                    if b in self.reach(a, set()):
                        out.add(frozenset((a, b)))
                    self.bonds[a][b] = self.bonds[b][a] = order_ab
        return out


def read_smiles(text: str) -> Molecule:
    """The molecule of a SMILES text: organic subset, bracket atoms, branches, ring closures; stereo marks are passed over.

    Raises ``BadStructure`` for unknown characters, unbalanced brackets or rings, and atoms with too many bonds.
    """
    mol, at, previous, order, branches = Molecule(), 0, -1, None, []
    rings: dict[str, tuple[int, float | None]] = {}
    bare: list[bool] = []

    def join(a: int, b: int, given: float | None) -> None:
        if a == b or b in mol.bonds[a]:
            raise BadStructure("bond to itself or twice")
        value = given if given is not None else (1.5 if mol.aromatic[a] and mol.aromatic[b] else 1.0)
        mol.bonds[a][b] = mol.bonds[b][a] = value

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadStructure(f"unreadable at {at}")
        at = m.end()
        if m["organic"] or m["sym"]:
            name = m["organic"] or m["sym"]
            charge = 0
            if sign := m["charge"]:
                digits = sign.lstrip("+-")
                charge = (1 if sign[0] == "+" else -1) * (int(digits) if digits else len(sign))
            mol.symbol.append(name.capitalize())
            mol.charge.append(charge)
            mol.aromatic.append(name[0].islower())
            mol.bonds.append({})
            bare.append(bool(m["organic"]))
            here = len(mol.symbol) - 1
            if previous >= 0:
                join(previous, here, order)
            previous, order = here, None
        elif m["bond"]:
            order = _ORDER[m["bond"]]
        elif m["ring"]:
            if previous < 0:
                raise BadStructure("ring before an atom")
            other = rings.pop(m["ring"], None)
            if other is None:
                rings[m["ring"]] = (previous, order)
            else:
                join(other[0], previous, order if order is not None else other[1])
            order = None
        elif m["open"]:
            if previous < 0:
                raise BadStructure("branch before an atom")
            branches.append(previous)
        elif m["close"]:
            if not branches:
                raise BadStructure("branch closed twice")
            previous = branches.pop()
        else:
            previous, order = -1, None
    if rings or branches or order is not None or not mol.symbol:
        raise BadStructure("open ring, branch or bond")
    for i, organic in enumerate(bare):
        allowed = VALENCES.get(mol.symbol[i])
        if organic and allowed and not mol.aromatic[i] and sum(mol.bonds[i].values()) > allowed[-1]:
            raise BadStructure("too many bonds")
    return _without_hydrogens(mol)


def _without_hydrogens(mol: Molecule) -> Molecule:
    kept = [i for i, s in enumerate(mol.symbol) if s != "H" or not mol.bonds[i]]
    new = {old: i for i, old in enumerate(kept)}
    return Molecule([mol.symbol[i] for i in kept], [mol.charge[i] for i in kept], [mol.aromatic[i] for i in kept], [{new[n]: o for n, o in mol.bonds[i].items() if n in new} for i in kept])


@dataclass
class Arm:
    """What hangs on an oxygen of the backbone."""

    position: int
    oxygen: int
    linkage: str  # ester, vinyl_ether, alkyl_ether, free or unsupported
    atoms: set[int]


@dataclass
class Backbone:
    """Three carbons that carry one phosphate and one or two chains."""

    carbons: tuple[int, int, int]
    phosphorus: int
    bridge: int
    arms: list[Arm]
    score: int

    def of(self, *kinds: str) -> list[Arm]:
        return [a for a in self.arms if a.linkage in kinds]


CHAINS = ("ester", "vinyl_ether", "alkyl_ether")


def _arm(mol: Molecule, carbon: int, oxygen: int, backbone: set[int], position: int) -> Arm:
    beyond = [n for n in mol.bonds[oxygen] if n != carbon and n not in backbone]
    if not beyond:
        return Arm(position, oxygen, "free", set())
    first = beyond[0]
    atoms = mol.reach(first, backbone | {oxygen})
    if mol.symbol[first] != "C":
        return Arm(position, oxygen, "unsupported", atoms)
    kind = "ester" if mol.double_to(first, "O") else "vinyl_ether" if mol.double_to(first, "C") else "alkyl_ether"
    return Arm(position, oxygen, kind, atoms)


def backbones(mol: Molecule) -> list[Backbone]:
    """All readings of the molecule as a glycerol phosphate with chains, the best first."""
    in_ring = {a for bond in mol.ring_bonds() for a in bond}
    plain = lambda i: mol.symbol[i] == "C" and not mol.aromatic[i] and i not in in_ring
    out: dict[tuple, Backbone] = {}
    for middle in filter(plain, range(len(mol.symbol))):
        ends = sorted(filter(plain, mol.bonds[middle]))
        for k, left in enumerate(ends):
            for right in ends[k + 1 :]:
                carbons = (left, middle, right)
                own = set(carbons)
                phosphates, arms, oxygens, odd = [], [], 0, 0
                for position, carbon in enumerate(carbons):
                    here = mol.near(carbon, "O")
                    oxygens += len(here)
                    odd += len(here) != 1
                    for o in here:
                        p = mol.near(o, "P")
                        if p:
                            phosphates.append((p[0], o))
                        else:
                            arms.append(_arm(mol, carbon, o, own, position))
                n = sum(a.linkage in CHAINS for a in arms)
                if len(phosphates) != 1 or n not in (1, 2):
                    continue
                free = sum(a.linkage == "free" for a in arms)
                # Weights of the score
                score = 100 + 25 * n + 5 * min(oxygens, 3) + 3 * max(0, 2 - abs(free - (2 - n))) - 20 * sum(a.linkage == "unsupported" for a in arms) - 5 * odd
                key = (frozenset(own), phosphates[0][0], tuple(sorted((a.oxygen, a.linkage) for a in arms if a.linkage in CHAINS)))
                out.setdefault(key, Backbone(carbons, *phosphates[0], arms, score))
    return sorted(out.values(), key=lambda b: -b.score)


def _amine_head(mol: Molecule, p: int, atoms: set[int], nitrogens: list[int]) -> tuple[str, int]:
    methyls = {n: sum(len(mol.bonds[c]) == 1 for c in mol.near(n, "C") if c in atoms) for n in nitrogens}
    most, positive = max(methyls.values()), any(mol.charge[n] > 0 for n in nitrogens)
    if most >= 3 and positive:
        return "phosphocholine", 1 if any(mol.charge[o] < 0 for o in mol.near(p, "O")) else 3
    acid = any(mol.symbol[c] == "C" and mol.double_to(c, "O") and any(mol.symbol[o] == "O" and b == 1 for o, b in mol.bonds[c].items()) for c in atoms)
    if acid:
        return "phosphoserine", 1 if positive or any(mol.symbol[o] == "O" and mol.charge[o] < 0 for o in atoms) else 3
    return {2: "n_dimethyl_phosphoethanolamine", 1: "n_methyl_phosphoethanolamine"}.get(most, "phosphoethanolamine"), 1


def _six_carbon_ring(mol: Molecule, atoms: set[int]) -> bool:
    carbons = {a for a in atoms if mol.symbol[a] == "C"}
    stack = [(c, (c,)) for c in carbons]
    while stack:
        last, path = stack.pop()
        for n in mol.bonds[last]:
            if n == path[0] and len(path) == 6:
                return True
            if n in carbons and n not in path and len(path) < 6:
                stack.append((n, (*path, n)))
    return False


def head_of(mol: Molecule, bone: Backbone) -> tuple[str, str | None, int | None]:
    """(status, headgroup, tier): "matched", or why there is no supported headgroup."""
    branches = []
    for o in mol.near(bone.phosphorus, "O"):
        if o != bone.bridge:
            atoms = mol.reach(o, {*bone.carbons, bone.phosphorus})
            if any(mol.symbol[a] == "C" for a in atoms):
                branches.append(atoms)
    if not branches:
        return "matched", "phosphate", 1
    if len(branches) > 1:
        return "multiple_phosphate_external_branches", None, None
    (atoms,) = branches
    count = Counter(mol.symbol[a] for a in atoms)
    carbonyls = {a for a in atoms if mol.symbol[a] == "C" and mol.double_to(a, "O")}
    nitrogens = [a for a in atoms if mol.symbol[a] == "N"]
    if any(c in carbonyls for n in nitrogens for c in mol.bonds[n]):
        return "n_acyl_phosphoethanolamine_not_supported", "phosphoethanolamine", 1
    if nitrogens:
        return "matched", *_amine_head(mol, bone.phosphorus, atoms, nitrogens)
    if count["O"] >= 5 and _six_carbon_ring(mol, atoms):
        return "matched", "phosphoinositol", 1
    if carbonyls:
        return "acylated_or_carbonyl_headgroup_not_supported", None, None
    if count["C"] == 3 and count["O"] >= 3:
        return "matched", "phosphoglycerol", 1
    if count["C"] == 1:
        return "matched", "phosphomethanol", 1
    if count["C"] == 2 and count["O"] <= 1:
        return "matched", "phosphoethanol", 1
    return "unknown_headgroup_branch", None, None


def _polar_head(mol: Molecule, p: int) -> tuple[str | None, int | None]:
    """A headgroup from the phosphate's branches alone, for molecules without a glycerol backbone."""
    for o in mol.near(p, "O"):
        atoms = mol.reach(o, {p})
        nitrogens = [a for a in atoms if mol.symbol[a] == "N"]
        if nitrogens and any(mol.symbol[a] == "C" for a in atoms):
            return _amine_head(mol, p, atoms, nitrogens)
    return None, None


def chain_facts(mol: Molecule, arm: Arm) -> dict:
    carbons = {a for a in arm.atoms if mol.symbol[a] == "C"}
    doubles = sum(mol.bonds[a].get(b) == 2 for a in carbons for b in mol.bonds[a] if b in carbons) // 2
    oxygens = sum(mol.symbol[a] == "O" for a in arm.atoms)
    carbonyl = arm.linkage == "ester" and any(mol.double_to(a, "O") for a in carbons)
    return {
        "linkage": arm.linkage, "position": arm.position, "carbon": len(carbons), "double_bonds": doubles,
        "heteroatoms": sum(mol.symbol[a] not in ("C", "H") for a in arm.atoms), "extra_oxygens": max(0, oxygens - carbonyl),
        "branches": sum(sum(n in carbons for n in mol.bonds[a]) > 2 for a in carbons),
    }


EMPTY = {
    "parse_status": "failed", "reasons": [], "headgroup": None, "head_tier": None, "backbone_family": None, "chain_count": 0, "linkages": [], "chains": [], "lipid_class": None,
    "free_hydroxyls": 0, "coverage": 0.0, "unassigned": None, "overlapping": None, "reconstruction_exact": False, "formal_charge": None,
}


def anatomy(smiles: str | None) -> dict:
    """Headgroup, backbone, chains and class of a structure, with a status and reasons.

    Statuses: success, invalid_input (null, blank or unreadable), unsupported_backbone, unsupported_topology,
    ambiguous_backbone, unsupported_extra_substitution, failed. The class comes from headgroup and chain count alone.
    """
    out = {**EMPTY, "reasons": []}

    def end(status: str, *reasons: str, **more) -> dict:
        return out | more | {"parse_status": status, "reasons": list(reasons)}

    if not smiles or not smiles.strip():
        return end("invalid_input", "missing_smiles")
    try:
        mol = read_smiles(smiles.strip())
    except BadStructure:
        return end("invalid_input", "invalid_smiles")
    phosphorus = [i for i, s in enumerate(mol.symbol) if s == "P"]
    if not phosphorus:
        return end("unsupported_backbone", "no_phosphorus_atom")
    if len(phosphorus) > 1:
        return end("unsupported_topology", "multiple_phosphorus_atoms")
    found = backbones(mol)
    if not found:
        head, tier = _polar_head(mol, phosphorus[0])
        family = "sphingoid_or_unsupported" if mol.symbol.count("N") >= 2 else "unsupported"
        return end("unsupported_backbone", "no_typical_glycerol_phosphate_backbone", headgroup=head, head_tier=tier, backbone_family=family)
    if len(found) > 1 and found[0].score == found[1].score:
        return end("ambiguous_backbone", "multiple_equivalent_glycerol_backbone_candidates")
    bone = found[0]
    status, head, tier = head_of(mol, bone)
    if status != "matched":
        return end("failed" if status == "unknown_headgroup_branch" else "unsupported_topology", status, headgroup=head, head_tier=tier, backbone_family="glycerol")
    chains = sorted(bone.of(*CHAINS), key=lambda a: (a.position, a.oxygen))
    lipid_class = rules.CLASS_OF.get((head, len(chains)))
    if lipid_class is None:
        return end("unsupported_topology", "headgroup_chain_count_combination_not_supported", headgroup=head, head_tier=tier, backbone_family="glycerol", chain_count=len(chains))
    chain_atoms = {x for a in chains for x in (a.oxygen, *a.atoms)}
    head_atoms = mol.reach(bone.phosphorus, {*bone.carbons, *chain_atoms}) | {bone.bridge}
    free = {a.oxygen for a in bone.of("free")}
    parts = [head_atoms, set(bone.carbons), chain_atoms, free]
    heavy = {i for i, s in enumerate(mol.symbol) if s not in COUNTER_IONS and s != "H"}
    times = Counter(a for part in parts for a in part if a in heavy)
    twice = {a for a, n in times.items() if n > 1}
    left = heavy - times.keys()
    # rebuilt from the parts' own bonds and the attachments that a phospholipid has; any other bond between parts, or to an unassigned atom, is missing
    bonds = {frozenset((a, b)) for a in heavy for b in mol.bonds[a] if b in heavy}
    inside = {b for b in bonds if any(b <= part for part in parts)}
    joints = {frozenset((bone.bridge, x)) for x in bone.carbons} | {frozenset((a.oxygen, x)) for a in (*chains, *bone.of("free")) for x in bone.carbons}
    rebuilt = inside | (joints & bonds)
    extra = bool(twice or left)
    return end(
        "unsupported_extra_substitution" if extra else "success", *(("atom_partition_incomplete", "unsupported_extra_substitution") if extra else ()),
        headgroup=head, head_tier=tier, backbone_family="glycerol", chain_count=len(chains), linkages=sorted(a.linkage for a in chains), chains=[chain_facts(mol, a) for a in chains],
        lipid_class=lipid_class, free_hydroxyls=len(free), coverage=len(times.keys() - twice) / len(heavy) if heavy else 1.0, unassigned=len(left), overlapping=len(twice),
        reconstruction_exact=rebuilt == bonds, formal_charge=sum(mol.charge[a] for a in head_atoms),
    )


SCHEMA = (
    "smiles string, parse_status string, reasons array<string>, headgroup string, head_tier int, backbone_family string, chain_count int, linkages array<string>, "
    "chains array<struct<linkage:string,position:int,carbon:int,double_bonds:int,heteroatoms:int,extra_oxygens:int,branches:int>>, lipid_class string, free_hydroxyls int, coverage double, "
    "unassigned int, overlapping int, reconstruction_exact boolean, formal_charge int"
)


def parse_structures(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """The anatomy of every distinct structure text: one row each (null is one of them).

    Spectra repeat structures many times over, so they are made distinct (combined on the map side)
    before Python sees them; join back on ``smiles`` null-safely.
    """

    def parse(columns: dict[str, list]) -> dict[str, list]:
        found = [{"smiles": s, **anatomy(s)} for s in columns["smiles"]]
        return {c: [f[c] for f in found] for c in ("smiles", *EMPTY)}

    return map_columns(df.select(F.col(smiles).cast("string").alias("smiles")).distinct(), lambda: parse, SCHEMA)


def counter_ion_split(smiles: str | None) -> dict:
    """The largest fragment of a salt and its companions: (major, minor list, n_fragments).

    The major fragment holds carbon before phosphorus before size; ties go to the first in code-point order.
    """
    parts = [x for x in (smiles or "").strip().split(".") if x]

    def rank(text: str) -> tuple:
        try:
            mol = read_smiles(text)
        except BadStructure:
            return (0, 0, 0)
        return (mol.symbol.count("C"), mol.symbol.count("P"), len(mol.symbol))

    if not parts:
        return {"major": None, "minor": [], "n_fragments": 0}
    best = min(parts, key=lambda t: (tuple(-x for x in rank(t)), t))
    rest = list(parts)
    rest.remove(best)
    return {"major": best, "minor": sorted(rest), "n_fragments": len(parts)}
