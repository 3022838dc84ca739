"""Quantities in free text: numbers, and unit strings segmented by dynamic programming over tries.

A unit string is cut into prefix, root and exponent (times, over, next factor ...). Cuts are scored (letters of another
case cost, long names are worth more); at each place of the string, the best cut is kept for every product of factors
that leads to it, so the work is in proportion to the string, however many cuts there are. What stays ambiguous -
"1,219" is 1219 or 1.219, "m" is milli or metre - is decided by the prior of the field: how usual is this value for a
cutoff, a smearing?
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass

# Factors of prefixes.
PREFIXES = {"": 1.0, "k": 1e3, "kilo": 1e3, "kilo-": 1e3, "千": 1e3, "M": 1e6, "mega": 1e6, "G": 1e9, "m": 1e-3, "milli": 1e-3, "milli-": 1e-3, "毫": 1e-3, "µ": 1e-6, "μ": 1e-6, "micro": 1e-6, "n": 1e-9, "nano": 1e-9}
SHORT = {1.0: "", 1e3: "k", 1e6: "M", 1e9: "G", 1e-3: "m", 1e-6: "μ", 1e-9: "n"}
# Names of unit roots; each has a dimension and its size in eV, where it is an energy.
ROOTS = {
    "eV": ("eV", "energy", 1.0), "electron volts": ("eV", "energy", 1.0), "electron volt": ("eV", "energy", 1.0), "electronvolts": ("eV", "energy", 1.0), "electronvolt": ("eV", "energy", 1.0), "electron-volts": ("eV", "energy", 1.0), "电子伏特": ("eV", "energy", 1.0), "电子伏": ("eV", "energy", 1.0),
    "Ry": ("Ry", "energy", 13.605693122994), "Ryd": ("Ry", "energy", 13.605693122994), "Rydberg": ("Ry", "energy", 13.605693122994), "Rydbergs": ("Ry", "energy", 13.605693122994), "里德伯": ("Ry", "energy", 13.605693122994),
    "Ha": ("Ha", "energy", 27.211386245988), "Hartree": ("Ha", "energy", 27.211386245988), "Hartrees": ("Ha", "energy", 27.211386245988), "Hartree atomic units": ("Ha", "energy", 27.211386245988), "atomic units": ("Ha", "energy", 27.211386245988), "E_h": ("Ha", "energy", 27.211386245988), "Eh": ("Ha", "energy", 27.211386245988), "a.u.": ("Ha", "energy", 27.211386245988), "哈特里": ("Ha", "energy", 27.211386245988),
    "J": ("J", "energy", 6.241509074460763e18), "joule": ("J", "energy", 6.241509074460763e18), "joules": ("J", "energy", 6.241509074460763e18), "焦耳": ("J", "energy", 6.241509074460763e18), "cal": ("cal", "energy", 4.184 * 6.241509074460763e18),
    "K": ("K", "temperature", 8.617333262145179e-5), "kelvin": ("K", "temperature", 8.617333262145179e-5), "kelvins": ("K", "temperature", 8.617333262145179e-5), "开尔文": ("K", "temperature", 8.617333262145179e-5),
    "mol": ("mol", "amount", 6.02214076e23), "mole": ("mol", "amount", 6.02214076e23), "cm": ("cm", "length", 1.239841984332e-4), "m": ("m", "length", 1.239841984332e-6),
    "atom": ("each", "count", 1.0), "cell": ("each", "count", 1.0), "formula unit": ("each", "count", 1.0), "atoms": ("each", "count", 1.0), "f.u.": ("each", "count", 1.0), "unit cell": ("each", "count", 1.0),
}
# How usual a value is for a field: mean and spread of log10 of the value in eV.
PRIORS = {"cutoff_energy": (2.7, 0.45), "smearing": (-1.2, 0.8), "convergence_criteria.energy": (-5.0, 2.5)}

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_EXPONENT = re.compile(r"\s?(?:\^\s?\{?\s?|\*\*)?([-−⁻+]?[0-9⁰¹²³⁴⁵⁶⁷⁸⁹])\}?")
_LINK = re.compile(r"\s*(/|·|\*|⋅|\bper\b|\s)\s*", re.I)
_ONE_OVER = re.compile(r"\s*1\s?/\s?")
_TIMES_TEN = r"(?:\s?[×x*·⋅]\s?10\s?(?:\^\s?\{?\s?[-−+]?\d+\s?\}?|\*\*\s?[-−+]?\d+|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))"
_NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"10(?:\^\s?\{?\s?[-−+]?\d+\s?\}?|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)"
    r"|(?:\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+[.,]\d+|\.\d+|\d+)(?:[eEdD][-−+]?\d+(?!\d)|" + _TIMES_TEN + r")?"
    r")"
)
_COUNTED = re.compile(r"\s*(?:st|nd|rd|th)?\s*(?:heaviest|species|cycles?|steps?|iterations?|atoms\b|orders?\b|times\b|k-?points?|bands?)", re.I)
_ORDINAL = re.compile(r"(?:order|阶|over|last|version|step|no\.?|the|n\s*=)\s*$", re.I)


def _trie(names) -> dict:
    root: dict = {}
    for name in names:
        node = root
        for c in name.lower():
            node = node.setdefault(c, {})
        node.setdefault("", []).append(name)
    return root


_PREFIX_TRIE, _ROOT_TRIE = _trie([p for p in PREFIXES if p]), _trie(ROOTS)


def _walk(trie: dict, text: str, low: str, at: int):
    """All names of the trie that begin at `at`, with their end and what letters of another case cost."""
    node, i = trie, at
    while i < len(low) and low[i] in node:
        node = node[low[i]]
        i += 1
        for name in node.get("", ()):
            yield name, i, sum(a != b for a, b in zip(text[at:i], name))


@dataclass(frozen=True)
class Unit:
    name: str
    ev: float
    score: float
    end: int


@dataclass(frozen=True)
class Quantity:
    value: float
    unit: str | None
    ev: float | None
    raw: str


@dataclass(frozen=True)
class Product:
    """What a chain of factors has made so far: at most one energy, heat or wave number, at most one per mole, counts left out."""

    kind: str = ""
    root: str = ""
    factor: float = 1.0
    molar: bool = False

    def times(self, factor: float, root: str, exponent: int) -> Product | None:
        """With one more factor, or None if that can't become a unit of energy."""
        kind = ROOTS[root][1]
        if kind == "count":
            return self if exponent == -1 else None
        if kind == "amount":
            return Product(self.kind, self.root, self.factor, True) if exponent == -1 and factor == 1 and not self.molar else None
        if self.kind or exponent != (-1 if kind == "length" else 1):
            return None
        return Product(kind, root, factor, self.molar)

    def unit(self) -> tuple[str, float] | None:
        """(name, size in eV) of a finished product."""
        if not self.kind or self.molar and self.kind != "energy":
            return None
        base, _, size = ROOTS[self.root]
        if self.kind == "length":
            return f"{SHORT[self.factor]}{base}-1", size / self.factor
        name, size = SHORT[self.factor] + base, size * self.factor
        return (f"{name}/mol", size / ROOTS["mol"][2]) if self.molar else (name, size)


def segment_unit(text: str, begin: int = 0, low: str | None = None) -> list[Unit]:
    """Every unit of energy that begins at `begin`, blanks left out, best first; `low` is the text in small letters, character by character."""
    low = lowered(text) if low is None else low
    at = begin
    while at < len(text) and text[at].isspace():
        at += 1
    states: dict[tuple[int, int], dict[Product, float]] = {(at, 1): {Product(): 0.0}}
    if m := _ONE_OVER.match(text, begin):
        states[(m.end(), -1)] = {Product(): 0.0}
    best: dict[str, Unit] = {}
    agenda = sorted(states)
    while agenda:  # places only grow
        at, sign = heapq.heappop(agenda)
        for product, score in states.pop((at, sign)).items():
            for prefix, i, off in [("", at, 0), *_walk(_PREFIX_TRIE, text, low, at)]:
                for root, j, off2 in _walk(_ROOT_TRIE, text, low, i):
                    if prefix and ROOTS[root][1] == "count" or off and len(prefix) == 1:
                        continue  # the case of a one-letter prefix tells milli from mega
                    gain = len(root) + 0.5 * len(prefix) - 0.6 * off2 - 0.6 * off
                    ends = [(j, 1)]
                    if m := _EXPONENT.match(text, j):
                        ends.append((m.end(), int(m.group(1).replace("−", "-").translate(_SUPER))))
                    for end, exponent in ends:
                        if end < len(text) and text[end].isalpha() and text[end - 1].isalpha() and text[end].isascii() and text[end - 1].isascii():
                            continue  # in the middle of a word
                        made = product.times(PREFIXES[prefix], root, sign * exponent)
                        if made is None:
                            continue
                        total = score + gain + (0.5 if exponent != 1 else 0)
                        if (got := made.unit()) and (got[0] not in best or (total, end) > (best[got[0]].score, best[got[0]].end)):
                            best[got[0]] = Unit(*got, total, end)
                        if m := _LINK.match(text, end):
                            follow = (m.end(), -1 if m.group(1).lower() in ("/", "per") else 1)
                            if follow not in states:
                                heapq.heappush(agenda, follow)
                                states[follow] = {}
                            if total > states[follow].get(made, -math.inf):
                                states[follow][made] = total
    return sorted(best.values(), key=lambda u: (-u.score, u.name))


def lowered(text: str) -> str:
    """In small letters, with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _readings(raw: str) -> list[float]:
    """The values that a written number may have."""
    s = raw.replace(" ", "").replace("−", "-")
    m = re.match(r"([\d.,]*?)(?:[×x*·⋅]?10(?:\^|\*\*)?\{?([-+]?\d+|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)\}?)$", s) if re.search(r"10(\^|\*\*|[⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹])", s) else None
    if m:
        head, power = m.group(1) or "1", int(m.group(2).translate(_SUPER))
    else:
        m = re.match(r"([\d.,]+)(?:[eEdD]([-+]?\d+))?$", s)
        if not m:
            return []
        head, power = m.group(1), int(m.group(2) or 0)
    forms = [head]
    if "," in head:
        forms = []
        if re.fullmatch(r"[1-9]\d{0,2}(,\d{3})+(\.\d+)?", head):
            forms.append(head.replace(",", ""))
        if head.count(",") == 1 and "." not in head:
            forms.append(head.replace(",", "."))
    out = []
    for f in forms:
        try:
            out.append(float(f"{f}e{power}"))
        except (ValueError, OverflowError):
            continue
    return out


def _prior(field: str, ev: float) -> float:
    mean, spread = PRIORS.get(field, (0.0, 4.0))
    return -0.5 * ((math.log10(ev) - mean) / spread) ** 2 if ev > 0 and math.isfinite(ev) else -1e9


def note_unit(note: str | None) -> Unit | None:
    """The unit that a note states for the whole record."""
    if not note:
        return None
    m = re.search(r"(?:energ(?:y|ies)\b[^.\n]*?(?:unit[^.\n]*?:|quoted in|given in|are in|in units of|\()|能量单位\s*[:：])\s*(.+)", note, re.I)
    units = segment_unit(m.group(1)) if m else []
    return units[0] if units else None


def quantities(text: str | None, field: str, note: str | None = None) -> list[Quantity]:
    """All values that the text states, with unit and in eV; unit and ev are None where no unit is stated anywhere."""
    if not text:
        return []
    whole = note_unit(note)
    low, found = lowered(text), []
    for m in _NUMBER.finditer(text):
        before = text[max(0, m.start() - 16) : m.start()]  # as long as the words that make an ordinal
        if found and m.start() < found[-1][3] or _COUNTED.match(text, m.end()) or _ORDINAL.search(before):
            continue  # part of a unit such as 1/cm or mol-1, or a count
        if before.rstrip().endswith("^") or re.search(r"[A-Za-z_]$", before):
            continue
        values = _readings(m.group())
        units = segment_unit(text, m.end(), low)
        # a number with its unit ends where the unit ends
        end = units[0].end if units else m.end()
        found.append((values, units, m.group(), end, m.start()))
    out = []
    for n, (values, units, raw, end, start) in enumerate(found):
        if not units and n + 1 < len(found):  # "7.8 to 31.2 Ha": the unit follows the last number
            between = text[end : found[n + 1][4]]
            if re.fullmatch(r"\s*(?:to|[-–—~～/]|and|至|到|or|,)\s*", between, re.I):
                units = found[n + 1][1]
        cands = units or ([whole] if whole else [])
        if not values:
            continue
        if not cands:
            out.append(Quantity(values[0], None, None, raw))
            continue
        scored = [(u.score + _prior(field, v * u.ev), -i, v, u) for u in cands for i, v in enumerate(values)]
        _, _, v, u = max(scored, key=lambda x: x[:2])
        out.append(Quantity(v, u.name, v * u.ev, raw))
    return out
