"""Option strings: counts with suffixes, identities, filter modes, identity surveys, pair selections, name lists."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from pathlib import Path

Limits = tuple[int | None, int | None]


def metric_number(text: str) -> int:
    """``10k``, ``1.5M``, ``2g``: decimal multiples."""
    m = re.fullmatch(r"\s*([0-9.eE+-]*[0-9.])\s*([A-Za-z]?)", text)
    if not m:
        raise ValueError(f"not a number: {text!r}")
    unit = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}.get(m[2].lower())
    if unit is None:
        raise ValueError(f"unknown suffix in {text!r}: use k, m or g")
    value = float(m[1]) * unit
    if value > 2**64 - 1:
        raise ValueError(f"too large: {text!r}")
    return max(0, int(value))


def identity_threshold(text: str, ani: float | None = None) -> float:
    """A fraction, a percentage over 1, or ``ani``, ``ani50``, ``ani50-2``: a surveyed median with an offset in percent."""
    if m := re.fullmatch(r"ani([^+-]*)(?:([+-])(.+))?", text.strip().lower()):
        if ani is None:
            raise ValueError("an ani threshold needs a survey of the mappings")
        if not m[2]:
            return ani
        moved = ani + (1 if m[2] == "+" else -1) * float(m[3]) / 100
        return min(1.0, moved) if m[2] == "+" else max(0.0, moved)
    value = float(text)
    return value / 100 if value > 1 else value


_UNBOUNDED = frozenset(["many", "infinity", "∞", "-1"])


def _count(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and int(text) > 0 else None


def filter_mode(text: str, dialect: str = "cli") -> Limits:
    """How many mappings to keep per query and per target position; None is no limit.

    ``cli``: ``1:1``, ``1`` or ``1:many``, ``many:1``, ``many:many``, ``M:N``, ``N`` (query only); anything else is 1:1.
    ``library``: differs where it always has: ``many:1`` limits the query axis to 1 as well, and a bare word is 1:1.
    ``spec``: ``N``, ``N:N`` and what can't be read are no limit, ``3`` and ``3:N`` limit the query.
    """
    low = text.strip().lower()
    if dialect == "spec":
        one, _, two = text.strip().partition(":")
        return _count(one), _count(two)
    sides = low.split(":")
    if dialect == "library":
        if low in ("many:many", "n:n"):
            return None, None
        if len(sides) != 2:
            return 1, 1
        q, t = (int(s) if s.isdigit() else None for s in text.split(":"))
        return (1, 1) if t == 1 and q is None else (q, t)
    if dialect != "cli":
        raise ValueError(f"no such dialect: {dialect}")
    if low in _UNBOUNDED or low == "-1:-1":
        return None, None
    if len(sides) == 2:
        return tuple(None if s in _UNBOUNDED else _count(s) for s in sides)
    if low.isdigit():
        if int(low) == 0:
            raise ValueError("0 keeps nothing; 1 keeps the best mapping")
        return int(low), None
    return 1, 1


@dataclass(frozen=True)
class Survey:
    """How to survey identity: ``all``, ``orthogonal``, or the best ``percent`` of the genome by ``order``."""

    kind: str
    percent: float = 100.0
    order: str = "identity"


def ani_method(text: str) -> Survey | None:
    low = text.lower()
    if low in ("all", "orthogonal", "1:1"):
        return Survey("orthogonal" if low == "1:1" else low)
    m = re.fullmatch(r"n([0-9.]+)(?:-(length|identity|score)(?:-.*)?)?", low)
    if not m or not 0 < float(m[1]) <= 100:
        return None
    return Survey("percentile", float(m[1]), m[2] or "identity")


@dataclass(frozen=True)
class Selection:
    """Which pairs to align: none (all of them), auto, random, giant, tree or density (left to the aligner)."""

    kind: str
    fraction: float | None = None
    near: int = 0
    far: int = 0

    def __str__(self) -> str:
        body = {"tree": f"{self.near}:{self.far}:{self.fraction:g}" if self.fraction is not None else "", "density": "auto" if self.fraction is None else f"{self.fraction:g}"}
        return self.kind if self.kind in ("none", "auto") else f"{self.kind}:{body.get(self.kind, f'{self.fraction:g}' if self.fraction is not None else '')}"

    @property
    def description(self) -> str:
        percent = None if self.fraction is None else f"{100 * self.fraction:.1f}%"
        return {
            "none": "every pair", "auto": "by the number of sequences", "random": f"a random {percent} of pairs",
            "giant": f"enough pairs to connect all with probability {self.fraction}",
            "tree": f"{self.near} nearest, {self.far} farthest and a random {percent}",
            "density": f"mapping density {percent or '10 ln n / n'}",
        }[self.kind]


def selection(text: str) -> Selection:
    def part(raw: str, closed: bool = True, zero: bool = False) -> float:
        value = float(raw)
        if not (0 < value < 1 or closed and value == 1 or zero and value == 0):
            raise ValueError(f"fraction out of range in {text!r}")
        return value

    if re.fullmatch(r"[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?", text):
        return Selection("random", part(text))
    kind, _, body = text.partition(":")
    if text in ("none", "all"):
        return Selection("none")
    if text == "auto":
        return Selection("auto")
    if kind == "random":
        return Selection("random", part(body))
    if kind in ("giant", "connectivity"):
        return Selection("giant", part(body, closed=False))
    if kind in ("tree", "knn") and len(bits := body.split(":")) <= 3:
        near, far = int(bits[0]), int(bits[1]) if len(bits) > 1 else 0
        if near < 0 or far < 0 or near + far == 0:
            raise ValueError(f"a tree needs near or far neighbours: {text!r}")
        return Selection("tree", part(bits[2], zero=True) if len(bits) > 2 else 0.0, near, far)
    if kind == "density":
        return Selection("density", None if body == "auto" else part(body))
    raise ValueError(f"no such pair selection: {text!r}")


def names_list(text: str) -> list[str]:
    """``a,b,c`` or ``@file`` with one name a line; blanks and ``#`` lines are skipped."""
    raw = Path(text[1:]).read_text().splitlines() if text.startswith("@") else text.split(",")
    return [x for x in map(str.strip, raw) if x and not x.startswith("#")]


def round_nice(value: int) -> int:
    """The nearest multiple of 50, 100, 200 or 500, by size, and one step at least unless it is 0."""
    if value == 0:
        return 0
    step = 50 if value <= 500 else 100 if value <= 1000 else 200 if value <= 3000 else 500
    return max(step, (value + step // 2) // step * step)


def clamp_scaffolds(gap: int, length: int, mean_length: int | None, adaptive: bool = True) -> tuple[int, int]:
    """Scaffold gap and least length for sequences of this mean length: ten times it, and three fifths of it, at most."""
    if not adaptive or not mean_length:
        return gap, length
    return min(gap, 10 * mean_length), round_nice(min(length, mean_length * 3 // 5))


def kmer_frequency(explicit: int | None, multiplier: int, haplotypes: int) -> int:
    return explicit if explicit is not None else haplotypes * max(1, multiplier)


#: Edge probabilities for graphs of 2 to 5 nodes (fixed values); 6 to 10 nodes take 0.5.
SMALL_GRAPHS = {2: 1.0, 3: 0.8, 4: 0.7, 5: 0.6}


def connectivity_probability(n: int, probability: float) -> float:
    """The edge probability at which a random graph of n nodes is connected with ``probability``: (ln n - ln(-ln x)) / n."""
    if n <= 1:
        return 1.0
    if n <= 10:
        return SMALL_GRAPHS.get(n, 0.5)
    x = min(0.999, max(0.001, probability))
    return min(1.0, max(0.001, (math.log(n) - math.log(-math.log(x))) / n))


def auto_density(n: int) -> float | None:
    """10 ln n / n, None where that keeps all."""
    if n <= 1 or (d := 10 * math.log(n) / n) >= 1:
        return None
    return d


def tree_pair_estimate(n: int, near: int, far: int, fraction: float) -> int:
    every = n * (n - 1) // 2
    return min(every, n * min(near, max(0, n - 1)) + n * min(far, max(0, n - 1)) + math.floor(every * fraction + 0.5))


def bytes_text(n: float, base: int = 1000) -> str:
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    k = 0
    while n >= base and k < len(units) - 1:
        n, k = n / base, k + 1
    return f"{n:.0f} B" if k == 0 else f"{n:.2f} {units[k]}"


def count_text(n: int) -> str:
    return f"{n:,}"


def signed_text(n: int) -> str:
    return f"{n:+,}"


def batch_bases(budget_bytes: int, bytes_per_base: float = 12.0, fixed_bytes: float = 0.1e9) -> int:
    """The bases of a batch whose working files fit a disk budget, by the model fixed + bytes_per_base * bases."""
    return max(0, int((budget_bytes - fixed_bytes) / bytes_per_base))


def peak_disk(batch_bases_: int, bytes_per_base: float = 12.0, fixed_bytes: float = 0.1e9) -> int:
    return int(fixed_bytes + bytes_per_base * batch_bases_)
