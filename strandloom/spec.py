"""What a filter, a trim or a statistics run is asked for.

None stands for an option that isn't set.  Quality thresholds are on the Phred
scale; ``phred_base`` (33 or 64) is what characters are above it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Offsets of the quality encodings.
PHRED_BASES = {"phred33": 33, "phred64": 64}


def phred_base(encoding: str) -> int:
    if encoding not in PHRED_BASES:
        raise ValueError(f"unknown quality encoding {encoding!r}: {' or '.join(PHRED_BASES)}")
    return PHRED_BASES[encoding]


def parse_range(text: str) -> tuple[int | None, int | None]:
    """``a,b``, ``a,``, ``a``, ``,b`` or ``,``; -1 means unset.

    Raises ValueError for other negative numbers, for what isn't a whole number
    and for a minimum above the maximum.
    """
    low, _, high = text.partition(",")

    def bound(part: str) -> int | None:
        if not part.strip():
            return None
        n = int(part)
        if n < -1:
            raise ValueError(f"{n} in range {text!r} is negative")
        return None if n == -1 else n

    found = bound(low), bound(high)
    if None not in found and found[0] > found[1]:
        raise ValueError(f"range {text!r}: the minimum is above the maximum")
    return found


def _given(*bounds: int | None) -> bool:
    return any(b is not None for b in bounds)


@dataclass(frozen=True)
class TrimSpec:
    """Ends to cut off where their mean quality is out of range."""

    left_length: int | None = None
    min_left_quality: int | None = None
    max_left_quality: int | None = None
    right_length: int | None = None
    min_right_quality: int | None = None
    max_right_quality: int | None = None
    phred_base: int = 33

    def trims_left(self) -> bool:
        return bool(self.left_length) and _given(self.min_left_quality, self.max_left_quality)

    def trims_right(self) -> bool:
        return bool(self.right_length) and _given(self.min_right_quality, self.max_right_quality)

    def require(self) -> TrimSpec:
        if not (self.trims_left() or self.trims_right()):
            raise ValueError("nothing to edit: give a length and a quality range for an end")
        return self


@dataclass(frozen=True)
class FilterSpec:
    """Thresholds of the read predicates."""

    min_length: int | None = None
    max_length: int | None = None
    min_quality: int | None = None
    max_quality: int | None = None
    max_out_of_quality: int | None = None
    left_length: int | None = None
    min_left_quality: int | None = None
    max_left_quality: int | None = None
    right_length: int | None = None
    min_right_quality: int | None = None
    max_right_quality: int | None = None
    max_n: int | None = None
    quality_start: int | None = None
    quality_end: int | None = None
    phred_base: int = 33

    @classmethod
    def legacy(cls) -> FilterSpec:
        return cls(min_length=50, max_length=200, min_quality=20, max_quality=60, max_out_of_quality=3, max_n=0)

    def with_outer_bases(self, left: int | None = None, right: int | None = None) -> FilterSpec:
        """The outer ``left`` and ``right`` bases must have the quality asked for of
        the read.  Neither may be longer than a quarter of the shortest read."""
        n = {side: x for side, x in (("left", left), ("right", right)) if x}
        if n and self.min_length is None or any(x > (self.min_length or 0) // 4 for x in n.values()):
            raise ValueError("an end is longer than a quarter of the shortest read")
        if n and not self.has_quality():
            raise ValueError("the outer bases need a quality range")
        ends = {f"{side}_length": x for side, x in n.items()}
        ends |= {f"{m}_{side}_quality": getattr(self, f"{m}_quality") for side in n for m in ("min", "max")}
        return replace(self, **ends)

    def has_quality(self) -> bool:
        return _given(self.min_quality, self.max_quality)

    def is_effective(self) -> bool:
        """Whether any predicate can fail a read: an end counts only with its
        length and a range, the count of bases out of range only with a range."""
        return (
            _given(self.min_length, self.max_length, self.max_n)
            or self.has_quality()
            or self.left_length is not None and _given(self.min_left_quality, self.max_left_quality)
            or self.right_length is not None and _given(self.min_right_quality, self.max_right_quality)
        )

    def require(self) -> FilterSpec:
        if not self.is_effective():
            raise ValueError("nothing to filter")
        return self

    def without_ends(self) -> FilterSpec:
        ends = ("left_length", "min_left_quality", "max_left_quality", "right_length", "min_right_quality", "max_right_quality")
        return replace(self, **dict.fromkeys(ends))


@dataclass(frozen=True)
class StatsSpec:
    filter: FilterSpec = FilterSpec()
    kmers: bool = False
    k: int = 5
    phred_base: int = 33
    report_compat: bool = False
